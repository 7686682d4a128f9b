"""Each operator against brute force over messy small tables: nulls, empty and long texts, ties, repeated rows, clashing names, no rows."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bloom, exact_dedup, fingerprint, language_id, mixing, near_join, packing, substring, toxicity, url_filter, warc
from graphloom.llm.common import WORD

DOCS = "doc_id long, text string, source string, lang string, `key` string, row int, size double, score string"
W = re.compile(WORD)


def make(spark, rows):
    """doc_id, text, source, lang; and columns with the names that operators use inside."""
    return spark.createDataFrame([(*r, "k", 7, 0.5, "s") for r in rows], DOCS).repartition(3)


def messy():
    random.seed(5)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(random.choice(vocab) for _ in range(n))
    base, passage = text(120), text(60)
    near = base.split()
    near[60] = "changed"
    rows = [(1, base, "a", "en"), (2, base, "a", "en"), (3, " ".join(near), "b", "en"), (4, None, None, None), (5, "", "b", "en"), (6, " \t\n ", "b", None), (7, "one", "a", "en")]
    rows += [(8, text(30) + " " + passage + " " + text(10), "a", "en"), (9, passage + " " + text(25), "b", "en"), (10, "x " * 500, "c", "en"), (11, text(9000), "c", "en"), (12, "Ünïcödé  \u2003 \x1c text 日本", "c", "en")]
    rows += [(None, text(40), None, "en"), (None, base, "a", "en"), (7, "one", "a", "en"), (20, base.replace(" ", "\n", 5), "a", "en"), (21, base + "\u00a0", "a", "en")]
    return rows + [(100 + i, text(random.randrange(1, 50)), random.choice("abc"), "en") for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, messy()).cache()


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


def words(t):
    return W.findall(t or "")


# 1


def verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, default))
    return host, path, best[1], best[2]


def test_urls_match_brute_force(spark):
    urls = ["http://a.NET/x", "https://www.example.net/en/1?q#f", "http://example.net/en", "http://xexample.com/de/", "http://x.example.com/de/a", "ftp://q.org/fr/", "no scheme", None, "", "http://", "http://a.b.net", "http://a..net/", "HTTP://É.org/fr/é", "http://net/", "http://h/p://net/", "http://a.net?/", "x://" + "a." * 300 + "net/" + "p" * 5000]
    pages = spark.createDataFrame([(i if i % 5 else None, u, "host") for i, u in enumerate(urls * 2)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = [tuple(r) for r in url_filter.judge_urls(pages, rules).collect()]
    want = [(i if i % 5 else None, *verdict(u, url_filter.RULES)) for i, u in enumerate(urls * 2)]
    assert collections.Counter(got) == collections.Counter(want)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert url_filter.judge_urls(pages, rules.limit(0)).where("verdict = 'block'").count() == 0


def test_exact_entries_and_a_full_filter_change_nothing(spark):
    listed = spark.createDataFrame([("h.com", f"/{i}", "block", True) for i in range(3000)], "host string, path string, verdict string, exact boolean")
    pages = spark.createDataFrame([(i, f"http://h.com/{i}") for i in range(2900, 3100)] + [(1, "http://www.h.com/1"), (2, "http://h.com/1/")], "page_id long, url string")
    for size in (1 << 20, 64):  # 64 bytes: the filter lets all through
        got = url_filter.judge_urls(pages, listed, max_bytes=size)
        assert got.where("verdict = 'block'").count() == 100


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("h"))
    h = np.array([r.h for r in keys.collect()], np.int64).view(np.uint64)
    bits = bloom.build(keys, "h", 2000)
    assert bloom.probe(bits, h).all() and bloom.probe(bits, h ^ np.uint64(0xABCDEF0123456789)).mean() < 0.02


# 2


def test_mix_meets_targets(docs, none):
    rows, sizes, per = mixing.mix(docs).collect(), {}, collections.Counter()
    for i, t, s, _ in messy():
        per[s] += len(words(t))
    names = sorted((s for s in per if s is not None)) + ([None] if None in per else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(per.values())
    while True:
        t = (total - sum(2 * per[s] for s in full)) / sum(w[s] for s in names if s not in full)
        new = {s for s in names if s not in full and w[s] * t > 2 * per[s]}
        if not new:
            break
        full |= new
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == per[r.source] and abs(r.target - (2 * per[r.source] if r.source in full else w[r.source] * t)) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        sizes[r.source] = max(sizes.get(r.source, 0), r.size)
    assert len(rows) == len(messy()) and all(abs(taken[s] - (2 * per[s] if s in full else w[s] * t)) <= sizes[s] / 2 + 1 for s in names)
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, rows), key=str) == sorted(map(key, mixing.mix(docs.repartition(5)).collect()), key=str)
    assert mixing.mix(none).count() == 0


def test_mix_slices_give_the_same_order(docs, monkeypatch):
    one = {(r.doc_id, r.size, r.taken) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "SLICE_ROWS", 7)
    assert {(r.doc_id, r.size, r.taken) for r in mixing.mix(docs).collect()} == one


@pytest.mark.parametrize("slices", [2000, 3])
def test_copies_are_those_of_the_mix(spark, docs, none, monkeypatch, slices):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slices)
    monkeypatch.setattr(mixing, "BLOCK_SLICES", 2)
    count = lambda rows: collections.Counter((r.doc_id, r.source, r.copies) for r in rows)
    whole = lambda d: mixing.copies(d).select("doc.doc_id", "doc.source", "copies").collect()
    assert count(whole(docs)) == count(mixing.mix(docs).collect()) and mixing.copies(none).count() == 0
    same = make(spark, [(1, "a b c", "a", "en")] * 41 + [(2, "d", "b", "en"), (3, None, "b", None)])  # the last key is one of repeated rows
    got, want = count(whole(same)), count(mixing.mix(same).collect())
    assert got == want and len([k for k in want if k[1] == "a"]) == 2


# 3


def test_transducers_compose():
    g = toxicity.grammar()

    def run(*classes):
        q, out = 0, []
        for c in classes:
            out.append(int(g.out[q, c]))
            q = g.next[q, c]
        return [o for o in out if o]

    t = toxicity
    plain = 1 + t.HITS.index(t.INSULT) * 8
    assert run(t.INSULT) == [plain] and run(t.TARGET, t.INSULT) == [plain + 1] and run(t.INSULT, t.TARGET) == [plain, 25]
    assert run(t.NEGATION, t.OTHER, t.INSULT) == [plain + 2] and run(t.NEGATION, *[t.OTHER] * 4, t.INSULT) == [plain]
    assert run(t.REPORT, *[t.OTHER] * 6, t.INSULT) == [plain + 4]


def test_toxicity_learns_and_is_whole(spark):
    random.seed(2)
    vocab = [f"wort{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        t = [random.choice(vocab) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            t[35], t[38] = random.choice(["idiot,", "zurgan", "zurgeb."]), "zurgik"
        rows.append((i, " ".join(t), "a", "en"))
        labels.append((i, int(bad)))
    d, l = make(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    terms, w = toxicity.learn(d, l.where(~language_id.held_out(0, 5)))
    s = {r.doc_id: r.score for r in toxicity.score(d, terms, w).collect()}
    assert np.mean([(s[i] >= 0.5) == bool(y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]) > 0.95
    far = make(spark, [(1, "wort1 " * 30000 + "zurgan zurgik idiot", "a", "en"), (2, None, "a", None), (3, "", "a", None), (3, "", "a", None)])
    s = [(r.doc_id, r.score) for r in toxicity.score(far, terms, w).collect()]
    assert len(s) == 4 and dict(s)[1] >= 0.5 and dict(s)[2] == dict(s)[3] < 0.5
    terms, w = toxicity.learn(make(spark, []), l.limit(0))
    assert {r.doc_id: r.score >= 0.5 for r in toxicity.score(make(spark, [(1, "you are a stupid idiot", "a", "en"), (2, "they said he is not stupid", "a", "en")]), terms, w).collect()} == {1: True, 2: False}


def plain_features(text, terms):
    """By definition: for each clause, the patterns of its hits and whether a target follows one."""
    t, kinds = toxicity, {w: k for k, ws in toxicity.LEXICON.items() for w in ws.split()}
    out, clause, raw = [0] * (t.PATTERNS + 1), [], text.split()
    out[-1] = len(raw)
    for j, r in enumerate(raw):
        w = r.strip(t.STRIP).lower()
        clause.append(kinds.get(w, t.LEARNED if w in terms or any(len(w) >= n and w[:n] + "*" in terms for n in t.PREFIXES) else t.OTHER))
        if r[-1] in t.ENDS or j == len(raw) - 1:
            seen = set()
            for i, k in enumerate(clause):
                before = clause[:i]
                if k in t.HITS:
                    negated, reported, aimed = t.NEGATION in before[-t.REACH :], t.REPORT in before, t.TARGET in before
                    seen.add(t.HITS.index(k) * 8 + reported * 4 + negated * 2 + aimed)
                if k == t.TARGET and any(h in before for h in t.HITS):
                    seen.add(24)
            for o in seen:
                out[o] += 1
            clause = []
    return out


def test_grammar_matches_its_definition():
    rng, terms = random.Random(6), frozenset({"zurgan", "bluk*"})
    pool = ["idiot", "Idiot!", "dumm", "kill", "you", "dich", "not", "nicht", "said", "selon", "zurgan", "blukert", "a", "b.", "c,", "word;", "..", "estúpido", "pas", "matar?"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    x = toxicity.features(texts, toxicity.Words(terms), toxicity.grammar())
    assert x.tolist() == [plain_features(t, terms) for t in texts]


def test_scores_follow_from_the_definition(spark):
    rng = random.Random(9)
    pool = ["idiot", "you", "not", "said", "word", "other.", "kill", "trash,", "tu", "crétin"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(i % 40)), "s", "en") for i in range(120)]
    w, got = toxicity.prior(), None
    got = {r.doc_id: r.score for r in toxicity.score(make(spark, rows), frozenset(), w).collect()}
    for i, t, *_ in rows:
        x = np.array(plain_features(t, ()), float)
        hits = x[[0, 1, 8, 9, 16, 17]].sum()
        m = w[:25] @ np.log1p(x[:25]) + w[25] * np.log1p(hits) + w[26] * (hits > 1) + w[27] * np.log1p(hits) * np.log1p(x[-1]) / 10 + w[28]
        assert abs(got[i] - 1 / (1 + np.exp(-m))) < 1e-9


def test_patterns_and_not_words_carry_the_result(spark):
    """Fitted on the tables: direct insults are toxic in four languages, the same words negated or reported are not."""
    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    terms, w = toxicity.trained(spark, data)
    direct = ["You are a stupid idiot. You trash.", "Du bist ein Trottel. Ihr seid Abschaum, widerlich.", "Tu es un crétin. Vous êtes minable, ordure.", "Tú eres un imbécil. Usted es escoria y basura."]
    soft = ["He said you are a stupid idiot. They said trash.", "Er sagte du bist ein Trottel. Laut Bericht ihr seid Abschaum, widerlich.", "Il disait tu es un crétin. Selon lui vous êtes minable, ordure.", "Dijo que tú eres un imbécil. Según él usted es escoria y basura.", "You are not stupid. You are never pathetic.", "Du bist kein Trottel. Ihr seid nicht widerlich."]
    s = toxicity.score(make(spark, [(i, t, "s", None) for i, t in enumerate(direct + soft)]), terms, w).collect()
    s = {r.doc_id: r.score for r in s}
    assert all(s[i] >= 0.5 for i in range(4)) and all(s[i] < 0.5 for i in range(4, len(s))), s


# 4


def brute_repeats(rows):
    seen, out = {}, {}
    order = sorted({(i, t or "") for i, t, *_ in rows}, key=lambda r: (r[0] is None, r[0], r[1]))
    for i, t in order:
        w = words(t)
        c = [False] * len(w)
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if k in seen:
                c[j : j + 20] = [True] * 20
            seen.setdefault(k, (i, j))
        out[i, t] = [a for a, b in zip(w, c, strict=True) if not b]
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_substrings_match_brute_force(docs, none, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARD", 10)
    monkeypatch.setattr(substring, "TASK", 40)
    rows = [r for r in messy() if r[0] is not None]
    want = brute_repeats(rows)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.drop_repeats(docs.where("doc_id is not null")).collect())
    assert got == collections.Counter((i, len(words(t)), len(words(t)) - len(want[i, t or ""]), " ".join(want[i, t or ""])) for i, t, *_ in rows)
    assert substring.drop_repeats(none).count() == 0 and substring.drop_repeats(docs).count() == len(messy())


def test_segments_hold_each_window_once():
    rng = np.random.default_rng(3)
    vocabulary = [b"a", b"bb", "é😀".encode(), b"q" * 8, b"q" * 9, b"y" * 64, b"y" * 65, b"\x00", b"\xc2\xa0"]
    texts = [b"".join(vocabulary[rng.integers(9)] + [b" ", b"\n", b" \t", b"\x0b"][rng.integers(4)] for _ in range(n)) for n in (0, 1, 19, 20, 21, 40, 300, 0, 5, 300)]
    joined, found, gram_of = b"\n".join(texts), collections.Counter(), {}
    for gram, i, start, n, a, z in zip(*(x.tolist() for x in substring.segments(texts)), strict=True):
        w = joined[a:z].split()
        assert w == texts[i].split()[start : start + n]
        for j in range(n - 19):
            found[i, start + j] += 1
            assert gram_of.setdefault(tuple(w[j : j + 20]), gram) == gram
    assert found == collections.Counter((i, j) for i, t in enumerate(texts) for j in range(len(t.split()) - 19))
    assert all(len(x) == 0 for none in ([], [b""], [b"", b"a"]) for x in substring.segments(none))


def test_fm_index_intervals():
    rng = np.random.default_rng(0)
    text = np.r_[rng.integers(1, 4, 300), 0, rng.integers(1, 4, 200), 0]
    text[100:140] = text[20:60]
    fm, gram = substring.FMIndex.build(text)
    at = np.array([i for i in range(len(text) - 20) if 0 not in text[i : i + 20]])
    lo, hi = fm.search(substring.windows_of(gram, at))
    for i, a, z in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
        same = [j for j in at.tolist() if (text[j : j + 20] == text[i : i + 20]).all()]
        assert (z - a == len(same) and fm.earliest(np.array([a]))[0] == min(same)) if len(same) > 1 else z - a <= 1


def test_fm_index_is_compressed():
    rng = np.random.default_rng(2)
    text = np.r_[rng.zipf(1.3, 100_000) % 5000 + 1, 0]
    assert substring.FMIndex.build(text)[0].nbytes() < 12 * len(text)
    bits = rng.random(200_000) < 0.3
    at = np.array([0, 1, 63, 64, 65_535, 65_536, 131_072, 199_999, 200_000])
    assert substring.Bits(bits).rank(at).tolist() == [int(bits[:i].sum()) for i in at]


# 5


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", big, "x"), (5, None, big, "x"), (3, "http://c", big, "x"), (None, "http://d", big, "x"), (7, "u", "small", "x"), (8, "u", "small", "x"), (9, "u", None, "x"), (9, "u", None, "x"), (10, "u", "z" * 300000, "x")], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "w")
    warc.write_archive(pages, path)
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(spark, path).collect())
    want = collections.Counter()
    for r in pages.collect():
        b = (r.html or "").encode()
        again = r.html == big and r.page_id != 5
        want[r.page_id, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 5 if again else None] += 1
    assert got == want and spark.read.parquet(path + "/payloads").count() == 4
    data = b"".join(bytes(r.record) for r in warc.records(spark, path).collect())
    lines = data.decode().split("\r\n")
    ids = [x.split(": ", 1)[1] for x in lines if x.startswith("WARC-Record-ID: ")]
    referred = [x.split(": ", 1)[1] for x in lines if x.startswith("WARC-Refers-To: ")]
    responses = {i for i, kind in zip(ids, (x for x in lines if x.startswith("WARC-Type: ")), strict=True) if kind.endswith("response")}
    assert len(referred) == 3 and set(referred) <= responses and len(set(ids)) == 8  # one row is repeated
    assert {r.url for r in spark.read.parquet(path + "/headers").collect()} == {r.url for r in pages.collect()}
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.warc").write_bytes(data)
    back = warc.read_warc(spark, str(tmp_path / "f")).collect()
    assert len(back) == 9 and sum(len(r.payload) for r in back) == len(big.encode()) + 10 + 300000
    assert all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest.removeprefix("sha1:") for r in back if r.record_type == "response")
    warc.write_archive(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


# 6


def brute_links(rows):
    s = []
    for _, t, *_ in rows:
        w = words(t)
        s.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    n, parent = len(rows), list(range(len(rows)))
    links = [0] * n

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if s[i] == s[j] or (s[i] | s[j] and 10 * len(s[i] & s[j]) >= 8 * len(s[i] | s[j])):
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = collections.defaultdict(list)
    for i in range(n):
        groups[root(i)].append(i)
    first = {i: min((rows[j][0] for j in g if rows[j][0] is not None), default=None) for g in groups.values() for i in g}
    return collections.Counter((rows[i][0], first[i], links[i]) for i in range(n)), len(groups)


@pytest.mark.parametrize("tile", [2048, 3])
def test_near_join_matches_brute_force(spark, docs, none, monkeypatch, tile):
    monkeypatch.setattr(near_join, "TILE", tile)
    random.seed(8)
    rows = messy()
    base = rows[0][1].split()
    for i in range(12):
        w = list(base)
        for _ in range(i % 5):
            w[random.randrange(len(w))] = f"e{i}"
        rows.append((300 + i, " ".join(w), "a", "en"))
    want, groups = brute_links(rows)
    got = near_join.near_join(make(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
    assert sum(r.kept for r in got) == groups
    assert near_join.near_join(none).count() == 0


def test_repeated_rows_send_one_text(spark):
    a, b = " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(1, 101))
    got = near_join.near_join(make(spark, [(1, a, "s", "en"), (2, b, "s", "en")] * 60)).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(1, 1, 119), (2, 1, 119)} and sum(r.kept for r in got) == 1


def test_keys_that_collide_get_another_seed(spark, monkeypatch):
    from graphloom.llm import common

    docs = make(spark, [(1, "a", "s", "en"), (1, "a", "s", "en"), (2, "b", "s", "en")])
    assert common.key_seed(docs) == 0
    monkeypatch.setattr(common, "doc_key", lambda seed: F.lit(7) if seed < 2 else F.xxhash64("doc_id", "text"))
    assert common.key_seed(docs) == 2


def test_pruning_keeps_true_pairs():
    m = near_join.least_matches()
    assert m == sorted(m) and m[-1] < 0.8 * 128 and m[0] < 10


# 7


def test_fingerprints(spark, docs, none):
    rows = [r for r in messy() if r[0] != 7 and (r[0] is not None or r[1] == messy()[0][1])]
    got = {r.doc_id: r for r in fingerprint.edited_neighbours(make(spark, rows).repartition(4)).collect()}
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    s, prints = fingerprint.Sampler(), {}
    assert len(got) == len(order)

    def plain(text):  # one term after another
        c = collections.Counter(text.encode().split())
        if not c:
            return "0" * 4 * s.k
        h, n = s.words.array(list(c)), np.array(list(c.values()))
        best = np.array([s.draw(h[i : i + 1], n[i : i + 1])[0] for i in range(len(h))]).argmin(axis=0)
        return fingerprint.text_of(s.names(h[best][None], n[best][None])[0])

    share = lambda a, b: sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / s.k
    for k, (i, t) in enumerate(order):
        follows, nxt = order[(k + 1) % len(order)]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint == plain(t) and r.edited_fingerprint == plain(edited)
        assert r.near_edited == share(r.fingerprint, r.edited_fingerprint) and r.near_next == share(r.fingerprint, got[follows].fingerprint)
    assert got[1].fingerprint == got[2].fingerprint and fingerprint.edited_neighbours(none).count() == 0
    assert fingerprint.edited_neighbours(docs).count() == len(messy())
    assert {r.fingerprint for r in fingerprint.fingerprints(docs.where("doc_id in (1, 2)")).collect()} == {got[1].fingerprint}


def test_collision_rate_is_the_weighted_jaccard():
    rng = random.Random(4)
    s = fingerprint.Sampler(1024)
    for _ in range(6):
        a = [rng.choice("abcdefghijklmnop") for _ in range(60)]
        b = a[:30] + [rng.choice("klmnopqrstuv") for _ in range(rng.randrange(10, 60))]
        x, y = collections.Counter(a), collections.Counter(b)
        want = sum((x & y).values()) / sum((x | y).values())
        p, q = s.sign(pa.array([" ".join(a), " ".join(b)]))
        assert abs(fingerprint.likeness(p, q) - want) < 0.07


def test_samples_do_not_depend_on_what_is_held(monkeypatch):
    texts = pa.array([" ".join(f"t{j * k % 37}" for j in range(30)) for k in range(1, 20)] + ["", " a  a "])
    want = fingerprint.Sampler().sign(texts)
    monkeypatch.setattr(fingerprint, "HELD", 3)
    monkeypatch.setattr(fingerprint, "CHUNK", 1)
    s = fingerprint.Sampler()
    assert (s.sign(texts) == want).all() and (np.vstack([s.sign(texts[i : i + 1]) for i in range(len(texts))]) == want).all()


def test_samples_have_their_distributions():
    """a is Exp(w); given that, v of a term with weight w is below v of one with weight 1 with probability w / (w + 1)."""
    s, rng = fingerprint.Sampler(64), np.random.default_rng(1)
    terms = rng.integers(0, 2**63, 4000).astype(np.uint64)
    one = s.draw(terms, np.ones(4000, np.int64)) / 2**32
    assert abs(one.mean() - 0.5) < 0.005 and abs(np.corrcoef(one[:, 0], one[:, 1])[0, 1]) < 0.05
    for w in (2, 3, 10, 1000):
        v = s.draw(terms, np.full(4000, w)) / 2**32
        assert abs(v.mean() - 1 / (w + 1)) < 0.02 / w ** 0.5 and abs((v < np.roll(one, 1, axis=0)).mean() - w / (w + 1)) < 0.01
        assert (v <= one).all()


# 8


def test_language_held_out_accuracy(spark):
    random.seed(1)
    parts = {"en": ["the", "and", "tion", "ing", "er"], "de": ["der", "und", "ung", "sch", "ei"], "fr": ["le", "et", "eau", "oi", "que"]}
    rows = [(i, " ".join("".join(random.choices(parts[g], k=3)) for _ in range(random.randrange(3, 40))), "a", g) for i in range(300) for g in [random.choice(list(parts))]]
    d = make(spark, rows)
    train = d.where(~language_id.held_out(2, 4))
    langs, logs = language_id.fit(train)
    odd = make(spark, [(1, None, "a", "en"), (2, "12 !? \n", "a", "en"), (3, "", "a", "en"), (4, "Der und " * 40000, "a", "en"), (4, "\U0001d400\U00010450 der", "a", "en")])
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(odd, langs, logs).collect()]
    assert sorted(g[1] for g in got) == ["de", "de", "und", "und", "und"] and all(0 <= g[2] <= 1 for g in got)
    p = {r.doc_id: r.lang_pred for r in language_id.predict(d.where(language_id.held_out(2, 4)), langs, logs).collect()}
    assert len(p) > 50 and np.mean([p[i] == g for i, _, _, g in rows if i in p]) > 0.97
    langs, logs = language_id.fit(train.limit(0))
    assert {r.lang_pred for r in language_id.predict(d, langs, logs).collect()} == {"und"}


def test_language_scores_match_a_plain_model(spark):
    rows = [(1, "abc abd", "s", "x"), (2, "bcd", "s", "y"), (3, "abcd é", "s", None)]
    langs, logs = language_id.fit(make(spark, rows))
    b = language_id.buckets(np.r_[language_id.Letters()("abcd é"), 0].astype(np.uint32))
    want = np.exp(logs[b].sum(axis=(0, 1)).astype(float))
    r = language_id.predict(make(spark, rows[2:]), langs, logs).first()
    assert abs(r.score - want.max() / want.sum()) < 1e-6


# 9


@pytest.mark.parametrize("parts, rounds", [(1, 1), (2, 3), (7, 2), (3, None)])
def test_exact_dedup_matches_brute_force(docs, none, parts, rounds):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t, *_ in messy():
        groups[norm(t)].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, least, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    got = exact_dedup.exact_dedup(docs.repartition(parts), rounds).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert len(kept) == len(groups) == len({k[1] for k in kept}) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_runs_are_merged_evenly_and_in_order(spark):
    rows = spark.range(8000).select(exact_dedup.text_key((F.col("id") % 4000).cast("string")).alias("key"), F.col("id").alias("doc_id"), F.col("id").alias("row"), F.lit(1).cast("long").alias("n")).repartition(5)
    sizes = exact_dedup.merge_runs(rows, 3).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("doc_id").alias("top"), F.sum("n").alias("all")).collect()
    assert len(sizes) == 8 and sum(r.n for r in sizes) == 4000 and max(r.n for r in sizes) < 600 and max(r.top for r in sizes) < 4000 and sum(r["all"] for r in sizes) == 8000
    assert [exact_dedup.rounds_for(n, 200) for n in (0, 1 << 11, 1 << 20, 1 << 30)] == [1, 1, 8, 10]
    a, b = (exact_dedup.Run(np.array(k, "S48"), np.zeros(3, bool), np.array(i), np.array(i), np.ones(3, int)) for k, i in ((["a", "c", "d"], [5, 1, 2]), (["a", "b", "d"], [4, 7, 3])))
    m = exact_dedup.merge(a, b)
    assert m.key.tolist() == [b"a", b"b", b"c", b"d"] and m.doc_id.tolist() == [4, 7, 1, 2] and m.n.tolist() == [2, 1, 1, 2]


def test_carried_columns_may_have_any_name(spark):
    odd = spark.createDataFrame([(1, "a b", "s", 1.5), (2, "a  b", "s", 2.5)], "doc_id long, text string, source string, `a.b``c` double")
    for rows in (exact_dedup.exact_dedup(odd, carry=True), mixing.copies(odd)):
        assert sorted(tuple(r.doc) for r in rows.collect()) == [(1, "a b", "s", 1.5), (2, "a  b", "s", 2.5)]


# 10


def test_packing_is_gapless_and_exact(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    pieces = packing.pack(docs, length=64).collect()
    by = collections.defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append(r)
    last = max(by)
    for s, rs in by.items():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == list(np.cumsum([0, *[r.length for r in rs]])[:-1]) and (s == last or sum(r.length for r in rs) == 64)
    stream = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    got, held = collections.Counter(), b""
    for r in stream:
        assert r.start * 4 == len(held) and r.length * 4 == len(r.ids)
        held += bytes(r.ids)
        if len(held) == 4 * r.doc_tokens:
            got[r.doc_id, held] += 1
            held = b""
    assert not held
    assert got == collections.Counter((i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t, *_ in messy())
    assert packing.pack(none).count() == 0


def test_word_encoder_equals_the_tokenizer():
    e = packing.WordEncoder(packing.tokenizer_path())
    rng = random.Random(3)
    letters = list("abcÉß'’.,!?\t \n\r\x0b\x1c\x85\xa0\u2003\u200b\u0338ΣσİıŁ12½日😀<|>")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(2000)] + ["<|endoftext|> a", "It's we'll  DON'T", "x" * 41 + " ÀÖß. straße,,, aaaaaaaa", ""]
    for tail in ((), (7, 8)):
        ids, n = e.encode(pa.array(texts), tail)
        for t, got in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert got.tolist() == [*e.tok.encode(t, add_special_tokens=False).ids, *tail], repr(t)


def test_other_tokenizers_encode_whole_texts():
    e = packing.WordEncoder(packing.tokenizer_path("byte_bpe_50k.json"))
    assert e.merges is None
    texts = ["A  b\n c", "", "naïve Words"]
    ids, n = e.encode(pa.array(texts), (1,))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*e.tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]
