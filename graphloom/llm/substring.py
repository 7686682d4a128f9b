"""Substring dedup: an FM-index with a wavelet matrix for each shard; backward search finds, for each window of a document, the
interval of its occurrences, and intervals of windows that start earlier elsewhere are reported."""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import doc_key, grams, key_seed, mix, pieces, runs, stored, table

#: Words of a window, and of the gram whose least hash sends a window to its shard.
WINDOW, GRAM = 20, 5
#: Words that one step of the backward search takes; it divides WINDOW.
STRIDE = 5
#: Segments in a shard's index and in a task, on average; segments of one gram above which its windows are grouped by their digests instead.
SHARD, TASK, HOT = 8_000, 64_000, 20_000
#: Bytes of texts that are cut at once; a word of more bytes than LONG is hashed by itself.
PIECE, LONG = 1 << 20, 64


class Bits:
    """A bit vector with ranks: a count of 32 bits at each 1024th 64-bit word and one of 16 bits at each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.r_[packed, np.zeros(8 + (-len(packed)) % 8, np.uint8)].view(np.uint64)
        ones = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)
        self.far = ones[::1024].astype(np.uint32)
        self.near = (ones - np.repeat(self.far, 1024)[: len(ones)]).astype(np.uint16)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        return self.far[w >> 10].astype(np.int64) + self.near[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def nbytes(self) -> int:
        return self.words.nbytes + self.far.nbytes + self.near.nbytes


class WaveletMatrix:
    """Ranks over a sequence of symbols below 2**levels: one bit vector a level."""

    def __init__(self, x: np.ndarray, levels: int):
        self.levels, self.bits, self.zeros = levels, [], []
        x = x.astype(np.int32)
        for level in range(levels - 1, -1, -1):
            b = ((x >> level) & 1).astype(bool)
            self.bits.append(Bits(b))
            self.zeros.append(len(x) - int(b.sum()))
            x = np.concatenate([x[~b], x[b]])

    def go(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where place i comes to lie after all levels, on the path of its symbol. Differences on one path are ranks."""
        for level in range(self.levels):
            ones = self.bits[level].rank(i)
            i = np.where((symbols >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, i - ones)
        return i

    def nbytes(self) -> int:
        return sum(b.nbytes() for b in self.bits)


def ranks(x: np.ndarray) -> tuple[np.ndarray, int]:
    u, inv = np.unique(x, return_inverse=True)
    return inv.astype(np.int64), len(u)


class FMIndex:
    """Over text, word numbers from 1 with 0 between segments: suffixes sorted by their first WINDOW words or more, and the gram
    of STRIDE words before each of them in a wavelet matrix. A step of the search takes a gram, so WINDOW / STRIDE steps find a window.

    What is kept is compressed: the wavelet matrix, with about 1.3 bits for each bit of a symbol, a bit for each suffix that begins an interval of
    equal windows, and of the suffix array one number for each such interval, its earliest suffix."""

    @classmethod
    def build(cls, text: np.ndarray) -> tuple[FMIndex, np.ndarray]:
        """The index, and the number of the gram at each place of the text, by which its windows are asked."""
        fm = cls.__new__(cls)
        return fm, fm._build(text)

    def _build(self, text):
        n = len(text)
        by = {1: ranks(text)}

        def ahead(a, k):
            return np.concatenate([a[k:], np.zeros(min(k, n), np.int64)])[:n]

        def joined(a, b):
            (x, _), (y, ny) = by[a], by[b]
            by[a + b] = ranks(x * (ny + 1) + np.where(np.arange(n) + a < n, ahead(y, a) + 1, 0))

        h = 1
        while 2 * h <= WINDOW:
            joined(h, h)
            h *= 2
        joined(4, 1)
        joined(16, 4)
        gram, size = by[STRIDE]
        suffixes = np.argsort(by[WINDOW][0], kind="stable")
        before = suffixes - STRIDE
        last = np.where(before >= 0, gram[before], size)  # no whole gram before: a symbol of its own
        self.first = np.searchsorted(gram[suffixes], np.arange(size + 1)).astype(np.int32)
        self.tree = WaveletMatrix(last, max(1, int(size).bit_length()))
        self.base = self.tree.go(np.arange(size), np.zeros(size, np.int64)).astype(np.int32)
        window = by[WINDOW][0][suffixes]
        starts = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        several = np.diff(np.r_[starts, n]) > 1
        mark = np.zeros(n, bool)
        mark[starts[several]] = True
        self.heads, self.least = Bits(mark), np.minimum.reduceat(suffixes, starts)[several].astype(np.uint32)
        return gram

    def search(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with the words of each row: the numbers of its grams, the last one first; those that shrink to one suffix stop there."""
        lo, hi = self.first[grams[:, 0]].astype(np.int64), self.first[grams[:, 0] + 1].astype(np.int64)
        for k in range(1, grams.shape[1]):
            open_ = np.flatnonzero(hi - lo > 1)
            if not len(open_):
                break
            g = grams[open_, k]
            both = self.tree.go(np.r_[g, g], np.r_[lo[open_], hi[open_]]) + np.tile(self.first[g].astype(np.int64) - self.base[g], 2)
            lo[open_], hi[open_] = both[: len(open_)], both[len(open_) :]
        return lo, hi

    def earliest(self, lo: np.ndarray) -> np.ndarray:
        """Where the earliest window of an interval of several, which begins at lo, stands in the text."""
        return self.least[self.heads.rank(lo)].astype(np.int64)

    def nbytes(self) -> int:
        return self.tree.nbytes() + self.heads.nbytes() + self.first.nbytes + self.base.nbytes + self.least.nbytes


def windows_of(gram: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For windows at places of a text with these gram numbers, their grams, the last one first."""
    return np.column_stack([gram[at + WINDOW - k * STRIDE] for k in range(1, WINDOW // STRIDE + 1)])


def repeated(segments: list[bytes]) -> list[np.ndarray]:
    """For segments (words joined by a space) in order: which of each one's windows also start earlier in them."""
    ids = defaultdict(itertools.count().__next__)
    ids[b"\n"]  # 0, between segments: no word is a line feed
    words = b" \n ".join([*segments, b""]).split(b" ")[:-1]
    text = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    ends = np.flatnonzero(text == 0)
    lengths = np.diff(ends, prepend=-1) - 1
    starts = ends - lengths
    counts = lengths - WINDOW + 1
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    fm, gram = FMIndex.build(text)
    lo, hi = fm.search(windows_of(gram, at))
    flag = np.zeros(len(at), bool)
    many = np.flatnonzero(hi - lo > 1)
    flag[many] = at[many] != fm.earliest(lo[many])
    return np.split(flag, np.cumsum(counts)[:-1])


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a text: where each begins and ends, and a hash of its bytes, taken eight at a time over all words at once. The hashes only say where
    windows go, so words that share one do no harm."""
    buf = np.frombuffer(text + bytes(8), np.uint8)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    space[len(text) :] = True
    edges = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edges[::2], edges[1::2]
    eight = np.ndarray(len(text) + 1, "<u8", buf, strides=(1,))
    n = end - start
    h = np.zeros(len(start), np.uint64)
    todo = np.flatnonzero(n <= LONG)
    for k in range(0, LONG, 8):
        todo = todo[n[todo] > k]
        if not len(todo):
            break
        unused = (8 * np.maximum(0, 8 - (n[todo] - k))).astype(np.uint64)
        h[todo] = mix(h[todo] * np.uint64(0x9E3779B97F4A7C15) + ((eight[start[todo] + k] << unused) >> unused))
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[start[i] : end[i]])
    return start, end, h


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows of a text whose least gram is the same one: its hash, the text's place in the list, first word, number of words, and the bytes [a, b)
    of the texts joined by a line feed. Equal windows have equal least grams."""
    start, end, h = hashed(b"\n".join(texts))
    if len(h) < WINDOW:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none, none
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(start, at)
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    g = grams(h, GRAM)
    value, least = g, np.arange(len(g))
    width = 1
    while width < WINDOW - GRAM + 1:  # the first of the least in twice as many grams, until all of a window's are compared
        step = min(width, WINDOW - GRAM + 1 - width)
        right = value[step:] < value[:-step]
        value, least = np.where(right, value[step:], value[:-step]), np.where(right, least[step:], least[:-step])
        width += step
    inside = np.flatnonzero(of[: len(of) - WINDOW + 1] == of[WINDOW - 1 :])
    cut = np.flatnonzero(np.r_[True, (np.diff(inside) > 1) | (least[inside[1:]] != least[inside[:-1]])]) if len(inside) else inside
    n = np.diff(np.r_[cut, len(inside)]) + WINDOW - 1 if len(inside) else cut
    i = inside[cut]
    return g[least[i]], of[i], i - first[of[i]], n, start[i], end[i + n - 1]


def covered(start: int, flags: np.ndarray) -> list[tuple[int, int]]:
    """Words [a, b) under the flagged windows."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > WINDOW)
    return list(zip((start + at[np.r_[0, cut + 1]]).tolist(), (start + at[np.r_[cut, len(at) - 1]] + WINDOW).tolist(), strict=True))


OCCURRENCE = "gram long, digest binary, doc_id long, key long, start int, n int, words binary"


def find_repeats(docs: DataFrame, seed: int = 0, bloom_bytes: int = 32 << 20) -> DataFrame:
    """key, a, b: words [a, b) of the document (doc_key) are under windows whose words also start earlier, in a document with a
    smaller doc_id (null last; of one id, the smaller key) or earlier in the same document.

    Windows go to shards by their least gram, and runs of windows with the same one as one segment. Grams that occur once
    can't hold a repeat: those that occur more often fill a Bloom filter of bounded size, which only spares work. Equal
    segments become one, that of the first occurrence, before anything is dealt out; the other occurrences are repeats as a
    whole. Shards hold about SHARD segments; where one gram has more than HOT different ones, its windows are grouped by
    digest instead, an aggregation that is no larger for a hot one.
    """

    def count(batches):
        for b in batches:
            got = [segments(texts_of(part))[0] for part in pieces(b, 0, PIECE)]
            u, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    rows = docs.select(doc_key(seed).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    often = stored(rows.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"), "grams")
    bits = docs.sparkSession.sparkContext.broadcast(bloom.build(often, "gram", often.count(), bloom_bytes))

    def cut(batches):
        for b in batches:
            for part in pieces(b, 2, PIECE):
                keys, ids, texts = part.column("key").to_pylist(), part.column("doc_id").to_pylist(), texts_of(part)
                found = segments(texts)
                ok = bloom.probe(bits.value, found[0])
                joined = b"\n".join(texts)
                gram, *rest = (x[ok] for x in found)
                for i in range(0, len(gram), 20_000):
                    out = []
                    for g, d, start, n, a, z in zip(*(x[i : i + 20_000].tolist() for x in (gram.view(np.int64), *rest)), strict=True):
                        s = b" ".join(joined[a:z].split())
                        out.append((g, xxhash.xxh3_128_digest(s), ids[d], keys[d], start, n, s))
                    yield made(out)

    def made(out):
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["gram", "digest", "doc_id", "key", "start", "n", "words"])

    all_ = stored(rows.mapInArrow(cut, OCCURRENCE), "segments")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key", "start")
    unique = stored(all_.groupBy("digest").agg(F.min(order).alias("o"), F.first("gram").alias("gram"), F.first("words").alias("words")), "unique")
    # Copies of a whole segment.
    same = all_.select("digest", "key", "start", "n").join(unique.select("digest", F.col("o.key").alias("k0"), F.col("o.start").alias("s0")), "digest")
    whole = same.where("key != k0 or start != s0").select("key", F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))
    # Windows shared by different segments.
    per = unique.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
    todo = unique.join(per, "gram").select("gram", "m", "o.no", "o.doc_id", "o.key", "o.start", "words")
    total = per.agg(F.sum("m")).first()[0] or 0
    sub = F.pmod(F.xxhash64(F.col("gram"), F.lit(7)), F.lit(TASK // SHARD)).alias("sub")
    shards = todo.where(F.col("m") <= HOT).select("gram", sub, "no", "doc_id", "key", "start", "words").repartition(max(1, -(-total // TASK)), "gram").sortWithinPartitions("sub", "no", "doc_id", "key", "start")

    def search(batches):
        import pandas as pd

        for g in runs(batches, lambda b: b["sub"].to_numpy()):
            out = []
            for k, s, flags in zip(g["key"].tolist(), g["start"].tolist(), repeated([bytes(w) for w in g["words"]]), strict=True):
                out += [(k, a, b) for a, b in covered(s, flags)]
            if out:
                yield pd.DataFrame(out, columns=["key", "a", "b"])

    def windows(batches):
        for b in batches:
            out = []
            for no, i, k, s, w in zip(*(b.column(c).to_pylist() for c in ("no", "doc_id", "key", "start", "words")), strict=True):
                ws = w.split(b" ")
                out += [(xxhash.xxh3_128_digest(b" ".join(ws[j : j + WINDOW])), no, i, k, s + j) for j in range(len(ws) - WINDOW + 1)]
            types = [pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["digest", "no", "doc_id", "key", "start"])

    parts = shards.mapInPandas(search, "key long, a int, b int")
    found = whole.unionByName(parts)
    if per.where(F.col("m") > HOT).limit(1).count():
        w = stored(todo.where(F.col("m") > HOT).mapInArrow(windows, "digest binary, no boolean, doc_id long, key long, start int"), "windows")
        first = w.groupBy("digest").agg(F.min(F.struct("no", "doc_id", "key", "start")).alias("o"))
        w = w.join(first, "digest").where("key != o.key or start != o.start")
        found = found.unionByName(w.select("key", F.col("start").alias("a"), (F.col("start") + WINDOW).alias("b")))
    return found


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) for every row of docs (doc_id: a whole number, text). Null text:
    no words. Rows that repeat both doc_id and text are one document, so neither is earlier; they get the same result.
    Texts of fewer than 20 words keep all. No rows: no rows."""
    seed = key_seed(docs)
    spans = find_repeats(docs, seed).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    rows = docs.select(doc_key(seed).alias("key"), "doc_id", "text").join(spans, "key", "left").select("doc_id", "text", "spans")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                n, gone, kept = [], [], []
                for t, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    words = split(t)
                    n.append(len(words))
                    if spans:
                        d = np.zeros(len(words) + 1, np.int32)
                        np.add.at(d, [s["a"] for s in spans], 1)
                        np.add.at(d, [s["b"] for s in spans], -1)
                        words = [words[j] for j in np.flatnonzero(np.cumsum(d[:-1]) == 0).tolist()]
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
