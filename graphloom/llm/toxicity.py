"""Toxicity: a weighted finite-state pattern grammar. Transducers for words, negation, reported speech and target are composed;
what the composition writes for each clause is weighed, so that matched clauses count and not words alone."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import WordHash, extended, grams, stored, table
from .language_id import held_out

#: Word classes: what the first transducer writes.
OTHER, INSULT, THREAT, LEARNED, TARGET, NEGATION, REPORT = range(7)
HITS = (INSULT, THREAT, LEARNED)
#: English, German, French and Spanish.
LEXICON = {
    INSULT: """idiot idiots moron morons stupid dumb loser losers scum trash garbage clown clowns pathetic worthless disgusting fool fools imbecile jerk filth vermin parasite coward liar pig
        dumm dummkopf trottel depp idiotin abschaum versager widerlich erbärmlich wertlos lügner feigling
        imbécile stupide crétin crétine abruti ordure minable pathétique dégoûtant salaud débile menteur
        idiota idiotas estúpido estúpida imbécil basura asqueroso patético perdedor payaso escoria mentiroso cobarde""",
    THREAT: """kill killed hurt destroy punch stab shoot murder strangle crush
        töten umbringen verprügeln erschießen erwürgen zerstören tuer frapper massacrer étrangler détruire matar golpear destruir disparar apuñalar""",
    TARGET: "you your yours yourself u ur he she they them him her these those people everyone du dich dir ihr euch sie tu toi vous ton te tú usted ustedes vosotros",
    NEGATION: "not no never n't isn't aren't wasn't don't doesn't won't cannot can't nobody nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás tampoco",
    REPORT: "said says say claimed claims wrote writes reported reports called quoted according allegedly sagte sagten behauptete behauptet schrieb laut angeblich dit disait écrit selon affirme dijo dice escribió según afirma",
}
#: Words that a negation reaches, characters of a learned prefix, and how sure a learned term must be: log-odds over their error, and share of toxic texts.
REACH, PREFIXES, SURE, SHARE = 3, (4, 5, 6), 2.7, 0.8
#: The classifier is fitted on at most so many labelled rows, chosen by a hash of doc_id.
MAX_FIT = 40_000
STRIP = ".,;:!?\"'()[]{}<>|*#%&$_-–—«»“”„’…¡¿"
ENDS = ".!?;:"


class Transducer:
    """A deterministic transducer: from a state and a symbol to a state and an output symbol."""

    def __init__(self, states: int, inputs: int, step, outputs: int):
        self.states, self.inputs, self.outputs = states, inputs, outputs
        self.next = np.zeros((states, inputs), np.int32)
        self.out = np.zeros((states, inputs), np.int32)
        for q in range(states):
            for a in range(inputs):
                self.next[q, a], self.out[q, a] = step(q, a)

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what self writes."""

        def step(q, a):
            p, r = divmod(q, other.states)
            b = self.out[p, a]
            return self.next[p, a] * other.states + other.next[r, b], other.out[r, b]

        return Transducer(self.states * other.states, self.inputs, step, other.outputs)


def grammar() -> Transducer:
    """Reads the word classes of one clause; writes 0, or 1 + a pattern: (class of the hit, negated, reported, aimed at a target), or the last pattern for a target that follows a hit."""
    # Adds 7 to a class within the reach of a negation.
    negation = Transducer(REACH + 1, 7, lambda q, a: (REACH if a == NEGATION else max(q - 1, 0), a + 7 * (q > 0)), 14)
    # Adds 14 after a verb of report, to the end of the clause.
    report = Transducer(2, 14, lambda q, a: (int(q or a % 7 == REPORT), a + 14 * q), 28)

    def aim(q, a):  # bit 0: a target was seen, bit 1: a hit was seen
        kind = a % 7
        if kind == TARGET:
            return q | 1, 25 if q & 2 else 0
        if kind in HITS:
            return q | 2, 1 + HITS.index(kind) * 8 + (a // 7) * 2 + (q & 1)
        return q, 0

    return negation.then(report).then(Transducer(4, 28, aim, 26))


PATTERNS = 25


class Words(dict):
    """The first transducer: a raw word to its class, + 8 if it ends a clause."""

    def __init__(self, terms: frozenset):
        super().__init__()
        self.fixed = {w: k for k, ws in LEXICON.items() for w in ws.split()}
        self.terms = terms

    def kind(self, w: str) -> int:
        k = self.fixed.get(w, OTHER)
        return LEARNED if k == OTHER and self.terms and (w in self.terms or any(len(w) >= n and w[:n] + "*" in self.terms for n in PREFIXES)) else k

    def __missing__(self, raw: str) -> int:
        v = self.kind(raw.strip(STRIP).lower()) + 8 * (raw[-1] in ENDS)
        if len(self) < 400_000:
            self[raw] = v
        return v


def features(texts: list[str], words: Words, g: Transducer) -> np.ndarray:
    """For each text: for each pattern the number of clauses that match it, then the number of words."""
    out = np.zeros((len(texts), PATTERNS + 1))
    hit = np.zeros(16, bool)
    hit[list(HITS) + [k + 8 for k in HITS]] = True
    for i, t in enumerate(texts):
        raw = t.split()
        out[i, -1] = len(raw)
        if not raw:
            continue
        codes = np.fromiter(map(words.__getitem__, raw), np.int8, len(raw))
        at = np.flatnonzero(hit[codes])
        if not len(at):
            continue
        ends = np.flatnonzero(codes >= 8)
        which = np.unique(np.searchsorted(ends, at))
        for c in which.tolist():
            a, z = (ends[c - 1] + 1 if c else 0), (ends[c] + 1 if c < len(ends) else len(raw))
            q, seen = 0, set()
            for k in (codes[a:z] & 7).tolist():
                o = g.out[q, k]
                q = g.next[q, k]
                if o:
                    seen.add(int(o) - 1)
            for o in seen:
                out[i, o] += 1
    return out


#: Patterns of hits that are neither negated nor reported.
DIRECT = [h * 8 + aimed for h in range(len(HITS)) for aimed in range(2)]


def design(x: np.ndarray) -> np.ndarray:
    """Log counts of the patterns; of the clauses with a direct hit, also by the logarithm of the length; a constant. Clauses whose hits
    are all negated or reported weigh by their own patterns alone."""
    hits = x[:, DIRECT].sum(axis=1)
    words = np.log1p(x[:, -1])
    return np.column_stack([np.log1p(x[:, :PATTERNS]), np.log1p(hits), hits > 1, np.log1p(hits) * words / 10, np.ones(len(x))])


#: Weights where there is nothing to learn from: aimed and plain insults count, negated and reported ones little.
def prior() -> np.ndarray:
    w = np.zeros(PATTERNS + 4)
    for h in range(3):
        for tags in range(4):
            for aimed in range(2):
                w[h * 8 + tags * 2 + aimed] = (4.0 if not tags else 0.5) + aimed * (2.0 + (h == 1))
    w[PATTERNS - 1], w[-1] = 0.5, -3.0
    return w


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, decay: float = 1.0) -> np.ndarray:
    """Newton's method, with steps halved until they help, and a quadratic pull to the start weights (but not of the constant)."""
    pull = np.full(len(start), decay)
    pull[-1] = 1e-3

    def loss(w):
        m = x @ w
        return float(np.logaddexp(0, m).sum() - y @ m + 0.5 * (pull * (w - start) ** 2).sum())

    w = start.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * (w - start))
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def hashes(terms: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), np.uint64, len(terms))


def terms_of(text: str) -> set[str]:
    ws = {w.strip(STRIP).lower() for w in text.split()}
    ws.discard("")
    out = {w for w in ws if not w.isdigit() and len(w) <= 30}
    for n in PREFIXES:
        out |= {w[:n] + "*" for w in ws if len(w) >= n}
    return out


def learn(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> tuple[frozenset, np.ndarray]:
    """Terms and weights from labelled rows; docs and labels: doc_id and text, toxic. Of the labelled ids at most max_fit are
    used, by a hash; null ids and null labels are not. Texts that share their least shingle count once, so copies don't teach
    their words. Terms that toxic texts have surely more often (SURE, SHARE) join the grammar's lexicon as words of a class, so they count
    in its patterns only; these are all terms that pass, each in at least 3 toxic texts and 0.5 % of them, so their number is bounded by that of
    the words of the fitted rows. The patterns' weights follow by logistic regression. Null and empty texts are texts without terms. With one
    label only, or none: no terms, and the weights of prior()."""
    ids = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)

    def sketch(batches):
        h = WordHash()
        for b in batches:
            least = []
            for t in b.column(1).to_pylist():
                g = grams(h.array((t or "").encode("utf-8", "replace").split()), 8)
                least.append(int(g.min().view(np.int64)) if len(g) else xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "replace")) >> 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.int64())], ["doc_id", "text", "toxic", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    rows = stored(rows.mapInArrow(sketch, "doc_id long, text string, toxic int, sketch long"), "labelled")
    first = rows.groupBy("sketch", "toxic").agg(F.min("doc_id").alias("doc_id"))
    unique = rows.join(F.broadcast(first.select("doc_id")), "doc_id")
    totals = {r.toxic: r.n for r in unique.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return frozenset(), prior()

    def counted(bits=None):
        def run(batches):
            c = Counter()
            for b in batches:
                for t in b.column("text").to_pylist():
                    terms = list(terms_of(t))
                    h = hashes(terms)
                    c.update(terms if bits is None else (terms[i] for i in np.flatnonzero(bloom.probe(bits.value, h)).tolist()))
            keys = list(c)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes(keys).view(np.int64)), pa.array([c[k] for k in keys], pa.int64())], ["term", "h", "n"])

        return run

    # Terms of toxic texts; a Bloom filter of these, of bounded size, spares most terms of the others, and a join is exact.
    schema, least = "term string, h long, n long", max(3, pos // 200)
    a = unique.where("toxic = 1").mapInArrow(counted(), schema).groupBy("term").agg(F.sum("n").alias("a"), F.first("h").alias("h")).where(F.col("a") >= least)
    a = stored(a, "terms")
    bits = docs.sparkSession.sparkContext.broadcast(bloom.build(a, "h", a.count()))
    b = unique.where("toxic = 0").mapInArrow(counted(bits), schema).groupBy("term").agg(F.sum("n").alias("b"))
    half = lambda c: c + F.lit(0.5)
    n, m = F.col("a"), F.coalesce("b", F.lit(0))
    odds = F.ln(half(n) / half(pos - n)) - F.ln(half(m) / half(neg - m))
    sure = (odds / F.sqrt(1 / half(n) + 1 / half(m)) >= SURE) & (n / (n + m) >= SHARE)
    terms = frozenset(r.term for r in a.join(b, "term", "left").where(sure).select("term").collect())

    def measure(batches):
        words, g = Words(terms), grammar()
        for bt in batches:
            x = features(bt.column("text").to_pylist(), words, g)
            yield pa.RecordBatch.from_arrays([bt.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])

    got = unique.mapInArrow(measure, "toxic int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist())
    return terms, logistic(design(x), got.column("toxic").to_numpy().astype(float), prior())


def score(docs: DataFrame, terms: frozenset, weights: np.ndarray, keep: tuple = ("doc_id",)) -> DataFrame:
    """keep and score (0 to 1) for every row and whole text. Null and empty texts get the score of a text without matches; repeated rows are kept."""
    def run(batches):
        words, g = Words(terms), grammar()
        for b in batches:
            x = features([t or "" for t in b.column(0).to_pylist()], words, g)
            s = 1 / (1 + np.exp(-np.clip(design(x) @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s)], [*b.schema.names[1:], "score"])

    kept = docs.select(*keep)
    return docs.select("text", *keep).mapInArrow(run, extended(kept, "score double"))


def trained(spark: SparkSession, sf_dir: str) -> tuple[frozenset, np.ndarray]:
    labels = table(spark, sf_dir, "labels").where(~held_out(0, 5))
    return learn(table(spark, sf_dir, "documents"), labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, weights = trained(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(0, 5).alias("held_out"))
    return score(docs, terms, weights, ("doc_id", "held_out")).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
