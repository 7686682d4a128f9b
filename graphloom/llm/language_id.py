"""Language ID: multinomial naive Bayes over hashed character n-grams, scored in numpy batches against a broadcast matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, table

#: Hash buckets of n-grams, lengths of n-grams, and the count that each bucket has beforehand.
BUCKETS, GRAMS, PRIOR = 1 << 16, (1, 2, 3), 0.1
#: Most languages that a model may have; more are an error. It bounds a task's counts (100 MB), what is collected (13 million
#: rows of counts, 300 MB) and the matrix that is broadcast (50 MB).
MAX_LANGS = 200
UNKNOWN = "und"


def held_out(remainder: int, modulus: int) -> Column:
    """crc32 of doc_id as text leaves the remainder; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


class Letters:
    """Code points to lower-case letters, with a space for all that isn't a letter."""

    def __init__(self):
        self.map = np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else 32 for i in range(0x10000)], np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        x = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        if len(x) and int(x.max()) >= 0x10000:
            high = x >= 0x10000
            u, inv = np.unique(x[high], return_inverse=True)
            x = np.where(high, 0, x)
            x[high] = np.array([i if chr(i).isalpha() else 32 for i in u.tolist()], np.uint32)[inv]
            return np.where(high, x, self.map[np.where(high, 32, x)])
        return self.map[x]


def buckets(points: np.ndarray) -> np.ndarray:
    """One row per n-gram length: the bucket of the n-gram that begins at each place, or BUCKETS where it has no letter or crosses the end (code point 0) of a text."""
    out = np.full((len(GRAMS), len(points)), BUCKETS, np.int32)
    h, letter, over = np.zeros(len(points), np.uint32), np.zeros(len(points), bool), np.zeros(len(points), bool)
    for n in range(1, max(GRAMS) + 1):
        k = len(points) - n + 1
        if k <= 0:
            break
        p = points[n - 1 :]
        h, letter, over = h[:k] * np.uint32(0x01000193) + p + np.uint32(n * 0x9E3779), letter[:k] | (p > 32), over[:k] | (p == 0)
        if n in GRAMS:
            x = h ^ (h >> np.uint32(15))
            x = x * np.uint32(0x2C1B3C6D)
            x = x ^ (x >> np.uint32(12))
            out[GRAMS.index(n), :k] = np.where(letter & ~over, (x & np.uint32(BUCKETS - 1)).astype(np.int32), BUCKETS)
    return out


def _pieces(texts: list, letters: Letters, size: int = 1 << 20):
    """Texts joined up to about size code points, each followed by code point 0: indices, points, starts."""
    held, n, first = [], 0, 0
    for i, t in enumerate(texts):
        x = letters(t or "")
        held += [x, np.zeros(1, np.uint32)]
        n += len(x) + 1
        if n >= size or i == len(texts) - 1:
            lengths = np.array([len(a) + 1 for a in held[::2]])
            yield slice(first, i + 1), np.concatenate(held), np.cumsum(lengths) - lengths
            held, n, first = [], 0, i + 1


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (BUCKETS + 1 x languages; the last row is zero). Counts cover every row with a language
    and sum up in each partition first; what reaches the driver is one number per language and bucket."""

    def count(batches):
        letters, sums = Letters(), {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for s, points, starts in _pieces(b.column(0).to_pylist(), letters):
                ids = buckets(points)
                ends = np.r_[starts[1:], len(points)]
                for name, a, z in zip(langs[s], starts.tolist(), ends.tolist(), strict=True):
                    if name not in sums:
                        if len(sums) >= MAX_LANGS:
                            raise ValueError(f"over {MAX_LANGS} languages")
                        sums[name] = np.zeros(BUCKETS + 1, np.int64)
                    sums[name] += np.bincount(ids[:, a:z].ravel(), minlength=BUCKETS + 1)
        for name, c in sums.items():
            at = np.flatnonzero(c[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "bucket", "n"])

    rows = docs.where(F.col(lang).isNotNull()).select(text, F.col(lang).alias("lang")).mapInArrow(count, "lang string, bucket long, n long")
    rows = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    if len(langs) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    c = np.full((BUCKETS, len(langs)), PRIOR)
    col = {x: i for i, x in enumerate(langs)}
    c[rows.column("bucket").to_numpy(), np.array([col[x] for x in rows.column("lang").to_pylist()], int)] += rows.column("n").to_numpy()
    return langs, np.vstack([np.log(c / c.sum(axis=0)), np.zeros((1, len(langs)))]).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score (the posterior of the predicted language, all languages alike beforehand) for every row and whole text.
    Null texts, texts without a letter and any text when nothing was learned: und, score 0. Repeated rows are kept."""
    model = docs.sparkSession.sparkContext.broadcast(logs)

    def score(batches):
        letters = Letters()
        for b in batches:
            preds, scores = [], []
            for _, points, starts in _pieces(b.column(0).to_pylist(), letters):
                has = np.logical_or.reduceat(points > 32, starts)
                if not langs:
                    preds += [UNKNOWN] * len(starts)
                    scores += [0.0] * len(starts)
                    continue
                total = np.zeros((len(starts), len(langs)))
                for ids in buckets(points):
                    total += np.add.reduceat(model.value[ids], starts, axis=0, dtype=np.float64)
                p = np.exp(total - total.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                preds += [langs[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), has.tolist(), strict=True)]
                scores += np.where(has, p.max(axis=1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[1:], "lang_pred", "score"])

    kept = docs.select(*keep)
    schema = extended(kept, "lang_pred string, score double")
    return docs.select(text, *keep).mapInArrow(score, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(2, 4).alias("held_out"))
    langs, logs = fit(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return predict(docs, langs, logs, keep=("doc_id", "held_out"))
