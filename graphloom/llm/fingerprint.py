"""Document fingerprints: consistent weighted sampling. Gamma-based samples of weighted terms give signatures whose collision rate is the generalised Jaccard similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHash, extended, mix, partitions, pieces, stored, table

#: Samples of a fingerprint; each is written as 16 bits. Terms are hashed words; weights are their counts.
SAMPLES = 64
#: Bytes of text that are signed at once; (term, count) pairs whose samples are held at once; pairs that are drawn at once.
PIECE, HELD, CHUNK = 4 << 20, 400_000, 1024


class Sampler:
    """Ioffe's scheme: for each sample k and term of weight w, with r, c ~ Gamma(2, 1) and b ~ U(0, 1) drawn from a hash of (term, k):
    t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y exp r); the term with the smallest a is the sample, (term, t) its name.

    For a weight of 1, t is 0, and a = c exp(-r (1 - b)) has the distribution Exp(1). So v = 1 - exp(-a), which is uniform, is drawn
    first, and c, r, b, in their distribution given a, only for larger weights: c = a + Exp(1), and with e = ln(c / a) = r (1 - b),
    r = e + Exp(1). v stands for a in comparisons, as a whole number of 32 bits."""

    def __init__(self, samples: int = SAMPLES):
        self.k, self.words = samples, WordHash()
        salt = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.salts = [(salt >> np.uint64(j)).astype(np.uint32) for j in (0, 32)]

    def hash(self, terms: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """32 bits for each term and sample."""
        low, high = terms.astype(np.uint32)[:, None], (terms >> np.uint64(32)).astype(np.uint32)[:, None]
        x = (low ^ salt) * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x += high
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0x27D4EB2F)
        x ^= x >> np.uint32(16)
        return x

    def steps(self, terms: np.ndarray, weights: np.ndarray, v: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """t and ln a, given v, for terms of any weight."""
        u = self.hash(terms, salt + np.uint32(0x3C6EF372))
        half = [(x.astype(np.float32) + np.float32(0.5)) * np.float32(2**-16) for x in (u & np.uint32(0xFFFF), u >> np.uint32(16))]
        a = -np.log1p(-np.minimum((v.astype(np.float32) + np.float32(0.5)) * np.float32(2**-32), np.float32(1 - 2**-24)))
        ln_c = np.log(a - np.log(half[0]))
        e = ln_c - np.log(a)
        r = e - np.log(half[1])
        t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + 1 - e / r)
        return t, ln_c - e - r * t  # r (t - b + 1) is r t + e

    def draw(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """v of all samples, one row for each term."""
        out = np.empty((len(terms), self.k), np.uint32)
        for i in range(0, len(terms), CHUNK):
            s = slice(i, i + CHUNK)
            v = out[s] = self.hash(terms[s], self.salts[0])
            many = np.flatnonzero(weights[s] > 1)
            if len(many):
                t, ln_a = self.steps(terms[s][many], weights[s][many], v[many], self.salts[0])
                out[i + many] = np.where(t == 0, v[many], (-np.expm1(-np.exp(ln_a.astype(np.float64))) * 2.0**32).astype(np.uint32))
        return out

    def names(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """16 bits for each sample's (term, t): terms and weights have a column for each sample."""
        x = self.hash(terms.ravel(), np.zeros(1, np.uint32)).reshape(terms.shape) ^ self.salts[1]
        many = weights > 1
        if many.any():
            i, k = np.nonzero(many)
            salt = self.salts[0][k][:, None]
            v = self.hash(terms[i, k], salt)
            t, _ = self.steps(terms[i, k], weights[i, k], v, salt)
            x[i, k] += t[:, 0].astype(np.int64).astype(np.uint32) * np.uint32(0x9E3779B1)
        x *= np.uint32(0x85EBCA6B)
        return (x >> np.uint32(16)).astype(np.uint16)

    def sign(self, texts: pa.Array) -> np.ndarray:
        """One signature (uint16 x samples) per text; texts without words get the name of nothing, zeros."""
        words = pc.ascii_split_whitespace(texts)
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        flat = words.flatten().dictionary_encode()
        index, known = flat.indices.to_numpy(), flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        hashes = self.words.array(known)
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        terms, size = hashes[order], max(1, len(order))
        # (text, term), terms in the order of their hashes, whatever else the piece holds
        key = np.repeat(np.arange(len(texts)) * size, np.diff(ends)) + place[index]
        if b"" in known:  # white space at an end of a text
            key = key[index != known.index(b"")]
        key.sort()
        first = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
        weight = np.diff(np.r_[first, len(key)])
        key = key[first]
        at = np.searchsorted(key, np.arange(len(texts) + 1) * size)
        term = key - np.repeat(np.arange(len(texts)) * size, np.diff(at))
        top = int(weight.max(initial=1)) + 1
        pairs, row = np.unique(term * top + weight, return_inverse=True)
        best = np.zeros((len(texts), self.k), np.int64)
        some = np.flatnonzero(np.diff(at))
        if len(pairs) <= HELD:
            v = self.draw(terms[pairs // top], pairs % top)
            for i in some.tolist():
                r = row[at[i] : at[i + 1]]
                best[i] = at[i] + v.take(r, axis=0).argmin(axis=0)
        else:  # too many to hold: a running least for each text
            for i in some.tolist():
                least = np.full(self.k, 2**32 - 1, np.uint32)
                best[i] = at[i]
                for j in range(at[i], at[i + 1], 64 * CHUNK):
                    z = min(at[i + 1], j + 64 * CHUNK)
                    v = self.draw(terms[term[j:z]], weight[j:z])
                    b = v.argmin(axis=0)
                    low = v[b, np.arange(self.k)]
                    best[i] = np.where(low < least, j + b, best[i])
                    least = np.minimum(low, least)
        out = np.zeros((len(texts), self.k), np.uint16)
        out[some] = self.names(terms[term[best[some]]], weight[best[some]]) if len(some) else 0
        return out


def text_of(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of samples that agree: an estimate of sum(min) / sum(max) of the two texts' word counts."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",), samples: int = SAMPLES) -> DataFrame:
    """keep and fingerprint for every row and whole text. Null is the empty text; texts without words share one fingerprint."""

    def run(batches):
        s = Sampler(samples)
        for b in batches:
            for p in pieces(b, 0, PIECE):
                sig = s.sign(p.column(0))
                yield pa.RecordBatch.from_arrays([*p.columns[1:], pa.array(map(text_of, sig), pa.string())], [*p.schema.names[1:], "fingerprint"])

    schema = extended(docs.select(*keep), "fingerprint string")
    return docs.select(F.coalesce(text, F.lit("")), *keep).mapInArrow(run, schema)


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_neighbours(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Each document's fingerprint, that of its text with the last third replaced from the next document (descending doc_id,
    null last; ties by a hash of the text, then any order; after the last: the first), and how alike they are.

    Rows are dealt by range of doc_id and sorted, so the next document is nearly always the next row of the task. The first
    and last row of each task go to a scratch table as well, where a task's last row is joined with the first of the next task that has rows. A single document is its own next one. No rows: no rows.
    """
    import hashlib

    order = [F.desc_nulls_last("doc_id"), F.desc("tie")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))

    def edit(texts, nexts):
        return [t[: len(t) - len(t) // 3] + x[: len(t) // 3] for t, x in zip(texts, nexts, strict=True)]

    def results(ids, texts, edited, sigs, edited_sigs, next_sigs):
        return [[i, len(t), hashlib.sha256(e.encode("utf-8", "replace")).hexdigest(), text_of(a), text_of(b), likeness(a, b), likeness(a, n)] for i, t, e, a, b, n in zip(ids, texts, edited, sigs, edited_sigs, next_sigs, strict=True)]

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def batch(done, ends):
        cols = list(zip(*done, strict=True)) if done else [[]] * 7
        cols = [[*c, *([None] * len(ends))] for c in cols]
        cols[0] = [*(cols[0][: len(done)]), *(e[1] for e in ends)]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
        arrays += [pa.array([None] * len(done) + [e[0] for e in ends], pa.int32()), pa.array([None] * len(done) + [e[2] for e in ends], pa.string()), pa.array([None] * len(done) + [e[3] for e in ends], pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, [*names, "edge", "text", "part"])

    def run(batches):
        s, held = Sampler(samples), None
        for b in batches:
            for part in pieces(b, 1, PIECE):
                ids, texts, where = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)[0].as_py()
                edges = [(0, ids[0], texts[0], where)] if held is None else []
                rows = texts if held is None else [held[1], *texts]
                edited = edit(rows[:-1], rows[1:])
                both = s.sign(pa.array(texts + edited, pa.string()))
                sigs = both[: len(texts)]
                if held is not None:
                    ids, sigs = [held[0], *ids], np.vstack([held[2], sigs])
                held = (ids[-1], texts[-1], sigs[-1], where)
                yield batch(results(ids[:-1], rows[:-1], edited, sigs[:-1], both[len(texts) :], sigs[1:]), edges)
        if held is not None:
            yield batch([], [(1, held[0], held[1], held[3])])

    dealt = rows.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    out = stored(dealt.mapInArrow(run, ROW + ", edge int, text string, part int"), "neighbours")

    def close(batches):
        # rows: the last of a task, with the text of the first row of the next task
        s = Sampler(samples)
        for b in batches:
            for part in pieces(b, 1, PIECE):
                ids, own, nexts = (part.column(i).to_pylist() for i in range(3))
                edited = edit(own, nexts)
                sigs = s.sign(pa.array(own + edited + nexts, pa.string())).reshape(3, len(ids), -1)
                yield batch(results(ids, own, edited, sigs[0], sigs[1], sigs[2]), []).select(names)

    # tasks that have rows, each with the next such task, the last with the first: two numbers a task
    every = out.where("edge = 1").select("part")
    order = Window.orderBy("part")
    nexts = every.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("after"))
    firsts = out.where("edge = 0").select(F.col("part").alias("after"), F.col("text").alias("next"))
    edges = out.where("edge = 1").select("part", "doc_id", "text").join(nexts, "part").join(firsts, "after").select("doc_id", "text", "next")
    return out.where("edge is null").select(*names).unionByName(edges.mapInArrow(close, ROW))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents"))
