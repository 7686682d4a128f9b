"""N-gram Jaccard join with Bayesian pruning: MinHash values are compared a few at a time, a pair is dropped once the posterior
probability that its similarity reaches the threshold is below a tolerance, and the rest are verified exactly."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import WordHash, doc_key, key_seed, mix, runs, shingles, stored, table

#: Words of a shingle, similarity of a link.
SHINGLE, THRESHOLD = 5, 0.8
#: MinHash values; bands of so many of them bring pairs together. A pair at the threshold misses all bands with probability (1 - 0.8**4)**32 = 5e-8.
HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
#: Values compared at once, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-7
#: Members of a bucket that one task compares; larger buckets are cut into tiles, and every two tiles meet in a task of their own.
TILE = 2048

_seed = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS, SHIFTS = _seed[:HASHES] | np.uint64(1), _seed[HASHES:]


def minhash(x: np.ndarray) -> np.ndarray:
    """The least of each hash over a set of shingles, as 32 bits; no shingles: all ones."""
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for i in range(0, len(x), 2048):
        h = np.multiply.outer(FACTORS, x[i : i + 2048])
        h += SHIFTS[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For STEP, 2 STEP, ... compared values: the fewest matches with which P(similarity >= threshold | matches), under a uniform
    prior, reaches the tolerance. That posterior, a tail of Beta(m + 1, n - m + 1), is P(Bin(n + 1, threshold) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        p, m = 0.0, 0
        while m <= n:
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if p >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def signatures(docs: DataFrame, seed: int = 0) -> DataFrame:
    """key, doc_id, cls (digest of the set of shingles), sig (16 bits of each MinHash value), bands: one row per row of docs."""

    def run(batches):
        words = WordHash()
        for b in batches:
            cls, sigs = [], np.empty((b.num_rows, HASHES), np.uint32)
            none = np.zeros(b.num_rows, bool)
            for i, t in enumerate(b.column("text").to_pylist()):
                x = shingles((t or "").encode("utf-8", "replace").split(), words, SHINGLE)
                cls.append(xxhash.xxh3_128_digest(x.tobytes()))
                sigs[i], none[i] = minhash(x), not len(x)
            h = np.zeros((b.num_rows, BANDS), np.uint64)
            parts = sigs.reshape(-1, BANDS, ROWS).astype(np.uint64)
            for j in range(ROWS):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j] + np.uint64(1))
            h = (h >> np.uint64(6)) | (np.arange(BANDS, dtype=np.uint64) << np.uint64(58))
            bands = [None if n else r for n, r in zip(none, h.astype(np.int64), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.array(cls, pa.binary()), pa.array([r.tobytes() for r in sigs.astype(np.uint16)], pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["key", "doc_id", "cls", "sig", "bands"])

    rows = docs.select(doc_key(seed).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(run, "key long, doc_id long, cls binary, sig binary, bands array<long>")
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "signatures")


def compare(sig: np.ndarray, bands: np.ndarray, band: int, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, fewest: list[int]):
    """Linked pairs (i, array of j) of one bucket, or of two of its tiles. Pairs that share an earlier band are left to it."""
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(ids.max()) + 1, bool)
    for at, i in enumerate(left.tolist()):
        js = left[at + 1 :] if right is None else right
        if band:
            js = js[~(bands[js, :band] == bands[i, :band]).any(axis=1)]
        low, high = np.minimum(sizes[js], sizes[i]), np.maximum(sizes[js], sizes[i])
        js = js[low >= THRESHOLD * high]
        matches = np.zeros(len(js), np.int64)
        for k, need in enumerate(fewest):
            if not len(js):
                break
            part = slice(k * STEP, (k + 1) * STEP)
            matches = matches + (sig[js, part] == sig[i, part]).sum(axis=1)
            ok = matches >= need
            js, matches = js[ok], matches[ok]
        if not len(js):
            continue
        mark[ids[starts[i] : starts[i] + sizes[i]]] = True
        n = sizes[js]
        flat = np.repeat(starts[js] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        common = np.add.reduceat(mark[ids[flat]].astype(np.int64), np.cumsum(n) - n)
        mark[ids[starts[i] : starts[i] + sizes[i]]] = False
        js = js[common * 10 >= 8 * (n + sizes[i] - common)] if THRESHOLD == 0.8 else js[common >= THRESHOLD * (n + sizes[i] - common)]
        if len(js):
            yield i, js


def near_join(docs: DataFrame, seed: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id: a whole number, text): key (doc_key by seed; None: one without collisions), doc_id, class_id, rep_id, n_links, kept.

    Similarity is the Jaccard of the sets of word 5-grams (fewer words: the text is one shingle). Documents with the same set
    are one class of copies, with rep_id the smallest doc_id (null last). n_links counts the other documents with similarity
    of 0.8 or more, copies included; class_id is the smallest doc_id of the group that links join, and kept marks one row of
    each group, that of the smallest doc_id. Texts without words are copies of each other and link to nothing else. Repeated
    rows are copies. No rows: no rows.

    Only representatives of classes are compared. Buckets of one band value are formed from hashes alone; buckets with the
    same members in several bands are kept once; singles go. Texts travel only for members of buckets that are left. A
    task compares a bucket, or two tiles of a large one, and returns a count for each member and a spanning forest, never
    pairs, so what leaves a group of near copies is in proportion to its members.
    """
    seed = key_seed(docs) if seed is None else seed
    t = signatures(docs, seed)
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")
    classes = stored(t.groupBy("cls").agg(F.min(order).alias("r"), F.count("*").alias("size")).select("cls", F.col("r.row").alias("rep"), F.col("r.doc_id").alias("rep_id"), "size"), "classes")
    reps = t.join(classes.select(F.col("rep").alias("row"), "size"), "row")
    banded = reps.select("row", F.explode("bands").alias("bucket"))
    kept = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("members"), F.min("row").alias("least")).where("n > 1")
    kept = kept.groupBy("n", "members", "least").agg(F.min("bucket").alias("bucket"))
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    at = banded.join(kept.select("bucket", tiles.alias("m")), "bucket").withColumn("tile", F.pmod(F.xxhash64("row"), "m").cast("int"))
    places = at.groupBy("row").agg(F.collect_list(F.struct("bucket", "m", "tile")).alias("places"))
    texts = docs.select(doc_key(seed).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    if not t.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # repeated rows: one text for each key, and one for each partition before they travel, so that they are no more to compare
        texts = texts.groupBy("key").agg(F.first("text").alias("text"))
    members = places.join(reps.select("row", "key", "sig", "bands", "size"), "row").join(texts, "key")
    members = members.select("row", "sig", "bands", "size", "text", F.explode("places").alias("p")).select("row", "sig", "bands", "size", "text", "p.bucket", "p.m", "p.tile")
    other = F.explode(F.when(F.col("m") > 1, F.sequence(F.lit(0), F.col("m") - 1)).otherwise(F.array("tile")))
    members = members.withColumn("other", other).select("bucket", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"), "tile", "row", "sig", "bands", "size", "text")
    fewest = least_matches()

    def run(batches):
        import pandas as pd

        words = WordHash()
        keys = lambda b: np.column_stack([b.bucket, b.ti, b.tj]).astype(np.int64).view([("", np.int64)] * 3).ravel()
        for g in runs(batches, keys):
            g = g.drop_duplicates("row")
            if len(g) < 2:
                continue
            sig = np.vstack([np.frombuffer(s, np.uint16) for s in g.sig])
            bands, tile, size = np.vstack(g.bands.to_numpy()), g.tile.to_numpy(), g["size"].to_numpy()
            sets = [shingles(x.encode("utf-8", "replace").split(), words, SHINGLE) for x in g.text]
            ti, tj = int(g.ti.iloc[0]), int(g.tj.iloc[0])
            left = np.flatnonzero(tile == ti)
            right = None if ti == tj else np.flatnonzero(tile == tj)
            links, parent, edges = np.zeros(len(g), np.int64), list(range(len(g))), []
            rows = g["row"].to_numpy()

            def root(i, parent=parent):
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for i, js in compare(sig, bands, int(g.bucket.iloc[0]) >> 58, sets, left, right, fewest):
                links[i] += size[js].sum()
                np.add.at(links, js, size[i])
                for j in js.tolist():
                    a, b = root(i), root(j)
                    if a != b:
                        parent[a] = b
                        edges.append((rows[i], rows[j]))
            hit = np.flatnonzero(links)
            if len(hit):
                yield pd.DataFrame({"row": np.r_[rows[hit], [a for a, _ in edges]].astype(np.int64), "links": np.r_[links[hit], np.zeros(len(edges), np.int64)], "other": pd.array([None] * len(hit) + [b for _, b in edges], "Int64")})

    found = stored(members.repartition("bucket", "ti", "tj").sortWithinPartitions("bucket", "ti", "tj", "row").mapInPandas(run, "row long, links long, other long"), "links")
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("other is not null").select(F.col("row").alias("src"), F.col("other").alias("dst")))
    reps = classes.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").join(links.select(F.col("row").alias("rep"), "links"), "rep", "left")
    reps = reps.withColumn("component", F.coalesce("component", "rep"))
    firsts = reps.groupBy("component").agg(F.min(F.struct(F.col("rep_id").isNull().alias("no"), "rep_id", "rep")).alias("f"))
    reps = reps.join(firsts, "component").select("cls", "rep_id", "size", F.coalesce("links", F.lit(0)).alias("links"), F.col("f.rep_id").alias("class_id"), F.col("f.rep").alias("first"))
    return t.select("key", "doc_id", "cls", "row").join(reps, "cls").select("key", "doc_id", "class_id", "rep_id", (F.col("links") + F.col("size") - 1).alias("n_links"), (F.col("row") == F.col("first")).alias("kept"))


def op6_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(table(spark, sf_dir, "documents")).drop("key")
