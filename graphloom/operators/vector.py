"""Vectors and names: a pluggable encoder with a hashing default, canonical names, orphan links, bridges between components."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..scratch import stored
from .components import connected_components
from .nearby import similar_pairs
from .quality import node_components
from .retrieve import dot, top_k

DIMENSIONS = 64


#: Characters that the encoder takes at a time.
CHARACTERS = 1 << 20


def _trigram_hashes(b: np.ndarray) -> np.ndarray:
    """CRC-32 of each three bytes in a row."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    c = np.full(max(0, len(b) - 2), 0xFFFFFFFF, np.uint32)
    for j in range(3):
        c = table[(c ^ b[j : j + len(c)]) & 0xFF] ^ (c >> 8)
    return ~c


def hash_encoder(dimensions: int = DIMENSIONS):
    """Texts to unit vectors by signed feature hashing of words and character trigrams: deterministic, without a model."""

    def hashed(low: list[str]) -> np.ndarray:
        words = [t.split() for t in low]
        grams = [[t[j : j + 3] for j in range(len(t) - 2)] if not t.isascii() else [] for t in low]
        parts = [([len(x) for x in some], np.fromiter((zlib.crc32(w.encode()) for x in some for w in x), np.uint32)) for some in (words, grams)]
        rows = [np.repeat(np.arange(len(low)), n) for n, _ in parts]
        plain = [t if t.isascii() else "" for t in low]
        size = np.fromiter(map(len, plain), np.int64, len(plain))
        of = np.repeat(np.arange(len(low)), size)[:-2]
        inside = of == np.repeat(np.arange(len(low)), size)[2:]
        h = np.concatenate([*(h for _, h in parts), _trigram_hashes(np.frombuffer("".join(plain).encode(), np.uint8))[inside]])
        at = np.concatenate([*rows, of[inside]]) * dimensions + h % dimensions
        return np.bincount(at, np.where(h & np.uint32(0x80000000), 1.0, -1.0), len(low) * dimensions).reshape(-1, dimensions)

    def encode(texts: list[str]) -> np.ndarray:
        low, out = [(t or "").lower() for t in texts], np.zeros((len(texts), dimensions), np.float32)
        i = 0
        while i < len(low):
            j, n = i, 0
            while j < len(low) and (j == i or n + len(low[j]) <= CHARACTERS):
                n += len(low[j])
                j += 1
            out[i:j] = hashed(low[i:j])
            i = j
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    return encode


def encode(rows: DataFrame, column: str, make=hash_encoder, out: str = "vector") -> DataFrame:
    """rows with a vector of a text column; make() is called once in each task, so a model is loaded once. Equal texts of a batch are encoded once."""

    import pandas as pd

    def vectors(batches):
        encoder = make()
        for s in batches:
            of, texts = pd.factorize(s.fillna(""))
            v = encoder(list(texts))
            yield pd.Series([v[i] for i in of])

    vectors.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(out, F.pandas_udf(vectors, "array<float>")(F.col(column)))


def canonical_names(names: DataFrame, threshold: float = fixed.TOKEN_OVERLAP, make=hash_encoder, near: float = fixed.CANONICAL_COSINE, lemmas: text.Lemmas | None = None) -> DataFrame:
    """name, canonical, of names (name, seq): equal normal forms (with lemmas, of lemmas) are one; then names whose words overlap by threshold join, and
    each group takes the name of its first row; then, unless make is None, a group joins the first earlier one that stands for itself and whose name has a cosine of near or more. Candidates share a rare word: each name is indexed under its least frequent
    words, as many as two names with that overlap can't both lack, so frequent words make no pairs."""
    normal = text.lemmatised("name", lemmas) if lemmas else text.normal_name("name")
    n = names.withColumn("norm", text.exact_name(normal))
    heads = n.groupBy("norm").agg(F.min(F.struct("seq", "name")).alias("h")).select("norm", "h.seq", F.col("h.name").alias("head"))
    ws = heads.select("norm", F.array_distinct(text.words("norm")).alias("words"))
    freq = ws.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("f"))
    ranked = ws.select("norm", F.explode("words").alias("word")).join(freq, "word").groupBy("norm").agg(F.array_sort(F.collect_list(F.struct("f", "word"))).alias("w"))
    k = F.size("w") - F.ceil(F.lit(threshold) * F.size("w")) + 1
    index = ranked.select("norm", F.explode(F.slice("w", F.lit(1), k.cast("int"))).alias("x")).select("norm", F.col("x.word").alias("word"))
    pairs = index.join(index.select(F.col("norm").alias("other"), "word"), "word").where("norm < other").select("norm", "other").distinct()
    pairs = pairs.where(text.token_overlap("norm", "other") >= threshold)
    comps = connected_components(pairs, "norm", "other").withColumnRenamed("node", "norm")
    groups = heads.join(comps, "norm", "left").withColumn("component", F.coalesce("component", "norm"))
    first = groups.groupBy("component").agg(F.min_by("head", "seq").alias("canonical"), F.min("seq").alias("seq"))
    if make is not None:
        first = stored(first, "groups")
        led = clusters(encode(first.select(F.col("seq").alias("vec_id"), "canonical"), "canonical", make).select("vec_id", "vector"), near)
        heads = first.select(F.col("seq").alias("leader"), F.col("canonical").alias("joined"))
        first = first.join(led.withColumnRenamed("vec_id", "seq"), "seq").join(heads, "leader").select("component", F.col("joined").alias("canonical"))
    return n.select("name", "norm").join(groups.select("norm", "component"), "norm").join(first, "component").select("name", "canonical")


def clusters(vectors: DataFrame, threshold: float = fixed.ORPHAN_COSINE, at_once: int = 500_000) -> DataFrame:
    """(vec_id, leader): greedy leaders in order of id. A vector that is like an earlier leader follows the first such one, any other leads.

    While over at_once pairs are open, a round on all executors lets the vectors without an open earlier neighbour lead, and what is like
    them follow; each round settles some, so it ends. So many pairs or fewer, two numbers each, are settled in order by one task. Both ways give the same leaders."""
    import pyarrow as pa

    def settle(batches):
        held = [np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
        led = set()
        for a, b in sorted(map(tuple, np.concatenate(held).tolist()), key=lambda r: r[1]) if held else ():
            if a not in led:
                led.add(b)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(led), pa.int64())], ["b"])

    pairs = stored(similar_pairs(vectors, threshold).select("a", "b"), "pairs")
    live, led = pairs, []
    while live.count() > at_once:
        led.append(stored(live.join(live.select(F.col("b").alias("a")).distinct(), "a", "left_anti").select("b").distinct(), "led"))
        live = stored(live.join(led[-1], "b", "left_anti").join(led[-1].withColumnRenamed("b", "a"), "a", "left_anti").select("a", "b"), "live")
    led = reduce(DataFrame.unionByName, [*led, live.repartition(1).mapInArrow(settle, "b long")])
    first = pairs.join(led.withColumnRenamed("b", "a"), "a", "left_anti").groupBy(F.col("b").alias("vec_id")).agg(F.min("a").alias("leader"))
    return vectors.select("vec_id").join(first, "vec_id", "left").select("vec_id", F.coalesce("leader", "vec_id").alias("leader"))


def link_orphans(nodes: DataFrame, edges: DataFrame, threshold: float = fixed.ORPHAN_COSINE, k: int = 1, make=hash_encoder) -> DataFrame:
    """Edges (src, related_to, dst) from nodes without edges to the most similar connected node, or its parent: nodes with id, seq, description. Only the first of the k nearest makes an edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    label = F.concat_ws(" ", "id", F.coalesce("description", F.lit("")))
    v = encode(nodes.select("id", "seq", label.alias("label")), "label", make).select("id", F.col("seq").alias("vec_id"), "vector")
    orphans = v.join(ends, "id", "left_anti").select(F.col("vec_id").alias("query_id"), "vector", F.col("id").alias("src"))
    near = top_k(orphans, v.join(ends, "id", "left_semi"), k).where(F.col("score") >= threshold)
    best = near.groupBy("query_id").agg(F.min_by("vec_id", "rank").alias("vec_id"), F.max("score").alias("score"))
    parent = edges.where("relation = 'subClassOf'").groupBy(F.col("src").alias("hit")).agg(F.min("dst").alias("parent"))
    out = best.join(orphans.select("query_id", "src"), "query_id").join(v.select("vec_id", F.col("id").alias("hit")), "vec_id").join(parent, "hit", "left")
    return out.select("src", F.lit("related_to").alias("relation"), F.coalesce("parent", "hit").alias("dst"), F.lit(0.85).alias("confidence"))


def bridge_components(nodes: DataFrame, edges: DataFrame, threshold: float | None = None, most: int = 50, make=hash_encoder, between: float = fixed.BRIDGE_COSINE) -> DataFrame:
    """Edges from each smaller component's representative (most edges, then first by seq) to the most similar node of the largest
    component, the most likely ones first, at most so many bridges. The other node of the largest component with the best mean similarity to both ends,
    if that is between or more, makes two edges of the bridge, by way of it. threshold: by default that of orphans, and 0.7 with more than 20 components."""
    comp = node_components(nodes, edges)
    size = comp.groupBy("component").agg(F.count("*").alias("n"))
    if threshold is None:
        threshold = min(fixed.ORPHAN_COSINE, fixed.MANY_COSINE) if size.count() > fixed.MANY_COMPONENTS else fixed.ORPHAN_COSINE
    largest = size.orderBy(F.desc("n"), "component").limit(1).select("component")
    deg = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("k"))
    full = nodes.join(comp, "id").join(deg, "id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    reps = full.join(largest, "component", "left_anti").groupBy("component").agg(F.min(F.struct((-F.col("k")).alias("k"), "seq", "id")).alias("r")).select("r.id", "r.seq")
    label = F.concat_ws(" ", "id", F.coalesce("description", F.lit("")))
    vec = encode(nodes.select("id", "seq", label.alias("label")), "label", make).select("id", F.col("seq").alias("vec_id"), "vector")
    q = vec.join(reps.select("id"), "id", "left_semi").select(F.col("vec_id").alias("query_id"), "vector", F.col("id").alias("src"))
    big = vec.join(full.join(largest, "component", "left_semi").select("id"), "id", "left_semi")
    near = top_k(q, big, 1).where(F.col("score") >= threshold).select("query_id", "vec_id", "score")
    out = near.join(q.withColumnRenamed("vector", "x"), "query_id").join(vec.select("vec_id", F.col("id").alias("dst"), F.col("vector").alias("y")), "vec_id")
    out = stored(out.orderBy(F.desc("score"), "src").limit(most), "bridges")
    # The mean of the cosines to two unit vectors is the product with half their sum, whose length is sqrt((1 + their cosine) / 2).
    unit = lambda c: F.transform(c, lambda x: x / (F.sqrt(dot(F.col(c), F.col(c))) + 1e-12))
    half = out.select("query_id", F.zip_with(unit("x"), unit("y"), lambda x, y: (x + y) / 2).alias("vector"))
    way = top_k(half, big, 2).withColumnRenamed("vec_id", "way_id").withColumnRenamed("score", "cos").drop("rank")
    way = way.join(out.select("query_id", "vec_id", "score"), "query_id").where("way_id != vec_id").withColumn("mean", F.col("cos") * F.sqrt((1 + F.col("score")) / 2)).where(F.col("mean") >= between)
    way = way.groupBy("query_id").agg(F.min_by("way_id", F.struct(-F.col("mean"), "way_id")).alias("way_id"), F.max("mean").alias("mean"))
    way = way.join(vec.select(F.col("vec_id").alias("way_id"), F.col("id").alias("way")), "way_id")
    ends = out.join(way, "query_id", "left").withColumn("score", F.coalesce("mean", "score"))
    steps = F.when(F.col("way").isNull(), F.array(F.struct("src", "dst"))).otherwise(F.array(F.struct("src", F.col("way").alias("dst")), F.struct(F.col("way").alias("src"), "dst")))
    return ends.select(F.explode(steps).alias("e"), "score").groupBy("e.src", "e.dst").agg(F.max("score").alias("score")).select("src", F.lit("related_to").alias("relation"), "dst", "score")
