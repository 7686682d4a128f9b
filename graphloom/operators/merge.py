"""Merging: evidence across chunks, duplicate entities, two graphs. Ties go to the first row by seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def aggregate_triples(rows: DataFrame) -> DataFrame:
    """src, relation, dst, confidence (mean over occurrences, 1 at most), chunk_ids (sorted, distinct), vote_count of occurrences (src, relation, dst, confidence, chunk_id)."""
    g = rows.groupBy("src", "relation", "dst").agg(F.least(F.lit(1.0), F.avg("confidence")).alias("confidence"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return g.withColumn("vote_count", F.size("chunk_ids").cast("long"))


def aggregate_entities(rows: DataFrame) -> DataFrame:
    """One row per id of rows (id, seq, description, parent, synonyms, chunk_id): the longest description, the last parent, synonyms in order, chunks."""
    order = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(x).alias("v")))), lambda s: s.v)
    return rows.groupBy("id").agg(
        F.min_by("description", F.struct(-F.length(F.coalesce("description", F.lit(""))), "seq")).alias("description"),
        F.max_by("parent", F.when(F.col("parent").isNotNull(), F.col("seq"))).alias("parent"),
        F.array_distinct(F.flatten(order("synonyms"))).alias("synonyms"),
        F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"),
    )


def dedup_classes(rows: DataFrame) -> DataFrame:
    """One row per lower-case trimmed name of rows (name, seq, parent, description, synonyms): the spelling of an entry with a parent before others, then of the longest description, later ones first."""
    key = F.lower(F.trim("name")).alias("key")
    best = F.max_by("name", F.struct(F.col("parent").isNotNull().cast("int"), F.length(F.coalesce("description", F.lit(""))), "seq"))
    return rows.groupBy(key).agg(
        best.alias("name"),
        F.max_by("parent", F.when(F.col("parent").isNotNull(), F.col("seq"))).alias("parent"),
        F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), "seq")).alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("synonyms")))).alias("synonyms"),  # a class that many chunks name has few different lists
    )


def merge_descriptions(rows: DataFrame) -> DataFrame:
    """Fold of rows (id, seq, description, chunk_ids) by seq: a new text replaces one of under 20 characters, otherwise the longer stays; chunk ids are united."""
    steps = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("description", F.lit("")).alias("d"))))
    fold = F.aggregate(steps, F.lit(""), lambda acc, x: F.when((F.length(acc) < 20) & (x.d != ""), x.d).when(F.length(x.d) > F.length(acc), x.d).otherwise(acc))
    return rows.groupBy("id").agg(fold.alias("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))).alias("chunk_ids")).withColumn("vote_count", F.size("chunk_ids").cast("long"))


def merge_edges(rows: DataFrame) -> DataFrame:
    """One row per (src, relation, dst) of rows (confidence, vote_count, chunk_ids): confidence weighted by votes, 1 at most."""
    votes = F.greatest(F.col("vote_count"), F.lit(1))
    return rows.groupBy("src", "relation", "dst").agg(F.least(F.lit(1.0), F.sum(F.col("confidence") * votes) / F.sum(votes)).alias("confidence"), F.sum("vote_count").alias("vote_count"))


def digraph_view(edges: DataFrame) -> DataFrame:
    """The last relation by seq of each (src, dst): what a graph with one edge for each pair holds."""
    return edges.groupBy("src", "dst").agg(F.max_by("relation", "seq").alias("relation"))


def merge_graphs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by keys; the left one's values win, source_documents are united."""
    both = left.withColumn("_p", F.lit(0)).unionByName(right.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in left.columns if c not in keys and c != "source_documents"]
    aggs = [F.min_by(F.struct(*rest), "_p").alias("_v")] if rest else []
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_documents")))).alias("source_documents")] if "source_documents" in left.columns else []
    out = both.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *([f"_v.{c}" for c in rest]), *(["source_documents"] if "source_documents" in left.columns else []))


def infer_votes(rows: DataFrame, least: int = 3, bonus: float = 0.1) -> DataFrame:
    """Inferred relations (src, relation, dst, confidence) by triple: the highest confidence, with a bonus from least votes on."""
    g = rows.groupBy("src", "relation", "dst").agg(F.max("confidence").alias("c"), F.count("*").alias("vote_count"))
    return g.select("src", "relation", "dst", F.when(F.col("vote_count") >= least, F.least(F.lit(1.0), F.col("c") + bonus)).otherwise(F.col("c")).alias("confidence"), "vote_count")


def merge_counters(old_nodes, new_nodes, old_edges, new_edges) -> DataFrame:
    """One row: new_nodes, updated_nodes, new_edges that a merge would bring."""
    a = new_nodes.select("id").distinct().join(old_nodes.select("id").distinct().withColumn("old", F.lit(1)), "id", "left").agg(F.count_if(F.expr("old is null")).alias("new_nodes"), F.count("old").alias("updated_nodes"))
    k = ["src", "relation", "dst"]
    b = new_edges.select(*k).distinct().join(old_edges.select(*k), k, "left_anti").agg(F.count("*").alias("new_edges"))
    return a.join(b)


def cooccurrence(members: DataFrame, related: DataFrame, least: int = 2, tile: int = 1024) -> DataFrame:
    """(a, b, shared): pairs of entities that share least chunks, from members (id, chunk_id), without pairs that related (src, dst)
    has in either direction. The join is by chunk, not by pair; a chunk of over tile entities is dealt into tiles of about so many, and
    each two of its tiles meet as a key of their own, so that no task compares a whole hot chunk. One count tells whether there is one."""
    m = members.select("id", "chunk_id").distinct()
    largest = members.groupBy("chunk_id").agg(F.count("*").alias("n")).where("chunk_id is not null").agg(F.max("n")).first()[0] or 0
    pairs = _tiled_pairs(m, tile) if largest > tile else m.withColumnRenamed("id", "a").join(m.withColumnRenamed("id", "b"), "chunk_id").where("a < b")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    known = related.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.join(known, ["a", "b"], "left_anti")


def _tiled_pairs(m: DataFrame, tile: int) -> DataFrame:
    """(a, b), a < b, for each chunk of distinct (id, chunk_id) that has both; a task's key holds two tiles at most."""
    tiles = m.groupBy("chunk_id").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    t = m.join(tiles, "chunk_id").withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")))
    t = t.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumn("x", F.least("t", "o")).withColumn("y", F.greatest("t", "o"))
    left, right = t.select("chunk_id", "x", "y", F.col("id").alias("a"), F.col("t").alias("p")), t.select("chunk_id", "x", "y", F.col("id").alias("b"), F.col("t").alias("q"))
    # two entities of one tile meet where it is paired with itself only
    return left.join(right, ["chunk_id", "x", "y"]).where("a < b and (p != q or x = y)")


def interleave(rows: DataFrame, batch: int) -> DataFrame:
    """Round robin over components of rows (id, component, seq), in the order of each one's first seq: adds turn (within the component), place in the
    interleaved list, and batch, of a fixed number of rows each. The place is what earlier turns hold and the rank within the turn;
    earlier turns are summed by blocks of turns first, so no window spans all rows."""
    first = rows.groupBy("component").agg(F.min("seq").alias("_first"))
    turn = F.row_number().over(Window.partitionBy("component").orderBy("seq")) - 1
    rows = rows.withColumn("turn", turn).join(first, "component")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("turn").orderBy("_first", "component")) - 1)
    per = rows.groupBy("turn").agg(F.count("*").alias("k")).withColumn("_b", F.floor(F.col("turn") / 4096))
    ahead = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = per.groupBy("_b").agg(F.sum("k").alias("k")).select("_b", F.coalesce(F.sum("k").over(ahead("_b")), F.lit(0)).alias("_far"))
    per = per.withColumn("_near", F.coalesce(F.sum("k").over(ahead("_b", "turn")), F.lit(0))).join(blocks, "_b").select("turn", (F.col("_far") + F.col("_near")).alias("_before"))
    rows = rows.join(per, "turn").withColumn("place", F.col("_before") + F.col("_r"))
    return rows.withColumn("batch", F.floor(F.col("place") / batch)).drop("_first", "_r", "_before")
