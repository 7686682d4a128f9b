"""Mixing sources to target weights, by DataFrame functions only: Efraimidis-Spirakis keys sorted within a source, prefix-summed to the source's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, quoted, stored, table

WEIGHTS, SHARE, MOST, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, "mix"
#: Rows that a slice of a source's key range holds on average: what one window task sorts.
SLICE_ROWS = 2_000
#: Slices whose sums one window task takes.
BLOCK_SLICES = 4_096


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, n: Column) -> Column:
    """A weight from 1 to 2: 2 where words have six characters on average, as prose does, 1 far from that or without words."""
    chars = F.length(text).cast("double")
    return F.when(n > 0, 1.0 + F.greatest(F.lit(0.0), 1.0 - F.abs(chars / n - 6.0) / 6.0)).otherwise(1.0)


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, rows, target: weights go to sources by code point (null last), over and over; a target stops at
    most x its source's size, and the excess is shared again by weight. Closed form: with sources by cap / weight, the level
    is that of the first source which it does not fill (later ones, wrongly taking earlier ones as full, have lower levels). The windows here see one row for each source."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    every = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1)
    s = s.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(Window.partitionBy()))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("t", (F.col("total") - before) / rest)
    level = F.max(F.when(F.col("t") * F.col("w") <= F.col("cap"), F.col("t"))).over(Window.partitionBy())
    return s.select("source", "source_size", "rows", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def _keyed(docs: DataFrame, seed: str, *more: Column) -> DataFrame:
    """doc_id, source, size, e (the exponential key, by quality weight) of each row, and more columns."""
    text = F.coalesce("text", F.lit(""))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text)), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    base = docs.select("doc_id", "source", size(F.col("text")).alias("size"), quality(text, size(F.col("text"))).alias("q"), u.alias("u"), *more)
    return base.withColumn("e", -F.ln("u") / F.col("q")).drop("u", "q")


def _mixed(docs: DataFrame, weights, share: float, most: float, seed: str) -> DataFrame:
    base = stored(_keyed(docs, seed), "sized")
    per = targets(base, weights, share, most)
    rows = base.alias("b").join(per.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.*", "source_size", "rows", "target")
    slices = F.ceil(F.col("rows") / F.lit(float(SLICE_ROWS)))
    rows = rows.withColumn("slice", F.least(F.floor((1.0 - F.exp(-F.col("e"))) * slices), slices - 1))
    # sums ahead of each slice: of earlier blocks of slices, and of earlier slices of the block
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("words")).withColumn("block", F.floor(F.col("slice") / BLOCK_SLICES))
    blocks = sums.groupBy("source", "block").agg(F.sum("words").alias("words")).select(F.col("source").alias("s"), F.col("block").alias("k"), F.coalesce(F.sum("words").over(before("source", "block")), F.lit(0)).alias("far"))
    sums = sums.withColumn("near", F.coalesce(F.sum("words").over(before("source", "block", "slice")), F.lit(0)))
    sums = sums.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k"))).select("source", "slice", (F.col("far") + F.col("near")).alias("ahead"))
    inside = Window.partitionBy("source", "slice").orderBy("e", F.asc_nulls_last("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.alias("r").join(sums.alias("a"), F.col("r.source").eqNullSafe(F.col("a.source")) & (F.col("r.slice") == F.col("a.slice"))).select("r.*", "ahead")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("long")
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    return rows.withColumn("epochs", epochs).withColumn("fits", (F.col("ahead") + F.col("within") + F.col("size") / 2.0 <= left) & (F.col("size") > 0))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, size, source, source_size, target, copies, taken.

    Size counts the words of the text (null: 0). Each source takes as many complete epochs as its target holds; the rest goes
    to documents in the order of -ln(u) / quality, where u is a hash of seed, doc_id and text, up to the document at which the
    budget ends, which is taken if at least half of it fits: a source misses its target by half a document at most. A source's
    key range is cut into slices of about SLICE_ROWS, which are summed first, so a source with most of the rows is many tasks.
    Null text: size 0. A null source is a source, the last. Rows that repeat all of doc_id, text and source are interchangeable.
    No rows: no rows. Reruns agree: nothing is drawn at random.
    """
    rows = _mixed(docs, weights, share, most, seed).withColumn("copies", F.col("epochs") + F.col("fits").cast("long"))
    return rows.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """doc (all columns of docs, whatever their names, as a struct) and copies: the mix of mix(), for every row of docs.

    In each source the documents beyond the complete epochs are those up to a last one in the order of keys. So documents don't travel:
    the mix of keys gives each source's last key, and each row is compared with that. Of rows that repeat the last key, as many as
    the mix takes are taken; they are counted in slices.
    """
    order = lambda: F.struct("e", F.col("doc_id").isNull().alias("no"), "doc_id", "size")
    rows = stored(_mixed(docs, weights, share, most, seed).select("source", order().alias("at"), "epochs", "fits"), "mixed")
    last = rows.groupBy("source").agg(F.max(F.when(F.col("fits"), F.col("at"))).alias("last"), F.first("epochs").alias("epochs"))
    ties = rows.alias("r").join(last.alias("l"), F.col("r.source").eqNullSafe(F.col("l.source")) & (F.col("r.at") == F.col("l.last"))).groupBy(F.col("r.source").alias("source")).agg(F.count("*").alias("tied"), F.count_if(F.col("fits")).alias("some"))
    cuts = last.alias("l").join(ties.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source")), "left").select(F.col("l.source").alias("of"), "last", "epochs", "tied", "some")
    cuts = stored(cuts, "cuts")
    every = _keyed(docs, seed, F.struct(*quoted(docs)).alias("doc")).withColumn("at", order())
    every = every.join(cuts, F.col("source").eqNullSafe(F.col("of")))
    under = F.coalesce((F.col("size") > 0) & (F.col("at") <= F.col("last")), F.lit(False))
    part = F.coalesce((F.col("at") == F.col("last")) & (F.col("some") < F.col("tied")), F.lit(False))
    if cuts.where("some < tied").isEmpty():
        return every.select("doc", (F.col("epochs") + under.cast("long")).alias("copies"))
    tied = stored(every.where(part).select("of", "doc", "epochs", "tied", "some", F.monotonically_increasing_id().alias("row")), "tied")
    tied = tied.withColumn("slice", F.pmod(F.xxhash64("row"), F.ceil(F.col("tied") / F.lit(float(SLICE_ROWS))).cast("long")))
    n = tied.groupBy("of", "slice").agg(F.count("*").alias("n"))
    n = n.select(F.col("of").alias("o"), F.col("slice").alias("s"), F.coalesce(F.sum("n").over(Window.partitionBy("of").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    tied = tied.withColumn("r", F.row_number().over(Window.partitionBy("of", "slice").orderBy("row"))).join(n, F.col("of").eqNullSafe(F.col("o")) & (F.col("slice") == F.col("s")))
    tied = tied.select("doc", (F.col("epochs") + (F.col("ahead") + F.col("r") <= F.col("some")).cast("long")).alias("copies"))
    return every.where(~part).select("doc", (F.col("epochs") + under.cast("long")).alias("copies")).unionByName(tied)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB: the same mix of `{docs}`; the last select gives copies as well.
def sql(docs: str = "documents", select: str = "doc_id, size, source_size, target, copies * size AS taken") -> str:
    return f"""
WITH a AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM {docs}),
b AS (SELECT *, -ln(u) / CASE WHEN size > 0 THEN 1e0 + greatest(0e0, 1e0 - abs(length(text)::DOUBLE / size - 6e0) / 6e0) ELSE 1e0 END AS e FROM a),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM b GROUP BY source),
s2 AS (SELECT *, [5e0, 2e0, 1e0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2e0 * source_size AS cap, 1.5e0 * sum(source_size) OVER ()::DOUBLE AS total FROM s),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t FROM s2),
s4 AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN t * w <= cap THEN t END) OVER () * w, cap)) AS target FROM s3),
c AS (SELECT b.*, s4.source_size, s4.target, coalesce(sum(size) OVER (PARTITION BY b.source ORDER BY e, b.doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 1 END AS epochs FROM b JOIN s4 ON b.source IS NOT DISTINCT FROM s4.source),
d AS (SELECT *, epochs + (size > 0 AND ahead + size / 2e0 <= target - epochs * source_size)::INT AS copies FROM c)
SELECT {select} FROM d
"""


ORACLE = sql()
