"""URL filter: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import table

#: Host, path, verdict of the production rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds on the listed rules that are sent to every executor, in rows and bytes; above them the exact join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from there up to ? # or the end. Null or no ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict.

    listed: host, path, verdict and, optionally, exact (boolean). A rule fits its host and all subdomains when the path
    starts with the rule's; an exact entry fits only its own host and path. The longest fitting entry wins (ties: the longer
    host, then block before allow); where none fits, rule is null and verdict is default. Each url makes one key for each
    shape that the list has; the Bloom filter, of bounded size, drops keys that are certainly not listed; an equi-join with
    the list drops its false positives. Null ids and repeated rows are kept; null urls have an empty host and path; an
    empty list judges everything by default; other columns of pages are ignored.
    """
    if "exact" not in listed.columns:
        listed = listed.withColumn("exact", F.lit(False))
    tag = F.when(F.col("exact"), "=").otherwise("^")
    rules = listed.select(F.concat(tag, "host", "path").alias("key"), F.concat("host", "path").alias("rule"), F.length("host").alias("hl"), "verdict", "exact",
                          F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).where("key is not null")
    rules = rules.groupBy("key").agg(F.first("rule").alias("rule"), F.first("hl").alias("hl"), F.max("verdict").alias("verdict"), F.first("exact").alias("exact"), F.first("labels").alias("labels"), F.first("chars").alias("chars"))
    # what a url is looked up by: the different (labels of the host, characters of the path) of the prefix rules, in one row
    shapes = rules.where("not exact").agg(F.sort_array(F.collect_set(F.struct("labels", "chars"))).alias("shapes"))
    n, size = rules.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key") + F.octet_length("rule") + 32), F.lit(0))).first()
    bits = pages.sparkSession.sparkContext.broadcast(bloom.build(rules.select(F.xxhash64("key").alias("h")), "h", n, max_bytes))

    @F.arrow_udf("array<boolean>")
    def maybe(h: pa.Array) -> pa.Array:
        flags = bloom.probe(bits.value, h.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        lengths = np.r_[0, np.cumsum(h.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(lengths), pa.array(flags))

    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    tail = lambda k: F.array_join(F.slice("parts", F.greatest(F.lit(1), F.size("parts") - k + 1), k), ".")
    keys = F.transform(F.filter("shapes", lambda s: F.length("path") >= s.chars), lambda s: F.concat(F.lit("^"), tail(s.labels), F.substring("path", F.lit(1), s.chars)))
    rows = rows.withColumn("parts", F.split("host", r"\.")).join(F.broadcast(shapes)).withColumn("keys", F.array_distinct(F.concat(F.array(F.concat(F.lit("="), "host", "path")), keys))).drop("parts", "shapes")
    rows = rows.withColumn("flags", maybe(F.transform("keys", lambda k: F.xxhash64(k))))
    rows = rows.withColumn("key", F.explode_outer(F.filter("keys", lambda k, i: F.get("flags", i)))).select("row", "id", "host", "path", "key")
    small = rules.select("key", "rule", "hl", "verdict")
    # a url without a possible hit gets a key of its own that no rule has, so that such urls don't meet in one task
    rows = rows.withColumn("key", F.coalesce("key", F.concat(F.lit("\0"), F.col("row").cast("string"))))
    hit = rows.join(F.broadcast(small) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else small, "key", "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("l"), F.col("hl"), F.col("verdict"), F.col("rule"))))
    out = hit.groupBy("row").agg(F.first("id").alias(id_col), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("b"))
    return out.select(id_col, "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


ORACLE = """
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM q)
"""
