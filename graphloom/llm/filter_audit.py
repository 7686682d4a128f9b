"""Filter interaction audit: what each of five text filters removes under every order. Duplicates are found by a range sort and a look at
the row before; each document becomes a mask of the filters that it fails, and masks are counted by part, so all orders follow from sums."""

from __future__ import annotations

import hashlib
import math
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, stored, table

FILTERS = "ABCDE"
#: A: fewer words than this. B: less than this share of distinct words, in percent. C: a larger share of capitals, in percent. D: holds one of these. E: repeats a smaller doc_id's text.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MASKS = 1 << len(FILTERS)
DUPLICATE = 1 << FILTERS.index("E")
ROW = "doc_id long, part string, mask int, key binary, head boolean"


def text_mask(text: bytes, chars: int) -> int:
    """Bits of the filters A to D that a text fails. Splitting bytes at white space splits at the six characters of the contracts."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    fails = (len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * capitals > MOST_CAPITALS * chars, len(text.translate(None, SYMBOLS)) < len(text))
    return sum(f << i for i, f in enumerate(fails))


def text_key(text: bytes) -> bytes:
    return hashlib.sha256(text).digest() + len(text).to_bytes(8, "big")


def _compare(batches):
    """A partition, sorted by fingerprint, text and doc_id, to its rows. A row repeats a smaller doc_id if the row before has its text and
    either a smaller doc_id or the mark itself. Another partition may hold rows of the first and of the last fingerprint: so the heads of
    their groups of equal texts go out as rows of their own (head is true), and rows of the first fingerprint that a smaller doc_id elsewhere
    would mark have the text's key."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("key", pa.binary()), ("head", pa.bool_())])
    first = last = text = doc = key = None
    marked, begun, heads = False, False, []

    def head_rows(found):
        return pa.RecordBatch.from_pylist([{"doc_id": d, "part": "", "mask": 0, "key": text_key(t), "head": True} for t, d in found], schema)

    for b in batches:
        masks, keys = np.zeros(b.num_rows, np.int32), [None] * b.num_rows
        prints, ids, chars, texts = (*(b.column(c).to_pylist() for c in ("fingerprint", "doc_id", "chars")), b.column("text"))
        for i in range(b.num_rows):
            t = texts[i].as_py()
            if not begun or prints[i] != last or t != text:
                if not begun:
                    first, begun = prints[i], True
                elif prints[i] != last:
                    if last == first:
                        yield head_rows(heads)
                    heads = []
                heads.append((t, ids[i]))
                marked, mask = False, text_mask(t, chars[i])
                key = text_key(t) if prints[i] == first else None
            elif not marked and doc != ids[i]:
                marked = True
            masks[i] = mask | DUPLICATE * marked
            keys[i] = None if marked else key
            last, text, doc = prints[i], t, ids[i]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(masks), pa.array(keys, pa.binary()), pa.array(np.zeros(b.num_rows, bool))], schema=schema)
    yield head_rows(heads)


def masks(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, part, mask: one row per row of docs (doc_id: a whole number, text, source), with a bit for each filter that it fails.

    Rows are sorted by the text's 64-bit fingerprint, the whole text and doc_id (null last). Ranges are cut by fingerprint and doc_id, so the
    driver samples numbers only, and a text with most of the rows is many partitions; where one is cut, the groups at
    both ends are joined by a SHA-256 and length of their text. Equal texts are equal bytes.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("fingerprint"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.length(text).alias("chars"), F.encode(text, "utf-8").alias("text"))
    keys = ["fingerprint", F.asc_nulls_last("doc_id")]
    rows = rows.repartitionByRange(parts or partitions(docs), *keys).sortWithinPartitions("fingerprint", "text", F.asc_nulls_last("doc_id"))
    rows = stored(rows.mapInArrow(_compare, ROW), "masks")
    starts = rows.where("head").groupBy("key").agg(F.min("doc_id").alias("start"))
    open_ = rows.where("not head and key is not null").join(starts, "key")
    later = F.col("start").isNotNull() & (F.col("doc_id").isNull() | (F.col("start") < F.col("doc_id")))
    open_ = open_.select("doc_id", "part", (F.col("mask") + F.when(later, DUPLICATE).otherwise(0)).alias("mask"))
    return rows.where("not head and key is null").select("doc_id", "part", "mask").unionByName(open_)


def counters(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and mask, and how many of them are good or toxic, as a row of labels says."""
    says = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0)).alias(c)
    told = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").alias("of")).agg(says("quality"), says("toxic"))
    every = failed.groupBy("part", "mask").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    lost = failed.join(told, F.col("doc_id") == F.col("of")).groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))
    return every.unionByName(lost).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs: doc_id, text, source; labels: doc_id, quality, toxic; other columns are ignored. Null text: empty. Null source: the part with the
    empty name, like an empty one. A null doc_id is larger than any other, and has no label; rows that repeat a doc_id and its text don't
    fail E for each other. Repeated or null labels: one that says 1 counts. No documents: no rows.

    What travels of a document after the sort is its part and mask. Each part then has 32 counters at most. What a filter does
    depends on the set of filters before it alone, so counters are added up for 80 sets and filters, and these go to the orders and steps
    that have them. Summed over all orders, a filter removes 120 / k for each document that fails k filters, this one among them.
    """
    n = len(FILTERS)
    pairs = F.array(*(F.struct(F.lit(s).alias("before"), F.lit(1 << f).alias("bit")) for f in range(n) for s in range(MASKS) if not s >> f & 1))
    orders = [(sum(1 << FILTERS.index(x) for x in o[:k]), 1 << FILTERS.index(o[k]), "".join(o), k + 1) for o in permutations(FILTERS) for k in range(n)]
    steps = docs.sparkSession.createDataFrame(orders, "before int, bit int, filter_order string, step int")
    mask = F.col("mask")
    gone, bad = mask.bitwiseAND(F.col("x.before")) != 0, mask.bitwiseAND(F.col("x.bit")) != 0
    total = lambda when, c, name: F.sum(F.when(when, F.col(c)).otherwise(0)).alias(name)
    share = F.col("n") * (F.lit(math.factorial(n)) / F.bit_count(mask)).cast("long")
    sums = counters(masks(docs, parts), labels).withColumn("x", F.explode(pairs)).groupBy("part", "x.before", "x.bit").agg(
        total(~gone & ~bad, "n", "kept"), total(~gone & bad, "n", "removed"), total(gone & bad, "n", "redundant"), total(mask == F.col("x.bit"), "n", "unique_fails"),
        total(~gone & bad, "good", "good_lost"), total(~gone & bad, "toxic", "toxic_lost"), F.sum(F.when(bad, share).otherwise(0)).alias("shapley"))
    return sums.join(F.broadcast(steps), ["before", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id AS of, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
    regexp_matches(text, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM t LEFT JOIN l ON doc_id = of),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS seq FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(seq, lambda x: 'ABCDE'[x]), '') AS filter_order, step, seq[step] AS filter, seq[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT *, fails[filter] AS bad, len(list_filter(before, lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS k FROM g, s),
c AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (bad AND k = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (bad AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (bad AND NOT gone), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT * EXCLUDE (filter), (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM c
"""
