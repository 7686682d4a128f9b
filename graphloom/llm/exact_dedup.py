"""Exact dedup: partitions hold sorted digest runs and exchange them in binomial rounds; in each round two partitions swap halves of
their runs, sorted runs are merged, and of equal texts the smallest identifier stays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, stored, table

#: Rows that one partition's run holds at most, on average, and at least where the session has partitions to spare.
RUN_ROWS, LEAST_ROWS = 1 << 20, 1 << 10
#: Bytes of a text's key: its SHA-256, its length and a check hash of 64 bits.
KEY = 48
RUN = "part long, key binary, doc_id long, row long, n long"


def normal(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_key(t: Column) -> Column:
    """Texts are equal when all of their SHA-256, their number of bytes and a second hash are."""
    tail = [F.unhex(F.lpad(F.hex(x), 16, "0")) for x in (F.octet_length(t).cast("long"), F.xxhash64(t))]
    return F.concat(F.unhex(F.sha2(t, 256)), *tail)


class Run:
    """Sorted rows: keys (KEY bytes each), identifiers (null: no is set), rows, counts."""

    def __init__(self, key, no, doc_id, row, n):
        self.key, self.no, self.doc_id, self.row, self.n = key, no, doc_id, row, n

    @classmethod
    def of(cls, table: pa.Table) -> Run:
        col = lambda c: table.column(c).combine_chunks()
        key = col("key").cast(pa.binary(KEY))
        key = np.frombuffer(key.buffers()[1], f"S{KEY}")[key.offset : key.offset + len(key)] if len(key) else np.zeros(0, f"S{KEY}")
        ids = col("doc_id")
        return cls(key, ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), col("row").to_numpy(), col("n").to_numpy())

    def take(self, at) -> Run:
        return Run(self.key[at], self.no[at], self.doc_id[at], self.row[at], self.n[at])

    def __len__(self):
        return len(self.key)

    def batch(self, part: int) -> pa.RecordBatch:
        keys = pa.Array.from_buffers(pa.binary(KEY), len(self), [None, pa.py_buffer(np.ascontiguousarray(self.key))]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(self), part)), keys, pa.array(self.doc_id, mask=self.no), pa.array(self.row), pa.array(self.n)], ["part", "key", "doc_id", "row", "n"])

    def least(self) -> Run:
        """Of equal keys, which follow each other, the row with the smallest identifier (null last, then the row), with all counts."""
        if not len(self):
            return self
        first = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]])
        if len(first) == len(self):
            return self
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(self)]))
        best = self.take(np.lexsort((self.row, self.doc_id, self.no, group))[first])
        best.n = np.add.reduceat(self.n, first)
        return best


def merge(a: Run, b: Run) -> Run:
    """Two sorted runs to one: each row of b goes behind the rows of a that aren't larger."""
    to = np.searchsorted(a.key, b.key, "right") + np.arange(len(b))
    of_a = np.ones(len(a) + len(b), bool)
    of_a[to] = False
    at = np.empty(len(of_a), np.int64)
    at[of_a], at[to] = np.arange(len(a)), len(a) + np.arange(len(b))
    both = (np.concatenate([x, y]) for x, y in ((a.key, b.key), (a.no, b.no), (a.doc_id, b.doc_id), (a.row, b.row), (a.n, b.n)))
    return Run(*both).take(at).least()


def merge_all(runs: list[Run]) -> Run:
    """Multiway: neighbours are merged, and what comes out again, until one run is left."""
    while len(runs) > 1:
        runs = [merge(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def natural(rows: Run) -> list[Run]:
    """Cut rows where the order falls: an exchange brings one partition's run after the other's. However they come, each piece is sorted."""
    cut = np.r_[0, np.flatnonzero(rows.key[1:] < rows.key[:-1]) + 1, len(rows)]
    return [rows.take(slice(i, j)) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _first(batches):
    """A partition's sorted rows to its run. One row is held between batches."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t], promote_options="default")
        if t.num_rows:
            run = Run.of(t).least()
            done = run.batch(0) if not len(run) else run.batch(int(t.column("part")[0].as_py()))
            held = pa.Table.from_batches([done.slice(done.num_rows - 1)])
            yield done.slice(0, done.num_rows - 1)
    if held is not None:
        yield from held.to_batches()


def _merge(batches):
    """The runs that came to a partition, merged."""
    t = pa.Table.from_batches(list(batches), pa.schema([("part", pa.int64()), ("key", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64())]))
    if t.num_rows:
        part = t.column("part")[0].as_py()
        yield merge_all([r.least() for r in natural(Run.of(t))]).batch(part)


def rounds_for(rows: int, sessions: int) -> int:
    """Rounds, the logarithm of the number of partitions: by rows, and as many as the session has unless these would be tiny."""
    return max(1, int(max(rows / RUN_ROWS, min(sessions, rows / LEAST_ROWS), 2) - 1).bit_length())


def merge_runs(rows: DataFrame, rounds: int) -> DataFrame:
    """key, doc_id, row (of the text's smallest identifier), n: one row per text.

    Each of 2**rounds partitions sorts its rows into a run. In round r, partitions whose numbers differ in bit r swap: each keeps
    the keys whose bit r is its own, and merges the two runs. repartitionById puts each run into the partition that it names. So
    each round has the same number of partitions, each with an even share of keys, and copies are gone before the next round
    moves anything: a group of copies is two rows for each partition at most. After the last round each text is in one place.
    """
    n = 1 << rounds
    runs = rows.withColumn("part", F.spark_partition_id().cast("long") % n).select("part", "key", "doc_id", "row", "n")
    runs = runs.sortWithinPartitions("part", "key", F.asc_nulls_last("doc_id"), "row").mapInArrow(_runs, RUN)
    bits = F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long")
    for r in range(rounds):
        own = F.col("part").bitwiseAND(F.lit((n - 1) & ~(1 << r)))
        runs = runs.withColumn("part", own.bitwiseOR(bits.bitwiseAND(F.lit(1 << r))))
        runs = runs.repartitionById(n, F.col("part").cast("int")).mapInArrow(_merge, RUN)
    return runs.drop("part")


def _runs(batches):
    """Rows sorted by part and key, one run after the other."""
    from itertools import groupby

    def cut():
        for b in batches:
            part = b.column("part").to_numpy(zero_copy_only=False)
            at = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)] if len(part) else np.zeros(1, int)
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield int(part[i]), b.slice(i, j - i)

    for _, group in groupby(cut(), key=lambda x: x[0]):
        yield from _first(b for _, b in group)


def exact_dedup(docs: DataFrame, rounds: int | None = None, carry: bool = False) -> DataFrame:
    """One row per row of docs (doc_id: a whole number, text): doc_id, keep_id, group_size, kept, text_sha256; with carry all columns
    of docs as well, whatever their names, in struct doc.

    Texts are equal when their normal forms have the same SHA-256, the same number of bytes and the same 64-bit check hash.
    Of equal texts the row with the smallest doc_id stays (null last; of rows that repeat a doc_id exactly one). Null text
    counts as empty, and empty texts are equal. No rows: no rows. Only digests travel, never texts, and a group of copies is
    one row per partition before it travels.
    """
    t = normal(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *([F.struct(*quoted(docs)).alias("doc")] if carry else []), text_key(t).alias("key"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    if rounds is None:
        rounds = rounds_for(rows.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    best = merge_runs(rows.select("key", "doc_id", "row").withColumn("n", F.lit(1).cast("long")), rounds)
    best = best.select("key", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
    out = rows.join(best, "key")
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"), *(["doc"] if carry else []))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def sql(docs: str = "documents") -> str:
    return f"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS sha FROM {docs}) WINDOW w AS (PARTITION BY sha)
"""


ORACLE = sql()
