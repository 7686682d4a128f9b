"""Scratch tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a temporary one, which goes when Python ends, only where that is unset and everything runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return _own["dir"]


def scratch_path(spark: SparkSession, name: str = "t") -> str:
    return f"{scratch_root(spark)}/graphloom-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to a scratch table and read it back. The table goes when the driver's Python ends."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
