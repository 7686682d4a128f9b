"""Knowledge bases: folders of Parquet tables, with a metadata table beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import read_version, write_version

TABLES = ("nodes", "edges", "axioms", "data_props")
META = "kb_id string, name string, description string, language string, documents array<string>, created_at timestamp, tables string"


class Catalog:
    """Knowledge bases under one root. A write makes new folders and at last one marker file, whose name is the version's; readers follow
    the last marker, so they see whole versions, and a write that dies leaves the version before it in place. The version before the
    current one stays for its readers; older ones are deleted."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def versions(self, kb_id: str) -> list[str]:
        """Names of the complete versions, the current one last."""
        return [n for n in self._names(f"{self.root}/{kb_id}/current") if not n.startswith(".")]

    def exists(self, kb_id: str) -> bool:
        return bool(self.versions(kb_id))

    def _publish(self, kb_id: str, row: dict, tables: dict[str, DataFrame] | None = None) -> None:
        old = self.versions(kb_id)
        name = f"{int(old[-1].split('.')[0]) + 1 if old else 1:08d}.{uuid.uuid4().hex}"
        base = f"{self.root}/{kb_id}"
        if tables is not None:
            row = {**row, "tables": name}
            for t in TABLES:
                df = tables[t]
                df.select(*(c for c, k in df.dtypes if k not in ("array<float>", "array<double>"))).write.parquet(f"{base}/tables/{name}/{t}")
        meta = self.spark.createDataFrame([tuple(row.get(f.split()[0]) for f in META.split(", "))], META)
        meta.withColumn("created_at", F.coalesce("created_at", F.current_timestamp())).coalesce(1).write.parquet(f"{base}/meta/{name}")
        if self.versions(kb_id) != old:
            raise RuntimeError(f"{kb_id} has another version since this write began")
        fs, mark = self._fs(f"{base}/current/{name}")
        fs.create(mark, False).close()
        keep = self.versions(kb_id)[-2:]
        used = {r.tables for r in self.spark.read.schema(META).parquet(*(f"{base}/meta/{k}" for k in keep)).collect()}
        for kind, kept in (("current", set(keep)), ("meta", set(keep)), ("tables", used)):
            for n in self._names(f"{base}/{kind}"):
                if n.split(".")[0] < keep[0].split(".")[0] and n not in kept:
                    fs.delete(self._fs(f"{base}/{kind}/{n}")[1], True)

    def save(self, kb_id: str, tables: dict[str, DataFrame], name: str | None = None, description: str | None = None, language: str = "en", documents: list[str] = (), merge: bool = False) -> None:
        """Write the tables without vectors and upsert the metadata: created_at stays; documents are added when merging, else replaced; so is the language."""
        old = self.metadata(kb_id) if self.exists(kb_id) else None
        docs = list(dict.fromkeys([*(old.documents if old and merge else []), *documents]))
        row = {"kb_id": kb_id, "name": name or (old.name if old else kb_id), "description": description if description is not None else (old.description if old else None)}
        self._publish(kb_id, {**row, "language": old.language if old and merge else language, "documents": docs, "created_at": old.created_at if old else None}, tables)

    def load(self, kb_id: str) -> dict[str, DataFrame]:
        at = self.metadata(kb_id).tables
        return {t: self.spark.read.parquet(f"{self.root}/{kb_id}/tables/{at}/{t}") for t in TABLES}

    def metadata(self, kb_id: str):
        if not self.exists(kb_id):
            raise FileNotFoundError(kb_id)
        return self.spark.read.schema(META).parquet(f"{self.root}/{kb_id}/meta/{self.versions(kb_id)[-1]}").first()

    def update(self, kb_id: str, **fields) -> None:
        """Set name, description or language: a new version of the metadata over the same tables."""
        old = self.metadata(kb_id).asDict()
        self._publish(kb_id, {**old, **{k: v for k, v in fields.items() if k in ("name", "description", "language") and v is not None}})

    def list(self) -> DataFrame:
        """Metadata of all knowledge bases, the newest first; names and languages have defaults."""
        found = [f"{self.root}/{k}/meta/{v[-1]}" for k in self._names(self.root) if (v := self.versions(k))]
        df = self.spark.read.schema(META).parquet(*found) if found else self.spark.createDataFrame([], META)
        return df.drop("tables").withColumn("name", F.coalesce("name", "kb_id")).withColumn("language", F.coalesce("language", F.lit("en"))).orderBy(F.desc("created_at"))

    def save_health(self, kb_id: str, health: DataFrame) -> None:
        """Keep a health report of a knowledge base, with its id in each row, as a new version beside its tables."""
        write_version(self.spark, f"{self.root}/{kb_id}/health", {"health": health.withColumn("kb_id", F.lit(kb_id))})

    def load_health(self, kb_id: str) -> DataFrame | None:
        """The report that was kept for this knowledge base; None if there is none or it is another's."""
        got = (read_version(self.spark, f"{self.root}/{kb_id}/health") or {}).get("health")
        return None if got is None or got.where(F.col("kb_id") == kb_id).isEmpty() else got.where(F.col("kb_id") == kb_id)

    def delete(self, kb_id: str) -> None:
        fs, p = self._fs(f"{self.root}/{kb_id}")
        if not fs.delete(p, True):
            raise FileNotFoundError(kb_id)

    def activate(self, kb_id: str) -> None:
        """Name the tables of a knowledge base as views of the session."""
        for t, df in self.load(kb_id).items():
            df.createOrReplaceTempView(t)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a JSON log."""
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON log; broken lines are rows of nulls, a missing log is empty."""
    try:
        return spark.read.schema(schema).json(path, mode="PERMISSIVE")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
