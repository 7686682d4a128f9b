"""The graph that the driver tables hold: classes, instances, relations, data properties, axioms, chunks. In DataFrames, and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Space between the sequence numbers of kinds of nodes.
STEP = 10**9
#: Lines that a task groups to supplies.
LINES = 250_000
AXIOMS = [("disjointness", ["NATION_A", "NATION_B"]), ("transitivity", ["partOf"]), ("symmetry", ["tradesWith"]), ("inverse", ["supplies", "suppliedBy"]), ("domain", ["supplies", "Supplier"]), ("range", ["supplies", "Product"]), ("asymmetry", ["tradesWith"])]


class Graph:
    """Lazy DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        t = lambda name: table(spark, sf_dir, name)
        r, n, c, s, p = t("region"), t("nation"), t("customer"), t("supplier"), t("part")
        row = lambda df, k, key, id_, type_, kind, text: df.select((F.lit(k * STEP) + key).cast("long").alias("seq"), id_.alias("id"), type_.alias("type"), F.lit(kind).alias("kind"), text.alias("description"))
        part_id = F.concat(F.lit("Part#"), F.col("p_partkey").cast("string"))
        none = F.lit(None).cast("string")
        cls = F.lit("Class")
        nr = n.join(r, n.n_regionkey == r.r_regionkey)
        brands = p.groupBy(F.col("p_brand").alias("id")).agg(F.min("p_partkey").alias("k"))
        types = p.groupBy(F.col("p_type").alias("id")).agg(F.min("p_partkey").alias("k"))
        nodes = spark.range(1).select(F.lit(0).cast("long").alias("seq"), F.lit("World").alias("id"), cls.alias("type"), F.lit("class").alias("kind"), F.lit("root of all places").alias("description"))
        nodes = nodes.unionByName(row(r, 1, F.col("r_regionkey"), F.col("r_name"), cls, "class", F.concat(F.lit("region "), F.lower("r_name"))))
        nodes = nodes.unionByName(row(nr, 2, F.col("n_nationkey"), F.col("n_name"), cls, "class", F.concat(F.lit("nation of "), F.col("r_name"))))
        nodes = nodes.unionByName(row(brands, 3, F.col("k"), F.col("id"), cls, "class", none)).unionByName(row(types, 4, F.col("k"), F.col("id"), cls, "class", F.lit("part type")))
        cn, sn = c.join(n, c.c_nationkey == n.n_nationkey), s.join(n, s.s_nationkey == n.n_nationkey)
        nodes = nodes.unionByName(row(cn, 5, F.col("c_custkey"), F.col("c_name"), F.col("n_name"), "instance", F.concat(F.lower("c_mktsegment"), F.lit(" customer"))))
        nodes = nodes.unionByName(row(sn, 6, F.col("s_suppkey"), F.col("s_name"), F.col("n_name"), "instance", none))
        self.nodes = nodes.unionByName(row(p, 7, F.col("p_partkey"), part_id, F.col("p_type"), "instance", F.col("p_name")))
        edge = lambda df, src, rel, dst, conf=F.lit(1.0), votes=F.lit(1), origin="extraction": df.select(src.alias("src"), F.lit(rel).alias("relation"), dst.alias("dst"), conf.cast("double").alias("confidence"), votes.cast("long").alias("vote_count"), F.lit(origin).alias("origin"))
        place = edge(r, F.col("r_name"), "subClassOf", F.lit("World")).unionByName(edge(nr, F.col("n_name"), "subClassOf", F.col("r_name")))
        place = place.unionByName(edge(nr, F.col("n_name"), "partOf", F.col("r_name"), F.lit(0.9))).unionByName(edge(r, F.col("r_name"), "partOf", F.lit("World"), F.lit(0.9)))
        other = n.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("name2"))
        trade = n.join(other, F.pmod(n.n_nationkey * 7 + 3, F.lit(25)) == F.col("k2"))
        place = place.unionByName(edge(trade, F.col("n_name"), "tradesWith", F.col("name2"), F.lit(0.6), F.lit(3), "inference_llm"))
        typed = edge(cn, F.col("c_name"), "type", F.col("n_name")).unionByName(edge(sn, F.col("s_name"), "type", F.col("n_name"))).unionByName(edge(p, part_id, "type", F.col("p_type")))
        typed = typed.unionByName(edge(p, part_id, "hasBrand", F.col("p_brand"), F.lit(0.9)))
        line = t("lineitem").withColumn("off", F.round(F.col("l_discount") * 100).cast("long"))
        # dealt by the pair first, into as many tasks as there are lines: hardly any pair repeats, so that aggregating before the exchange would hold all rows of a task for nothing
        tasks = max(spark.sparkContext.defaultParallelism, -(-line.count() // LINES))
        per = line.select("l_suppkey", "l_partkey", "l_orderkey", "off").repartition(tasks, "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.sum("off").alias("off"), F.count("*").alias("k"), F.count_distinct("l_orderkey").alias("votes"))
        per = per.join(s.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("p_partkey", F.col("l_partkey"))
        self.supplies = edge(per, F.col("s_name"), "supplies", part_id, 1.0 - F.col("off") / (100.0 * F.col("k")), F.col("votes"), "inference_owl")
        self.places, self.types = place, typed
        self.edges = place.unionByName(typed).unionByName(self.supplies)
        names = {x.n_nationkey: x.n_name for x in n.where("n_nationkey in (0, 1)").collect()}
        rows = [(k, [names.get(0) if e == "NATION_A" else names.get(1) if e == "NATION_B" else e for e in es]) for k, es in AXIOMS]
        self.axioms = spark.createDataFrame(rows, "axiom_type string, entities array<string>")
        eav = lambda df, e, a, v, kind: df.select(e.alias("entity"), F.lit(a).alias("attribute"), v.cast("string").alias("value"), F.lit(kind).alias("datatype"))
        cents = lambda c: F.round(F.col(c) * 100).cast("long")
        self.data_props = eav(c, F.col("c_name"), "balance_cents", cents("c_acctbal"), "integer").unionByName(eav(c, F.col("c_name"), "segment", F.col("c_mktsegment"), "string")).unionByName(eav(p, part_id, "size", F.col("p_size"), "int")).unionByName(eav(s, F.col("s_name"), "balance_cents", cents("s_acctbal"), "number"))
        self.members = line.select(part_id_of("l_partkey").alias("id"), F.col("l_orderkey").alias("chunk_id"))


def part_id_of(key: str):
    return F.concat(F.lit("Part#"), F.col(key).cast("string"))


_E = "SELECT {src} AS src, '{rel}' AS relation, {dst} AS dst, {conf}::DOUBLE AS confidence, {votes}::BIGINT AS vote_count, '{origin}' AS origin FROM {of}"


def _edge(of, src, rel, dst, conf="1", votes="1", origin="extraction"):
    return _E.format(of=of, src=src, rel=rel, dst=dst, conf=conf, votes=votes, origin=origin)


_NR = "nation JOIN region ON n_regionkey = r_regionkey"
#: The same graph for DuckDB: to stand after WITH or WITH RECURSIVE.
CTE = f"""
nodes AS (SELECT 0::BIGINT AS seq, 'World' AS id, 'Class' AS type, 'class' AS kind, 'root of all places' AS description
  UNION ALL SELECT {STEP}::BIGINT + r_regionkey, r_name, 'Class', 'class', 'region ' || lower(r_name) FROM region
  UNION ALL SELECT 2 * {STEP}::BIGINT + n_nationkey, n_name, 'Class', 'class', 'nation of ' || r_name FROM {_NR}
  UNION ALL SELECT 3 * {STEP}::BIGINT + min(p_partkey), p_brand, 'Class', 'class', NULL FROM part GROUP BY p_brand
  UNION ALL SELECT 4 * {STEP}::BIGINT + min(p_partkey), p_type, 'Class', 'class', 'part type' FROM part GROUP BY p_type
  UNION ALL SELECT 5 * {STEP}::BIGINT + c_custkey, c_name, n_name, 'instance', lower(c_mktsegment) || ' customer' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 6 * {STEP}::BIGINT + s_suppkey, s_name, n_name, 'instance', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 7 * {STEP}::BIGINT + p_partkey, 'Part#' || p_partkey, p_type, 'instance', p_name FROM part),
places AS ({_edge("region", "r_name", "subClassOf", "'World'")} UNION ALL {_edge(_NR, "n_name", "subClassOf", "r_name")}
  UNION ALL {_edge(_NR, "n_name", "partOf", "r_name", "0.9")} UNION ALL {_edge("region", "r_name", "partOf", "'World'", "0.9")}
  UNION ALL {_edge("nation a JOIN nation b ON (a.n_nationkey * 7 + 3) % 25 = b.n_nationkey", "a.n_name", "tradesWith", "b.n_name", "0.6", "3", "inference_llm")}),
types AS ({_edge("customer JOIN nation ON c_nationkey = n_nationkey", "c_name", "type", "n_name")} UNION ALL {_edge("supplier JOIN nation ON s_nationkey = n_nationkey", "s_name", "type", "n_name")}
  UNION ALL {_edge("part", "'Part#' || p_partkey", "type", "p_type")} UNION ALL {_edge("part", "'Part#' || p_partkey", "hasBrand", "p_brand", "0.9")}),
supplies AS (SELECT s_name AS src, 'supplies' AS relation, 'Part#' || l_partkey AS dst, 1e0 - sum(round(l_discount * 100)::BIGINT)::BIGINT / (100e0 * count(*)) AS confidence, count(DISTINCT l_orderkey) AS vote_count, 'inference_owl' AS origin
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name, l_partkey),
edges AS (SELECT * FROM places UNION ALL SELECT * FROM types UNION ALL SELECT * FROM supplies),
data_props AS (SELECT c_name AS entity, 'balance_cents' AS attribute, round(c_acctbal * 100)::BIGINT::VARCHAR AS value, 'integer' AS datatype FROM customer
  UNION ALL SELECT c_name, 'segment', c_mktsegment, 'string' FROM customer UNION ALL SELECT 'Part#' || p_partkey, 'size', p_size::VARCHAR, 'int' FROM part
  UNION ALL SELECT s_name, 'balance_cents', round(s_acctbal * 100)::BIGINT::VARCHAR, 'number' FROM supplier),
nation_a AS (SELECT n_name FROM nation WHERE n_nationkey = 0), nation_b AS (SELECT n_name FROM nation WHERE n_nationkey = 1),
members AS (SELECT 'Part#' || l_partkey AS id, l_orderkey AS chunk_id FROM lineitem)
"""


def sql(body: str, extra: str = "") -> str:
    return f"WITH RECURSIVE {CTE}{',' + extra if extra else ''} {body}"
