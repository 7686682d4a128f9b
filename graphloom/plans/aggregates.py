"""Queries over aggregations, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate, extract, merge
from .fixture import Graph, sql, table
from .registry import query

#: Line items as extractions: a chunk is an order, a class a part, a relation the return flag.
OCC = "occ AS (SELECT l_suppkey AS s, l_partkey AS p, l_returnflag AS r, round(l_discount * 100)::BIGINT AS c, l_orderkey AS chunk FROM lineitem)"


def occurrences(spark, d):
    line = table(spark, d, "lineitem")
    return line.select(F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("relation"), F.col("l_partkey").alias("dst"), F.round(F.col("l_discount") * 100).alias("confidence"), F.col("l_orderkey").alias("chunk_id"))


@query("a1_triples", f"WITH {OCC} SELECT s AS src, r AS relation, p AS dst, count(DISTINCT chunk) AS vote_count, list_sort(list_distinct(list(chunk))) AS chunk_ids FROM occ GROUP BY 1, 2, 3")
def a1(spark, d):
    return merge.aggregate_triples(occurrences(spark, d)).select("src", "relation", "dst", "vote_count", "chunk_ids")


#: Conversation turns as descriptions of a conversation.
def entities(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), F.col("text").alias("description"), F.when(F.col("turn") % 2 == 1, F.col("role")).alias("parent"), F.array("role").alias("synonyms"), F.col("turn").alias("chunk_id"))


@query("a2_entities", "SELECT conv_id AS id, arg_min(text, (-length(text), turn)) AS description, arg_max(CASE WHEN turn % 2 = 1 THEN role END, turn) FILTER (turn % 2 = 1) AS parent, list_sort(list_distinct(list(turn))) AS chunk_ids FROM conversations GROUP BY 1")
def a2(spark, d):
    return merge.aggregate_entities(entities(spark, d)).select("id", "description", "parent", "chunk_ids")


@query("a3_classes", "SELECT lower(trim(p_name, ' ')) AS key, arg_max(p_name, (1, length(p_type), p_partkey)) AS name, arg_max(p_type, p_partkey) AS parent FROM part GROUP BY 1")
def a3(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"), F.col("p_type").alias("parent"), F.col("p_type").alias("description"), F.array("p_brand").alias("synonyms"))
    return merge.dedup_classes(p).select("key", "name", "parent")


@query("a4_fold", "WITH RECURSIVE t AS (SELECT conv_id AS id, text AS d, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), f(id, i, acc) AS (SELECT DISTINCT conv_id, 0::BIGINT, '' FROM conversations UNION ALL SELECT f.id, t.i, CASE WHEN length(acc) < 20 AND d <> '' THEN d WHEN length(d) > length(acc) THEN d ELSE acc END FROM f JOIN t ON t.id = f.id AND t.i = f.i + 1) SELECT id, arg_max(acc, i) AS description, max(i) AS vote_count FROM f GROUP BY id")
def a4(spark, d):
    e = entities(spark, d).select("id", "seq", "description", F.array("chunk_id").alias("chunk_ids"))
    return merge.merge_descriptions(e).select("id", "description", "vote_count")


@query("a5_edges", f"WITH {OCC} SELECT s AS src, r AS relation, p AS dst, sum(votes)::BIGINT AS vote_count FROM (SELECT s, r, p, chunk, count(*) AS votes FROM occ GROUP BY ALL) GROUP BY 1, 2, 3")
def a5(spark, d):
    o = occurrences(spark, d).groupBy("src", "relation", "dst", "chunk_id").agg(F.count("*").alias("vote_count"), F.avg("confidence").alias("confidence"))
    return merge.merge_edges(o).select("src", "relation", "dst", "vote_count")


@query("q1_digraph", f"WITH {OCC} SELECT s AS src, p AS dst, arg_max(r, (chunk, n)) AS relation FROM (SELECT l_suppkey AS s, l_partkey AS p, l_returnflag AS r, l_orderkey AS chunk, l_linenumber AS n FROM lineitem) GROUP BY 1, 2")
def q1(spark, d):
    line = table(spark, d, "lineitem")
    return merge.digraph_view(line.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("relation"), F.struct("l_orderkey", "l_linenumber").alias("seq")))


@query("a14_infer_votes", f"WITH {OCC} SELECT s AS src, r AS relation, p AS dst, count(*) AS vote_count, CASE WHEN count(*) >= 3 THEN least(1e0, max(c) / 100e0 + 0.1) ELSE max(c) / 100e0 END AS confidence FROM occ GROUP BY 1, 2, 3")
def a14(spark, d):
    o = occurrences(spark, d)
    return merge.infer_votes(o.withColumn("confidence", F.col("confidence") / 100.0)).select("src", "relation", "dst", "vote_count", "confidence")


@query("a16_evaluation", "SELECT user_id AS kb_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS failures, round(1e6 * count(*) FILTER (event_type <> 'purchase') / count(*))::BIGINT AS coverage, round(1e3 * avg(value))::BIGINT AS mean, round(1e6 * sum(event_id % 3) / sum(greatest(event_id % 5, 1)))::BIGINT AS fact_recall FROM events GROUP BY 1")
def a16(spark, d):
    facts = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") != "purchase", 1)
    e = table(spark, d, "events").select(F.col("user_id").alias("kb_id"), "event_id", facts.alias("facts"), "value", (F.col("event_id") % 3).alias("found"), (F.col("event_id") % 5).alias("total"))
    recall = evaluate.fact_recall(e, "kb_id", 1e6).withColumnRenamed("kb_id", "_k")
    out = evaluate.means(e, "kb_id", ["value"], ["event_id"], 1e6).join(recall, F.col("kb_id").eqNullSafe(F.col("_k")))
    whole = lambda c: F.round(c).cast("long")
    return out.select("kb_id", "n", "failures", whole(F.col("coverage")).alias("coverage"), whole(F.col("value") * 1e3).alias("mean"), whole(F.col("fact_recall")).alias("fact_recall"))


@query("a19_report_merge", "SELECT user_id, count(*) AS chunks, bool_or(event_type = 'purchase') AS merge_skipped, arg_max(event_type, event_id) AS last_reason FROM events GROUP BY 1")
def a19(spark, d):
    e = table(spark, d, "events")
    return evaluate.merge_reports(e.select(F.col("user_id"), F.col("event_id").alias("doc_index"), F.lit(1).alias("chunks"), (F.col("event_type") == "purchase").alias("merge_skipped"), F.col("event_type").alias("last_reason")), "user_id")


@query("a20_chunk_stats", "SELECT l_orderkey AS chunk_id, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def a20(spark, d):
    kinds = {"a": "A", "n": "N", "r": "R"}
    return extract.chunk_stats(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_returnflag").alias("kind")), kinds)


# windows


@query("w1_query_cap", "SELECT page_id, q FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY page_id) AS r FROM (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS q, row_number() OVER (PARTITION BY url ORDER BY page_id) AS u FROM pages) WHERE u = 1) WHERE r <= 3")
def w1(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "://([^/?#]*)", 1).alias("q"))
    return extract.cap_per_query(p, "q", "url", "page_id", 3).select("page_id", "q")


@query("w4_trend", "SELECT event_id, value - lag(value) OVER w AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w4(spark, d):
    e = table(spark, d, "events")
    return evaluate.trend(e, "user_id", ["ts", "event_id"], "value").select("event_id", "delta")


@query("w5_first_gaps", "SELECT key, id FROM (SELECT lower(trim(p_name, ' ')) AS key, p_name AS id, row_number() OVER (PARTITION BY lower(trim(p_name, ' ')) ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def w5(spark, d):
    return extract.first_by_name(table(spark, d, "part").select(F.col("p_name").alias("id"), F.col("p_partkey").alias("seq"))).select("key", "id")


@query("w6_interleave", "SELECT id, turn, (row_number() OVER (ORDER BY turn, f) - 1) // 4 AS batch FROM (SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS turn, min(c_custkey) OVER (PARTITION BY c_nationkey) AS f FROM customer)")
def w6(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("component"), F.col("c_custkey").alias("seq"))
    return merge.interleave(c, 4).select("id", "turn", "batch")


@query("w7_budget", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 400")
def w7(spark, d):
    return extract.within_budget(table(spark, d, "conversations"), "conv_id", "turn", "text", 400).select("conv_id", "turn")


@query("k11_history", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 50")
def k11(spark, d):
    return extract.newest(table(spark, d, "events"), "user_id", ["ts", "event_id"], 50).select("user_id", "event_id")


# filters with fallbacks, gates, validation


@query("p10_fidelity_filter", "SELECT page_id FROM pages WHERE CASE WHEN regexp_matches(lower(regexp_extract(url, '://([^/?#]*)', 1)), 'blog\\.|wordpress\\.com|blogspot\\.com') THEN 0.45 ELSE 0.15 END >= 0.3")
def p10(spark, d):
    from ..functions import text

    return extract.by_fidelity(table(spark, d, "pages").withColumn("fidelity", text.fidelity("url")), 0.3).select("page_id")


@query("p10_fallback", "SELECT page_id FROM pages")
def p10b(spark, d):
    from ..functions import text

    return extract.by_fidelity(table(spark, d, "pages").withColumn("fidelity", text.fidelity("url")), 0.95).select("page_id")


@query("p11_inferred", "SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_discount * 10 >= 0.65")
def p11(spark, d):
    line = table(spark, d, "lineitem")
    return extract.inferred(line.select(F.col("l_suppkey").cast("string").alias("src"), F.lit("related_to").alias("relation"), F.col("l_partkey").cast("string").alias("dst"), (F.col("l_discount") * 10).alias("confidence"))).select(F.col("src").cast("long"), F.col("dst").cast("long"))


@query("p13_gate", "SELECT grade, (CASE grade WHEN 'A' THEN 0.8 WHEN 'B' THEN 0.6 WHEN 'C' THEN 0.4 WHEN 'D' THEN 0.2 ELSE 0 END)::DOUBLE AS threshold FROM (SELECT unnest(['A', 'B', 'C', 'D', 'F']) AS grade)")
def p13(spark, d):
    g = spark.createDataFrame([(x,) for x in "ABCDF"], "grade string")
    return g.select("grade", extract.gate(F.lit(None).cast("double"), F.col("grade")).alias("threshold"))


@query("p14_validation", "SELECT p_partkey AS id, least(greatest(p_size / 25e0, 0e0), 1e0) AS salience, CASE WHEN p_size % 5 = 0 THEN 1e0 ELSE p_size / 100e0 END AS confidence FROM part WHERE p_size > 1")
def p14(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 1, F.col("p_name")).alias("name"), (F.col("p_size") / 25.0).alias("salience"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 100.0).otherwise(0.0).alias("confidence"))
    return extract.valid_classes(rows).select("id", "salience", "confidence")


# sorts


@query("o7_pages", "SELECT page_id, score FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 0.5e0 * f + 0.5e0 * (page_id % 10 / 10e0) ELSE f END AS score FROM (SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(url, '://([^/?#]*)', 1)), 'blog\\.|wordpress\\.com|blogspot\\.com') THEN 0.45::DOUBLE ELSE 0.15::DOUBLE END AS f FROM pages)) ORDER BY score DESC, page_id LIMIT 20")
def o7(spark, d):
    from ..functions import text

    p = table(spark, d, "pages").select("page_id", text.fidelity("url").alias("fidelity"), F.when(F.col("page_id") % 2 == 0, F.col("page_id") % 10 / 10.0).alias("content_score"))
    return extract.ranked_pages(p, 20).select("page_id", "score")


@query("o10_recent", "SELECT user_id, last, row_number() OVER (ORDER BY last DESC, e DESC, user_id) <= 5 AS recent FROM (SELECT user_id, max(ts) AS last, arg_max(event_id, (ts, event_id)) AS e FROM events GROUP BY 1)")
def o10(spark, d):
    return evaluate.kb_list(table(spark, d, "events"), "user_id", ["ts", "event_id"], 5)


@query("o10_best_worst", "SELECT arg_min(user_id, (-v, user_id)) AS best, arg_min(user_id, (v, user_id)) AS worst FROM (SELECT user_id, count(*) AS v FROM events GROUP BY 1)")
def o10b(spark, d):
    return evaluate.best_and_worst(table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("v")), "user_id", "v")


@query("u4_ordered_distinct", "SELECT user_id, list(event_type ORDER BY f) AS types FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1")
def u4(spark, d):
    return extract.ordered_distinct(table(spark, d, "events"), "user_id", "event_type", "event_id", "types")


@query("u5_union", "SELECT c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier UNION ALL SELECT p_name, 'part' FROM part")
def u5(spark, d):
    return extract.concatenated({t: table(spark, d, t).select(F.col(f"{t[0]}_name").alias("name")) for t in ("customer", "supplier", "part")}, "kind")


@query("a18_hypergraph", sql("SELECT relation AS key, dst AS value, count(DISTINCT src) AS blocks FROM edges GROUP BY 1, 2"))
def a18(spark, d):
    from ..operators.retrieve import hypergraph

    n, e = hypergraph(Graph(spark, d).edges.select(F.col("src").alias("block"), F.col("relation").alias("key"), F.col("dst").alias("value")))
    return n.join(e.select("block", F.explode("hids").alias("hid")), "hid").groupBy("hid", "key", "value").agg(F.count("*").alias("blocks")).drop("hid")


@query("m5_attributes", "SELECT p_partkey AS entity, unnest(['brand', 'type']) AS attribute, unnest([p_brand, p_type]) AS value FROM part")
def m5(spark, d):
    p = table(spark, d, "part")
    return extract.attributes(p.select(F.col("p_partkey").alias("entity"), F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type").alias("attributes")))


@query("m6_wide", sql("SELECT entity, list_sort(list(attribute || '=' || value)) AS props FROM data_props GROUP BY entity"))
def m6(spark, d):
    """Each property comes twice, an older value before the last."""
    rows = Graph(spark, d).data_props
    rows = rows.withColumn("seq", F.lit(2)).unionByName(rows.withColumn("value", F.concat(F.lit("old "), "value")).withColumn("seq", F.lit(1)))
    return extract.wide(rows).select("entity", F.array_sort(F.transform(F.map_entries("props"), lambda e: F.concat(e.key, F.lit("="), e.value))).alias("props"))


@query("m2_rings", sql("SELECT id, CASE WHEN k > 80 THEN 0 WHEN k >= 10 THEN 1 WHEN k >= 2 THEN 2 ELSE 3 END AS ring, round(1000 * least(90, 20 + 14 * ln(k + 1)))::BIGINT AS size, round(1000 * greatest(1.5, least(6, k * 0.6e0)))::BIGINT AS mass FROM (SELECT n.id, count(e.id) AS k FROM nodes n LEFT JOIN (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) e USING (id) GROUP BY n.id)"))
def m2(spark, d):
    from ..operators.viewer import styles

    g = Graph(spark, d)
    whole = lambda c: F.round(F.col(c) * 1000).cast("long").alias(c)
    return styles(g.nodes, g.edges).select("id", "ring", whole("size"), whole("mass"))


@query("m4_blocks", sql("SELECT src AS subject, src || ' ' || relation AS key, dst AS value, src || ' ' || relation || ': ' || dst AS \"full\" FROM edges WHERE relation <> 'partOf' UNION ALL SELECT src, 'k', 'v', 'whole' FROM edges WHERE relation = 'partOf'"))
def m4(spark, d):
    own = lambda v: F.when(F.col("relation") == "partOf", v)
    b = Graph(spark, d).edges.groupBy(F.col("src").alias("subject")).agg(F.collect_list(F.struct("relation", F.col("dst").alias("target"), own("k").alias("key"), own("v").alias("value"), own("whole").alias("full"))).alias("attributes"))
    return extract.flattened(b)


@query("m8_legacy", sql("SELECT 'entity' AS what, id AS name, CASE WHEN kind = 'class' THEN 'Class' ELSE type END AS kind, NULL AS target FROM nodes UNION ALL SELECT 'relation', src, relation, dst FROM edges"))
def m8(spark, d):
    g = Graph(spark, d)
    return extract.legacy_view(g.nodes, g.edges)


@query("m3_json", "SELECT conv_id, turn, role FROM conversations")
def m3(spark, d):
    """Replies with fences, a trailing comma, and an end that is cut off."""
    c = table(spark, d, "conversations")
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('Sure:\n```json\n{"role": "'), "role", F.lit('",}\n```'))).otherwise(F.concat(F.lit('{"role": "'), "role", F.lit('", "x": [1, 2')))
    from ..functions import text

    return c.select("conv_id", "turn", F.get_json_object(text.repaired_json(raw), "$.role").alias("role"))
