"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as ex
from ..sources import export
from .fixture import Graph, sql, table
from .registry import query

U = lambda c: f"'{export.BASE}' || coalesce(nullif(trim(regexp_replace(regexp_replace(trim({c}, ' '), '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'entity')"
TRIPLES = f"""
SELECT {U('id')} AS s, '{export.RDF}type' AS p, '{export.OWL}Class' AS o FROM nodes WHERE kind = 'class' UNION SELECT {U('id')}, '{export.RDFS}comment', description FROM nodes WHERE coalesce(description, '') <> '' UNION SELECT {U('id')}, '{export.RDFS}label', id FROM nodes
UNION SELECT {U('id')}, '{export.RDF}type', '{export.OWL}NamedIndividual' FROM nodes WHERE kind = 'instance' UNION SELECT {U('id')}, '{export.RDF}type', {U('type')} FROM nodes WHERE kind = 'instance'
UNION SELECT {U('src')}, '{export.RDFS}subClassOf', {U('dst')} FROM edges WHERE relation = 'subClassOf' UNION SELECT {U('src')}, '{export.RDF}type', {U('dst')} FROM edges WHERE relation = 'type'
UNION SELECT {U('relation')}, '{export.RDF}type', '{export.OWL}ObjectProperty' FROM edges WHERE relation NOT IN ('subClassOf', 'type') UNION SELECT {U('src')}, {U('relation')}, {U('dst')} FROM edges WHERE relation NOT IN ('subClassOf', 'type')
UNION SELECT {U('attribute')}, '{export.RDF}type', '{export.OWL}DatatypeProperty' FROM data_props UNION SELECT {U('entity')}, {U('attribute')}, value FROM data_props
UNION SELECT {U('a.n_name')}, '{export.OWL}disjointWith', {U('b.n_name')} FROM nation_a a, nation_b b UNION SELECT * FROM (VALUES ('{export.BASE}partOf', '{export.RDF}type', '{export.OWL}TransitiveProperty'), ('{export.BASE}tradesWith', '{export.RDF}type', '{export.OWL}SymmetricProperty'), ('{export.BASE}supplies', '{export.OWL}inverseOf', '{export.BASE}suppliedBy'), ('http://example.org/ontology', '{export.RDF}type', '{export.OWL}Ontology'), ('http://example.org/ontology', '{export.RDFS}label', 'ontology'))"""


def all_triples(spark, d):
    g = Graph(spark, d)
    return export.triples(g.nodes, g.edges, g.data_props, g.axioms)


@query("k6_triples", sql(TRIPLES))
def k6(spark, d):
    return all_triples(spark, d).select("s", "p", "o").distinct()


@query("k7_ntriples")
def k7b(spark, d):
    """All triples; the SQL of k6_triples has no kinds of literals, so tests hold small graphs against expected lines."""
    return export.ntriples(all_triples(spark, d))


@query("k7_turtle", sql("SELECT '<' || s || '>' AS s, count(*) AS pairs FROM (" + TRIPLES + ") GROUP BY 1"))
def k7t(spark, d):
    t = export.turtle(all_triples(spark, d))
    return t.select(F.split_part("line", F.lit(" "), F.lit(1)).alias("s"), F.size(F.split("line", " ;\n    ")).cast("long").alias("pairs"))


@query("k9_schema", f"SELECT '{export.BASE}' || n_name AS s, '{export.RDF}type' AS p, '{export.OWL}Class' AS o FROM nation UNION SELECT '{export.BASE}' || n_name, '{export.RDFS}subClassOf', '{export.BASE}' || replace(r_name, ' ', '_') FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT '{export.BASE}size', '{export.RDF}type', '{export.OWL}DatatypeProperty' UNION SELECT '{export.BASE}size', '{export.RDFS}range', '{export.XSD}integer'")
def k9(spark, d):
    c = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"))
    p = spark.createDataFrame([("size", "data", None, "int")], "name string, kind string, domain string, range string")
    return export.schema_triples(c, p).select("s", "p", "o")


@query("k1_stats", sql("SELECT (SELECT count(*) FROM nodes WHERE kind = 'class') AS classes, (SELECT count(*) FROM nodes WHERE kind = 'instance') AS instances, (SELECT count(*) FROM edges) AS relations, 7 AS axioms, (SELECT count(*) FROM data_props) AS data_properties"))
def k1(spark, d):
    g = Graph(spark, d)
    return export.stats(g.nodes, g.edges, g.axioms, g.data_props)


@query("k1_node_link", sql("SELECT 'node' AS kind, id AS a, kind AS b, type AS c FROM nodes UNION ALL SELECT 'link', src, relation, dst FROM edges UNION ALL SELECT 'data_property', entity, attribute, value FROM data_props UNION ALL SELECT 'axiom', axiom, NULL, NULL FROM (SELECT unnest(['disjointness', 'transitivity', 'symmetry', 'inverse', 'domain', 'range', 'asymmetry']) AS axiom)"))
def k1n(spark, d):
    """The JSON of each row is read back."""
    g = Graph(spark, d)
    field = lambda *names: F.coalesce(*(F.get_json_object("json", f"$.{n}") for n in names), F.lit(None).cast("string"))
    rows = export.node_link(g.nodes, g.edges, g.axioms, g.data_props)
    return rows.select("kind", field("id", "src", "entity", "axiom_type").alias("a"), F.coalesce(F.get_json_object("json", "$.relation"), F.get_json_object("json", "$.attribute"), F.get_json_object("json", "$.kind")).alias("b"), field("dst", "value", "type").alias("c"))


@query("s3_node_link", sql("SELECT 'node' AS kind, id AS a, kind AS b, coalesce(description, '') AS c FROM nodes UNION ALL SELECT 'link', src, relation, dst FROM edges UNION ALL SELECT 'data_property', entity, attribute, value FROM data_props UNION ALL SELECT 'origin', src, origin, dst FROM edges UNION ALL SELECT 'axiom', a, CASE WHEN a = 'disjointness' THEN n0.n_name || ',' || n1.n_name WHEN a = 'transitivity' THEN 'partOf' WHEN a IN ('symmetry', 'asymmetry') THEN 'tradesWith' WHEN a = 'inverse' THEN 'supplies,suppliedBy' WHEN a = 'domain' THEN 'supplies,Supplier' ELSE 'supplies,Product' END, NULL FROM (SELECT unnest(['disjointness', 'transitivity', 'symmetry', 'inverse', 'domain', 'range', 'asymmetry']) AS a), nation_a n0, nation_b n1"))
def s3(spark, d):
    """The whole graph written as node-link JSON files and read again in splits, with axioms, data properties and fields without a column of their own."""
    import atexit

    from ..scratch import drop, scratch_path
    from ..sources import node_link

    g, path = Graph(spark, d), scratch_path(spark, "node_link")
    atexit.register(drop, spark, path)
    node_link.write_kb({"nodes": g.nodes, "edges": g.edges, "axioms": g.axioms, "data_props": g.data_props}, path)
    t = node_link.read_kb(spark, path)
    row = lambda df, kind, a, b, c: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), b.alias("b"), c.alias("c"))
    e, none = t["edges"], F.lit(None).cast("string")
    both = lambda kind, b: F.struct(F.lit(kind).alias("kind"), F.col("src").alias("a"), b.alias("b"), F.col("dst").alias("c"))
    # both rows of an edge come from one reading of its JSON
    out = row(t["nodes"], "node", "id", F.col("kind"), F.col("description")).unionByName(e.select(F.inline(F.array(both("link", F.col("relation")), both("origin", F.col("attributes")["origin"])))))
    return out.unionByName(row(t["data_props"], "data_property", "entity", F.col("attribute"), F.col("value"))).unionByName(row(t["axioms"], "axiom", "axiom_type", F.array_join("entities", ","), none))


@query("k16_describe", "SELECT doc_id, CASE WHEN length(p) <= 250 THEN p ELSE regexp_extract(substr(p, 1, 250), '(?s)^(.*)\\s', 1) END AS description FROM (SELECT doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda x: length(x) > 30)[1] AS p FROM documents)")
def k16(spark, d):
    return table(spark, d, "documents").select("doc_id", export.describe("text").alias("description"))


@query("s1_documents", "SELECT page_id, CASE WHEN page_id % 3 = 2 THEN NULL ELSE html END AS text, CASE WHEN page_id % 3 = 2 THEN 'unsupported file type: .bin' END AS error FROM pages")
def s1(spark, d):
    """Pages as files of several suffixes, through the loader's parser."""
    from ..sources.documents import parse_documents

    name = F.concat(F.col("page_id").cast("string"), F.when(F.pmod("page_id", F.lit(3)) == 0, ".txt").when(F.pmod("page_id", F.lit(3)) == 1, ".MD").otherwise(".bin"))
    files = table(spark, d, "pages").select(name.alias("path"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    return parse_documents(files).select(F.split_part("path", F.lit("."), F.lit(1)).cast("long").alias("page_id"), "text", "error")


@query("s9_logs", "SELECT user_id, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1")
def s9(spark, d):
    """Events appended to a JSON log in two runs, and read back."""
    from ..scratch import scratch_path
    from ..sources.kb import append_log, read_log

    e, path = table(spark, d, "events"), scratch_path(spark, "log")
    for part in (e.where("event_type = 'purchase'"), e.where("event_type != 'purchase' or event_type is null")):
        append_log(part.select("event_id", "user_id", "value"), path)
    log = read_log(spark, path, "event_id long, user_id long, value double")
    return log.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query("c2_extract")
def c2(spark, d):
    """Rows of the deterministic extractor over every chunk; tests hold it against plain Python."""
    from ..functions import fixed, text

    chunks = table(spark, d, "documents").select("doc_id", F.posexplode(text.chunks_fixed("text", fixed.CHUNK_SIZE, fixed.CHUNK_OVERLAP)).alias("chunk_id", "text")).withColumn("chunk_id", F.col("chunk_id").cast("long"))
    return ex.extract(chunks).select("doc_id", "chunk_id", F.size("classes").alias("classes"), F.size("relations").alias("relations"), "error")


def said_of_parts(spark, d):
    """Three chunks for each part: its type is a product; it and another thing are of a type; what it contains, and its size."""
    word = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), word("p_type").alias("t"), word("p_brand").alias("b"), F.concat(F.lit("Part"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("string").alias("size"))
    first = F.concat(F.lit("A "), "t", F.lit(" is a product. No "), "t", F.lit(" is a "), "b", F.lit("."))
    second = F.concat("name", F.lit(" is a "), "t", F.lit(". Other"), "name", F.lit(" is a ghost."))
    third = F.concat("name", F.lit(" contains a product. "), "name", F.lit(" requires Other"), "name", F.lit(". "), "name", F.lit(" has a size of "), "size", F.lit(". Other"), "name", F.lit(" has a size of 9."))
    return p.select("doc_id", F.posexplode(F.array(first, second, third)).alias("chunk_id", "text")).withColumn("chunk_id", F.col("chunk_id").cast("long"))


@query("c2_three_stages", """WITH p AS (SELECT p_partkey AS doc_id, regexp_replace(lower(p_type), '[^a-z]', '', 'g') AS t, 'Part' || p_partkey AS name, p_size::VARCHAR AS size FROM part)
SELECT doc_id, 0::BIGINT AS chunk_id, 'class' AS kind, t AS a, 'product' AS b, NULL AS c FROM p UNION ALL SELECT doc_id, 0, 'class', 'product', NULL, NULL FROM p
UNION ALL SELECT doc_id, 1, 'instance', name, t, NULL FROM p UNION ALL SELECT doc_id, 2, 'relation', name, 'contains', 'product' FROM p UNION ALL SELECT doc_id, 2, 'value', name, 'size', size FROM p""")
def c2s(spark, d):
    """Classes of one chunk name the instances of the next, and both the relations of the last; what isn't known by then is dropped: ghosts, what they have, and axioms of brands."""
    got = ex.staged_extract(said_of_parts(spark, d))
    row = lambda kind, column, a, b, c: got.select("doc_id", "chunk_id", F.explode(column).alias("x")).select("doc_id", "chunk_id", F.lit(kind).alias("kind"), F.col(a).alias("a"), (F.col(b) if b else F.lit(None).cast("string")).alias("b"), (F.col(c) if c else F.lit(None).cast("string")).alias("c"))
    out = row("class", "classes", "x.name", "x.parent", None).unionByName(row("instance", "instances", "x.name", "x.class_name", None))
    out = out.unionByName(row("relation", "relations", "x.src", "x.relation", "x.dst")).unionByName(row("value", "data_properties", "x.entity", "x.attribute", "x.value"))
    return out.unionByName(got.select("doc_id", "chunk_id", F.explode("axioms").alias("x")).select("doc_id", "chunk_id", F.lit("axiom").alias("kind"), F.col("x.axiom_type").alias("a"), F.array_join("x.entities", ",").alias("b"), F.lit(None).cast("string").alias("c")))


@query("l2_complete", "SELECT p_partkey AS seq, CASE WHEN p_size = 1 THEN '' ELSE upper(p_name) END AS reply, CASE WHEN p_size = 1 THEN 'context length exceeded' END AS error FROM part")
def l2(spark, d):
    """A model that answers in capitals, and can't take some prompts."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.when(F.col("p_size") == 1, "long").otherwise("short"), F.lit(":"), "p_name").alias("prompt"))

    def model(prompt):
        if prompt.startswith("long:"):
            raise ValueError("context length exceeded")
        return prompt.split(":", 1)[1].upper()

    return ex.complete(p, model).select("seq", "reply", "error")


@query("k13_sections", "SELECT page_id, '## ' || url || chr(10) || 'Source: ' || url || chr(10) || 'Fidelity: ' || CASE WHEN regexp_matches(h, '(docs\\.|readthedocs|wiki\\.|wikipedia\\.org|\\.gov)') THEN 'documentation' WHEN regexp_matches(h, '(blog\\.|wordpress\\.com|blogspot\\.com)') THEN 'blog' ELSE 'post' END || chr(10) || 'Query: page' || chr(10) || chr(10) || lower(url) AS section FROM (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h FROM pages WHERE url IS NOT NULL)")
def k13s(spark, d):
    from ..functions import text

    p = table(spark, d, "pages").where("url is not null")
    return export.page_sections(p.select("page_id", "url", F.lit(None).cast("string").alias("title"), F.lower("url").alias("content"), text.fidelity("url").alias("fidelity"), F.lit("page").alias("query")))


@query("k16_boilerplate", "SELECT page_id, CASE WHEN contains(url, 'example.com') THEN split_part(url, '/de/', 1) WHEN contains(url, 'example.net') THEN split_part(url, '/en/', 1) ELSE url END AS content FROM pages")
def k16b(spark, d):
    return table(spark, d, "pages").select("page_id", export.strip_boilerplate("url", {"example.net": "/en/", "example.com": "/de/"}, "url").alias("content"))


@query("k14_view_rows", sql("SELECT 'node' AS kind, n.id AS a, CASE WHEN coalesce(d.k, 0) > 80 THEN 0 WHEN coalesce(d.k, 0) >= 10 THEN 1 WHEN coalesce(d.k, 0) >= 2 THEN 2 ELSE 3 END::VARCHAR AS b, NULL AS c FROM nodes n LEFT JOIN (SELECT id, count(*) AS k FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) d USING (id) UNION ALL SELECT 'edge', src, relation, dst FROM edges GROUP BY src, relation, dst"))
def k14(spark, d):
    from ..operators.viewer import view_rows

    g = Graph(spark, d)
    j = lambda n: F.get_json_object("json", f"$.{n}")
    rows, node = view_rows(g.nodes, g.edges), F.col("kind") == "node"
    return rows.select("kind", F.when(node, j("id")).otherwise(j("src")).alias("a"), F.when(node, j("ring")).otherwise(j("relation")).alias("b"), j("dst").alias("c"))
