"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from .fixture import table
from .registry import query

Q = "'"
LIST = lambda words: ", ".join(f"'{w.replace(Q, Q + Q)}'" for w in words)
STARTS = lambda col, words: " OR ".join(f"starts_with({col}, '{w.replace(Q, Q + Q)}')" for w in words)
#: Names of all kinds to judge: parts, customers, words of documents, urls.
NAMES = "names AS (SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) FROM documents UNION ALL SELECT url FROM pages UNION ALL SELECT regexp_extract(text, '^[^.]*') FROM documents))"


def names(spark, d):
    t = lambda n: table(spark, d, n)
    out = t("part").select(F.col("p_name").alias("name")).union(t("customer").select("c_name")).union(t("documents").select(F.explode(F.split("text", "[ \n]+")))).union(t("pages").select("url"))
    return out.union(t("documents").select(F.regexp_extract("text", r"^[^.]*", 0))).distinct()


@query("p4_token_overlap", "SELECT doc_id, n_name AS name, EXISTS (SELECT 1 FROM unnest(string_split(replace(replace(n_name, '-', ' '), '_', ' '), ' ')) x(w) WHERE length(w) > 1 AND contains(lower(text), lower(w))) AS shares FROM documents, nation")
def p4(spark, d):
    n = F.broadcast(table(spark, d, "nation").select(F.col("n_name").alias("name")))
    return table(spark, d, "documents").join(n).select("doc_id", "name", text.shares_token("name", "text").alias("shares"))


@query("p5_grounded", "SELECT doc_id, b AS name, contains(lower(text), lower(b)) OR EXISTS (SELECT 1 FROM unnest(regexp_split_to_array(lower(b), '\\s+')) x(w) WHERE length(w) > 3 AND contains(lower(text), w)) AS grounded FROM documents, (SELECT DISTINCT p_name AS b FROM part)")
def p5(spark, d):
    n = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return table(spark, d, "documents").join(n).select("doc_id", "name", text.grounded("name", "text").alias("grounded"))


@query("p5_grounded_full")
def p5b(spark, d):
    """The pairs that hold, with difflib's ratio, which SQL lacks; tests hold this against plain Python."""
    from ..operators import similar

    n = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return similar.grounded_pairs(table(spark, d, "documents").select("doc_id", "text"), n)


@query("p5_grounded_pairs", "WITH n AS (SELECT DISTINCT regexp_extract(text, '[A-Za-z]+ [A-Za-z]+') AS b FROM documents) SELECT DISTINCT doc_id, b AS name FROM documents, n WHERE b <> '' AND (contains(lower(text), lower(b)) OR EXISTS (SELECT 1 FROM unnest(string_split(lower(b), ' ')) x(w) WHERE length(w) > 3 AND contains(lower(text), w)))")
def p5p(spark, d):
    """Each document's first two words as a name, in all documents; with a ratio of 1 only, which is containment, so that SQL has the same pairs."""
    from ..operators import similar

    docs = table(spark, d, "documents").select("doc_id", "text")
    n = docs.select(F.regexp_extract("text", "([A-Za-z]+ [A-Za-z]+)", 1).alias("name")).where("name != ''").distinct()
    return similar.grounded_pairs(docs, n, least=1.0)


@query("p6_noise", f"WITH {NAMES} SELECT name, coalesce(name, '') = '' OR length(name) > 60 OR c IN ({LIST(fixed.NOISE_NAMES)}) OR {' OR '.join(f'regexp_matches(c, {Q}{p}{Q})' for p in fixed.NOISE_PATTERNS)} OR {STARTS('c', fixed.NOISE_STARTS)} AS noise FROM (SELECT name, lower(trim(name, ' ')) AS c FROM names)")
def p6(spark, d):
    return names(spark, d).select("name", text.is_noise("name").alias("noise"))


@query("p7_agent_noise", f"WITH {NAMES} SELECT name, name = '' OR length(name) > 50 OR regexp_matches(c, '^[\\d.%]+$') OR c IN ({LIST(fixed.AGENT_NOISE_NAMES)}) OR {STARTS('c', fixed.AGENT_NOISE_STARTS)} OR (length(name) > 40 AND regexp_matches(name, '[ ,]')) AS noise FROM (SELECT name, lower(trim(name, ' ')) AS c FROM names)")
def p7(spark, d):
    return names(spark, d).select("name", text.is_agent_noise("name").alias("noise"))


@query("p8_concept_name", f"WITH {NAMES} SELECT name, NOT (length(name) > 60 OR s = '' OR regexp_matches(s, '^[\\d.%]+$') OR {STARTS('lower(s)', fixed.CONCEPT_STARTS)} OR (length(s) > 45 AND regexp_matches(s, '[ ,]')) OR lower(s) IN ('e', '100%', 'switch aggro')) AS valid FROM (SELECT name, trim(name, ' ') AS s FROM names)")
def p8(spark, d):
    return names(spark, d).select("name", text.is_concept_name("name").alias("valid"))


@query("p9_definition", f"SELECT conv_id, turn, CASE WHEN NOT (s = '' OR upper(s) = 'NONE' OR length(s) < 15 OR {STARTS('upper(s)', fixed.REFUSALS)}) THEN substr(s, 1, 500) END AS definition FROM (SELECT *, trim(text, ' ') AS s FROM conversations)")
def p9(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.definition("text").alias("definition"))


@query("f1_sentences")
def f1(spark, d):
    """Look-behind isn't in DuckDB's regular expressions; tests hold this against Python's."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences("text")).alias("sentence_id", "sentence"))


@query("f3_sections")
def f3(spark, d):
    """Sections by running count of starts; text before the first start is section 0. Tests hold this against a plain loop."""
    doc = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("lines"), text.section_starts("text").alias("starts"))
    ids = F.transform("lines", lambda _, i: F.aggregate(F.slice("starts", 1, i + 1), F.lit(0), lambda a, s: a + s.cast("int")))
    return doc.select("doc_id", F.explode(F.arrays_zip(ids.alias("section"), F.col("lines").alias("line"))).alias("x")).groupBy("doc_id", F.col("x.section").alias("section")).agg(F.count("*").alias("n_lines"))


@query("f5_fixed_chunks", "SELECT doc_id, i // 1700 AS chunk_id, substr(text, i + 1, 2000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 1700)) AS i FROM documents)")
def f5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.chunks_fixed("text", fixed.CHUNK_SIZE, fixed.CHUNK_OVERLAP)).alias("chunk_id", "chunk")).withColumn("chunk_id", F.col("chunk_id").cast("long"))


@query("f7_relation_names", f"SELECT word, coalesce(m.canonical, word) AS relation FROM (SELECT DISTINCT unnest(string_split('isA KindOf contains part_of consistsOf usedIn owns Requires', ' ')) AS word) LEFT JOIN (VALUES {', '.join(f'({Q}{k}{Q}, {Q}{v}{Q})' for k, v in fixed.RELATION_NAMES.items())}) m(alias, canonical) ON m.alias = lower(word)")
def f7(spark, d):
    return spark.createDataFrame([(w,) for w in "isA KindOf contains part_of consistsOf usedIn owns Requires".split()], "word string").select("word", text.relation_name("word").alias("relation"))


@query("f8_normal_name", f"WITH {NAMES} SELECT name, trim(regexp_replace(regexp_replace(replace(replace(lower(name), '-', ' '), '_', ' '), '''s\\b', '', 'g'), '\\s+', ' ', 'g'), ' ') AS normal FROM names")
def f8(spark, d):
    return names(spark, d).select("name", text.normal_name("name").alias("normal"))


#: A table of lemmas: irregular plurals, and endings with the fewest characters before them.
LEMMAS = text.Lemmas({"mice": "mouse", "children": "child", "the": "the", "is": "is", "was": "was"}, [("sses", "ss", 1), ("ies", "y", 2), ("es", "e", 3), ("s", "", 3), ("ss", "ss", 0), ("us", "us", 0)])


@query("f8_lemmas", """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM documents)
SELECT name, CASE WHEN name IN ('the', 'is', 'was') THEN name WHEN name = 'mice' THEN 'mouse' WHEN name = 'children' THEN 'child' WHEN name LIKE '%sses' AND length(name) >= 5 THEN name[:-3] WHEN name LIKE '%ies' AND length(name) >= 5 THEN name[:-4] || 'y'
  WHEN name LIKE '%es' AND length(name) >= 5 THEN name[:-2] WHEN name LIKE '%ss' OR name LIKE '%us' THEN name WHEN name LIKE '%s' AND length(name) >= 4 THEN name[:-2] ELSE name END AS lemma FROM w""")
def f8l(spark, d):
    """Every word of the documents."""
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("name")).distinct()
    return w.select("name", text.lemmatised("name", LEMMAS).alias("lemma"))


@query("f9_exact_name", f"WITH {NAMES} SELECT name, trim(regexp_replace(regexp_replace(lower(trim(name, ' ')), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'), ' ') AS exact FROM names")
def f9(spark, d):
    return names(spark, d).select("name", text.exact_name("name").alias("exact"))


@query("f10_token_overlap", "SELECT a, b, len(list_intersect(x, y)) / greatest(len(x), len(y)) AS overlap FROM (SELECT a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM (SELECT DISTINCT p_name AS a FROM part), (SELECT DISTINCT p_name AS b FROM part))")
def f10(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    return p.join(p.withColumnRenamed("a", "b")).select("a", "b", text.token_overlap("a", "b").alias("overlap"))


@query("f11_tokens", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def f11(spark, d):
    return table(spark, d, "documents").select("doc_id", text.estimate_tokens("text").alias("tokens"))


@query("f12_fences", "SELECT conv_id, turn, trim(text, ' ') AS plain FROM conversations")
def f12(spark, d):
    fenced = F.concat(F.lit("```json\n"), F.trim("text"), F.lit("\n```"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.strip_fences(fenced).alias("plain"))


@query("f13_split_camel", "SELECT DISTINCT lower(regexp_replace(regexp_replace(p_type || initcap_, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')) AS words FROM (SELECT p_type, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS initcap_ FROM part)")
def f13(spark, d):
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.lower(F.expr("substring(p_name, 2)")))
    return table(spark, d, "part").select(text.split_camel(F.concat("p_type", name)).alias("words")).distinct()


@query("f14_normal_token", f"WITH {NAMES} SELECT name, trim(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), ' ') AS token FROM names")
def f14(spark, d):
    return names(spark, d).select("name", text.normal_token("name").alias("token"))


CONV = "SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def turns(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("x")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y")), ["conv_id", "turn"])


CLAIMS = "list_filter(list_transform(regexp_split_to_array(x, '[.!?]'), lambda s: trim(s, ' ')), lambda s: length(s) > 10)"


@query("f15_context_recall", f"SELECT conv_id, turn, CASE WHEN len(c) = 0 THEN 1e0 ELSE len(list_filter(c, lambda s: contains(lower(y), lower(s)))) / len(c) END AS recall FROM (SELECT *, {CLAIMS} AS c FROM ({CONV}))")
def f15(spark, d):
    return turns(spark, d).select("conv_id", "turn", text.context_recall(text.claims("x"), F.array("y")).alias("recall"))


TOK = "list_filter(regexp_split_to_array(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), ' '), '\\s+'), lambda w: length(w) > 1 AND NOT list_contains([" + LIST(fixed.STOPWORDS) + "], w))"


@query("f16_relaxed_recall", f"SELECT conv_id, turn, CASE WHEN len(k) = 0 THEN 1e0 ELSE len(list_filter(k, lambda t: len(list_filter(t, lambda w: contains(ctx, w))) >= 0.75 * len(t))) / len(k) END AS recall FROM (SELECT *, list_filter(list_transform({CLAIMS}, lambda s: {TOK.format('s')}), lambda t: len(t) >= 3) AS k, trim(regexp_replace(lower(y), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), ' ') AS ctx FROM ({CONV}))")
def f16(spark, d):
    return turns(spark, d).select("conv_id", "turn", text.context_recall_relaxed(text.claims("x"), F.array("y")).alias("recall"))


@query("f17_entity_recall", "SELECT doc_id, len(list_filter(e, lambda w: contains(lower(text), lower(w)))) / len(e) AS recall FROM (SELECT doc_id, text, (SELECT list(n_name ORDER BY n_nationkey) FROM nation) || ['The', 'Die'] AS e FROM documents)")
def f17(spark, d):
    n = table(spark, d, "nation").agg(F.sort_array(F.collect_list("n_name")).alias("e"))
    return table(spark, d, "documents").join(F.broadcast(n)).select("doc_id", text.entity_recall(F.concat("e", F.array(F.lit("The"), F.lit("Die"))), F.array("text")).alias("recall"))


@query("f18_answer_f1", f"SELECT conv_id, turn, CASE WHEN len(p) = 0 AND len(r) = 0 THEN 1e0 WHEN len(r) = 0 OR len(p) = 0 THEN 0e0 ELSE 2e0 * len(list_intersect(p, r)) / (len(p) + len(r)) END AS f1 FROM (SELECT *, list_distinct({TOK.format('x')}) AS p, list_distinct({TOK.format('y')}) AS r FROM ({CONV}))")
def f18(spark, d):
    return turns(spark, d).select("conv_id", "turn", text.answer_f1("x", "y").alias("f1"))


@query("f19_entities")
def f19b(spark, d):
    """All documents. \\b differs between engines next to accents, so tests hold this against Python's."""
    return table(spark, d, "documents").select("doc_id", F.size(text.entities_in("text")).cast("long").alias("n"))


@query("f20_ngrams", "SELECT p_partkey, count(DISTINCT g) AS n FROM (SELECT p_partkey, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ') AS w FROM part), range(2, 5) a(n), range(1, 12) b(i) WHERE i + n - 1 <= len(w)) WHERE length(g) >= 4 GROUP BY 1")
def f20(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.size(text.ngrams(F.concat_ws(" ", "p_name", "p_type", "p_brand"))).cast("long").alias("n"))


@query("f21_fact_parts", "SELECT p_partkey, p_name AS subject, 'size' AS attribute, p_size::VARCHAR AS value FROM part")
def f21(spark, d):
    fact = F.concat(F.lit("subject: "), "p_name", F.lit(", attribute: size, value: "), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", text.fact_parts(fact).alias("f")).select("p_partkey", "f.subject", "f.attribute", "f.value")


@query("f22_claims", f"SELECT conv_id, turn, len({CLAIMS}) AS n FROM (SELECT *, text AS x FROM conversations)")
def f22(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(text.claims("text")).cast("long").alias("n"))


@query("f23_score", "SELECT l_orderkey, l_linenumber, l_discount AS score FROM lineitem")
def f23(spark, d):
    said = F.concat(F.lit("score: "), F.when(F.col("l_discount") == 0, "0").otherwise(F.format_number("l_discount", 2)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.score_in(said).alias("score"))


FIDELITY = "CASE " + " ".join(f"WHEN regexp_matches(h, '{p}') THEN {s}" for s, p in fixed.FIDELITY) + f" ELSE {fixed.FIDELITY_DEFAULT} END"


@query("f24_fidelity", f"SELECT page_id, ({FIDELITY})::DOUBLE AS fidelity FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h FROM pages)")
def f24(spark, d):
    return table(spark, d, "pages").select("page_id", text.fidelity("url").alias("fidelity"))


@query("f25_source_label", "SELECT s_name || ' supplies ' || p_name AS label FROM supplier, (SELECT DISTINCT p_name FROM part) UNION ALL SELECT c_name FROM customer")
def f25(spark, d):
    s = table(spark, d, "supplier").select(F.replace("s_name", F.lit("-"), F.lit("_")).alias("s_name")).join(table(spark, d, "part").select("p_name").distinct())
    refs = s.select(F.concat(F.lit("edge:"), "s_name", F.lit("-supplies-"), "p_name").alias("ref")).union(table(spark, d, "customer").select(F.concat(F.lit("node:"), "c_name")))
    return refs.select(text.source_label("ref").alias("label"))


@query("f26_clean_answer", "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text || ' ', '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ') AS answer FROM conversations")
def f26(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.clean_answer(F.concat("text", F.lit(" [node:A][dp:B:c]"))).alias("answer"))


@query("f27_concepts", f"SELECT conv_id, turn, coalesce((SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT regexp_extract_all(lower(c.text), '([a-z0-9]+)', 1) AS t)) WHERE length(w) > 1 AND w NOT IN ({LIST(fixed.STOPWORDS)}) GROUP BY w ORDER BY i LIMIT 10)), []) AS concepts FROM conversations c")
def f27(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.concepts_in("text").alias("concepts"))


@query("f28_domain_hint", "SELECT CASE WHEN len(list_filter(['block', 'mob', 'biome'], lambda w: contains(lower(string_agg(p_name, ' ')), w))) >= 2 THEN 'Minecraft' END AS hint FROM part")
def f28(spark, d):
    from ..operators.retrieve import domain_hint

    return domain_hint(table(spark, d, "part").select(F.col("p_name").alias("id"))).select("hint")


@query("f29_search_queries", "SELECT n_name AS id, n_name || ' definition' AS query FROM nation")
def f29(spark, d):
    from ..operators.retrieve import search_queries

    return search_queries(table(spark, d, "nation").select(F.col("n_name").alias("id")))


@query("f31_edge_id", "SELECT c_name AS src, n_name AS dst, substr(md5(c_name || chr(0) || n_name || chr(0) || 'type'), 1, 12) AS edge_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def f31(spark, d):
    e = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return e.select(F.col("c_name").alias("src"), F.col("n_name").alias("dst"), text.edge_id("c_name", "n_name", F.lit("type")).alias("edge_id"))


@query("f33_with_sources", "SELECT s_name, 'node:' || s_name || ' [sources: ' || n_name || ', file.txt]' AS ref FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def f33(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_name", text.with_sources(F.concat(F.lit("node:"), "s_name"), F.array("n_name", F.lit("file.txt"))).alias("ref"))


@query("f34_base_name", "SELECT page_id, regexp_extract(url, '([^/]+)/?$', 1) AS name FROM pages")
def f34(spark, d):
    return table(spark, d, "pages").select("page_id", text.base_name("url").alias("name"))


@query("k8_safe_local", f"WITH {NAMES} SELECT name, coalesce(nullif(trim(regexp_replace(regexp_replace(trim(name, ' '), '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'entity') AS local FROM names")
def k8(spark, d):
    return names(spark, d).select("name", text.safe_local("name").alias("local"))


@query("k13_labels", "SELECT page_id, CASE WHEN regexp_matches(h, '(docs\\.|readthedocs|wiki\\.|wikipedia\\.org|\\.gov)') THEN 'documentation' WHEN regexp_matches(h, '(blog\\.|wordpress\\.com|blogspot\\.com)') THEN 'blog' ELSE 'post' END AS label FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h FROM pages)")
def k13(spark, d):
    return table(spark, d, "pages").select("page_id", text.fidelity_label(text.fidelity("url")).alias("label"))


@query("s7_page_text")
def s7(spark, d):
    """Back references in tag pairs differ between engines; tests hold this against small pages."""
    return table(spark, d, "pages").select("page_id", text.html_text("html").alias("content"))


@query("s8_page_reference", "SELECT page_id, kind, CASE kind WHEN 'reference' THEN 'reference: ' || url WHEN 'pdf' THEN 'pdf: ' || octet_length(encode(coalesce(html, ''))) || ' bytes' END AS content FROM (SELECT *, CASE WHEN contains(url, '/fr/') THEN 'reference' WHEN page_id % 4 = 0 THEN 'pdf' ELSE 'page' END AS kind FROM pages)")
def s8(spark, d):
    """Every fourth link is a .pdf; the text of pages differs between engines and has tests of its own."""
    u = F.when((F.col("page_id") % 4 == 0) & ~F.contains("url", F.lit("/fr/")), F.concat("url", F.lit(".PDF"))).otherwise(F.col("url"))
    c = table(spark, d, "pages").select("page_id", text.link_content(u, "html", ["/fr/"]).alias("c"))
    return c.select("page_id", "c.kind", F.when(F.col("c.kind") != "page", F.col("c.content")).alias("content"))


@query("f11_fit_budget", "SELECT doc_id, CASE WHEN 500 + greatest(1, length(text) // 4) <= 800 THEN text ELSE substr(text, 1, greatest(200, length(text) - ((500 + greatest(1, length(text) // 4) - 800) * 4 + 100))) || chr(10) || '[truncated]' END AS text FROM documents")
def f11b(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fit_budget("text", F.lit(500), 800).alias("text"))


@query("f28_metadata_hint", "SELECT 'Minecraft' AS hint")
def f28b(spark, d):
    from ..operators.retrieve import domain_hint

    return domain_hint(table(spark, d, "nation").select(F.col("n_name").alias("id")), "notes about crafting").select("hint")
