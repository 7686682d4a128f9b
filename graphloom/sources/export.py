"""Triples, node-link JSON and other sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text

RDF, RDFS, OWL, XSD, SKOS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/2004/02/skos/core#"
BASE = "http://example.org/ontology#"


def uri(name, base: str = BASE) -> Column:
    return F.concat(F.lit(base), text.safe_local(name))


def triples(nodes: DataFrame, edges: DataFrame, data_props: DataFrame, axioms: DataFrame, base: str = BASE, label: str = "ontology") -> DataFrame:
    """(s, p, o, o_kind, datatype), distinct: an ontology header, classes with comments, individuals with types, subClassOf between
    classes, rdf:type from individuals to classes, every other relation as a declared object property, typed data properties, axioms."""
    u = lambda c: uri(c, base)
    row = lambda df, s, p, o, kind="uri", dt=None: df.select(s.alias("s"), (p if isinstance(p, Column) else F.lit(p)).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), (F.lit(dt) if not isinstance(dt, Column) else dt).cast("string").alias("datatype"))
    c, i = nodes.where("kind = 'class'"), nodes.where("kind = 'instance'")
    kinds = nodes.select("id", "kind")
    e = edges.select("src", "relation", "dst").distinct()
    e = e.join(kinds.select(F.col("id").alias("src"), F.col("kind").alias("sk")), "src", "left").join(kinds.select(F.col("id").alias("dst"), F.col("kind").alias("dk")), "dst", "left")
    other = e.where(~F.col("relation").isin("subClassOf", "type"))
    ent = lambda k: F.get("entities", F.lit(k))
    xsd = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in fixed.XSD.items() for x in kv]), F.lower("datatype")), F.lit("string"))
    one = nodes.sparkSession.range(1)
    parts = [
        row(one, F.lit(base.rstrip("#/")), RDF + "type", F.lit(OWL + "Ontology")),
        row(one, F.lit(base.rstrip("#/")), RDFS + "label", F.lit(label), "literal"),
        row(c, u("id"), RDF + "type", F.lit(OWL + "Class")),
        row(nodes.where("coalesce(description, '') != ''"), u("id"), RDFS + "comment", F.col("description"), "literal"),
        row(nodes, u("id"), RDFS + "label", F.col("id"), "literal"),
        row(i, u("id"), RDF + "type", F.lit(OWL + "NamedIndividual")),
        row(i, u("id"), RDF + "type", u(F.coalesce(F.nullif("type", F.lit("")), F.lit("Thing")))),
        row(e.where("relation = 'subClassOf' and sk = 'class' and dk = 'class'"), u("src"), RDFS + "subClassOf", u("dst")),
        row(e.where("relation = 'type' and sk = 'instance' and dk = 'class'"), u("src"), RDF + "type", u("dst")),
        row(other, u("relation"), RDF + "type", F.lit(OWL + "ObjectProperty")),
        row(other, u("src"), u("relation"), u("dst")),
        row(data_props, u("attribute"), RDF + "type", F.lit(OWL + "DatatypeProperty")),
        row(data_props, u("entity"), u("attribute"), F.col("value"), "literal", F.concat(F.lit(XSD), xsd)),
        row(axioms.where("axiom_type = 'disjointness'"), u(ent(0)), OWL + "disjointWith", u(ent(1))),
        row(axioms.where("axiom_type = 'transitivity'"), u(ent(0)), RDF + "type", F.lit(OWL + "TransitiveProperty")),
        row(axioms.where("axiom_type = 'symmetry'"), u(ent(0)), RDF + "type", F.lit(OWL + "SymmetricProperty")),
        row(axioms.where("axiom_type = 'inverse'"), u(ent(0)), OWL + "inverseOf", u(ent(1))),
    ]
    if "synonyms" in nodes.columns:
        parts.append(row(nodes.select("id", F.explode("synonyms").alias("x")), u("id"), SKOS + "altLabel", F.col("x"), "literal"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def schema_triples(classes: DataFrame, properties: DataFrame, base: str = BASE) -> DataFrame:
    """Triples of a schema: classes (name, parent) and properties (name, kind object or data, domain, range)."""
    u = lambda c: uri(c, base)
    row = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("datatype"))
    xsd = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in fixed.XSD.items() for x in kv]), F.lower("range")), F.lit("string"))
    parts = [row(classes, u("name"), RDF + "type", F.lit(OWL + "Class")), row(classes.where("parent is not null"), u("name"), RDFS + "subClassOf", u("parent"))]
    parts.append(row(properties, u("name"), RDF + "type", F.when(F.col("kind") == "object", OWL + "ObjectProperty").otherwise(OWL + "DatatypeProperty")))
    parts.append(row(properties.where("domain is not null"), u("name"), RDFS + "domain", u("domain")))
    parts.append(row(properties.where("range is not null"), u("name"), RDFS + "range", F.when(F.col("kind") == "object", u("range")).otherwise(F.concat(F.lit(XSD), xsd))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _escaped(c) -> Column:
    c = F.replace(F.col(c), F.lit("\\"), F.lit("\\\\"))
    for a, b in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _object() -> Column:
    lit = F.concat(F.lit('"'), _escaped("o"), F.lit('"'), F.when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), "datatype", F.lit(">"))).otherwise(""))
    return F.when(F.col("o_kind") == "uri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(lit)


def ntriples(t: DataFrame) -> DataFrame:
    """(line): one triple each."""
    return t.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), _object(), F.lit(" .")).alias("line"))


def turtle(t: DataFrame) -> DataFrame:
    """(line): one subject each. A subject's triples meet in one row; subjects are nodes, and the widest are hubs."""
    po = F.concat(F.lit("<"), "p", F.lit("> "), _object())
    return t.groupBy("s").agg(F.array_join(F.sort_array(F.collect_list(po)), " ;\n    ").alias("x")).select(F.concat(F.lit("<"), "s", F.lit("> "), "x", F.lit(" .")).alias("line"))


def jsonld(t: DataFrame) -> DataFrame:
    """(line): one JSON object for each subject and property."""
    value = F.when(F.col("o_kind") == "uri", F.to_json(F.struct(F.col("o").alias("@id")))).otherwise(F.to_json(F.struct(F.col("o").alias("@value"), F.col("datatype").alias("@type"))))
    values = t.groupBy("s", "p").agg(F.array_join(F.sort_array(F.collect_list(value)), ",").alias("v"))
    return values.select(F.concat(F.lit('{"@id":"'), "s", F.lit('","'), "p", F.lit('":['), "v", F.lit("]}")).alias("line"))


def rdfxml(t: DataFrame) -> DataFrame:
    """(line): one rdf:Description for each triple; the caller adds the document's head and end."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    ns, local = F.regexp_extract("p", r"^(.*[#/])", 1), F.regexp_extract("p", r"([^#/]*)$", 1)
    body = F.when(F.col("o_kind") == "uri", F.concat(F.lit(' rdf:resource="'), esc("o"), F.lit('"/>'))).otherwise(F.concat(F.when(F.col("datatype").isNotNull(), F.concat(F.lit(' rdf:datatype="'), "datatype", F.lit('"'))).otherwise(""), F.lit(">"), esc("o"), F.lit("</p:"), local, F.lit(">")))
    return t.select(F.concat(F.lit('<rdf:Description rdf:about="'), esc("s"), F.lit('"><p:'), local, F.lit(' xmlns:p="'), ns, F.lit('"'), body, F.lit("</rdf:Description>")).alias("line"))


FORMATS = {"nt": ntriples, "n-triples": ntriples, "turtle": turtle, "ttl": turtle, "json-ld": jsonld, "jsonld": jsonld, "xml": rdfxml, "rdf+xml": rdfxml, "owl": rdfxml, "rdf": rdfxml}


def serialize(t: DataFrame, format: str) -> DataFrame:
    if format.lower() not in FORMATS:
        raise ValueError(f"unsupported format: {format}")
    return FORMATS[format.lower()](t)


def node_link(nodes: DataFrame, edges: DataFrame, axioms: DataFrame, data_props: DataFrame) -> DataFrame:
    """(kind, json): one row for each node, link, axiom and property, without vectors, so no row holds the graph."""
    plain = lambda df: df.select(*(c for c, t in df.dtypes if t not in ("array<float>", "array<double>")))
    one = lambda df, kind: plain(df).select(F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("json"))
    return one(nodes, "node").unionByName(one(edges, "link")).unionByName(one(axioms, "axiom")).unionByName(one(data_props, "data_property"))


def stats(nodes: DataFrame, edges: DataFrame, axioms: DataFrame, data_props: DataFrame) -> DataFrame:
    n = nodes.agg(F.count_if(F.expr("kind = 'class'")).alias("classes"), F.count_if(F.expr("kind = 'instance'")).alias("instances"))
    return n.join(edges.agg(F.count("*").alias("relations"))).join(axioms.agg(F.count("*").alias("axioms"))).join(data_props.agg(F.count("*").alias("data_properties")))


def page_sections(pages: DataFrame) -> DataFrame:
    """(page_id, section): markdown of scored pages (page_id, url, title, content, fidelity, query)."""
    return pages.select("page_id", F.concat_ws("\n", F.concat(F.lit("## "), F.coalesce("title", "url")), F.concat(F.lit("Source: "), "url"), F.concat(F.lit("Fidelity: "), text.fidelity_label(F.col("fidelity"))), F.concat(F.lit("Query: "), "query"), F.lit(""), "content").alias("section"))


def describe(content) -> Column:
    """The first paragraph of more than 30 characters, cut at a word before 250."""
    p = F.get(F.filter(F.split(text.col(content), "\n\n"), lambda x: F.length(x) > 30), F.lit(0))
    return F.when(F.length(p) <= 250, p).otherwise(F.regexp_extract(F.substring(p, 1, 250), r"(?s)^(.*)\s", 1))


def strip_boilerplate(content, markers: dict[str, str], url) -> Column:
    """The text before the marker of the page's site."""
    c, out = text.col(content), text.col(content)
    for site, mark in markers.items():
        out = F.when(F.contains(text.col(url), F.lit(site)), F.get(F.split(c, mark), F.lit(0))).otherwise(out)
    return out
