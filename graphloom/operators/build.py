"""From documents to a graph: chunks, extraction, taxonomy, aggregation, inference, quality; and enrichment from pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..scratch import stored
from ..settings import Settings
from . import extract, merge, quality, reason
from .contain import found_in

SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def semantic_chunks(t: str, size: int, overlap: int) -> list[str]:
    """Sentences packed to size characters; each chunk begins with the last sentences of the one before, as few as have overlap characters. A text that makes under two chunks is cut by length."""
    out, held, fresh = [], [], False
    for s in (x.strip() for x in SENTENCE.split(t or "")):
        if not s:
            continue
        if held and fresh and sum(map(len, held)) + len(held) + len(s) > size:
            out.append(" ".join(held))
            keep, n = [], 0
            for x in reversed(held):
                if n >= overlap or n + len(x) > size // 2:
                    break
                keep.insert(0, x)
                n += len(x)
            held = keep
        held.append(s)
        fresh = True
    if held and fresh:
        out.append(" ".join(held))
    if len(out) < 2:
        step = size - min(overlap, size - 1)
        return [t[i : i + size] for i in range(0, len(t or ""), step)]
    return out


def chunk(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, chunk_id, text) of docs (doc_id, text), by sentences or by length."""
    if s.chunk_mode == "fixed":
        parts = docs.select("doc_id", F.posexplode(text.chunks_fixed("text", s.chunk_size, s.chunk_overlap)).alias("chunk_id", "text"))
        return parts.withColumn("chunk_id", F.col("chunk_id").cast("long"))
    size, overlap = s.chunk_size, s.chunk_overlap

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(i, k, c) for i, t in zip(b["doc_id"], b["text"], strict=True) for k, c in enumerate(semantic_chunks(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_id long, text string")


def taxonomy(classes: DataFrame, most: int | None = None) -> DataFrame:
    """(name, parent): one row a class; a parent must be a known class and not the class itself."""
    c = merge.dedup_classes(classes)
    known = c.select(F.lower("name").alias("p"), F.col("name").alias("parent_name"))
    out = c.withColumn("p", F.lower("parent")).join(known, "p", "left").withColumn("parent", F.when(F.lower("parent_name") != F.lower("name"), F.col("parent_name")))
    return out.select("name", "parent", "description", "synonyms")


def build(docs: DataFrame, axioms: DataFrame, settings: Settings | None = None, extractor=None, staged: bool = False) -> dict[str, DataFrame]:
    """nodes, edges, inferred, errors of docs; staged, with extract.staged_extract, data_props and axioms as well, and the axioms found
    take part in the inference. Chunk ids are doc_id and chunk_id as one text, so votes are chunks that say the same."""
    s = (settings or Settings()).effective()
    if staged:
        got = extract.staged_extract(chunk(docs, s), extractor or extract.staged_rules)
    else:
        got = extract.extract(chunk(docs, s), extractor or extract.extract_rules)
    got = stored(got.withColumn("chunk", F.concat_ws(":", "doc_id", "chunk_id")), "extracted")
    cls = got.select("chunk", F.inline("classes")).select("chunk", "name", "parent", "description")
    ins = got.select("chunk", F.inline("instances")).select("chunk", "name", "class_name")
    rel = got.select("chunk", F.inline("relations"))
    raw = cls.select("name", F.xxhash64("chunk").alias("seq"), "parent", "description", F.array().cast("array<string>").alias("synonyms"))
    tax = stored(taxonomy(raw), "taxonomy")
    occ = rel.select("src", text.relation_name("relation").alias("relation"), "dst", "confidence", F.col("chunk").alias("chunk_id"))
    occ = occ.unionByName(cls.where("parent is not null").select(F.col("name").alias("src"), F.lit("subClassOf").alias("relation"), F.col("parent").alias("dst"), F.lit(1.0).alias("confidence"), F.col("chunk").alias("chunk_id")))
    occ = occ.unionByName(ins.select(F.col("name").alias("src"), F.lit("type").alias("relation"), F.col("class_name").alias("dst"), F.lit(1.0).alias("confidence"), F.col("chunk").alias("chunk_id")))
    # occurrences are kept, not triples with all their chunks: one triple can be said by most chunks, and only who asks for chunk_ids gathers them
    edges = merge.aggregate_triples(stored(extract.valid_relations(occ), "occurrences"))
    nodes = tax.select(F.col("name").alias("id"), F.lit("Class").alias("type"), F.lit("class").alias("kind"), "description")
    nodes = nodes.unionByName(ins.groupBy(F.col("name").alias("id")).agg(F.min("class_name").alias("type")).select("id", "type", F.lit("instance").alias("kind"), F.lit(None).cast("string").alias("description")))
    nodes = nodes.groupBy("id").agg(F.min_by(F.struct("type", "kind", "description"), "kind").alias("n")).select("id", "n.*").withColumn("seq", F.xxhash64("id"))
    out = {"nodes": nodes, "edges": edges, "errors": got.where("error is not null").select("doc_id", "chunk_id", "error")}
    if staged:
        axioms = axioms.select("axiom_type", "entities").unionByName(got.select(F.inline("axioms"))).distinct()
        out |= {"axioms": axioms, "data_props": got.select(F.inline("data_properties")).distinct()}
    return out | {"inferred": reason.infer(edges, axioms)}


def gated_merge(old: dict, new: dict, min_score: float = 0.0, min_nodes: int = 0) -> tuple[dict, DataFrame]:
    """The old graph with the new one's rows, unless the new one is too small or unreliable; and one row of counters with the score and whether it was merged."""
    score = quality.reliability(quality.structure(new["nodes"], new["edges"])).first().score
    ok = score >= min_score and new["nodes"].count() >= min_nodes
    counters = merge.merge_counters(old["nodes"], new["nodes"], old["edges"], new["edges"]).withColumn("score", F.lit(score)).withColumn("merged", F.lit(ok))
    if not ok:
        return old, counters
    join = lambda t, k: merge.merge_graphs(old[t].select(*new[t].columns), new[t], k)
    return {"nodes": join("nodes", ["id"]), "edges": join("edges", ["src", "relation", "dst"])}, counters


def plan_queries(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """(id, query): searches for the highest-ranked nodes."""
    from .graph import rank_nodes
    from .retrieve import search_queries

    return search_queries(rank_nodes(nodes, edges, most).select("id"))


def enrichment_pages(queries: DataFrame, pages: DataFrame, least: float, each: int = 3) -> DataFrame:
    """Pages (page_id, url, content, fidelity) whose text has a planned query's concept: each page once, at most each of a query, of enough fidelity. Concepts and texts meet in a containment join."""
    q = queries.select("id", "query", F.lower("id").alias("pattern"))
    rows = pages.select(F.struct("page_id", "url", "content", "fidelity").alias("key"), F.lower("content").alias("text"))
    hit = found_in(rows, q).join(q, "pattern").select("id", "query", "key.*")
    first = hit.groupBy("page_id").agg(F.min(F.struct("id", "query", "url", "content", "fidelity")).alias("h")).select("page_id", "h.*")
    best = first.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("fidelity"), "page_id"))).where(F.col("_r") <= each).drop("_r")
    return extract.by_fidelity(best, least)
