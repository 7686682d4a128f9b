"""Taxonomies and their enrichment: parents asked in batches, clusters of leaves, instances for classes that have few."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..scratch import stored
from .build import taxonomy
from .extract import complete, repair_json
from .quality import degrees
from .vector import clusters, encode, hash_encoder

#: Classes of a prompt, and top-level classes that need no second pass.
BATCH, ROOTS = 40, 10


def head_nouns(prompt: str) -> str:
    """The model by default: in the prompt's last line, a JSON list of names, a name of several words has the name of its last words, the longest one listed, as parent."""
    names = json.loads(prompt.strip().splitlines()[-1])
    known = {n.lower(): n for n in names}
    parent = lambda n: next((known[t] for i in range(1, len(n.split())) if (t := " ".join(n.lower().split()[i:])) in known), None)
    return json.dumps({"taxonomy": [{"name": n, "parent": parent(n)} for n in names]})


def _ask(names: DataFrame, model: Callable[[str], str], what: str) -> DataFrame:
    """(name, parent) of replies about groups of names (batch, name)."""
    groups = names.groupBy(F.col("batch").alias("seq")).agg(F.to_json(F.sort_array(F.collect_list("name"))).alias("j"))
    asked = complete(groups.select("seq", F.concat(F.lit(what + "\n"), "j").alias("prompt")), model)

    def rows(batches):
        import pandas as pd

        for b in batches:
            out = []
            for r in b["reply"]:
                got = repair_json(r or "")
                got = got.get("taxonomy") or got.get("roots") if isinstance(got, dict) else None
                out += [(e["name"], e.get("parent") or None) for e in got or [] if isinstance(e, dict) and e.get("name")] if isinstance(got, list) else []
            yield pd.DataFrame(out, columns=["name", "parent"])

    return asked.mapInPandas(rows, "name string, parent string")


def build_taxonomy(classes: DataFrame, model: Callable[[str], str] = head_nouns, batch: int = BATCH) -> DataFrame:
    """(name, parent, description, synonyms): classes (name, seq, parent, description, synonyms) once each, with parents from the model,
    which is asked about some batch names at a time, else as they came. A parent must be a known class and not the class itself; of
    several replies one with a parent counts. With more than ROOTS classes at the top these are asked together once more, the first 20 by name."""
    base = stored(taxonomy(classes), "classes")
    n = base.count()
    names = base.select("name", F.pmod(F.xxhash64("name"), F.lit(max(1, -(-n // batch)))).alias("batch"))
    known = base.select(F.col("name").alias("parent"))

    def valid(rows):
        ok = rows.join(known, "parent", "left_semi").where("name != parent")
        return ok.groupBy("name").agg(F.min("parent").alias("said"))

    out = base.join(valid(_ask(names, model, "Give each class its parent among these, or null.")), "name", "left").withColumn("parent", F.coalesce("said", "parent")).drop("said")
    out = stored(out, "taxonomy")
    top = out.where("parent is null").select("name")
    if top.count() > ROOTS:
        few = top.orderBy("name").limit(20).withColumn("batch", F.lit(0).cast("long"))
        again = valid(_ask(few, model, "Put these top classes under each other where they belong.")).join(few.select("name"), "name", "left_semi")
        out = out.join(again, "name", "left").withColumn("parent", F.coalesce("parent", "said")).drop("said")
    return out.select("name", "parent", "description", "synonyms")


def shortest_is_parent(names: list[str]) -> tuple[str, str]:
    """(parent, child) by default: the shortest name and the first of the others."""
    by = sorted(names, key=lambda n: (len(n), n))
    return by[0], by[1]


def enrich(nodes: DataFrame, edges: DataFrame, choose: Callable[[list[str]], tuple[str, str]] = shortest_is_parent, root: str = "Thing", least: float = fixed.ORPHAN_COSINE, most: int = 5, make=hash_encoder) -> DataFrame:
    """(src, subClassOf, dst, confidence, origin): edges for a flat hierarchy. Classes right under root without subclasses are
    clustered by their vectors; in a cluster of 2 to most names, choose names a parent and its child. Nodes: id, seq, kind, description."""
    sub = edges.where("relation = 'subClassOf'").select("src", "dst").distinct()
    flat = nodes.where("kind = 'class'").join(sub.where(F.col("dst") == root).select(F.col("src").alias("id")), "id", "left_semi").join(sub.select(F.col("dst").alias("id")), "id", "left_anti")
    label = F.concat_ws(" ", "id", F.coalesce("description", F.lit("")))
    v = stored(encode(flat.select("id", F.col("seq").alias("vec_id"), label.alias("label")), "label", make).select("id", "vec_id", "vector"), "leaves")
    groups = clusters(v.select("vec_id", "vector"), least).join(v.select("vec_id", "id"), "vec_id").groupBy("leader").agg(F.count("*").alias("n"), F.sort_array(F.slice(F.collect_list("id"), 1, most)).alias("names")).where(F.col("n").between(2, most))

    def pick(batches):
        import pandas as pd

        for b in batches:
            out = []
            for names in b["names"]:
                parent, child = choose(list(names))
                if parent in names and child in names and parent != child:
                    out.append((child, parent))
            yield pd.DataFrame(out, columns=["src", "dst"])

    new = groups.select("names").mapInPandas(pick, "src string, dst string").join(sub, ["src", "dst"], "left_anti")
    return new.select("src", F.lit("subClassOf").alias("relation"), "dst", F.lit(0.75).alias("confidence"), F.lit("enrichment").alias("origin"))


def population_targets(nodes: DataFrame, edges: DataFrame, most: int = 10, share: float = 0.5) -> DataFrame:
    """(id, degree, instances): classes to find instances for, if there are fewer instances than share of the classes: of those
    without any (or of all, where each has one) the ones with most edges, ties by seq; most of them. Otherwise none."""
    c = nodes.where("kind = 'class'").select("id", "seq")
    n = edges.where("relation = 'type'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("instances"))
    c = c.join(degrees(nodes, edges), "id").join(n, "id", "left").withColumn("instances", F.coalesce("instances", F.lit(0)))
    all_ = nodes.agg(F.count_if(F.expr("kind = 'instance'")).alias("_i"), F.count_if(F.expr("kind = 'class'")).alias("_c"))
    c = c.join(F.broadcast(all_)).where(F.col("_i") < share * F.col("_c"))
    none = c.agg(F.count_if(F.expr("instances = 0")).alias("_none"))
    return c.join(F.broadcast(none)).where("_none = 0 or instances = 0").orderBy(F.desc("degree"), "seq").limit(most).select("id", "degree", "instances")


def boost_population(targets: DataFrame, nodes: DataFrame, windows: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(id, type, description): new instances of the targets' classes that the model finds in windows (text), each name once and none that
    is a node. The targets are at most a few; each is asked about each window."""
    t = targets.select("id").join(nodes.select("id", F.coalesce("description", "id").alias("d")), "id")
    ask = windows.join(F.broadcast(t)).select(F.monotonically_increasing_id().alias("seq"), "id", F.concat(F.lit("Instances of "), "id", F.lit(" ("), "d", F.lit(") as JSON {instances: [{name, description}]} in:\n"), "text").alias("prompt"))
    ask = stored(ask, "tasks")
    got = complete(ask, model).select("seq", "reply").join(ask.select("seq", "id"), "seq")

    def rows(batches):
        import pandas as pd

        for b in batches:
            out = []
            for c, r in zip(b["id"], b["reply"], strict=True):
                v = repair_json(r or "")
                found = v.get("instances") if isinstance(v, dict) else None
                out += [(i["name"].strip(), c, (i.get("description") or "").strip()) for i in found or [] if isinstance(i, dict) and isinstance(i.get("name"), str) and i["name"].strip()] if isinstance(found, list) else []
            yield pd.DataFrame(out, columns=["id", "type", "description"])

    new = got.select("id", "reply").mapInPandas(rows, "id string, type string, description string").join(nodes.select("id"), "id", "left_anti")
    return new.groupBy("id").agg(F.min(F.struct("type", "description")).alias("n")).select("id", "n.type", "n.description")
