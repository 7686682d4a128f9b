"""From chunks to rows: validation, gates, budgets, an extractor interface with a deterministic default."""

from __future__ import annotations

import functools
import json
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..scratch import stored


def chunk_stats(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return rows.groupBy("chunk_id").agg(*(F.count_if(F.col("kind") == v).alias(k) for k, v in kinds.items()))


def cap_per_query(rows: DataFrame, query: str, url: str, seq: str, most: int) -> DataFrame:
    """The first row of each url, then the first most rows of each query."""
    first = rows.groupBy(url).agg(F.min_by(F.struct(*rows.columns), seq).alias("r")).select("r.*")
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(seq))).where(F.col("_r") <= most).drop("_r")


def first_by_name(rows: DataFrame) -> DataFrame:
    """key (lower, trimmed), id, seq: the first row of each name."""
    return rows.groupBy(F.lower(F.trim("id")).alias("key")).agg(F.min_by("id", "seq").alias("id"), F.min("seq").alias("seq"))


def within_budget(rows: DataFrame, key: str, order: str, text: str, most: int) -> DataFrame:
    """The first rows of each key whose texts, with two characters between them, fit."""
    n = F.sum(F.length(text) + 2).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def newest(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """Each key's last rows. Rows beyond the number needed are dropped by a rank that Spark limits before the exchange."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def by_fidelity(pages: DataFrame, least: float, fallback: float = fixed.FIDELITY_DEFAULT) -> DataFrame:
    """Pages of at least this fidelity; if there is none, of the fallback."""
    any_ = pages.agg(F.count_if(F.col("fidelity") >= least).alias("_n"))
    return pages.join(F.broadcast(any_)).where(F.col("fidelity") >= F.when(F.col("_n") > 0, F.lit(least)).otherwise(F.least(F.lit(least), F.lit(fallback)))).drop("_n")


def inferred(rows: DataFrame, least: float = fixed.INFER_CONFIDENCE) -> DataFrame:
    ok = "src is not null and src != '' and dst is not null and dst != ''"
    return rows.where(ok).where(F.coalesce("confidence", F.lit(0.5)) >= least)


def gate(score: Column, grade: Column) -> Column:
    """The threshold: the score if above 0, else the grade's."""
    table = F.create_map(*[x for at, g in fixed.GRADES for x in (F.lit(g), F.lit(at))])
    return F.coalesce(F.when(score > 0, score), F.element_at(table, grade))


def valid_classes(rows: DataFrame) -> DataFrame:
    """Rows with a name; salience from 0 to 1, no confidence or 0 is 1."""
    return rows.where("name is not null and trim(name) != ''").withColumn("salience", F.least(F.greatest("salience", F.lit(0.0)), F.lit(1.0))).withColumn("confidence", F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0)))


def valid_relations(rows: DataFrame) -> DataFrame:
    return rows.where("src is not null and trim(src) != '' and dst is not null and trim(dst) != ''").withColumn("confidence", F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0)))


def valid_axioms(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("axiom_type").isin(fixed.AXIOM_TYPES) & (F.size("entities") > 0))


def attributes(rows: DataFrame) -> DataFrame:
    return rows.select("entity", F.explode("attributes").alias("attribute", "value"))


def wide(rows: DataFrame) -> DataFrame:
    """(entity, props): the last value by seq of each attribute."""
    last = rows.groupBy("entity", "attribute").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "value"))).alias("props"))


EXTRACTION = "classes array<struct<name:string,parent:string,description:string>>, instances array<struct<name:string,class_name:string>>, relations array<struct<src:string,relation:string,dst:string,confidence:double>>"
IS_A = re.compile(r"\b(?:an?|the)\s+([A-Za-z][\w-]*)\s+is\s+an?\s+(?:kind\s+of\s+)?([A-Za-z][\w-]*)", re.I)
INSTANCE = re.compile(r"\b([A-Z][\w-]*)\s+is\s+an?\s+([a-z][\w-]*)")
HAS = re.compile(r"\b([A-Z]?[\w-]+)\s+(contains|causes|enables|prevents|requires)\s+(?:an?\s+|the\s+)?([\w-]+)", re.I)


def extract_rules(chunk: str) -> dict:
    """The deterministic extractor: 'a dog is an animal' is a class and its parent, 'Rex is a dog' an instance, 'X requires Y' a relation."""
    classes = {a.lower(): b.lower() for a, b in IS_A.findall(chunk)}
    inst = {a: b.lower() for a, b in INSTANCE.findall(chunk) if a.lower() not in ("a", "an", "the", "it", "this", "that")}
    names = {**{p: None for p in [*classes.values(), *inst.values()] if p not in classes}, **classes}
    return {"classes": [{"name": n, "parent": p, "description": None} for n, p in sorted(names.items())], "instances": [{"name": n, "class_name": c} for n, c in sorted(inst.items())], "relations": [{"src": a, "relation": r.lower(), "dst": b, "confidence": 1.0} for a, r, b in HAS.findall(chunk)]}


def extract(chunks: DataFrame, extractor: Callable[[str], dict] = extract_rules, attempts: int = 3) -> DataFrame:
    """chunks (doc_id, chunk_id, text) with classes, instances, relations and error. An extractor that fails is asked again up to
    attempts times; then the row is empty and error says why, so that one chunk doesn't end the job."""

    def run(batches: Iterator):
        import pandas as pd

        for b in batches:
            out = []
            for t in b["text"]:
                got, why = {}, None
                for _ in range(attempts):
                    try:
                        got, why = extractor(t or ""), None
                        break
                    except Exception as e:  # any failure of a model
                        why = str(e)[:500]
                out.append((got.get("classes", []), got.get("instances", []), got.get("relations", []), why))
            yield pd.concat([b[["doc_id", "chunk_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["classes", "instances", "relations", "error"])], axis=1)

    return chunks.select("doc_id", "chunk_id", "text").mapInPandas(run, f"doc_id long, chunk_id long, {EXTRACTION}, error string")


#: What each stage of a staged extraction asks for, as columns of rows.
STAGES = {
    "classes": {"classes": "array<struct<name:string,parent:string,description:string,salience:double>>"},
    "instances": {"instances": "array<struct<name:string,class_name:string,description:string>>"},
    "relations": {
        "relations": "array<struct<src:string,relation:string,dst:string,confidence:double>>",
        "data_properties": "array<struct<entity:string,attribute:string,value:string,datatype:string>>",
        "axioms": "array<struct<axiom_type:string,entities:array<string>>>",
    },
}
#: Names that models give the fields of a row.
ALIASES = {"src": ("src", "source"), "dst": ("dst", "target"), "entity": ("entity", "subject"), "axiom_type": ("axiom_type", "type"), "relations": ("relations", "object_properties")}
NOT_A = re.compile(r"\bno\s+([A-Za-z][\w-]*)\s+is\s+an?\s+([A-Za-z][\w-]*)", re.I)
VALUE = re.compile(r"\b([\w-]+)\s+has\s+an?\s+([\w-]+)\s+of\s+([\w-]+)", re.I)


def staged_rules(stage: str, chunk: str, classes: list[dict], instances: list[dict]) -> dict:
    """The deterministic extractor by stages: as extract_rules, with classes that 'a dog is an animal' names, instances of known classes, and 'X has a size of 3' as a value and 'no X is a Y' as disjointness."""
    got = extract_rules(chunk)
    if stage == "classes":
        of_class = {a.lower() for pair in IS_A.findall(chunk) for a in pair}
        return {"classes": [c for c in got["classes"] if c["name"] in of_class]}
    known = {c["name"].lower() for c in classes}
    if stage == "instances":
        return {"instances": [i for i in got["instances"] if i["class_name"].lower() in known]}
    values = [{"entity": e, "attribute": a, "value": v, "datatype": "integer" if v.isdigit() else "string"} for e, a, v in VALUE.findall(chunk)]
    return {"relations": got["relations"], "data_properties": values, "axioms": [{"axiom_type": "disjointness", "entities": [a.lower(), b.lower()]} for a, b in NOT_A.findall(chunk)]}


def prompted(model: Callable[[str], str], prompts: dict[str, str]) -> Callable:
    """A stage extractor by a text model: prompts has, by stage, a text with {chunk}, {classes} and {instances}; the reply is JSON, mended where it can be."""

    def ask(stage, chunk, classes, instances):
        text = prompts[stage]
        for name, value in (("classes", json.dumps(classes)), ("instances", json.dumps(instances)), ("chunk", chunk)):
            text = text.replace("{" + name + "}", value)
        return repair_json(model(text))

    return ask


@functools.cache
def _fields(kind: str) -> list[str]:
    return re.findall(r"(\w+):", kind)


def _rows_of(reply, column: str, kind: str) -> list[dict]:
    """The rows of one column in a stage's reply: a list alone, or under the column's name; fields by any of their names; anything else is left out."""
    if isinstance(reply, dict):
        reply = next((reply[k] for k in ALIASES.get(column, (column,)) if k in reply), [])
    names, out = _fields(kind), []
    for r in reply if isinstance(reply, list) else []:
        if isinstance(r, dict):
            row = {n: next((r[k] for k in ALIASES.get(n, (n,)) if r.get(k) is not None), None) for n in names}
            for n in row:
                if row[n] is not None and n in ("confidence", "salience"):
                    row[n] = float(row[n]) if isinstance(row[n], (int, float)) else None
                elif row[n] is not None and n == "entities":
                    row[n] = [str(x) for x in row[n]] if isinstance(row[n], list) else []
                elif row[n] is not None:
                    row[n] = str(row[n])
            out.append(row)
    return out


def _stage(chunks: DataFrame, stage: str, extractor: Callable, attempts: int) -> DataFrame:
    """chunks (doc_id, chunk_id, text, known_classes, known_instances) with the stage's columns and its error."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    columns = STAGES[stage]
    doc, chunk = (chunks.schema[c].dataType.simpleString() for c in ("doc_id", "chunk_id"))
    schema = StructType.fromDDL(f"doc_id {doc}, chunk_id {chunk}, text string, {', '.join(f'{c} {k}' for c, k in columns.items())}, error string")
    types = list(to_arrow_schema(schema).types)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for t, classes, instances in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                rows, why = {}, None
                for _ in range(attempts):
                    try:
                        reply = extractor(stage, t or "", json.loads(classes), json.loads(instances))
                        rows, why = {c: _rows_of(reply, c, k) for c, k in columns.items() if len(columns) == 1 or isinstance(reply, dict)}, None
                        break
                    except Exception as e:  # any failure of a model
                        why = str(e)[:500]
                        if any(f in why.lower() for f in FATAL):
                            break
                out.append((*(rows.get(c, []) for c in columns), why))
            made = zip(*out, strict=True) if out else [()] * (len(columns) + 1)
            arrays = [*(b.column(i).cast(t) for i, t in zip(range(3), types, strict=False)), *(pa.array(x, t) for x, t in zip(made, types[3:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return chunks.select("doc_id", "chunk_id", "text", "known_classes", "known_instances").mapInArrow(run, schema)


def _vocabulary(rows: DataFrame, key: list[str], most: int, columns: list[str]) -> DataFrame:
    """key, known (JSON list) of rows (key, name, salience, more columns): each key's different names by lower case, most salient first, then by name,
    while their JSON has at most so many characters. A name's row is the least one of its most salient."""
    order = F.struct((-F.coalesce("salience", F.lit(1.0))).alias("s"), *columns)
    first = rows.where("trim(name) != ''").groupBy(*key, F.lower(F.trim("name")).alias("_n")).agg(F.min(order).alias("r"))
    first = first.select(*key, "_n", "r", F.to_json(F.struct(*(F.col(f"r.{c}").alias(c) for c in columns))).alias("j"))
    used = F.sum(F.length("j") + 2).over(Window.partitionBy(*key).orderBy("r.s", "_n").rowsBetween(Window.unboundedPreceding, 0))
    kept = first.withColumn("_u", used).where(F.col("_u") <= most)
    return kept.groupBy(*key).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r.s", "_n", "j"))), lambda x: x.j), ", "), F.lit("]")).alias("known"))


def staged_extract(chunks: DataFrame, extractor: Callable = staged_rules, scope: str = "document", attempts: int = 3, vocabulary: int = 3000, strict: bool = True) -> DataFrame:
    """Three stages: classes of each chunk; instances, asked with the known classes; relations, data properties and axioms, asked with both.

    One row for each row of chunks (doc_id, chunk_id, text): doc_id, chunk_id, classes, instances, relations, data_properties, axioms, errors (by
    stage), error (the first, or null). What is known to a chunk is what earlier stages found in its document, or, with scope "chunk", in
    itself; of that the most salient rows whose JSON has vocabulary characters are asked with. extractor: (stage, text,
    classes, instances) to rows. A class none of whose words is in its chunk is dropped. With strict, so are instances of unknown
    classes, and relations, values and axioms between unknown names. A stage that fails leaves its part empty, and the next ones go on. Null
    or empty text is asked as an empty one; no chunks: no rows. Each stage is written, so a later one's failure asks no model again.
    """
    key = ["doc_id"] if scope == "document" else ["doc_id", "chunk_id"]
    # a small table is much work here
    base = chunks.select("doc_id", "chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    base = stored(base.repartition(2 * chunks.sparkSession.sparkContext.defaultParallelism, "doc_id", "chunk_id"), "chunks")
    none = F.lit("[]")
    from ..functions import text as tx

    cls = _stage(base.withColumns({"known_classes": none, "known_instances": none}), "classes", extractor, attempts)
    cls = cls.withColumn("classes", F.filter("classes", lambda c: (F.trim(c["name"]) != "") & tx.shares_token(c["name"], "text")))
    cls = stored(cls.select("doc_id", "chunk_id", "classes", "error"), "classes")
    named = cls.select("doc_id", "chunk_id", F.inline("classes"))
    names = named.select(*key, F.lower(F.trim("name")).alias("of")).unionByName(named.select(*key, F.lower(F.trim("parent")).alias("of"))).where("of != ''").distinct()
    known = stored(_vocabulary(named, key, vocabulary, ["name", "parent"]).withColumnRenamed("known", "known_classes"), "vocabulary")
    asked = base.join(known, key, "left").withColumns({"known_classes": F.coalesce("known_classes", none), "known_instances": none})
    ins = stored(_stage(asked, "instances", extractor, attempts).drop("text"), "instances")
    one = ins.select("doc_id", "chunk_id", F.inline("instances")).where("trim(name) != ''")
    if strict:
        one = one.withColumn("of", F.lower(F.trim("class_name"))).join(names, [*key, "of"], "left_semi")
    one = stored(one.select("doc_id", "chunk_id", "name", "class_name", "description"), "known")
    told = _vocabulary(one.withColumn("salience", F.lit(1.0)), key, vocabulary, ["name", "class_name"]).withColumnRenamed("known", "known_instances")
    asked = base.join(known, key, "left").join(told, key, "left").withColumns({c: F.coalesce(c, none) for c in ("known_classes", "known_instances")})
    rel = stored(_stage(asked, "relations", extractor, attempts).drop("text"), "relations")
    ends = names.unionByName(one.select(*key, F.lower(F.trim("name")).alias("of"))).distinct()

    def rows(column, *of):
        """A column's rows, between known names."""
        out = rel.select("doc_id", "chunk_id", F.posexplode(column).alias("at", "x"))
        for i, c in enumerate(of if strict else ()):
            out = out.withColumn("of", F.lower(F.trim(c))).join(ends, [*key, "of"], "left_semi").select("doc_id", "chunk_id", "at", "x")
        return out

    def gathered(found, column):
        return found.groupBy("doc_id", "chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s.x).alias(column))

    parts = [gathered(rows("relations", F.col("x.src"), F.col("x.dst")), "relations"), gathered(rows("data_properties", F.col("x.entity")), "data_properties")]
    ax = rel.select("doc_id", "chunk_id", F.posexplode("axioms").alias("at", "x")).where(F.col("x.axiom_type").isin(fixed.AXIOM_TYPES))
    if strict:
        each = ax.select("doc_id", "chunk_id", "at", F.size("x.entities").alias("n"), F.explode(F.transform("x.entities", lambda e: F.lower(F.trim(e)))).alias("of")).join(ends, [*key, "of"], "left_semi")
        whole = each.groupBy("doc_id", "chunk_id", "at", "n").agg(F.count("*").alias("k")).where("k = n").select("doc_id", "chunk_id", "at")
        ax = ax.join(whole, ["doc_id", "chunk_id", "at"], "left_semi")
    parts.append(gathered(ax, "axioms"))
    out = cls.select("doc_id", "chunk_id", "classes", F.col("error").alias("e1")).join(ins.select("doc_id", "chunk_id", F.col("error").alias("e2")), ["doc_id", "chunk_id"]).join(rel.select("doc_id", "chunk_id", F.col("error").alias("e3")), ["doc_id", "chunk_id"])
    out = out.join(one.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("name", "class_name", "description"))).alias("instances")), ["doc_id", "chunk_id"], "left")
    for p in parts:
        out = out.join(p, ["doc_id", "chunk_id"], "left")
    kinds = {c: k for columns in STAGES.values() for c, k in columns.items()}
    errors = F.map_filter(F.create_map(*(x for n, e in zip(STAGES, ("e1", "e2", "e3"), strict=True) for x in (F.lit(n), F.col(e)))), lambda k, v: v.isNotNull())
    return out.select("doc_id", "chunk_id", *(F.coalesce(c, F.array().cast(k)).alias(c) for c, k in kinds.items()), errors.alias("errors"), F.coalesce("e1", "e2", "e3").alias("error"))


def single_shot(chunks: DataFrame, model: Callable, attempts: int = 3) -> DataFrame:
    """chunk rows (doc_id, chunk_id, text) with entities, relations and error, from one question a chunk. model: (text, plain) to a reply. If it says that it
    can't answer by a schema, it is asked for plain text once; a reply that no mending makes JSON is no rows."""
    from .judge import is_schema_error

    kinds = {"entities": "array<struct<name:string,type:string,description:string>>", "relations": "array<struct<src:string,relation:string,dst:string,confidence:double>>"}

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for t in b["text"]:
                rows, why, plain = {}, None, False
                for _ in range(attempts):
                    try:
                        reply = repair_json(model(t or "", plain))
                        rows, why = {c: _rows_of(reply, c, k) if isinstance(reply, dict) else [] for c, k in kinds.items()}, None
                        break
                    except Exception as e:  # any failure of a model
                        why = str(e)[:500]
                        if is_schema_error(e) and not plain:
                            plain = True
                out.append((rows.get("entities", []), rows.get("relations", []), why))
            yield pd.concat([b[["doc_id", "chunk_id"]].reset_index(drop=True), pd.DataFrame(out, columns=[*kinds, "error"])], axis=1)

    doc, chunk = (chunks.schema[c].dataType.simpleString() for c in ("doc_id", "chunk_id"))
    return chunks.select("doc_id", "chunk_id", "text").mapInPandas(run, f"doc_id {doc}, chunk_id {chunk}, " + ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", error string")


def repair_json(raw: str):
    """The value in a model's reply: fences, comments, text around it, trailing commas, single quotes and a cut end are mended, the least change first. Null if nothing helps."""
    if not raw or not raw.strip():
        return None
    fenced = re.findall(r"```(?:json)?\s*(.*?)```", raw, re.S)
    starts = [i for i in (raw.find("{"), raw.find("[")) if i >= 0]
    bases = [*reversed(fenced), raw, *([raw[min(starts) :]] if starts else [])]

    def tidy(s):
        s = re.sub(r"(?<!:)//[^\n\"]*$|/\*.*?\*/", "", s, flags=re.S | re.M)
        return re.sub(r",\s*([}\]])", r"\1", s)

    def balanced(s):
        """Up to the bracket that closes the first one; or, for a cut text, closed in order."""
        stack, quote, i = [], False, 0
        for i, c in enumerate(s):
            if quote:
                quote = c != '"' or (i and s[i - 1] == "\\")
            elif c == '"':
                quote = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]" and stack:
                stack.pop()
                if not stack:
                    return s[: i + 1]
        s = s + '"' * quote
        return re.sub(r",\s*$", "", s.rstrip()) + "".join(reversed(stack))

    for fix in (lambda s: s, tidy, lambda s: tidy(balanced(s)), lambda s: tidy(balanced(s.replace("'", '"')))):
        for base in bases:
            try:
                return json.loads(fix(base.strip()))
            except ValueError:
                continue
    return None


#: Errors after which asking again can't help.
FATAL = ("context size", "context length")


def complete(items: DataFrame, model: Callable[[str], str] | None = None, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """items (seq, prompt) with reply and error: a pluggable model, asked again on failure after wait, 2 wait, 4 wait ... seconds, 8 at most, but not
    when the prompt is too long for it; an item that fails gets an empty reply and its error. The default model echoes the prompt's last line."""
    model = model or (lambda p: p.strip().splitlines()[-1] if p.strip() else "")

    def run(batches):
        for b in batches:
            replies, errors = [], []
            for p in b["prompt"]:
                reply, why = "", None
                for i in range(attempts):
                    try:
                        reply, why = model(p or ""), None
                        break
                    except Exception as e:  # any failure of a model
                        why = str(e)[:500]
                        if any(f in why.lower() for f in FATAL):
                            break
                        if i + 1 < attempts:
                            time.sleep(min(8.0, wait * 2**i))
                replies.append(reply)
                errors.append(why)
            yield b.assign(reply=replies, error=errors)[["seq", "prompt", "reply", "error"]]

    return items.select("seq", "prompt").mapInPandas(run, "seq long, prompt string, reply string, error string")


def ordered_distinct(rows: DataFrame, key: str, value: str, seq: str, out: str) -> DataFrame:
    """key and out: the different values of each key in the order in which they came first."""
    first = rows.groupBy(key, value).agg(F.min(seq).alias("_f"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", value))), lambda s: s[value]).alias(out))


def concatenated(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """The rows of all parts, each with the name of its part."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def ranked_pages(pages: DataFrame, most: int) -> DataFrame:
    """The first pages (page_id, fidelity, content_score) by their score, ties by id: half fidelity and half the score of the content, where there is one; else fidelity."""
    score = F.coalesce(0.5 * F.col("fidelity") + 0.5 * F.col("content_score"), F.col("fidelity"))
    return pages.withColumn("score", score).orderBy(F.desc("score"), "page_id").limit(most)


def flattened(blocks: DataFrame) -> DataFrame:
    """(subject, key, value, full) of factual blocks (subject, attributes array<struct<relation,target,key,value,full>>): where key, value or full
    lacks, it follows from the subject, relation and target."""
    a = blocks.select("subject", F.inline("attributes"))
    a = a.withColumn("key", F.coalesce("key", F.concat_ws(" ", "subject", "relation"))).withColumn("value", F.coalesce("value", "target", F.lit("")))
    return a.select("subject", "key", "value", F.coalesce("full", F.concat("key", F.lit(": "), "value")).alias("full"))


def legacy_view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, kind, target): entities with their type, and relations, of which parents are subClassOf."""
    n = nodes.select(F.lit("entity").alias("what"), F.col("id").alias("name"), F.when(F.col("kind") == "class", "Class").otherwise(F.col("type")).alias("kind"), F.lit(None).cast("string").alias("target"))
    return n.unionByName(edges.select(F.lit("relation").alias("what"), F.col("src").alias("name"), F.col("relation").alias("kind"), F.col("dst").alias("target")))
