"""Node-link JSON of knowledge bases, read in splits and written in parts. A file is one JSON object of any size; Spark's text reader cuts it at
closing braces, and two passes find where each split stands in the object, so that no task and no row holds more than one element."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import stored

#: By byte: 1 for what opens, -1 for what closes.
STEP = np.zeros(256, np.int8)
STEP[[*b"{["]], STEP[[*b"}]"]] = 1, -1
CUT = "\0"
#: Names of the sections of a file, by table.
SECTIONS = {"nodes": ("nodes",), "edges": ("links", "edges"), "axioms": ("axioms",), "data_props": ("data_properties",), "vectors": ("embedding_cache",)}
KNOWN = {
    "nodes": "id string, type string, kind string, description string, synonyms array<string>, source_documents array<string>",
    "edges": "source string, relation string, target string, confidence double, vote_count long, source_documents array<string>",
    "axioms": "axiom_type string, entities array<string>",
    "data_props": "entity string, attribute string, value string, datatype string, source_documents array<string>",
}


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the quotes that begin or end strings, places of brackets, and how many of the quotes stand before each bracket. No text begins after a backslash, since fragments end with a brace."""
    quotes, slashes = np.flatnonzero(data == ord('"')), np.flatnonzero(data == ord("\\"))
    if len(slashes):
        # a quote after an odd run of backslashes is escaped
        i = np.arange(len(slashes))
        run = i - np.maximum.accumulate(np.where(np.diff(slashes, prepend=-2) > 1, i, 0)) + 1
        j = np.minimum(np.searchsorted(slashes, quotes - 1), len(slashes) - 1)
        quotes = quotes[(slashes[j] != quotes - 1) | (run[j] % 2 == 0)]
    at = np.flatnonzero(STEP[data])
    return quotes, at, np.searchsorted(quotes, at)


class Scanner:
    """Where a text of fragments stands in a JSON object: in a string or not, how deep, in which section. Elements are what is two levels down."""

    def __init__(self, in_string: bool = False, depth: int = 0):
        self.in_string, self.depth = in_string, depth
        self.section = self.name = None
        #: The part so far of a string that texts cut; a name that begins in an earlier split is marked, and its first part comes from there.
        self.cut = CUT if in_string and depth in (1, 2) else ""

    def read(self, text: bytes) -> Iterator[tuple[bytes, str | None, bool, bool]]:
        """(piece, name, begins, ends) of each element or part of one in the next fragments. An element that is open at their end has a piece there.
        Only brackets of the object, its sections and its elements are looked at one by one."""
        data = np.frombuffer(text, np.uint8)
        quotes, at, before = _marks(data)
        live = before % 2 == self.in_string
        at, before = at[live], before[live]
        step = STEP[data[at]]
        depth = self.depth + np.cumsum(step, dtype=np.int64)
        level = depth - (step > 0)
        seen = np.flatnonzero(level <= 2)
        last = np.where(seen > 0, at[seen - 1], -1)

        def told(k, least):
            """The string that ends with the k-th quote, if no bracket follows it."""
            if k == 1 and self.in_string:
                return self.cut + text[: quotes[0] + 1].decode() if least < 0 else None
            return text[quotes[k - 2] : quotes[k - 1] + 1].decode() if k > 1 and quotes[k - 2] > least else None

        begin, begins = (0 if self.depth > 2 else None), False
        for p, up, to, k, least in zip(at[seen].tolist(), (step[seen] > 0).tolist(), level[seen].tolist(), before[seen].tolist(), last.tolist(), strict=True):
            if up and to == 1:
                self.section, self.name = told(k, least), None
            elif up and to == 2:
                begin, begins, self.name = p, True, told(k, least)
            elif to == 2 and begin is not None:
                yield text[begin : p + 1], self.name, begins, True
                begin, begins = None, False
        if begin is not None:
            yield text[begin:], self.name, begins, False
        self.depth = int(depth[-1]) if len(depth) else self.depth
        cut = (len(quotes) + self.in_string) % 2 == 1
        self.cut = "" if not cut or self.depth not in (1, 2) else text[quotes[-1] :].decode() if len(quotes) else self.cut + text.decode()
        self.in_string = cut


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """file, block (the split's start), text: fragments in order within a split."""
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.concat("value", F.lit("}")).alias("text"))


def _runs(batches):
    """(file, block, fragments of a batch as one text) in order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        file, block, text = (b.column(i) for i in range(3))
        new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(new) + 1).tolist()]
        _, ends, data = text.buffers()
        ends = np.frombuffer(ends, np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset :]
        for i, j in zip(starts, [*starts[1:], b.num_rows], strict=True):
            yield file[i].as_py(), block[i].as_py(), data[int(ends[i]) : int(ends[j])].to_pybytes()


def _states(fragments: DataFrame) -> dict:
    """(in a string, depth) at the start of each split: what a split does is found for both ways to begin, and put together in order. One row a split comes to the driver."""

    def run(batches):
        import pyarrow as pa

        out: dict = {}
        for file, block, text in _runs(batches):
            odd, outside, inside = out.get((file, block), (False, 0, 0))
            data = np.frombuffer(text, np.uint8)
            quotes, at, before = _marks(data)
            step, even = STEP[data[at]].astype(np.int64), before % 2 == odd
            out[file, block] = odd ^ (len(quotes) % 2 == 1), outside + int(step[even].sum()), inside + int(step[~even].sum())
        rows = [{"file": f, "block": b, "out_string": odd, "out_depth": x, "in_string": not odd, "in_depth": y} for (f, b), (odd, x, y) in out.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("block", pa.int64()), ("out_string", pa.bool_()), ("out_depth", pa.int64()), ("in_string", pa.bool_()), ("in_depth", pa.int64())]))

    found, file, state = {}, None, (False, 0)
    rows = fragments.mapInArrow(run, "file string, block long, out_string boolean, out_depth long, in_string boolean, in_depth long").collect()
    for r in sorted(rows, key=lambda r: (r.file, r.block)):
        if r.file != file:
            file, state = r.file, (False, 0)
        found[r.file, r.block] = state
        state = (r.in_string, state[1] + r.in_depth) if state[0] else (r.out_string, state[1] + r.out_depth)
    return found


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, pos, name, json): each element of the arrays and objects of the files' top level, with its place in its section, and its key where that is an object."""
    fragments = _fragments(spark, path)
    sent = spark.sparkContext.broadcast(_states(fragments))

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("local", pa.int64()), ("section", pa.string()), ("name", pa.string()), ("part", pa.int64()), ("whole", pa.bool_()), ("json", pa.string())])
        at, s, n, part = None, None, -1, 0

        def close():
            # one row for the split: how many elements begin in it, the section at its end, and the part of a name there
            return [{"file": at[0], "block": at[1], "local": n, "section": s.section, "name": None, "part": -1, "whole": False, "json": s.cut}]

        for file, block, text in _runs(batches):
            out = []
            if (file, block) != at:
                if at is not None:
                    yield pa.RecordBatch.from_pylist(close(), schema)
                at, s, n, part = (file, block), Scanner(*sent.value[file, block]), -1, 0
            for piece, name, begins, ends in s.read(text):
                n += begins
                part += 1
                out.append((n, s.section, name, part, begins and ends, piece))
            local, section, names, parts, whole, json = zip(*out, strict=True) if out else [()] * 6
            json = pa.array(json, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file, pa.string()), len(out)), pa.repeat(pa.scalar(block, pa.int64()), len(out)), pa.array(local, pa.int64()), pa.array(section, pa.string()), pa.array(names, pa.string()), pa.array(parts, pa.int64()), pa.array(whole, pa.bool_()), json], schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_pylist(close(), schema)

    rows = stored(fragments.mapInArrow(run, "file string, block long, local long, section string, name string, part long, whole boolean, json string"), "elements")
    marks, file, count, section, cut = [], None, 0, None, ""
    for r in sorted(rows.where("part = -1").collect(), key=lambda r: (r.file, r.block)):
        if r.file != file:
            file, count, section, cut = r.file, 0, None, ""
        marks.append((r.file, r.block, count, section, cut))
        count, section, cut = count + r.local + 1, r.section or section, r.json.replace(CUT, cut)
    marks = spark.createDataFrame(marks, "file string, block long, before long, carried string, cut string")
    rows = rows.where("part >= 0").join(F.broadcast(marks), ["file", "block"]).withColumn("n", F.col("before") + F.col("local")).withColumns({"section": F.coalesce("section", "carried"), "name": F.replace("name", F.lit(CUT), F.col("cut"))})
    pieces = rows.where("not whole").groupBy("file", "n").agg(F.min("section").alias("section"), F.min_by("name", F.struct("block", "part")).alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "json"))), lambda x: x.json), "").alias("json"))
    every = rows.where("whole").select("file", "n", "section", "name", "json").unionByName(pieces)
    plain = lambda c: F.from_json(F.concat(F.lit('{"x":'), c, F.lit("}")), "x string").x
    first = every.groupBy("file", "section").agg(F.min("n").alias("first")).withColumn("called", plain(F.col("section")))
    return every.join(F.broadcast(first), ["file", "section"]).select("file", F.col("called").alias("section"), (F.col("n") - F.col("first")).alias("pos"), plain(F.col("name")).alias("name"), "json")


def read_kb(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, edges, axioms, data_props, vectors (id, vector) and seed (seq, name: names for a canonicaliser, in order) of node-link JSON files.

    Fields without a column of their own are in attributes, a map to their JSON. A node without an id is called by its place, links name
    nodes by id or by place in their own file, an id wins where both ends are texts; links whose places aren't there are dropped. Defaults: type Entity, kind class,
    relation related_to, confidence 1, datatype string. A file that lacks a section has no rows of it. Files that aren't objects have none; an element that isn't an object is left out.
    """
    every = stored(elements(spark, path), "elements")

    def of(table):
        raw = every.where(F.col("section").isin(list(SECTIONS[table])) & F.startswith("json", F.lit("{")))
        known = [c.split()[0] for c in KNOWN[table].split(", ")]
        x = raw.select("file", "pos", "json", F.from_json("json", KNOWN[table]).alias("x"), F.from_json("json", "map<string,string>").alias("m"))
        names = [*known, "name"] if table == "nodes" else [*known, "type"] if table == "axioms" else known
        return x.select("file", "pos", "json", "x.*", F.map_filter("m", lambda k, v: ~k.isin(names)).alias("attributes"))

    n = of("nodes")
    n = n.select("file", "pos", F.coalesce("id", F.col("pos").cast("string")).alias("id"), F.coalesce("type", F.lit("Entity")).alias("type"), F.coalesce("kind", F.lit("class")).alias("kind"), F.coalesce("description", F.lit("")).alias("description"), "synonyms", "source_documents", "attributes")
    # a place is a bare number in the JSON; a name is in quotes
    number = lambda c: F.when(F.rlike(c, F.lit(r"^\d+$")), F.try_to_number(F.regexp_extract("json", rf'"{c}"\s*:\s*(\d+)\s*[,}}]', 1), F.lit("999999999999999999")).cast("long"))
    e = of("edges").withColumns({"s": number("source"), "t": number("target")})
    by_place = F.rlike("json", F.lit(r'"source"\s*:\s*\d')) & F.rlike("json", F.lit(r'"target"\s*:\s*\d'))  # told before the JSON is parsed
    at = lambda k: n.select("file", F.col("pos").alias(k), F.col("id").alias(f"{k}_id"))
    placed = e.where(by_place).where("s is not null and t is not null").join(at("s"), ["file", "s"]).join(at("t"), ["file", "t"]).withColumns({"source": F.col("s_id"), "target": F.col("t_id")})
    columns = ["source", "relation", "target", "confidence", "vote_count", "source_documents", "attributes"]
    e = placed.select(*columns).unionByName(e.where("s is null and t is null and source is not null and target is not null").select(*columns))
    e = e.select(F.col("source").alias("src"), F.coalesce("relation", F.lit("related_to")).alias("relation"), F.col("target").alias("dst"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "vote_count", "source_documents", "attributes")
    a = of("axioms").withColumn("axiom_type", F.coalesce("axiom_type", F.get_json_object("json", "$.type")))
    d = of("data_props").withColumn("datatype", F.coalesce("datatype", F.lit("string")))
    v = every.where((F.col("section") == "embedding_cache") & F.startswith("json", F.lit("["))).select(F.col("name").alias("id"), F.from_json("json", "array<float>").alias("vector"))
    files = every.select("file").distinct()
    order = files.join(files.withColumnRenamed("file", "f"), F.col("f") < F.col("file"), "left").groupBy("file").agg(F.count("f").alias("k"))
    seed = n.join(F.broadcast(order), "file").select((F.shiftleft(F.col("k"), 40) + F.col("pos")).alias("seq"), F.col("id").alias("name"))
    return {"nodes": n.drop("file", "pos"), "edges": e, "axioms": a.select("axiom_type", "entities", "attributes"), "data_props": d.select("entity", "attribute", "value", "datatype", "source_documents", "attributes"), "vectors": v, "seed": seed}


def write_kb(tables: dict[str, DataFrame], path: str, parts: int | None = None) -> None:
    """Write tables (nodes, edges, axioms, data_props; columns of read_kb or fewer) as node-link JSON in a new folder: each task writes one file, an object with its share of every section; with parts, rows are dealt to as many tasks first. Links name nodes by id."""
    names = {"nodes": "nodes", "edges": "links", "axioms": "axioms", "data_props": "data_properties"}
    # values of attributes are JSON already, or plain texts
    value = lambda v: F.when(F.rlike(v, F.lit(r'^\s*(\{.*\}|\[.*\]|-?\d+(\.\d+)?([eE][-+]?\d+)?|true|false|null)\s*$')), v).otherwise(F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'^\{"v":(.*)\}$', 1))
    more = F.array_join(F.transform(F.map_entries("attributes"), lambda x: F.concat(F.lit(","), F.regexp_extract(F.to_json(F.struct(x.key.alias("v"))), r'^\{"v":(.*)\}$', 1), F.lit(":"), value(F.coalesce(x.value, F.lit("null"))))), "")
    rows = None
    for k, (table, section) in enumerate(names.items()):
        df = tables[table].withColumnsRenamed({"src": "source", "dst": "target"} if table == "edges" else {})
        json = F.to_json(F.struct(*[c for c in df.columns if c != "attributes"]))
        if "attributes" in df.columns:
            json = F.regexp_replace(F.concat(F.regexp_replace(json, r"\}$", ""), F.coalesce(more, F.lit("")), F.lit("}")), r"^\{,", "{")
        own = df.select(F.lit(k).alias("k"), F.lit(section).alias("section"), json.alias("json"))
        rows = own if rows is None else rows.unionByName(own)

    def run(batches):
        import pyarrow as pa

        at = None
        for b in batches:
            out = []
            for section, json in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out.append("," if section == at else ("{" if at is None else "],") + f'"{section}":[')
                out.append(json)
                at = section
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(["".join(out)], pa.string())], ["value"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array(["]}"])], ["value"])

    # a task's rows are of one table, or come table by table, unless they are dealt anew
    dealt = rows.repartition(parts, F.xxhash64("json")).sortWithinPartitions("k") if parts else rows
    dealt.select("section", "json").mapInArrow(run, "value string").write.text(path)
