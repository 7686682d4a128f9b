"""Retrieval: records of a graph, vector top-k, concept matches, greedy set cover, question templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..scratch import stored
from .contain import either_way

#: Scores that a task holds at a time, of so many vectors, and pairs of which it computes exact ones at a time.
TILE, COLUMNS, BLOCK = 1 << 20, 2_048, 65_536
#: Open pairs of node and record that one task covers.
PAIRS = 2_000_000


def records(nodes: DataFrame, edges: DataFrame, data_props: DataFrame) -> DataFrame:
    """node, kind (class, instance, edge, data_property), key, value, full, source_ref: one row per fact. Edges with evidence have it in
    their value; rows with source_documents name them in their reference."""
    ref = lambda df, base: (text.with_sources(base, F.coalesce("source_documents", F.array().cast("array<string>"))) if "source_documents" in df.columns else base).alias("source_ref")
    n = nodes.select(F.col("id").alias("node"), "kind", F.concat("id", F.lit(" type")).alias("key"), F.col("type").alias("value"), ref(nodes, F.concat(F.lit("node:"), "id")))
    e = edges.select(F.col("src").alias("node"), F.lit("edge").alias("kind"), F.concat("src", F.lit(" "), "relation").alias("key"), (F.when(F.coalesce("evidence", F.lit("")) != "", F.concat("dst", F.lit(" | Evidence: "), "evidence")).otherwise(F.col("dst")) if "evidence" in edges.columns else F.col("dst")).alias("value"), ref(edges, F.concat(F.lit("edge:"), "src", F.lit("-"), "relation", F.lit("-"), "dst")))
    p = data_props.select(F.col("entity").alias("node"), F.lit("data_property").alias("kind"), F.concat("entity", F.lit(" "), "attribute").alias("key"), "value", ref(data_props, F.concat(F.lit("dp:"), "entity", F.lit(":"), "attribute")))
    return n.unionByName(e).unionByName(p).withColumn("full", F.concat("key", F.lit(": "), "value"))


def concept_match(question: Column, name: Column, synonyms: Column | None = None) -> Column:
    """A word of the question of three characters or more is in the name, or the name in it; or so with one of the synonyms."""
    def hit(n):
        n = F.lower(n)
        return F.exists(text.words(F.lower(question)), lambda w: (F.length(w) > 2) & (F.contains(n, w) | F.contains(w, n)))

    return hit(name) if synonyms is None else hit(name) | F.coalesce(F.exists(synonyms, hit), F.lit(False))


def concept_words(questions: DataFrame) -> DataFrame:
    """(query_id, word): the different words of three characters or more of each question."""
    return questions.select("query_id", F.explode(F.array_distinct(text.words(F.lower("question")))).alias("word")).where("length(word) > 2")


def concept_matches(questions: DataFrame, names: DataFrame, name: str = "id") -> DataFrame:
    """(query_id, name): the different names that concept_match says of each question, for any number of both: a containment join of words and names."""
    words = stored(concept_words(questions), "words")
    n = names.select(F.col(name).alias("name"), F.lower(name).alias("low")).distinct()
    pairs = either_way(n, words, "low")
    return words.join(pairs, "word").select("query_id", F.col("name").alias("low")).distinct().join(n, "low").select("query_id", "name").distinct()


def question_entities(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, id): nodes that phrases of two to four words of a question name. Of each phrase, the first node by seq whose name
    contains it or is in it, and nodes before that one of which a synonym does. Phrases and names meet in a containment join."""
    phrases = stored(questions.select("query_id", F.explode(text.ngrams("question")).alias("phrase")).distinct(), "phrases")
    names = nodes.groupBy(F.lower("id").alias("low")).agg(F.min("seq").alias("seq"), F.min_by("id", "seq").alias("id"))
    pairs = either_way(names, phrases, "low", "phrase").withColumnsRenamed({"name": "low", "word": "phrase"})
    first = stored(pairs.join(names, "low").groupBy("phrase").agg(F.min("seq").alias("stop"), F.min_by("id", "seq").alias("id")), "first")
    out = phrases.join(first, "phrase").select("query_id", "id")
    if "synonyms" in nodes.columns:
        syn = nodes.select("id", "seq", F.explode("synonyms").alias("s")).select("id", "seq", F.lower("s").alias("low"))
        near = either_way(syn, phrases, "low", "phrase").withColumnsRenamed({"name": "low", "word": "phrase"})
        syn = near.join(syn, "low").join(first.select("phrase", "stop"), "phrase", "left").where("stop is null or seq < stop")
        out = out.unionByName(phrases.join(syn.select("phrase", "id"), "phrase").select("query_id", "id"))
    return out.distinct()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def unit_length(x):
    """Rows of a matrix as doubles of length one; a zero row stays zero."""
    import numpy as np

    x = np.asarray(x, np.float64)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def unit_rows(column):
    """A list column of an Arrow table or batch as rows of doubles of length one; a zero vector stays zero, null elements are NaN."""
    import numpy as np
    import pyarrow as pa

    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(c)
    flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) if n else np.zeros(0)
    if n and len(flat) and not c.null_count and len(flat) % n == 0 and (np.diff(c.offsets.to_numpy()) == len(flat) // n).all():
        x = flat.reshape(n, -1)
    else:
        x = np.array(c.to_pylist(), np.float64) if n else np.zeros((0, 1))
    return unit_length(x)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, max_queries: int = 50_000, make=None) -> DataFrame:
    """(query_id, vec_id, score, rank): each query's k nearest vectors by cosine, ties by id.

    queries and vectors: id columns query_id, vec_id, and vector (array of floats); with make, an encoder's, vectors have text in place of vector, which the
    task that compares it encodes, so that vectors are neither written nor sent. The queries go to every task as one matrix of
    at most max_queries rows; each batch of vectors is one matrix product, of which only k rows a query go on, so what is shuffled is k
    rows for each query and task. More queries than that are asked in blocks of about half as many, by a hash of their ids, each against all vectors, and the rows of a block are written.
    """

    def matrix(rows):
        return rows.column("query_id").to_numpy(), unit_rows(rows.column("vector"))

    queries, vectors = queries.select("query_id", "vector"), vectors.select("vec_id", "text" if make else "vector")
    rows = queries.limit(max_queries + 1).toArrow()
    if rows.num_rows > max_queries:
        tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism  # a small table is much work here
        queries, vectors, out = stored(queries, "queries"), stored(vectors.repartition(tasks), "vectors"), []
        n = -(-2 * queries.count() // max_queries)
        for i in range(n):
            sent = vectors.sparkSession.sparkContext.broadcast(matrix(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toArrow()))
            out.append(stored(_nearest(vectors, sent, k, make), "near"))
            sent.destroy()
        return reduce(DataFrame.unionByName, out)
    return _nearest(vectors, vectors.sparkSession.sparkContext.broadcast(matrix(rows)), k, make)


def _nearest(vectors: DataFrame, sent, k: int, make=None) -> DataFrame:
    """The k nearest vectors of each query of one broadcast block; scores are held for TILE pairs at a time.

    Equal vectors of a batch are compared once. Products in single precision, whose error is below eps, tell which pairs could be among the k best,
    given the k-th best score so far; only these get a score, in doubles, so what single precision leaves out can't be in the result.
    """
    import numpy as np

    def run(batches):
        import pyarrow as pa

        ids, q = sent.value
        if not len(ids):
            return
        encoder = make() if make else None
        q32, dead = q.astype(np.float32), ~np.isfinite(q).all(axis=1)
        q32[dead] = 0
        eps = (q.shape[1] + 16) * 2.0**-23
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        held, fresh, floor = none, [], np.full(len(ids), -np.inf)  # positions of queries, vectors, scores; those not yet merged; the k-th best score

        def best(parts):
            i, v, s = map(np.concatenate, zip(*parts, strict=True))
            order = np.lexsort((v, -s, i))
            i, v, s = i[order], v[order], s[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            return (i[place < k], v[place < k], s[place < k]), (i[place == k - 1], s[place == k - 1])

        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(0).to_numpy(zero_copy_only=False)
            x = np.ascontiguousarray(unit_rows(b.column(1)) if encoder is None else unit_length(encoder([t or "" for t in b.column(1).to_pylist()])))
            _, first, of = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
            order = np.lexsort((v, of))
            at = np.searchsorted(of[order], np.arange(len(first) + 1))  # ids of each different vector: v[order][at[u]:at[u + 1]], of which k can matter
            x, v, size = x[first], v[order], np.minimum(np.diff(at), k)
            bad = ~np.isfinite(x).all(axis=1)
            x32 = x.astype(np.float32)
            x32[bad] = 0
            for u0 in range(0, len(x), COLUMNS):
                part, off = np.ascontiguousarray(x32[u0 : u0 + COLUMNS].T), bad[u0 : u0 + COLUMNS]
                n, step = min(k, len(off)), TILE // COLUMNS
                room = np.empty((step, len(off)), np.float32)
                for lo in range(0, len(ids), step):
                    s = np.matmul(q32[lo : lo + step], part, out=room[: len(ids) - lo])
                    if off.any():
                        s[:, off] = -np.inf
                    if dead.any():
                        s[dead[lo : lo + step]] = -np.inf
                    least = floor[lo : lo + step] - eps
                    rows = np.nonzero(s.max(axis=1) >= least)[0]
                    if not len(rows):
                        continue
                    s, least = s[rows], least[rows]
                    new = np.isneginf(least)
                    if new.any():
                        least[new] = np.partition(s[new], len(off) - n, axis=1)[:, len(off) - n] - 2 * eps
                    i, u = np.nonzero(s >= least[:, None])
                    i, u = rows[i] + lo, u + u0
                    score = np.full(len(i), -np.inf)
                    for c in range(0, len(i), BLOCK):
                        score[c : c + BLOCK] = np.nan_to_num((q[i[c : c + BLOCK]] * x[u[c : c + BLOCK]]).sum(axis=1), nan=-np.inf)
                    times = size[u]
                    to = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(at[u], times)
                    fresh.append(best([(np.repeat(i, times), v[to], np.repeat(score, times))])[0])
                if sum(len(f[0]) for f in fresh) > len(held[0]) // 4:
                    held, (i, s) = best([held, *fresh])
                    floor[i], fresh = s, []
        held = best([held, *fresh])[0]
        if len(held[0]):
            i, v, s = held
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    near = vectors.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def first_records(recs: DataFrame, wanted: DataFrame, column: str, most: int) -> DataFrame:
    """(column, record_id): of each wanted value of a column, its first records, most at most, which Spark limits before the exchange."""
    own = recs.select(column, "record_id").join(wanted.select(column).distinct(), column, "left_semi")
    return own.withColumn("_r", F.row_number().over(Window.partitionBy(column).orderBy("record_id"))).where(F.col("_r") <= most).drop("_r")


def hyperedges(recs: DataFrame, most: int | None = None) -> DataFrame:
    """(node, record_ids): the records of each node as one array; with most, the first by id, which Spark limits before the exchange. The rows
    (node, record_id) of recs are the exact form for nodes with millions of records."""
    if most is not None:
        recs = recs.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("record_id"))).where(F.col("_r") <= most)
    return recs.groupBy("node").agg(F.sort_array(F.collect_list("record_id")).alias("record_ids"))


def hypergraph(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hypernodes (hid, key, value), one for each different pair, and hyperedges (block, hids) of rows (block, key, value)."""
    n = blocks.select("key", "value").distinct().withColumn("hid", F.xxhash64("key", "value"))
    e = blocks.groupBy("block").agg(F.sort_array(F.collect_set(F.xxhash64("key", "value"))).alias("hids"))
    return n.select("hid", "key", "value"), e


def set_cover(sets: DataFrame, picks: int | None = None, at_once: int = PAIRS) -> DataFrame:
    """(question, pick, node, gain): for each question, greedily the node with most uncovered records, ties by name, until every record is covered; with picks, the
    first so many. sets: question, node, record_ids, one row for each question and node; what is null covers nothing.

    A node that comes before all nodes with which it shares an uncovered record is picked with the gain that it has, whatever else is picked before: so all such nodes
    are picked in one round, and the picks of a question in order are those by gain and name. While a question has over at_once open pairs of node and record, rounds go over all
    executors; so many pairs or fewer are covered one pick after another by one task, as numbers. Both ways give the same picks."""
    key = ["question", "node"]
    rows = sets.select(*key, F.explode(F.array_distinct("record_ids")).alias("record")).where("question is not null and node is not null and record is not null")
    live, out, i = stored(rows, "sets"), [], 0
    while True:
        large = stored(live.groupBy("question").agg(F.count("*").alias("n")).where(F.col("n") > at_once).select("question"), "large")
        if large.isEmpty() or i == picks:
            break
        i += 1
        gains = live.groupBy(*key).agg(F.count("*").alias("gain"))
        most = live.join(F.broadcast(large), "question", "left_semi").join(gains, key).groupBy("question", "record").agg(F.min(F.struct((-F.col("gain")).alias("less"), "node")).alias("b"))
        ahead = most.groupBy("question", "b.node").agg(F.count("*").alias("n"), (-F.min("b.less")).alias("gain")).where("n = gain").select(*key, "gain")
        out.append(stored(ahead, "picks"))
        covered = live.join(out[-1].select(*key), key, "left_semi").select("question", "record")
        live = stored(live.join(covered, ["question", "record"], "left_anti"), "sets")
    tasks = live.sparkSession.sparkContext.defaultParallelism
    left = live.join(F.broadcast(large), "question", "left_anti").repartition(tasks, "question").sortWithinPartitions(*key)
    kind = {c: live.schema[c].dataType.simpleString() for c in key}
    out.append(left.mapInArrow(_covers(picks), f"question {kind['question']}, node {kind['node']}, gain long"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("gain"), "node"))
    found = reduce(DataFrame.unionByName, out).select("question", place.alias("pick"), "node", "gain")
    return found if picks is None else found.where(F.col("pick") <= picks)


def _covers(picks: int | None):
    """The picks of each question of a task, whose rows come in order of question and node; a task holds one question at a time, as numbers of nodes and records."""
    import numpy as np

    def run(batches):
        import heapq

        import pyarrow as pa
        import pyarrow.compute as pc

        def cover(parts):
            rows = pa.Table.from_batches(parts)
            name, record = rows.column("node").combine_chunks(), rows.column("record").dictionary_encode().combine_chunks()
            new = np.append(True, pc.not_equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False).astype(bool))
            first = np.flatnonzero(new)
            node, record = (np.cumsum(new) - 1).astype(np.int32), record.indices.to_numpy()
            at, order = np.append(first, len(node)), np.argsort(record, kind="stable")
            of, to = node[order], np.searchsorted(record[order], np.arange(record.max() + 2))  # the nodes of each record
            gain, open_ = np.diff(at), np.ones(len(to) - 1, bool)
            heap = [(-g, n) for n, g in enumerate(gain.tolist())]
            heapq.heapify(heap)
            taken = []
            while heap and (picks is None or len(taken) < picks):
                g, n = heap[0]
                if -g != gain[n]:
                    # it fell since it was put there
                    heapq.heapreplace(heap, (-int(gain[n]), n)) if gain[n] else heapq.heappop(heap)
                    continue
                heapq.heappop(heap)
                taken.append((n, -g))
                got = record[at[n] : at[n + 1]]
                got = got[open_[got]]
                open_[got] = False
                size = to[got + 1] - to[got]
                hit = of[np.repeat(to[got] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                np.subtract.at(gain, hit, 1)
            n, g = zip(*taken, strict=True)
            asked = rows.column("question")[:1].combine_chunks().take(pa.array(np.zeros(len(n), np.int64)))
            return pa.RecordBatch.from_arrays([asked, name.take(pa.array(first[list(n)])), pa.array(g, pa.int64())], ["question", "node", "gain"])

        held = []
        for b in batches:
            if not b.num_rows:
                continue
            q = b.column(0)
            ends = np.flatnonzero(pc.not_equal(q[1:], q[:-1]).to_numpy(zero_copy_only=False).astype(bool)) + 1
            for i, j in zip([0, *ends.tolist()], [*ends.tolist(), b.num_rows], strict=True):
                if held and held[-1].column(0)[-1] != q[i]:
                    yield cover(held)
                    held = []
                held.append(b.slice(i, j - i))
        if held:
            yield cover(held)

    return run


def ontological_context(question: str, nodes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(id, definition, superclasses, subclasses) of the first nodes by seq that match the question."""
    from .graph import parents_children

    hit = nodes.where(concept_match(F.lit(question), F.col("id"))).orderBy("seq").limit(most)
    rel = parents_children(hit, edges.join(F.broadcast(hit.select(F.col("id").alias("k"))), (F.col("src") == F.col("k")) | (F.col("dst") == F.col("k")), "left_semi"))
    return hit.join(rel, "id").select("id", F.coalesce("description", F.lit("")).alias("definition"), F.array_join("parents", ", ").alias("superclasses"), F.array_join("children", ", ").alias("subclasses"))


def graph_facts(question: str, nodes: DataFrame, edges: DataFrame, data_props: DataFrame, most: int = 30, stop=fixed.STOPWORDS) -> DataFrame:
    """(full, priority): facts about nodes that match the question without stop words; nodes, then edges, then properties; most distinct ones."""
    kept = " ".join(w for w in question.split() if w.lower() not in stop)
    hit = nodes.where(concept_match(F.lit(kept), F.col("id"))).select("id", "type")
    n = hit.select(F.concat("id", F.lit(" is a "), "type").alias("full"), F.lit(0).alias("priority"))
    ends = edges.join(hit.select(F.col("id").alias("src")), "src", "left_semi").unionByName(edges.join(hit.select(F.col("id").alias("dst")), "dst", "left_semi").select(edges.columns))
    e = ends.select(F.concat_ws(" ", "src", "relation", "dst").alias("full"), F.lit(1).alias("priority"))
    p = data_props.join(hit.select(F.col("id").alias("entity")), "entity", "left_semi").select(F.concat("entity", F.lit(" "), "attribute", F.lit(": "), "value").alias("full"), F.lit(2).alias("priority"))
    return n.unionByName(e).unionByName(p).groupBy("full").agg(F.min("priority").alias("priority")).orderBy("priority", "full").limit(most)


def questions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, question): single-hop templates over nodes and edges, two-hop ones over chains; a caller samples and limits."""
    from .graph import two_hops
    from .quality import degrees

    deg = degrees(nodes, edges)
    q = lambda df, kind, *parts: df.select(F.lit(kind).alias("kind"), F.concat(*parts).alias("question"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k")).where("k >= 2")
    one = q(nodes.where("kind = 'class'"), "what", F.lit("What is "), "id", F.lit("?")).unionByName(q(edges, "related", F.lit("How is "), "src", F.lit(" related to "), "dst", F.lit("?")))
    one = one.unionByName(q(deg.where("degree >= 3"), "factors", F.lit("What factors influence "), "id", F.lit("?"))).unionByName(q(out, "affect", F.lit("What does "), "id", F.lit(" affect?")))
    return one.unionByName(q(two_hops(edges, edges), "two_hop", F.lit("How does "), "u", F.lit(" relate to "), "w", F.lit("?"))).distinct()


def search_queries(nodes: DataFrame, domain: str | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(id, query): a search for each node's definition and, with edges, for each relation between two of the nodes; the domain stands before what doesn't name it."""
    out = nodes.select("id", F.concat("id", F.lit(" definition")).alias("query"))
    if edges is not None:
        ids = nodes.select("id")
        e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        out = out.unionByName(e.select(F.col("src").alias("id"), F.concat("src", F.lit(" "), "relation", F.lit(" "), "dst", F.lit(" relationship")).alias("query"))).distinct()
    if domain:
        out = out.withColumn("query", F.when(F.contains(F.lower("query"), F.lit(domain.lower())), F.col("query")).otherwise(F.concat(F.lit(f"{domain} "), "query")))
    return out


def domain_hint(nodes: DataFrame, metadata: str = "") -> DataFrame:
    """One row: hint, the first domain of which a keyword is in the metadata, or else two or more are in names of nodes; else null."""
    said = next((hint for words, hint in fixed.DOMAIN_HINTS if any(w in metadata.lower() for w in words)), None)
    cols = []
    for words, hint in fixed.DOMAIN_HINTS:
        hits = sum((F.max(F.contains(F.lower("id"), F.lit(w)).cast("int")) for w in words), F.lit(0))
        cols.append(F.when(hits >= 2, hint))
    return nodes.agg(F.coalesce(F.lit(said).cast("string"), *cols, F.lit(None).cast("string")).alias("hint"))
