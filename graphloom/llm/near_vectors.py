"""Near-duplicate vectors by an inverted multi-index: codebooks of the two halves of vectors form a grid of cells; each vector visits cells in
the order of distance until the target recall is reached, and what it meets there is verified by cosine in doubles."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import stored, table

#: Cosine of a link; the share of pairs at just that cosine, in any direction, that the visited cells must hold.
THRESHOLD, RECALL = 0.95, 0.999
#: Vectors of a cell on average; codewords of a half at most; rows that the codebooks are fitted on, at most about; rounds of fitting.
CELL_ROWS, MOST_WORDS, FIT_ROWS, FIT_ROUNDS = 48, 1024, 32_768, 8
#: Rows of that sample in which crowds are looked for, and how many of them make a crowd.
CROWD_SAMPLE, CROWD = 4_096, 16
#: Rows of a matrix of distances; pairs from which the room of the traversal is taken.
BLOCK, PAIRS = 2_048, 4_096
#: Vectors at home in a tile, which a task holds; visitors of a slice, which it streams.
TILE, VISITORS = 2_048, 65_536
#: Room for rounding of angles.
EPS = 1e-7


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as unit vectors, in doubles."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64) if raw else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def squares(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances, rows by codewords."""
    return (x * x).sum(axis=1)[:, None] + (words * words).sum(axis=1)[None, :] - 2.0 * (x @ words.T)


def codebook(x: np.ndarray, k: int, rng) -> np.ndarray:
    """k codewords (fewer if x has fewer rows) by Lloyd's rounds; a codeword without rows takes one that lies far off."""
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        of, far = np.zeros(len(x), np.int64), np.zeros(len(x))
        for i in range(0, len(x), BLOCK):
            d = squares(x[i : i + BLOCK], words)
            of[i : i + BLOCK], far[i : i + BLOCK] = d.argmin(axis=1), d.min(axis=1)
        n = np.bincount(of, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, of, x)
        words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], words)
        empty = np.flatnonzero(n == 0)
        words[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return words


def traverse(a: np.ndarray, b: np.ndarray, room: float) -> tuple[np.ndarray, np.ndarray]:
    """Multi-sequence traversal: (row, cell) in each row's order of distance, while a cell is at most room further than the nearest.

    a, b: squared distances to the codewords of each half. Each row has one sorted sequence for a half, and a frontier: for each entry of the first
    sequence the next entry of the second. The nearest cell of the frontier comes next, for all rows at once.
    """
    n, width = a.shape[0], b.shape[1]
    oa, ob = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
    sa, sb = np.take_along_axis(a, oa, 1), np.take_along_axis(b, ob, 1)
    sa, sb = sa - sa[:, :1], np.c_[sb - sb[:, :1], np.full(n, np.inf)]
    wide = max(1, int((sa <= room).sum(axis=1).max(initial=1)))
    sa, at, live = sa[:, :wide], np.zeros((n, wide), np.int64), np.arange(n)
    rows, cells = [], []
    while len(live):
        ahead = sa[live] + sb[live[:, None], at[live]]
        pick = ahead.argmin(axis=1)
        on = ahead[np.arange(len(live)), pick] <= room
        live, pick = live[on], pick[on]
        rows.append(live)
        cells.append(oa[live, pick] * width + ob[live, at[live, pick]])
        at[live, pick] += 1
    rows, cells = np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(cells or [np.zeros(0, int)])
    order = np.argsort(rows, kind="stable")
    return rows[order], cells[order]


class Index:
    """Codebooks, the room of the traversal, and the middles of crowds."""

    def __init__(self, sample: np.ndarray, words: int, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        fit = sample[: max(words, 3 * len(sample) // 4)]
        self.words = [codebook(h, words, rng) for h in self.halves(fit)]
        self.angle = math.acos(threshold)
        # the target recall: rows that the codebooks weren't fitted on, and others at exactly the threshold, in any direction; a pair is found if either visits the other's cell
        q = sample[len(fit) :] if len(sample) > len(fit) else sample
        q = q[rng.integers(0, len(q), PAIRS)]
        off = rng.normal(size=q.shape)
        off -= (off * q).sum(axis=1, keepdims=True) * q
        size = np.linalg.norm(off, axis=1, keepdims=True)
        p = threshold * q + math.sqrt(1 - threshold**2) * off / np.where(size > 0, size, 1)
        d, e = self.distances(q), self.distances(p)
        cell = lambda x: [h.argmin(axis=1) for h in x]
        further = lambda x, c: sum(h[np.arange(len(h)), i] - h.min(axis=1) for h, i in zip(x, c, strict=True))
        self.room = float(np.quantile(np.minimum(further(d, cell(e)), further(e, cell(d))), recall)) + 1e-12
        self.crowds = crowds(sample[:CROWD_SAMPLE], self.angle)

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.half], x[:, self.half :]]

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [squares(h, w) for h, w in zip(self.halves(x), self.words, strict=True)]

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """home of each row, and (row, place) of what it visits. Places are cells, or -1, -2, ...: crowds.

        Members of a crowd are within half the angle of a link of its middle, so they are all linked. Others that may be linked to
        members, by the triangle inequality of angles, visit the crowd; a member visits earlier crowds only.
        """
        rows, cells = traverse(*self.distances(x), self.room)
        first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
        home = cells[first].copy()
        if not len(self.crowds):
            return home, rows[~first], cells[~first]
        angles = np.arccos(np.clip(x @ self.crowds.T, -1, 1))
        of = angles.argmin(axis=1)
        member = angles[np.arange(len(x)), of] <= self.angle / 2 - EPS
        near = (angles <= 1.5 * self.angle + EPS) & (~member[:, None] | (np.arange(len(self.crowds))[None, :] < of[:, None]))
        i, j = np.nonzero(near)
        home[member] = -1 - of[member]
        out = ~first & ~member[rows]
        return home, np.r_[rows[out], i], np.r_[cells[out], -1 - j]


def crowds(x: np.ndarray, angle: float) -> np.ndarray:
    """Middles of the densest groups of a sample: each holds CROWD rows of it at least. They save work and change no result."""
    found, live = [], np.ones(len(x), bool)
    near = np.concatenate([x[i : i + 512] @ x.T >= math.cos(angle) for i in range(0, len(x), 512)]) if len(x) else np.zeros((0, 0), bool)
    while live.any():
        n = near[:, live].sum(axis=1) * live
        top = int(n.argmax())
        if n[top] < CROWD:
            break
        middle = x[near[top] & live].mean(axis=0)
        middle /= np.linalg.norm(middle)
        own = live & (np.arccos(np.clip(x @ middle, -1, 1)) <= angle / 2 - EPS)
        if own.sum() >= CROWD:
            found.append(middle)
            live &= ~own
        else:
            live &= ~near[top]
    return np.array(found).reshape(-1, x.shape[1])


class Home:
    """The vectors at home in a tile: link counts, and which of them are joined, as links come in."""

    def __init__(self, x, rows, sizes, visits, threshold, span):
        """span: the number of places, which are numbered from -crowds to cells - 1."""
        self.x, self.rows, self.sizes, self.threshold, self.span = x, rows, sizes, threshold, span
        n = np.array([len(v) for v in visits], np.int64)
        flat = np.concatenate([np.asarray(v, np.int64) for v in visits]) if n.sum() else np.zeros(0, np.int64)
        self.visits = np.sort(np.repeat(np.arange(len(rows)), n) * span + flat % span) if len(flat) else flat
        self.links, self.parent = np.zeros(len(rows), np.int64), np.arange(len(rows))

    def join(self, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
        """Join what each of n others (i) is linked to (j); the label of each other."""
        label = np.full(n, len(self.rows))
        while True:
            of = self.parent[j]
            label[:] = len(self.rows)
            np.minimum.at(label, i, of)
            if (label[i] == of).all():
                return label
            np.minimum.at(self.parent, of, label[i])
            while (self.parent[self.parent] != self.parent).any():
                self.parent = self.parent[self.parent]

    def meet(self, x, rows, sizes, homes, place):
        """Links of visitors; their counts and edges."""
        i, j = np.nonzero(x @ self.x.T >= self.threshold)
        if len(i) and len(self.visits):
            # a pair whose ends visit each other's cell counts in the smaller cell
            key = j * self.span + homes[i] % self.span
            at = np.minimum(np.searchsorted(self.visits, key), len(self.visits) - 1)
            keep = (self.visits[at] != key) | (place <= homes[i])
            i, j = i[keep], j[keep]
        if not len(i):
            return None
        np.add.at(self.links, j, sizes[i])
        links = np.bincount(i, self.sizes[j], len(rows)).astype(np.int64)
        label = self.join(i, j, len(rows))
        hit = np.flatnonzero(links)
        return rows[hit], links[hit], self.rows[label[hit]]

    def among(self):
        """Links of the vectors at home."""
        s = np.triu(self.x @ self.x.T >= self.threshold, 1)
        i, j = np.nonzero(s)
        if len(i):
            np.add.at(self.links, i, self.sizes[j])
            np.add.at(self.links, j, self.sizes[i])
            self.join(np.r_[i, i], np.r_[i, j], len(self.rows))

    def rest(self):
        hit = np.flatnonzero((self.links > 0) | (self.parent != np.arange(len(self.rows))))
        return self.rows[hit], self.links[hit], self.rows[self.parent[hit]]


def _meet(kind: str, threshold: float, span: int):
    """Tiles, one after the other: those at home first, then the visitors of a slice."""
    names = ["row", "links", "other"]

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names)

    def opened(held, at):
        x, rows, sizes = (np.concatenate([h[k] for h in held]) for k in range(3))
        home = Home(x, rows, sizes, [v for h in held for v in h[3]], threshold, span)
        if at[0] >= 0 and at[2] == 0:  # members of a crowd are linked for certain, and each slice has the same vectors at home
            home.among()
        return home

    def close(held, home, at):
        if home is None and held and at[0] >= 0 and at[2] == 0:
            home = opened(held, at)
        if home is not None:
            yield out(home.rest())

    def run(batches):
        at, held, home = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("place", "tile", "slice", "guest")])
            cut = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
            rows, sizes, homes = (b.column(c).to_numpy(zero_copy_only=False) for c in ("row", "size", "home"))
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                place, tile, piece, guest = keys[i].tolist()
                if (place, tile, piece) != at:
                    yield from close(held, home, at)
                    at, held, home = (place, tile, piece), [], None
                x = unit(b.column("v").slice(i, j - i).to_pylist(), kind)
                if not guest:
                    held.append((x, rows[i:j], sizes[i:j], [v or [] for v in b.column("visits").slice(i, j - i).to_pylist()]))
                    continue
                if not held:
                    continue
                home = home or opened(held, at)
                for k in range(i, j, TILE):
                    part = slice(k, min(j, k + TILE))
                    found = home.meet(x[k - i : part.stop - i], rows[part], sizes[part], homes[part].astype(np.int64), place)
                    if found:
                        yield out(found)
        yield from close(held, home, at)

    return run


def found_links(reps: DataFrame, n: int, length: int, kind: str, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """row, links, other: for each of the n vectors of one length in reps (row, size, v), parts of its count of links, and edges that join what links join."""
    share = min(1.0, FIT_ROWS / n)
    sample = reps.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("row", "v").collect()
    sample = unit([bytes(r.v) for r in sorted(sample, key=lambda r: bytes(r.v))], kind)
    sample = sample[np.random.default_rng(0).permutation(len(sample))]
    words = max(1, min(MOST_WORDS, math.ceil(math.sqrt(n / CELL_ROWS)), len(sample)))
    if not len(sample):
        sample, words = np.ones((1, length)) / math.sqrt(length), 1
    index = Index(sample, words, threshold, recall)
    sent = reps.sparkSession.sparkContext.broadcast(index)
    span = len(index.words[0]) * len(index.words[1]) + len(index.crowds)

    def code(batches):
        for b in batches:
            for t in (b.slice(i, BLOCK) for i in range(0, b.num_rows, BLOCK)):
                home, rows, visits = sent.value.places(unit(t.column("v").to_pylist(), kind))
                order = np.argsort(rows, kind="stable")
                ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=t.num_rows))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(visits[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(t.column(c) for c in ("row", "size", "v")), pa.array(home.astype(np.int32)), lists], ["row", "size", "v", "home", "visits"])

    coded = stored(reps.select("row", "size", "v").mapInArrow(code, "row long, size long, v binary, home int, visits array<int>"), "coded")
    one = lambda c, at_home: coded.select(c.alias("place"), F.lit(at_home).alias("h"))
    counts = one(F.col("home"), 1).unionByName(one(F.explode("visits"), 0)).groupBy("place").agg(F.sum("h").alias("homes"), F.count("*").alias("n"))
    tiles, slices = F.ceil(F.col("homes") / TILE).cast("int"), F.ceil(F.col("n") / VISITORS).cast("int")
    counts = counts.where("homes > 0 and n > 1").select(F.col("place").alias("at"), tiles.alias("tiles"), slices.alias("slices"))
    at = coded.select("row", "size", "v", "home", "visits", F.explode(F.concat(F.array("home"), "visits")).alias("place")).join(counts, F.col("place") == F.col("at"))
    h = F.xxhash64("row")
    tile, piece = F.pmod(h, "tiles").cast("int"), F.pmod(F.shiftright(h, 20), "slices").cast("int")
    below = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<struct<tile:int,slice:int,guest:int>>"))
    copy = lambda t, s, g: F.struct(t.alias("tile"), s.alias("slice"), F.lit(g).alias("guest"))
    own = below(F.col("slices"), lambda k: copy(tile, k, 0))
    earlier = below(F.when(F.col("place") >= 0, tile).otherwise(0), lambda k: copy(k, piece, 1))
    copies = F.when(F.col("place") == F.col("home"), F.concat(own, earlier)).otherwise(below(F.col("tiles"), lambda k: copy(k, piece, 1)))
    at = at.withColumn("c", F.explode(copies)).select("place", "c.tile", "c.slice", "c.guest", "row", "size", "v", "home", F.when(F.col("c.guest") == 0, F.col("visits")).alias("visits"))
    met = at.repartition("place", "tile", "slice").sortWithinPartitions("place", "tile", "slice", "guest", "row").mapInArrow(_meet(kind, threshold, span), "row long, links long, other long")
    if not len(index.crowds):
        return met
    members = coded.where("home < 0")
    sums = members.groupBy("home").agg(F.sum("size").alias("total"), F.min("row").alias("first"))
    certain = members.select("row", "size", "home").join(F.broadcast(sums), "home")  # one row a crowd: CROWD_SAMPLE / CROWD at most
    return met.unionByName(certain.select("row", (F.col("total") - F.col("size")).alias("links"), F.col("first").alias("other")))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Links join rows whose vectors have a cosine of threshold or more, in doubles; n_links counts the other rows linked directly, and
    component_id is the smallest vec_id reachable (null only if all are). Vectors that are null, empty, zero or hold null, NaN or infinite
    components link with nothing; vectors of different lengths neither. Equal vectors are one class and always linked. Repeated ids are
    rows of their own. No rows: no rows.

    Codebooks, and the room of the traversal for the recall, are fitted on a sample of about FIT_ROWS different vectors; every vector is
    indexed. Of pairs at just the threshold, recall is expected to be found, of nearer ones more; what is found is exact. Vectors
    in a crowd (within half the angle of a link of its middle) are linked without being compared. A task holds one tile of vectors
    and streams its visitors; it returns counts and a forest, never pairs.
    """
    import pyarrow.compute as pc

    inner = vectors.schema[column].dataType.elementType.simpleString()
    kind = "<f4" if inner == "float" else "<f8"
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), (F.col(column) if inner in ("float", "double") else F.col(column).cast("array<double>")).alias("x"))

    def pack(batches):
        for b in batches:
            x, out = b.column(2), []
            flat = x.flatten()
            ok = pc.fill_null(pc.is_finite(flat), False).to_numpy(zero_copy_only=False)
            values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(kind) + np.array(0, kind)  # -0.0 is 0.0
            n = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
            end = np.cumsum(n)
            for i, j in zip((end - n).tolist(), end.tolist(), strict=True):
                out.append(values[i:j].tobytes() if j > i and ok[i:j].all() and values[i:j].any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["row", "vec_id", "v"])

    t = rows.mapInArrow(pack, f"row long, vec_id {rows.schema['vec_id'].dataType.simpleString()}, v binary")
    t = stored(t.withColumn("digest", F.unhex(F.sha2("v", 256))), "vectors")
    classes = t.where("digest is not null").groupBy("digest").agg(F.count("*").alias("size"), F.min("row").alias("rep"), F.min("vec_id").alias("least"))
    classes = stored(classes, "classes")
    reps = stored(t.where("digest is not null").select("row", "v").join(classes.select(F.col("rep").alias("row"), "size"), "row"), "reps")
    width = int(kind[2])
    lengths = {r.n // width: r["count"] for r in reps.groupBy(F.octet_length("v").alias("n")).count().collect()}
    found = [found_links(reps.where(F.octet_length("v") == n * width), k, n, kind, threshold, recall) for n, k in sorted(lengths.items()) if k > 1]
    none = vectors.sparkSession.createDataFrame([], "row long, links long, other long")
    found = stored(reduce(DataFrame.unionByName, found or [none]), "found")
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("row").alias("src"), F.col("other").alias("dst")))
    of = classes.join(links.withColumnRenamed("row", "rep"), "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    of = stored(of.select("digest", "size", "least", "component", F.coalesce("links", F.lit(0)).alias("links")), "links")
    firsts = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(firsts, "component").select("digest", "component_id", (F.col("links") + F.col("size") - 1).alias("n_links"))
    out = t.where("digest is not null").select("vec_id", "digest").join(of, "digest").select("vec_id", "n_links", "component_id")
    alone = t.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE u AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id, vec_id AS node FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.node = l.a),
c AS (SELECT vec_id, min(node) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON a = vec_id
"""
