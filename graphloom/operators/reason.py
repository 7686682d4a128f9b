"""Rule-based inference over edges (src, relation, dst). Existence tests look at the relation, so the rules only add, and the fixpoint doesn't depend on their order."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..scratch import stored
from .fixpoint import transitive_closure

KEYS = ["src", "relation", "dst"]


def _new(rows: DataFrame, edges: DataFrame, relations=None) -> DataFrame:
    """Rows that edges lack. relations: names that the rows' relations are among, so that only such edges are compared."""
    if relations is not None:
        edges = edges.where(F.col("relation").isin(list(relations)))
    return rows.select(*KEYS).distinct().join(edges.select(*KEYS), KEYS, "left_anti")


def subsumption(edges: DataFrame) -> DataFrame:
    return _new(transitive_closure(edges.where("relation = 'subClassOf'")), edges, ["subClassOf"])


def inheritance(edges: DataFrame) -> DataFrame:
    """x type A, A subClassOf B: x type B."""
    t, s = edges.where("relation = 'type'").alias("t"), edges.where("relation = 'subClassOf'").alias("s")
    return _new(t.join(s, F.col("t.dst") == F.col("s.src")).select(F.col("t.src").alias("src"), F.lit("type").alias("relation"), F.col("s.dst").alias("dst")), edges, ["type"])


def domain_range(edges: DataFrame, axioms: DataFrame) -> DataFrame:
    """s p o: s type each domain of p, o type each range of p. Axioms: axiom_type, entities [property, class]."""
    a = axioms.where("axiom_type in ('domain', 'range')").select("axiom_type", F.get("entities", F.lit(0)).alias("relation"), F.get("entities", F.lit(1)).alias("dst"))
    e = edges.select(F.col("src").alias("s"), "relation", F.col("dst").alias("o")).join(a, "relation")
    return _new(e.select(F.when(F.col("axiom_type") == "domain", F.col("s")).otherwise(F.col("o")).alias("src"), F.lit("type").alias("relation"), "dst"), edges, ["type"])


def closure(edges: DataFrame, relations: list[str]) -> DataFrame:
    return _new(transitive_closure(edges.where(F.col("relation").isin(relations))), edges, relations)


def symmetric(edges: DataFrame, relations: list[str], any_relation: bool = False) -> DataFrame:
    """Reverse edges of symmetric relations; with any_relation, only where no edge goes back at all."""
    back = edges.where(F.col("relation").isin(relations)).select(F.col("dst").alias("src"), "relation", F.col("src").alias("dst"))
    keys = ["src", "dst"] if any_relation else KEYS
    return back.select(*KEYS).distinct().join((edges if any_relation else edges.where(F.col("relation").isin(relations))).select(*keys).distinct(), keys, "left_anti")


def inverse(edges: DataFrame, axioms: DataFrame) -> DataFrame:
    a = axioms.where("axiom_type = 'inverse'").select(F.get("entities", F.lit(0)).alias("p"), F.get("entities", F.lit(1)).alias("q"))
    both = a.unionByName(a.select(F.col("q").alias("p"), F.col("p").alias("q")))
    return _new(edges.join(both, F.col("relation") == F.col("p")).select(F.col("dst").alias("src"), F.col("q").alias("relation"), F.col("src").alias("dst")), edges.join(F.broadcast(both.select(F.col("q").alias("relation")).distinct()), "relation", "left_semi"))


def disjointness(edges: DataFrame, axioms: DataFrame) -> DataFrame:
    """(instance, a, b): instances of both classes of a disjointness axiom."""
    ax = axioms.where("axiom_type = 'disjointness'").select(F.get("entities", F.lit(0)).alias("a"), F.get("entities", F.lit(1)).alias("b"))
    t = edges.where("relation = 'type'").select(F.col("src").alias("instance"), "dst").distinct()
    one = t.join(ax, F.col("dst") == F.col("a")).select("instance", "a", "b")
    return one.join(t.select("instance", F.col("dst").alias("b")), ["instance", "b"], "left_semi").select("instance", "a", "b")


def axiom_relations(axioms: DataFrame) -> DataFrame:
    """(kind, relation): relations that axioms make transitive or symmetric."""
    a = axioms.where("axiom_type in ('transitivity', 'symmetry')")
    return a.select(F.when(F.col("axiom_type") == "transitivity", "transitive").otherwise("symmetric").alias("kind"), F.explode("entities").alias("relation")).distinct()


def relation_properties(edges: DataFrame, open_chains: int = 3, back_share: float = 0.7) -> DataFrame:
    """(relation, open_chains, n, backs, transitive, symmetric) of relations with two edges or more: transitive with more than
    open_chains chains a, b, c (a not c) without a to c; symmetric if more than back_share of the edges have a reverse.

    Open chains are counted, not listed: all chains, by products of in- and out-degrees, less those that turn back, less closed ones.
    Closed ones are triangles, found from each one's node of the lowest degree, so a hub's edges never meet each other; relations without chains have none to
    look for. Edges travel once, to be grouped by their two ends, which tells copies, reverses and loops, and their ends once, to be counted."""
    down = F.coalesce(F.col("src") > F.col("dst"), F.lit(False))
    ends = edges.select("relation", F.when(down, F.col("dst")).otherwise(F.col("src")).alias("x"), F.when(down, F.col("src")).otherwise(F.col("dst")).alias("y"), (~down).cast("int").alias("up"), down.cast("int").alias("down"))
    pair = stored(ends.groupBy("relation", "x", "y").agg(F.max("up").alias("up"), F.max("down").alias("down")), "pairs")
    both, loop = F.col("up") + F.col("down") == 2, F.col("x") == F.col("y")
    n = pair.groupBy("relation").agg(F.sum(F.col("up") + F.col("down")).alias("n"), (2 * F.count_if(both) + F.count_if(loop)).alias("backs"), (2 * F.count_if(both)).alias("turns")).where("n >= 2")
    pair = pair.where("x != y")  # a loop only makes closed chains
    sides = F.explode(F.array(F.struct(F.col("x").alias("id"), F.col("up").cast("long").alias("o"), F.col("down").cast("long").alias("i")), F.struct(F.col("y").alias("id"), F.col("down").cast("long").alias("o"), F.col("up").cast("long").alias("i"))))
    chains = pair.select("relation", sides.alias("s")).groupBy("relation", "s.id").agg(F.sum("s.o").alias("o"), F.sum("s.i").alias("i")).groupBy("relation").agg(F.sum(F.col("o") * F.col("i")).alias("chains"))
    chains = stored(chains, "chains")
    pair = pair.join(F.broadcast(chains.where("chains > 0").select("relation")), "relation", "left_semi")
    deg = pair.select("relation", F.explode(F.array("x", "y")).alias("id")).groupBy("relation", "id").agg(F.count("*").alias("k"))
    full = pair.join(deg.select("relation", F.col("id").alias("x"), F.col("k").alias("kx")), ["relation", "x"]).join(deg.select("relation", F.col("id").alias("y"), F.col("k").alias("ky")), ["relation", "y"])
    low = F.expr("struct(kx, x) < struct(ky, y)")
    oriented = full.select("relation", F.when(low, F.col("x")).otherwise(F.col("y")).alias("l"), F.when(low, F.col("y")).otherwise(F.col("x")).alias("h"), F.when(low, F.col("up")).otherwise(F.col("down")).alias("lh"), F.when(low, F.col("down")).otherwise(F.col("up")).alias("hl"))
    a = oriented.select("relation", "l", F.col("h").alias("x"), F.col("lh").alias("lx"), F.col("hl").alias("xl"))
    b = oriented.select("relation", "l", F.col("h").alias("y"), F.col("lh").alias("ly"), F.col("hl").alias("yl"))
    tri = a.join(b, ["relation", "l"]).where("x < y").join(pair, ["relation", "x", "y"])
    closed = tri.select("relation", F.expr("lx * up * ly + ly * down * lx + xl * ly * up + up * yl * xl + yl * lx * down + down * xl * yl").alias("c")).groupBy("relation").agg(F.sum("c").alias("closed"))
    out = n.join(chains, "relation", "left").join(closed, "relation", "left")
    out = out.withColumn("open_chains", (F.coalesce("chains", F.lit(0)) - F.col("turns") - F.coalesce("closed", F.lit(0))).cast("long"))
    return out.select("relation", "open_chains", "n", "backs", (F.col("open_chains") > open_chains).alias("transitive"), (F.col("backs") > back_share * F.col("n")).alias("symmetric"))


def relation_sets(edges: DataFrame, axioms: DataFrame, subject: str = "", detect: bool = False) -> tuple[list[str], list[str]]:
    """Transitive and symmetric relations: the built-in ones, those of axioms, of the subject's domain, and detected ones. Bounded by the number of relation names, which are schema, not data."""
    t, s = {*fixed.TRANSITIVE, *fixed.TRANSITIVE_CANONICAL}, {*fixed.SYMMETRIC, *fixed.SYMMETRIC_CANONICAL}
    for name, sets in fixed.DOMAIN_RULES.items():
        if subject and (name in subject.lower() or subject.lower() in name):
            t.update(sets["transitive"])
            s.update(sets["symmetric"])
            break
    for r in axiom_relations(axioms).collect():
        (t if r.kind == "transitive" else s).add(r.relation)
    if detect:
        for r in relation_properties(edges).where("transitive or symmetric").collect():
            t.update([r.relation] if r.transitive else [])
            s.update([r.relation] if r.symmetric else [])
    return sorted(t - {"subClassOf"}), sorted(s)


class Rules:
    """The rules of an ontology: which relations are closed and symmetric, and what axioms say. These are names of a schema, so the driver holds them."""

    def __init__(self, axioms: DataFrame, transitive: list[str], sym: list[str]):
        self.spark, self.closed, self.sym = axioms.sparkSession, sorted({"subClassOf", *transitive}), sorted(sym)
        said = [(r.axiom_type, *r.entities[:2]) for r in axioms.where("axiom_type in ('inverse', 'domain', 'range') and size(entities) >= 2").collect()]
        self.inverses = sorted({x for k, p, q in said if k == "inverse" for x in ((p, q), (q, p))})
        self.typed = sorted({x for x in said if x[0] != "inverse"})
        names = [p for p, _ in self.inverses]
        #: Relations with one inverse: an edge that came by the rule has the edge that it came from as its inverse.
        self.paired = [p for p in names if names.count(p) == 1]

    def _table(self, rows, schema: str) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(rows, schema))

    def _inverse(self) -> DataFrame:
        return self._table(self.inverses, "relation string, q string")

    def _typed(self) -> DataFrame:
        return self._table(self.typed, "axiom_type string, relation string, class string")

    def reads(self, names: set[str]) -> bool:
        """Whether any rule reads one of these relations."""
        return bool(names & {*self.closed, *self.sym, "type", *(p for p, _ in self.inverses), *(p for _, p, _ in self.typed)})

    def chained(self, delta: DataFrame, known: DataFrame) -> DataFrame:
        """Two edges of one closed relation that follow each other, one of them in delta; known holds delta."""
        d, k = (x.where(F.col("relation").isin(self.closed)) for x in (delta, known))
        left = d.select("relation", "src", F.col("dst").alias("mid")).join(k.select("relation", F.col("src").alias("mid"), "dst"), ["relation", "mid"])
        right = k.select("relation", "src", F.col("dst").alias("mid")).join(d.select("relation", F.col("src").alias("mid"), "dst"), ["relation", "mid"])
        return left.select(*KEYS).unionByName(right.select(*KEYS)).where("src != dst")

    def turned(self, came) -> tuple[set[str], set[str]]:
        """Relations that symmetry and inverses read in edges that came by (rule, relation): not those that a rule has turned already."""
        sym = {r for rule, r in came if r in self.sym and rule != "symmetric_closure"}
        return sym, {r for rule, r in came if any(r == p for p, _ in self.inverses) and not (rule == "inverse_propagation" and r in self.paired)}

    def writes(self, came) -> set[str]:
        """Relations of which the other rules may add edges, for edges that came by (rule, relation)."""
        sym, inv = self.turned(came)
        return {"type"} | sym | {q for p, q in self.inverses if p in inv}

    def step(self, delta: DataFrame, known: DataFrame, came: set | None = None) -> DataFrame | None:
        """(src, relation, dst, k, rule): what the other rules say of edges of delta (src, relation, dst, rule), with those of known, which holds delta. came: (rule, relation) of delta, if known."""
        names = None if came is None else {r for _, r in came}
        due = lambda *r: names is None or bool(names & set(r))
        found = []
        typed = lambda e: e.where("relation = 'type'").select(F.col("src").alias("x"), F.col("dst").alias("mid"))
        above = lambda e: e.where("relation = 'subClassOf'").select(F.col("src").alias("mid"), F.col("dst").alias("class"))
        if due("type"):
            found.append((0, "inheritance", typed(delta).join(above(known), "mid").select(F.col("x").alias("src"), F.lit("type").alias("relation"), F.col("class").alias("dst"))))
        if due("subClassOf"):
            found.append((0, "inheritance", typed(known).join(above(delta), "mid").select(F.col("x").alias("src"), F.lit("type").alias("relation"), F.col("class").alias("dst"))))
        if self.typed and due(*(p for _, p, _ in self.typed)):
            e = delta.join(self._typed(), "relation").select(F.when(F.col("axiom_type") == "domain", F.col("src")).otherwise(F.col("dst")).alias("src"), F.lit("type").alias("relation"), F.col("class").alias("dst"))
            found.append((1, "domain_range", e))
        sym, inv = (set(self.sym), {p for p, _ in self.inverses}) if came is None else self.turned(came)
        if sym:
            e = delta.where(F.col("relation").isin(self.sym) & (F.col("rule") != "symmetric_closure"))
            found.append((2, "symmetric_closure", e.select(F.col("dst").alias("src"), "relation", F.col("src").alias("dst"))))
        if inv:
            e = delta.where(~((F.col("rule") == "inverse_propagation") & F.col("relation").isin(self.paired))).join(self._inverse(), "relation")
            found.append((3, "inverse_propagation", e.select(F.col("dst").alias("src"), F.col("q").alias("relation"), F.col("src").alias("dst"))))
        out = None
        for k, rule, rows in found:
            rows = rows.select(*KEYS, F.lit(k).alias("k"), F.lit(rule).alias("rule"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def derivable(self, asked: DataFrame, known: DataFrame) -> DataFrame:
        """Edges of asked that one rule says of edges of known."""
        chain = asked.where(F.col("relation").isin(self.closed)).where("src != dst").alias("a").join(known.where(F.col("relation").isin(self.closed)).alias("b"), (F.col("a.relation") == F.col("b.relation")) & (F.col("a.src") == F.col("b.src")))
        chain = chain.select(F.col("a.src").alias("src"), F.col("a.relation").alias("relation"), F.col("a.dst").alias("dst"), F.col("b.dst").alias("mid"))
        last = known.where(F.col("relation").isin(self.closed)).select(F.col("src").alias("mid"), "relation", "dst")
        out = chain.join(last, ["mid", "relation", "dst"], "left_semi").select(*KEYS)
        types = asked.where("relation = 'type'")
        own = types.alias("a").join(known.where("relation = 'type'").alias("b"), F.col("a.src") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("a.dst").alias("dst"), F.col("b.dst").alias("mid"))
        sup = known.where("relation = 'subClassOf'").select(F.col("src").alias("mid"), "dst")
        out = out.unionByName(own.join(sup, ["mid", "dst"], "left_semi").select("src", F.lit("type").alias("relation"), "dst"))
        if self.typed:
            ends = known.join(self._typed(), "relation").select(F.when(F.col("axiom_type") == "domain", F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("class").alias("dst"))
            out = out.unionByName(types.join(ends, ["src", "dst"], "left_semi").select(*KEYS))
        if self.sym:
            out = out.unionByName(asked.where(F.col("relation").isin(self.sym)).join(known.select(F.col("dst").alias("src"), "relation", F.col("src").alias("dst")), KEYS, "left_semi"))
        if self.inverses:
            back = known.join(self._inverse(), "relation").select(F.col("dst").alias("src"), F.col("q").alias("relation"), F.col("src").alias("dst"))
            out = out.unionByName(asked.join(back, KEYS, "left_semi"))
        return out.distinct()

    def rounds(self, delta: DataFrame, known: DataFrame, first: bool, max_rounds: int):
        """(iteration, rule, src, relation, dst) of what follows from delta (src, relation, dst, rule); known, closed but for delta, holds it. first: delta is all of known.

        A round closes relations under chains with an edge of delta, doubling them each time, then applies each other rule once, to edges
        of delta and of what the closing added; what that adds is the delta of the next round. Rules whose relations delta lacks don't run."""
        def by(rows):
            return {(r.rule, r.relation) for r in rows.select("rule", "relation").distinct().collect()}

        trace, came = None, by(delta)
        for i in range(1, max_rounds + 1):
            parts, now, lately = [], delta, delta
            if any(r in self.closed for _, r in came):
                rule = F.when(F.col("relation") == "subClassOf", "transitive_subsumption").otherwise("transitive_closure")
                if first and i == 1:
                    new = stored(_new(transitive_closure(known.where(F.col("relation").isin(self.closed))), known, self.closed).withColumn("rule", rule), "closed")
                    known, now = known.unionByName(new.select(*KEYS)), now.unionByName(new)
                    parts.append(new)
                while not (first and i == 1):
                    new = stored(_new(self.chained(lately, known), known, self.closed).withColumn("rule", rule), "closed")
                    if new.isEmpty():
                        break
                    known, now, lately = known.unionByName(new.select(*KEYS)), now.unionByName(new), new
                    parts.append(new)
                came = came | {("transitive_closure", r) for _, r in came if r in self.closed}
            found = self.step(now, known, came)
            if found is not None:
                best = found.groupBy(*KEYS).agg(F.min(F.struct("k", "rule")).alias("r")).select(*KEYS, F.col("r.rule").alias("rule"))
                delta = stored(best.join(known.where(F.col("relation").isin(sorted(self.writes(came)))).select(*KEYS), KEYS, "left_anti"), "inferred")
                known = known.unionByName(delta.select(*KEYS))
                parts.append(delta)
            for p in parts:
                rows = p.select(F.lit(i).alias("iteration"), "rule", *KEYS)
                trace = rows if trace is None else trace.unionByName(rows)
            came = set() if found is None else by(delta)
            if not self.reads({r for _, r in came}):
                break
        else:
            warnings.warn(f"inference ended after {max_rounds} rounds, before its fixpoint", RuntimeWarning, stacklevel=3)
        none = self.spark.createDataFrame([], "iteration int, rule string, src string, relation string, dst string")
        return none if trace is None else trace


def infer(edges: DataFrame, axioms: DataFrame, subject: str = "", detect: bool = False, max_rounds: int = fixed.MAX_ITERATIONS) -> DataFrame:
    """(iteration, rule, src, relation, dst): every edge that the rules add, with the rule and round that added it first.

    Semi-naive: after the first round a rule looks only at edges that the last round added, joined with all that is known where it takes
    two; see Rules.rounds. Rounds end when none adds an edge that a rule reads; an empty graph ends after one.
    """
    rules = Rules(axioms, *relation_sets(edges, axioms, subject, detect))
    known = stored(edges.select(*KEYS).distinct().sortWithinPartitions("relation"), "known")
    return rules.rounds(known.withColumn("rule", F.lit("")), known, True, max_rounds)


def reinfer(edges: DataFrame, inferred: DataFrame, added: DataFrame, removed: DataFrame, axioms: DataFrame, subject: str = "", max_rounds: int = fixed.MAX_ITERATIONS) -> tuple[DataFrame, DataFrame]:
    """Edges, and what the rules infer from them, after a change: the same rows as infer of the changed edges, by work in proportion to what the change touches.

    edges and inferred (src, relation, dst): as they were, inferred complete. removed edges go, then added ones come. Delete and rederive:
    edges that follow from a removed one, however indirectly, are taken out; those of them that still follow from what is left come
    back, and so on; then added edges start the rounds of infer. The axioms are the same before and after; where these or relations that
    are detected change, infer anew. Removing what isn't there, adding what is, and repeated rows change nothing. Both results are written.
    """
    base, rows = edges.select(*KEYS).distinct(), inferred.select(*KEYS).distinct()
    rules = Rules(axioms, *relation_sets(edges, axioms, subject))
    gone = stored(removed.select(*KEYS).distinct().join(base, KEYS, "left_semi"), "removed")
    more = added.select(*KEYS).distinct()
    after = stored(base.join(gone, KEYS, "left_anti").unionByName(more).distinct(), "edges")
    kept = stored(base.join(gone, KEYS, "left_anti"), "kept")
    old = stored(kept.unionByName(gone).unionByName(rows.join(base, KEYS, "left_anti")), "known")
    out, delta = gone, gone
    while not delta.isEmpty():
        # what follows from delta in one step, and has no edge of its own
        step = rules.step(delta.withColumn("rule", F.lit("")), old)
        every = rules.chained(delta, old).unionByName(step.select(*KEYS)).distinct()
        delta = stored(every.join(old, KEYS, "left_semi").join(kept, KEYS, "left_anti").join(out, KEYS, "left_anti"), "out")
        out = out.unionByName(delta)
    out = stored(out, "out")
    left = stored(old.join(out, KEYS, "left_anti"), "left")
    back = stored(rules.derivable(out, left), "back")
    while not back.isEmpty():
        left, out = left.unionByName(back), out.join(back, KEYS, "left_anti")
        step = rules.step(back.withColumn("rule", F.lit("")), left)
        every = rules.chained(back, left).unionByName(step.select(*KEYS)).distinct()
        back = stored(every.join(out, KEYS, "left_semi"), "back")
    new = stored(more.join(left, KEYS, "left_anti"), "new")
    if not new.isEmpty():
        left = stored(left.unionByName(new), "known")
        left = left.unionByName(rules.rounds(new.withColumn("rule", F.lit("")), left, False, max_rounds).select(*KEYS))
    return after, stored(left.join(after, KEYS, "left_anti"), "inferred")
