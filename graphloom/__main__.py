"""python -m graphloom repair ROOT KB_ID [--dry-run] [--iterations N]: repair a stored knowledge base."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("command", choices=["repair"])
    p.add_argument("root")
    p.add_argument("kb_id")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--iterations", type=int, default=1)
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators.repair import repair
    from .scratch import stored
    from .sources.kb import Catalog

    spark = SparkSession.builder.getOrCreate()
    kb = Catalog(spark, a.root)
    t = kb.load(a.kb_id)
    added = stored(repair(t["nodes"], t["edges"], t["axioms"], iterations=a.iterations), "added")
    for r in added.groupBy("step").agg(F.count("*").alias("n")).collect():
        print(f"{r.step}: {r.n}")
    if not a.dry_run:
        edges = stored(t["edges"].unionByName(added.drop("step"), allowMissingColumns=True), "edges")
        rest = {k: stored(v, k) for k, v in t.items() if k != "edges"}
        kb.save(a.kb_id, {**rest, "edges": edges}, merge=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
