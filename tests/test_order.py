"""Means whose sums don't depend on how rows are dealt."""

from pyspark.sql import functions as F

from graphloom.operators import evaluate


def test_means_are_summed_in_order(spark):
    """Doubles are added up in the given order, whatever task they come from; a null counts as in avg, a key of nulls has none."""
    v = [0.1, 0.2, 0.3, 1e16, 1.0, -1e16, None, 0.7] * 40
    rows = [(i % 3, i, x, i % 2) for i, x in enumerate(v)] + [(9, 10_000, None, 0)]
    want = {}
    for k, _, x, _ in rows:
        s, n = want.get(k, (0.0, 0))
        want[k] = (s, n) if x is None else (s + x, n + 1)
    df = spark.createDataFrame(rows, "kb long, seq long, value double, facts int")
    for dealt in (df.coalesce(1), df.repartition(7, "seq").orderBy(F.desc("seq"))):
        got = {r.kb: r for r in evaluate.means(dealt, "kb", ["value"], ["seq"]).collect()}
        assert {k: r.value for k, r in got.items()} == {k: s / n if n else None for k, (s, n) in want.items()}
        assert got[9].n == 1 and got[9].failures == 1 and sum(r.n for r in got.values()) == len(rows)


def test_evaluation_of_odd_events_has_the_rows_of_its_sql(spark, tmp_path):
    """A null user is a row, a null type neither a failure nor covered, and shares are rounded as the SQL does: 41 of 640 are 64,063 millionths."""
    import duckdb

    from graphloom.plans import registry

    rows, found, total, i = [], 0, 0, 0
    while found < 41 or total < 640:  # events of one user with 41 found of 640
        f, t = i % 3, max(i % 5, 1)
        if (f == 1 and found < 41 or f == 0) and total + t <= 640:
            rows.append((i, 7, "view" if i % 4 else "purchase", i / 100))
            found, total = found + f, total + t
        i += 1
    assert (found, total) == (41, 640)
    n = i
    rows += [(n + 1, None, "view", 1.25), (n + 2, None, "purchase", None), (n + 3, 8, None, 2.5), (n + 4, 8, "view", None), (n + 5, 9, None, None)]
    rows += [(n + 10 + j, 10, "purchase" if j >= 41 else "click", 0.1) for j in range(640)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"SET threads = 1; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = registry.queries()["a16_evaluation"](spark, str(tmp_path))
    want = con.sql(registry.oracle_sql()["a16_evaluation"])
    assert got.columns == want.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
