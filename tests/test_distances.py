"""Hand-computed answers: zero vectors, NaN, ties, signed differences, weights."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from soundlattice.functions import vectors as V
from soundlattice.operators import distances as D
from soundlattice.operators import knn


def table(spark, rows):
    return spark.createDataFrame(rows, "id int, v array<double>, x double, y double")


def best(spark, rows, queries, **options):
    found = knn.best_distance(table(spark, rows), table(spark, queries), "id", **options)
    return {r["id"]: r["distance"] for r in found.collect()}


def test_cosine_of_vectors_puts_undefined_last(spark):
    rows = [(1, [1.0, 0.0], 0.0, 0.0), (2, [-1.0, 0.0], 0.0, 0.0), (3, [0.0, 0.0], 0.0, 0.0), (4, [float("nan"), 1.0], 0.0, 0.0), (5, None, 0.0, 0.0)]
    query = [(1, [1.0, 0.0], 0.0, 0.0)]
    got = best(spark, rows, query, dim={"v": 5.0})
    assert got == {1: 0.0, 2: 10.0, 3: math.inf, 4: math.inf, 5: math.inf}
    top = knn.knn_topk(table(spark, rows), table(spark, query), "id", 3, dim={"v": 5.0}).collect()
    assert [r["id"] for r in top] == [1, 2, 3]


def test_undefined_pairs_don_t_hide_defined_ones(spark):
    rows = [(1, [1.0, 0.0], 0.0, 0.0)]
    queries = [(1, [0.0, 0.0], 0.0, 0.0), (2, [0.0, 1.0], 0.0, 0.0)]
    assert best(spark, rows, queries, dim={"v": 2.0}) == {1: pytest.approx(2.0)}


def test_no_queries_give_infinity(spark):
    assert best(spark, [(1, [1.0], 0.0, 0.0)], [], dim={"v": 1.0}) == {1: math.inf}


def test_numeric_distances(spark):
    rows, query = [(1, [0.0], 2.0, 1.0)], [(1, [0.0], 0.0, 1.0)]
    numeric = lambda d, w: best(spark, rows, query, num=w, numeric=d)[1]
    assert numeric(D.manhattan_signed, {"x": 3.0}) == -6.0
    assert numeric(D.manhattan, {"x": 3.0}) == 6.0
    assert numeric(D.euclidean, {"x": 3.0}) == pytest.approx(math.sqrt(12))
    assert numeric(D.minkowski(3), {"x": 3.0}) == math.inf  # a negative sum has no real root here
    assert numeric(D.cosine_num, {"x": 1.0, "y": 1.0}) == numeric(D.cosine_num, {"x": 9.0, "y": 0.1})
    assert best(spark, rows, query, numeric=None, dimensional=None) == {1: 0.0}


def test_many_passes_equal_one(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist(), float(i), 0.0) for i in range(40)]
    whole = best(spark, rows, rows[:9], dim={"v": 1.0}, num={"x": 0.1})
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 300)
    assert best(spark, rows, rows[:9], dim={"v": 1.0}, num={"x": 0.1}) == pytest.approx(whole)
    pairs = knn.cross_score(table(spark, rows), table(spark, rows[:9]), "id", dim={"v": 1.0}, num={"x": 0.1})
    assert pairs.count() == 360 and {r["id"]: r["d"] for r in pairs.groupBy("id").min("distance").withColumnRenamed("min(distance)", "d").collect()} == pytest.approx(whole)
    again = knn.best_distance(table(spark, [*rows, rows[0]]), table(spark, rows[:9]), "id", dim={"v": 1.0})
    assert again.count() == 41  # repeated ids keep a row each


def test_options_of_the_pipeline(spark):
    rows = [(1, [0.0, 4.0], 1.0, 0.0), (2, [2.0, 0.0], 3.0, 0.0), (2, [4.0, 0.0], 5.0, 0.0), (3, [9.0, 9.0], 9.0, 0.0)]
    query = [(8, [2.0, 0.0], 3.0, 0.0), (8, [4.0, 0.0], 5.0, 0.0)]
    run = lambda **o: [(r["id"], r["distance"]) for r in knn.knn_topk(table(spark, rows), table(spark, query), "id", 10, **o).collect()]
    assert run(num={"x": 1.0}, pool_order=["x"])[0] == (2, 0.0) and len(run(num={"x": 1.0}, pool_order=["x"])) == 3
    assert run(dim={"v": 1.0}, expand=True, dimensional=None)[0][1] == 0.0 and run(dim={"v": 1.0}, expand=True, dimensional=None)[-1] == (3, pytest.approx(106**0.5))
    assert run(dim={"v": 1.0}, normalize_dimensional="zscore", dimensional=D.euclidean_dim)[0][1] == pytest.approx(0)
    halved = lambda data, columns, other: [df.withColumns({c: F.col(c) / 2 for c in columns}) for df in (data, other)]
    assert run(num={"x": 1.0}, normalize=halved)[-1] == (3, 2.0)
    with pytest.raises(ValueError):
        run(dim={"v": 1.0}, expand=True, normalize_dimensional="zscore")
    with pytest.raises(ValueError):
        run(num={"x": 1.0}, normalize="unknown")


def test_length_mismatch_fails(spark):
    with pytest.raises(Exception, match="differ in length"):
        best(spark, [(1, [1.0], 0.0, 0.0)], [(1, [1.0, 2.0], 0.0, 0.0)], dim={"v": 1.0})


def test_zscore_scales_both_sides_by_the_dataset(spark):
    data, query = knn.zscore(table(spark, [(1, [], 1.0, 5.0), (2, [], 3.0, 5.0)]), ["x", "y"], table(spark, [(9, [], 5.0, 6.0)]))
    assert sorted((r["x"], r["y"]) for r in data.collect()) == [(-1.0, 0.0), (1.0, 0.0)]
    assert query.first()["x"] == 3.0 and query.first()["y"] == 1.0


def test_config_conflict():
    with pytest.raises(ValueError):
        knn.check_config(expand=True, normalize_dimensional=True)
    knn.check_config(True, False)


def test_parse_and_sort(spark):
    row = spark.range(1).select(V.parse(F.lit("[0.1, 2e-05, -3.0]")).alias("a"), V.parse(F.lit("[1.0, nan]")).alias("b"), V.argsort(F.array(*map(F.lit, [3.0, 1.0, 1.0]))).alias("c"), V.clip(F.lit(None).cast("double"), -1, 1).alias("d")).first()
    assert row["a"] == [0.1, 2e-05, -3.0] and row["b"] is None and row["c"] == [1, 2, 0] and row["d"] is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=3, max_size=3), st.lists(st.floats(-5, 5), min_size=3, max_size=3))
def test_against_numpy(spark, a, b):
    rows, query = [(1, a, a[0], a[1])], [(1, b, b[0], b[1])]
    gap = best(spark, rows, query, dim={"v": 2.0}, dimensional=D.euclidean_dim)[1]
    assert gap == pytest.approx(2 * np.linalg.norm(np.subtract(a, b)), abs=1e-9)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    cosine = best(spark, rows, query, dim={"v": 2.0})[1]
    assert cosine == math.inf if n == 0 else cosine == pytest.approx(2 * (1 - np.clip(np.dot(a, b) / n, -1, 1)), abs=1e-6)


def mixed(n, seed):
    """Rows with copies, near copies, zero, null, NaN and tiny vectors."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8).tolist(), float(rng.integers(0, 5)), None) for i in range(n)]
    odd = [[0.0] * 8, None, [float("nan")] * 8, [None, *[1.0] * 7], [1e-170] * 8, [1e-120, *[0.0] * 7], [1e160] * 8]
    copies = [(n + k, rows[k][1], 1.0, None) for k in range(5)] + [(n + 5 + k, [x * (1 + 1e-15 * k) for x in rows[k][1]], 1.0, None) for k in range(5)]
    return rows + copies + [(n + 20 + k, v, 1.0, None) for k, v in enumerate(odd)] + [(n + 30, rows[0][1], None, None)]


def by_columns(spark, rows, queries, numeric, dimensional):
    """Every pair by the distances' columns: {(id, query): distance}."""
    q = table(spark, queries).select(F.struct("id", "v", "x", V.norm(F.col("v")).alias("v__norm")).alias("q"))
    c = table(spark, rows).withColumn("v__norm", V.norm(F.col("v"))).crossJoin(F.broadcast(q))
    of = knn.pair_distance({"x": 0.5}, {"v": 2.0}, numeric, dimensional)
    return {(r["id"], r["o"]): r["d"] for r in c.select("id", F.col("q.id").alias("o"), of(F.col("q")).alias("d")).collect()}


@pytest.mark.parametrize("numeric", [None, D.euclidean, D.manhattan_signed, D.manhattan, D.minkowski(4)])
@pytest.mark.parametrize("dimensional", [D.cosine_dim, D.euclidean_dim])
def test_blocks_equal_columns(spark, monkeypatch, numeric, dimensional):
    monkeypatch.setattr(knn, "SPREAD_QUERIES", 20)
    rows = mixed(60, 3)
    queries = rows[::2]
    want = by_columns(spark, rows, queries, numeric, dimensional)
    options = {"num": {"x": 0.5}, "dim": {"v": 2.0}, "numeric": numeric, "dimensional": dimensional}
    for digits in (None, 6):
        got = {(r["id"], r["query_id"]): r["distance"] for r in knn.cross_score(table(spark, rows), table(spark, queries), "id", digits=digits, **options).collect()}
        assert got.keys() == want.keys()
        for k, d in got.items():
            assert (d is None) == (want[k] is None) and (d is None or d == pytest.approx(want[k], rel=1e-12, abs=1e-6 if digits else 1e-7)), k
    found = best(spark, rows, queries, **options)
    for i, d in found.items():
        own = [x for (k, _), x in want.items() if k == i and x is not None]
        assert d == (pytest.approx(min(own), rel=1e-12, abs=1e-7) if own else math.inf)


def test_vectors_are_scored_in_blocks_over_all_cores(spark, monkeypatch, capsys):
    monkeypatch.setattr(knn, "SPREAD_QUERIES", 20)
    rows = table(spark, mixed(60, 4)).coalesce(1)
    for df in (knn.best_distance(rows, rows, "id", dim={"v": 1.0}), knn.cross_score(rows, rows, "id", dim={"v": 1.0}, dimensional=D.euclidean_dim, digits=6)):
        df.explain()
        plan = capsys.readouterr().out
        assert "MapInArrow" in plan and "lambda" not in plan and df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_rounds_as_sql(spark):
    from soundlattice.operators.scoring import round_half_away

    assert round_half_away(np.array([0.5, -0.5, 1.5, 2.5, 0.49999999999999994, np.inf, 1e300]), 0).tolist() == [1.0, -1.0, 2.0, 3.0, 0.0, np.inf, 1e300]
