"""Every registered query outside the language-model package against its SQL in DuckDB."""

import math

import duckdb
import numpy as np
import pytest

from soundlattice.functions.ordering import grade_up, heap
from soundlattice.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.item() if hasattr(v, "item") else v


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert table(df.collect(), df.columns) == table(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_top_n_neither_sorts_nor_shuffles_the_dataset(spark, sf, capsys):
    QUERIES["knn_topk"](spark, sf).explain()
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "Exchange hashpartitioning(vec_id" not in plan


def test_sort_distance_is_in_its_sql_s_order(spark, sf, duck, capsys):
    df = QUERIES["sort_distance"](spark, sf)
    assert [tuple(r) for r in df.collect()] == duck.execute(SQL["sort_distance"]).fetchall()
    df.explain()
    assert "MapInArrow" not in capsys.readouterr().out  # scored once, not again for the sort's sample


@pytest.mark.parametrize("name", ["arr_argsort", "sort_pairs"])
def test_equal_elements_are_ordered_as_in_sql(spark, tmp_path, name):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(0, (2, 5, 60, 1000)[i % 4], 64).astype(float).tolist()) for i in range(80)]
    rows += [(80, [0.0, -0.0] * 32), (81, sorted(rows[2][1])), (82, sorted(rows[2][1], reverse=True)), (83, [float(i // 3) if i % 2 else 9.0 for i in range(64)])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert dict(QUERIES[name](spark, str(tmp_path)).collect()) == dict(con.execute(SQL[name]).fetchall())


def test_order_of_equals_by_length():
    con = duckdb.connect()
    rng = np.random.default_rng(3)
    for n in (0, 1, 23, 24, 63, 127):
        for values in (2, 7, 90):
            row = rng.integers(0, values, n).astype(float).tolist()
            assert grade_up(row) == [i - 1 for i in con.execute("SELECT list_grade_up(?::DOUBLE[])", [row]).fetchone()[0]]
    for n in (24, 100):  # what bad partitions fall back to is still a sort
        row = rng.integers(0, 9, n).tolist()
        order = list(range(n))
        heap(row, order, 0, n)
        assert sorted(order) == list(range(n)) and [row[i] for i in order] == sorted(row)
