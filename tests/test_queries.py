import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__
from gantline import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return str(v)[:10] if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_agrees_with_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in queries.ORACLE_SQL:
        assert len(got) > 0
        return
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[n]) for n in order) for r in got), key=str) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def union_find(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in list(root)}


def test_whole_components_agree_with_union_find(spark, duck):
    edges = duck.execute("SELECT 'c' || o_custkey, 'p' || l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey").fetchall()
    got = queries.QUERIES["family_components"](spark, SF).collect()
    want = union_find(edges)
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want


def test_whole_components_of_hubs_chains_and_islands(spark, tmp_path):
    pairs = [(1, p) for p in range(1000, 1500)] + [(c, 1498 + c - i) for c in range(2, 200) for i in (0, 1)]  # a hot customer, and a chain off one of its parts
    pairs += [(c, 7000 + c // 3) for c in range(300, 400)] + [(c, 9000) for c in range(400, 700)]  # islands, and a hot part
    spark.createDataFrame([(i, c) for i, (c, _) in enumerate(pairs)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i, p, 1.0, 0.0) for i, (_, p) in enumerate(pairs)], "l_orderkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = queries.QUERIES["family_components"](spark, str(tmp_path)).collect()
    want = union_find([(f"c{c}", f"p{p}") for c, p in pairs])
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want and len(set(want.values())) == 36
