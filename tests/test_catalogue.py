"""Every query with SQL gives DuckDB's rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.operators import rows
from graphloom.plans import catalogue, fixpoint

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents"


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(catalogue.ORACLE[name])
    cols = [c[0] for c in want.description]
    got = catalogue.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(cols)
    order = lambda rows: sorted(rows, key=str)
    assert order(map(tuple, got.select(*cols).collect())) == order(want.fetchall())


def test_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        fixpoint.resolve(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "k long, nxt long"), 3)


def test_whole_tables(spark):
    """The graph queries cover every edge: brute force over the tables."""
    edges = {(2 * r.l_suppkey, 2 * r.l_partkey + 1) for r in spark.read.parquet(f"{DIR}/lineitem.parquet").select("l_suppkey", "l_partkey").collect()}
    low = {x: x for e in edges for x in e}
    while any(low[a] != low[b] for a, b in edges):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.k: r.component for r in catalogue.QUERIES["components"](spark, DIR).collect()}
    assert got == low
    assert {r.bucket for r in catalogue.QUERIES["bucket_primary"](spark, DIR).collect()} == set(low.values())
    rows = [(k,) for k in range(1000)]
    deps = {0: {0}}
    for k in range(1, 1000):
        deps[k] = {k // 2, k // 3} | deps[k // 2] | deps[k // 3]
    part = spark.createDataFrame(rows, "p_partkey long")
    assert {tuple(r) for r in catalogue.closure(part).collect()} == {(k, d) for k in deps for d in deps[k]}


def test_closure_of_cycles(spark):
    """Random graphs with cycles and edges of a node to itself: pairs and mutual pairs are those of plain search."""
    rng = random.Random(5)
    for n, m in ((6, 9), (12, 14), (1, 1)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        want = set(edges)
        while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
            want |= more
        got, mutual = rows.closure(spark.createDataFrame(sorted(edges), "src long, dst long"))
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert {tuple(r) for r in mutual.collect()} == {(a, b) for a, b in want if (b, a) in want}


def test_closure_joins_with_edges_only(spark):
    """A chain of n nodes has n * n / 2 pairs; joining pairs with pairs gives their cube."""
    chain = spark.range(150).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    rounds = []
    old, rows.cut = rows.cut, lambda df: rounds.append(out := old(df)) or out
    try:
        assert rows.closure(chain.where("src < 40"))[0].count() == 40 * 41 // 2
    finally:
        rows.cut = old
    # each round's table holds pairs of one length, no pair twice
    assert sum(r.count() for r in rounds) == 40 + 2 * 40 * 41 // 2


def test_components_of_a_long_path(spark):
    """A path in random order, a star, a node with itself, and a pair with a null."""
    rng = random.Random(7)
    names = rng.sample(range(1000, 10_000), 400)
    edges = [*zip(names, names[1:]), *((5, k) for k in range(20_000, 20_050)), (7, 7), (None, 8), (9, None), (5, 5)]
    rounds = []
    old, fixpoint.cut = fixpoint.cut, lambda df: rounds.append(out := old(df)) or out
    try:
        got = {r.k: r.component for r in fixpoint.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    finally:
        fixpoint.cut = old
    assert got == {k: min(names) for k in names} | {k: 5 for k in (5, *range(20_000, 20_050))} | {7: 7}
    assert sum(r.count() for r in rounds if r.columns == ["a", "b"]) < 4 * len(edges)  # all rounds' edges


def test_rounds_follow_the_walks(spark):
    """2,048 rows in cycles of two with tails of up to three: as many rounds as for eight rows, and the cycles' least nodes."""

    def run(n):
        tables = []
        old, fixpoint.cut = fixpoint.cut, lambda df: tables.append(1) or old(df)
        try:
            at = F.col("id") % 8
            nodes = spark.range(n).select(F.col("id").alias("k"), F.when(at == 7, F.col("id") - 1).when(at == 6, F.col("id") + 1).when(at == 5, F.col("id") + 1).when(at == 0, F.lit(None)).otherwise(F.col("id") + 1).alias("nxt"))
            return {r.k: (r.root, r.cycle) for r in fixpoint.resolve_rows(nodes).collect()}, len(tables)
        finally:
            fixpoint.cut = old

    (few, rounds), (many, more) = run(8), run(2048)
    assert rounds == more
    assert many == {k: (k, None) if k % 8 == 0 else (None, k - k % 8 + 6) for k in range(2048)}
    assert few == {k: many[k] for k in range(8)}
