"""Clustering against a plain loop over whole numbers, ties and odd rows included; bounds never lose a nearest centre."""

import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import cluster

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"
NAN, INF = float("nan"), float("inf")


def plain(rows, k=8, rounds=10, dims=64):
    kept = []
    for key, e, *_ in rows:
        if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e):
            kept.append((key, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in e]))
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centres = [v for _, v in start]
    near = lambda v: min(range(len(centres)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, centres[c])), c))
    for _ in range(rounds):
        of = [near(v) for _, v in kept]
        for c in range(len(centres)):
            if mine := [v for (_, v), o in zip(kept, of) if o == c]:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    of = [near(v) for _, v in kept]
    d = [sum((a - b) ** 2 for a, b in zip(v, centres[o])) for (_, v), o in zip(kept, of)]
    total = {c: sum(x for x, o in zip(d, of) if o == c) for c in of}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(key, o, x, total[o], sum(d), digest[o]) for (key, _), o, x in zip(kept, of, d)]


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    steps = lambda n: (rng.integers(-3, 3, (n, 64)) / 4).astype(np.float32).tolist()
    rows = [(i, v, i % 3, "x") for i, v in enumerate(steps(60))]
    rows += [(7, rows[3][1], None, None), (7, rows[3][1], 1, "x"), (None, rows[5][1], 1, "x"), (None, steps(1)[0], 1, "x")]
    rows += [(100, None, 1, "x"), (101, [], 1, "x"), (102, [0.5] * 63, 1, "x"), (103, [NAN] + [0.0] * 63, 1, "x"), (104, [INF] + [0.0] * 63, 1, "x"), (105, [None] + [0.0] * 63, 1, "x")]
    rows += [(200 + i, [0.0] * 64, 1, "x") for i in range(30)] + [(2**60 + 1, [30_000.25] + [-1e-9] * 63, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in cluster.op12_cluster(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    few = spark.createDataFrame(rows[:3], SCHEMA)
    assert {r.cluster for r in cluster.clusters(few)[0].collect()} == {0, 1, 2}
    assert cluster.clusters(df.where("vec_id between 100 and 105"))[0].count() == 0
    with pytest.raises(Exception, match="a component times 1024"):
        cluster.clusters(spark.createDataFrame([(1, [1e9] * 64, 1, "x")], SCHEMA))[0].collect()


def test_tables(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{at}/embeddings.parquet')")
    want = sorted(con.execute(cluster.SQL).fetchall())
    assert sorted(tuple(r) for r in cluster.op12_cluster(spark, at).collect()) == want
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    assert sorted(plain(rows)) == want
    skipped = cluster.clusters(spark.read.parquet(f"{at}/embeddings.parquet"))[3]
    assert len(skipped) == 11 and max(skipped) > 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.sampled_from([2, 9, 1 << 20, cluster.MOST - 1]))
def test_bounds_lose_no_nearest(seed, k, most):
    """Several rounds with random moves: the cluster is the nearest centre, the smaller of equals, whatever was skipped."""
    rng = np.random.default_rng(seed)
    x, centres = rng.integers(-most, most, (40, 3)), rng.integers(-most, most, (k, 3))
    of, u, low = np.zeros(40, np.int16), np.full(40, np.inf, np.float32), np.zeros((40, k), np.float32)
    for _ in range(6):
        cluster.assign(x, centres, of, u, low)
        d = np.stack([cluster.squares(x, c) for c in centres], axis=1)
        assert (of == d.argmin(axis=1)).all()
        assert (u.astype(np.float64) ** 2 >= d[np.arange(40), of] * (1 - 1e-15)).all() and (low.astype(np.float64) ** 2 <= d * (1 + 1e-15)).all()
        new = centres + rng.integers(-max(1, most // 50), max(1, most // 50) + 1, centres.shape) * rng.integers(0, 2, (k, 1))
        new = np.clip(new, -most, most)
        u, low = cluster.shifted(u, low, of, cluster.squares(new, centres))
        centres = new
