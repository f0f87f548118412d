"""Vector links against all pairs."""

import numpy as np

from graphloom.llm import embedding

V = "vec_id long, embedding array<float>, label int, n int"


def brute(rows):
    ids = [r[0] for r in rows]
    good = [i for i, r in enumerate(rows) if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    links, root = {i: 0 for i in ids}, {i: i for i in ids}
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.float32(rows[a][1]).astype(float), np.float32(rows[b][1]).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[ids[a]] += 1
                    links[ids[b]] += 1
                    p, q = root[ids[a]], root[ids[b]]
                    root = {k: min(p, q) if r in (p, q) else r for k, r in root.items()}
    return links, root


def test_links(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(40):
        base = rng.normal(size=64)
        for _ in range(1 + 14 * (g % 5 == 0)):
            rows.append((len(rows), (base + rng.normal(size=64) * rng.choice([0, 0.05, 0.1])).tolist(), int(g % 3), 7))
    odd = [None, [], [0.0] * 64, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] * 64]
    rows += [(1000 + i, e, 1, None) for i, e in enumerate(odd)] + [(2000, rows[0][1], None, 1)]
    for chunk in (512, 5):
        monkeypatch.setattr(embedding, "CHUNK", chunk)
        got = {r.vec_id: r for r in embedding.near_vectors(spark.createDataFrame(rows, V)).collect()}
        links, root = brute(rows)
        assert len(got) == len(rows)
        assert sum(r.n_links for r in got.values()) >= 0.97 * sum(links.values())
        assert all(r.n_links <= links[i] for i, r in got.items())
        assert [r.component_id for r in got.values()] == [root[i] for i in got]
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embedding.near_vectors(spark.createDataFrame([], V)).count() == 0


def test_few_dimensions_miss_nothing(spark, monkeypatch):
    """One to three dimensions beside eight, in one table: every link is found, also in blocks of chunks."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=[1, 2, 3, 3, 8][i % 5]).tolist(), int(i % 3 == 0), 0) for i in range(500)]
    rows += [(1000 + i, [1.0, x, 0.0][: 2 + i % 2], 1, 0) for i, x in enumerate([0.2, 0.2, -0.2, 0.0, 0.0, 1e-9, 5.0, 5.0])]
    links, root = brute(rows)
    for chunk in (512, 7):
        monkeypatch.setattr(embedding, "CHUNK", chunk)
        got = {r.vec_id: r for r in embedding.near_vectors(spark.createDataFrame(rows, V)).collect()}
        few = [r[0] for r in rows if len(r[1]) < 4]
        assert [(got[i].n_links, got[i].component_id) for i in few] == [(links[i], root[i]) for i in few]
    flat = [r for r in rows if len(r[1]) == 2]
    assert {r.vec_id: r.n_links for r in embedding.near_vectors(spark.createDataFrame(flat, V)).collect()} == {r[0]: brute(flat)[0][r[0]] for r in flat}


def test_recall_by_dimension():
    """Pairs at cosine 0.9805 that meet in some table, for each number of dimensions that is hashed from few on."""
    rng = np.random.default_rng(9)
    for dim in (4, 5, 6, 7, 8, 16):
        vertices, tables = embedding.shape(600, dim)
        a = rng.normal(size=(600, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.normal(size=(600, dim))
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = 0.9805 * a + np.sqrt(1 - 0.9805**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        (ha, pa), (hb, pb) = embedding.codes(a, vertices, tables), embedding.codes(b, vertices, tables)
        assert ((ha == hb) | (pa == hb) | (ha == pb)).any(axis=1).mean() >= 0.95, dim
