"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, verified."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, table

FEWEST = 3  # vertices of a bucket
ROOM = 16  # buckets there are for each vector, at least
CHUNK = 512  # members of a bucket that one block takes of one side
STEP = 1 << 15  # pairs that are compared at once
FLAT = 3  # dimensions up to which cells of a grid stand for hashed buckets
NO_BUCKET = -(1 << 63)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, three butterfly levels a pass; their length is a power of two."""
    n, d = x.shape
    left, two = d, np.array([[1.0, 1.0], [1.0, -1.0]], dtype=x.dtype)
    while left > 1:
        r = min(8, left)
        h = np.ones((1, 1), dtype=x.dtype)
        while len(h) < r:
            h = np.kron(h, two)
        x = (np.ascontiguousarray(x.reshape(n, r, d // r).transpose(0, 2, 1)).reshape(-1, r) @ h).reshape(n, d)
        left //= r
    return x / np.sqrt(x.dtype.type(d))


def shape(n: int, dim: int) -> tuple[int, int]:
    """(vertices a bucket, tables) for n vectors: the buckets outgrow the vectors, and more tables hold the recall."""
    sides, k = 2 << max(3, (dim - 1).bit_length()), FEWEST
    while sides**k < ROOM * n:
        k += 1
    return k, 4 * k - 2


def codes(unit: np.ndarray, vertices: int = FEWEST, tables: int = 10, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(home, probe) bucket of each row in each table: `vertices` cross-polytope vertices a bucket.

    The probe takes the next nearest vertex where the nearest one is the least certain.
    """
    d = 1 << max(3, (unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), d), dtype=np.float32)
    x[:, : unit.shape[1]] = unit
    rng, rows = np.random.default_rng(seed), np.arange(len(unit))
    home, probe = np.zeros((2, len(unit), tables), dtype=np.int64)
    for t in range(tables):
        best, other, gap = np.zeros((3, vertices, len(unit)))
        for k in range(vertices):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d).astype(np.float32))
            size = np.abs(y)
            a = size.argmax(axis=1)
            top = size[rows, a].copy()
            size[rows, a] = -1
            b = size.argmax(axis=1)
            best[k], other[k], gap[k] = 2 * a + (y[rows, a] < 0), 2 * b + (y[rows, b] < 0), top - size[rows, b]
        weak = gap.argmin(axis=0)
        for k in range(vertices):  # wraps around where there are many vertices; chance meetings are verified anyway
            home[:, t] = home[:, t] * (2 * d + 1) + best[k].astype(np.int64)
            probe[:, t] = probe[:, t] * (2 * d + 1) + np.where(weak == k, other[k], best[k]).astype(np.int64)
    return home, probe


def cells(unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, probe) cell of each row in a grid as wide as linked vectors can lie apart; a table for each neighbour in half of the directions.

    So a linked pair shares a cell or one of the two probes the other's, and none is missed.
    """
    width = max(np.sqrt(max(2 - 2 * least, 0.0)) * 1.001, 2.0**-18)
    dim = unit.shape[1]
    sides = [o for o in itertools.product((-1, 0, 1), repeat=dim) if o > (0,) * dim]
    at = np.floor(unit / width).astype(np.int64) + (1 << 19)
    key = lambda c: c @ (np.int64(1) << (20 * np.arange(dim, dtype=np.int64)))
    return np.repeat(key(at)[:, None], len(sides), axis=1), np.stack([key(at + np.array(o)) for o in sides], axis=1)


def _pairs(first: np.ndarray, last: np.ndarray, chunk: np.ndarray, cross: np.ndarray):
    """Row numbers (x, y), x < y, of the pairs of each group [first, last), about STEP at a time; of cross groups, pairs of two chunks."""
    n = last - first
    left = np.repeat(last, n) - np.arange(n.sum()) - 1 if len(n) and first[0] == 0 and (first[1:] == last[:-1]).all() else None
    if left is None:
        raise ValueError("groups must follow one another")
    done = np.concatenate([[0], np.cumsum(left)])
    across = np.repeat(cross, n)
    at = 0
    while at < len(left):
        end = max(at + 1, int(np.searchsorted(done, done[at] + STEP, side="right")) - 1)
        x = np.repeat(np.arange(at, end), left[at:end])
        y = x + 1 + np.arange(len(x)) - np.repeat(done[at:end] - done[at], left[at:end])
        keep = (chunk[x] != chunk[y]) | ~across[x]
        yield x[keep], y[keep]
        at = end


def _compared(g: pd.DataFrame, least: float) -> pd.DataFrame | None:
    """Links of the rows' groups that no earlier table and no other group has, as counts of each row, and the least row linked."""
    t, key, ca, cb, chunk = (g[c].to_numpy() for c in ("t", "key", "ca", "cb", "chunk"))
    label, rep, own, n = g["label"].to_numpy(), g["rep"].to_numpy(), g["is_home"].to_numpy(), g["n"].to_numpy()
    new = np.ones(len(g) + 1, dtype=bool)
    new[1:-1] = (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1]) | (label[1:] != label[:-1])
    edge = np.flatnonzero(new)
    first, last = edge[:-1], edge[1:]
    home, probe = np.stack(g["home"].to_numpy()), np.stack(g["probe"].to_numpy())
    size = np.array([len(u) for u in g["unit"]])
    flat, start = np.concatenate(g["unit"].to_numpy()), np.cumsum(size) - size
    links, ex, ey = np.zeros(len(g), dtype=np.int64), [], []
    for x, y in _pairs(first, last, chunk, (ca != cb)[first]):
        ok = (own[x] | own[y]) & (rep[x] != rep[y])
        x, y = x[ok], y[ok]
        swap = ~own[x]
        x, y = np.where(swap, y, x), np.where(swap, x, y)  # x is at home
        at = t[x]
        # a pair that probes each other's home counts where the smaller id probes
        ok = own[y] | ~((probe[x, at] == home[y, at]) & (rep[y] > rep[x]))
        for s in range(int(at.max()) if len(at) else 0):
            ok &= (s >= at) | ~((home[x, s] == home[y, s]) | (probe[x, s] == home[y, s]) | (home[x, s] == probe[y, s]))
        x, y = x[ok], y[ok]
        for d in np.unique(size[x]):  # vectors of one group have one length
            of = np.flatnonzero(size[x] == d)
            a, b = x[of], y[of]
            span = np.arange(d)
            hit = np.einsum("ij,ij->i", flat[start[a][:, None] + span], flat[start[b][:, None] + span]) >= least
            a, b = a[hit], b[hit]
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
            ex.append(a)
            ey.append(b)
    if not ex or not (links > 0).any():
        return None
    x, y, low = np.concatenate(ex), np.concatenate(ey), rep.copy()
    while True:  # smallest id over the links found here, until it settles
        before = low.copy()
        np.minimum.at(low, x, low[y])
        np.minimum.at(low, y, low[x])
        if (before == low).all():
            break
    got = links > 0
    return pd.DataFrame({"rep": rep[got], "links": links[got], "low": low[got]})


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Links are pairs of one label, cosine >= least in double precision, that share a bucket (home or
    probe) of some table. Rows whose vector or label is null, whose vector is empty, zero or holds a null or
    non-finite component have no link. Equal vectors of a label are one member with a count. Buckets grow in
    number with the vectors, and so do the tables. Large buckets are compared in blocks of two chunks, which give
    counts and a spanning forest, not pairs. Rows with one vec_id count as one vector; if their vectors or labels
    differ, each is compared. Vectors of at most three dimensions are met in cells of a grid, which misses no link. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.col("label").isNotNull() & F.col("e").isNotNull() & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("e", lambda x: x != 0)
    good = cut(rows.where(fine))
    one = cut(good.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    total = one.agg(F.count("*").alias("n"), F.min(F.when(F.size("e") > FLAT, F.size("e"))).alias("d"), F.max(F.when(F.size("e") <= FLAT, F.size("e"))).alias("flat")).first()
    vertices, hashes = shape(total["n"], total["d"] or 1)
    tables = max(hashes if total["d"] or not total["n"] else 0, (3 ** (total["flat"] or 0) - 1) // 2, 1)

    def filled(x: np.ndarray) -> list[np.ndarray]:
        return list(np.pad(x, ((0, 0), (0, tables - x.shape[1])), constant_values=NO_BUCKET))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, part in b.groupby(b["e"].map(len)):
                x = np.stack(part["e"].to_numpy())
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                home, probe = cells(x, least) if d <= FLAT else codes(x, vertices, hashes)
                yield pd.DataFrame({"label": part["label"] + f"/{d}", "rep": part["rep"], "n": part["n"], "unit": list(x), "home": filled(home), "probe": filled(probe)})

    coded = cut(one.mapInPandas(hashed, "label string, rep long, n long, unit array<double>, home array<long>, probe array<long>"))
    place = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.array(
        F.struct(t.alias("t"), F.get("home", t).alias("key"), F.lit(True).alias("is_home")), F.struct(t.alias("t"), F.get("probe", t).alias("key"), F.lit(False).alias("is_home"))))))
    placed = coded.select("label", "rep", place.alias("p")).select("label", "rep", "p.*").where(F.col("key") != NO_BUCKET)
    sizes = placed.groupBy("label", "t", "key").agg(F.count("*").alias("m"), F.max("is_home").alias("any")).where("m > 1 and any").withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int")).select("label", "t", "key", "chunks")
    dealt = placed.join(sizes, ["label", "t", "key"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks").cast("int"))
    other = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    other = other.select("label", "t", "key", "rep", "is_home", "chunk", F.least("chunk", "o").alias("ca"), F.greatest("chunk", "o").alias("cb"))
    full = other.join(coded.drop("label"), "rep")
    group = ["label", "t", "key", "ca", "cb"]

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            changed = (b[group] != b[group].shift()).any(axis=1).to_numpy()
            last = int(np.flatnonzero(changed)[-1])  # the last group may go on in the next batch
            rest = b.iloc[last:].reset_index(drop=True)
            if last and (got := _compared(b.iloc[:last], least)) is not None:
                yield got
        if rest is not None and len(rest) > 1 and (got := _compared(rest, least)) is not None:
            yield got

    found = cut(full.repartition(*group).sortWithinPartitions(*group).mapInPandas(compared, "rep long, links long, low long"))
    comp = components(found.select(F.col("rep").alias("u"), F.col("low").alias("v")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per = one.join(counts, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    per = cut(per.select("label", "e", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = good.join(per, ["label", "e"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
