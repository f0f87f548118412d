"""Centroid clustering over integers: Elkan's bounds skip distances, and what is compared is exact.

The vectors are written once, in blocks. A round joins each block with its own bounds, which lie in a table bucketed
as the blocks are, so that no vector is shuffled or written again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

BLOCK = 4096  # vectors of a block, about
MOST = 1 << 26  # components in absolute value: 64 squared differences then fit a long
STATE = "block long, n long, cluster binary, upper binary, lower binary, sums array<long>, counts array<long>, inertia array<string>, skipped long"


def up(x: np.ndarray) -> np.ndarray:
    """Distances of exact squares in single precision, not below the true ones."""
    return np.nextafter(np.sqrt(x.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """The same, not above them."""
    return np.maximum(np.nextafter(np.sqrt(x.astype(np.float64)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to c."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, centres: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Moves each row of x to its nearest centre, the smaller number among equals; bounds are tightened in place. Gives how many distances were skipped.

    A centre is left out only where a bound shows that it is farther than the row's own, strictly; so no tie is lost.
    """
    k = len(centres)
    half = np.stack([down(squares(centres, c)) for c in centres]) / np.float32(2)
    half = np.nextafter(half, np.float32(-np.inf))
    np.fill_diagonal(half, np.inf)
    near = half.min(axis=1)
    some = np.flatnonzero(~(near[cluster] > upper))
    done = 0
    if len(some):
        own = cluster[some]
        may = ~(lower[some] > upper[some][:, None]) & ~(half[own] > upper[some][:, None])
        may[np.arange(len(some)), own] = False
        some = some[may.any(axis=1)]
    if len(some):
        rows, best = x[some], squares(x[some], centres[cluster[some]])
        done += len(some)
        upper[some] = up(best)
        lower[some, cluster[some]] = down(best)
        for c in range(k):
            own, u = cluster[some], upper[some]
            at = np.flatnonzero((own != c) & ~(lower[some, c] > u) & ~(half[own, c] > u))
            if not len(at):
                continue
            d, i = squares(rows[at], centres[c]), some[at]
            done += len(at)
            lower[i, c] = down(d)
            better = (d < best[at]) | ((d == best[at]) & (c < own[at]))
            at, i = at[better], i[better]
            best[at], cluster[i], upper[i] = d[better], c, up(d[better])
    return len(x) * k - done


def shifted(upper: np.ndarray, lower: np.ndarray, cluster: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after the centres moved by the squares given, rounded away from the truth."""
    far = up(moved) * (moved > 0)
    u = np.where(far[cluster] > 0, np.nextafter(upper + far[cluster], np.float32(np.inf)), upper)
    low = np.where(far > 0, np.nextafter(lower - far, np.float32(-np.inf)), lower)
    return u.astype(np.float32), np.maximum(low, 0).astype(np.float32)


def bucketed(df: DataFrame, files: int, name: str) -> DataFrame:
    """df written once and read as a table bucketed by block. The catalogue forgets it at once, its files go with the session."""
    spark, own = df.sparkSession, f"graphloom_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(files, "block").option("path", scratch(spark, name)).saveAsTable(own)
    out = spark.table(own)
    spark.sql(f"drop table {own}")
    return out


def first_centres(kept: DataFrame, k: int, seed: int, key: str) -> np.ndarray:
    """The k vectors of the smallest hashes of seed and key; k rows reach the driver."""
    name = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    order = F.struct(F.col(key).isNull().alias("none"), F.sha2(name.cast("binary"), 256).alias("h"), F.col("v").alias("v"))
    got = kept.select(order.alias("o")).orderBy("o").limit(k).collect()
    return np.array([r["o"]["v"] for r in got], dtype=np.int64)


def whole(vector: Column, dims: int, scale: int) -> tuple[Column, Column]:
    """Whether a vector is kept, and its components as integers."""
    fine = F.coalesce((F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    part = lambda x: F.floor(F.when(F.abs(x) * scale < MOST, x * scale).otherwise(F.raise_error(F.lit(f"a component times {scale} is {MOST} or more"))))
    return fine, F.transform(vector.cast("array<double>"), part)


def clusters(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, np.ndarray, list[int], list[int]]:
    """(key, cluster, distance) of each kept vector, the last centres, each cluster's inertia, and how many distances each round skipped.

    Vectors of another length, null, or with null or non-finite components are left out. Repeated rows are vectors of
    their own; rows without key are assigned, but start a centre only where no others are left. Fewer than k vectors
    give as many centres; none give no rows. A component that times scale reaches MOST is an error, since squares
    of it would leave the range of exact numbers. Other columns are ignored.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType
    fine, v = whole(F.col(f"`{column}`"), dims, scale)
    kept = vectors.where(fine).select(F.col(f"`{key}`").alias("key"), v.alias("v"))
    centres = first_centres(kept, k, seed, "key")
    n = kept.count()
    files = max(1, min(-(-n // BLOCK), max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (BLOCK * 64))))
    k = len(centres)
    if not k:
        return kept.select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), centres, [], []

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = TaskContext.get().partitionId() << 32
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy()).astype(np.int64)
                small = np.int16 if np.abs(x).max() < 1 << 15 else np.int32
                for i in range(0, len(b), BLOCK):
                    part = x[i : i + BLOCK]
                    yield pd.DataFrame({"block": [own], "n": [len(part)], "wide": [np.dtype(small).itemsize], "vectors": [part.astype(small).tobytes()], "keys": [list(b["key"].iloc[i : i + BLOCK])]})
                    own += 1

    packed = kept.select(F.col("key").cast("string").alias("key"), "v").mapInPandas(pack, "block long, n long, wide int, vectors binary, keys array<string>")
    blocks = bucketed(packed.repartition(files, "block"), files, "vectors")

    def round_of(centres: np.ndarray, moved: np.ndarray | None, last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for r in b.itertuples():
                    x = np.frombuffer(r.vectors, np.int16 if r.wide == 2 else np.int32).reshape(r.n, -1).astype(np.int64)
                    if moved is None:
                        cluster, upper, lower = np.zeros(r.n, np.int16), np.full(r.n, np.inf, np.float32), np.zeros((r.n, k), np.float32)
                    else:
                        cluster = np.frombuffer(r.cluster, np.int16).copy()
                        upper, lower = shifted(np.frombuffer(r.upper, np.float32), np.frombuffer(r.lower, np.float32).reshape(r.n, k), cluster, moved)
                    skipped = assign(x, centres, cluster, upper, lower)
                    sums, inertia = np.zeros((k, dims), np.int64), ["0"] * k
                    counts = np.bincount(cluster, minlength=k)
                    for c in np.flatnonzero(counts):
                        mine = x[cluster == c]
                        sums[c] = mine.sum(axis=0)
                        if last:
                            inertia[c] = str(sum(squares(mine, centres[c]).tolist()))  # may be longer than 64 bits
                    out.append((r.block, r.n, cluster.tobytes(), b"" if last else upper.tobytes(), b"" if last else lower.tobytes(), sums.ravel(), counts, inertia, skipped))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])

        return run

    moved, state, skipped = None, None, []
    for turn in range(rounds + 1):
        rows = blocks.select("block", "n", "wide", "vectors")
        if state is not None:
            rows = rows.join(state.select("block", "cluster", "upper", "lower").hint("merge"), "block")
        state = bucketed(rows.mapInPandas(round_of(centres, moved, turn == rounds), STATE), files, "bounds")
        at = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(k * dims - 1)).alias("i"), F.col("sums").alias("s")))
        if turn < rounds:
            totals = state.select(at.alias("z")).groupBy("z.i").agg(F.sum(F.col("z.s").cast("decimal(38,0)")).alias("s")).collect()  # k * dims rows
        per = state.select(F.posexplode(F.arrays_zip(F.col("counts").alias("c"), F.col("inertia").alias("d"))), "skipped")
        of = {r["pos"]: r for r in per.groupBy("pos").agg(F.sum("col.c").alias("c"), F.sum(F.col("col.d").cast("decimal(38,0)")).alias("d"), F.sum("skipped").alias("s")).collect()}  # k rows
        skipped.append(int(of[0]["s"]))
        if turn < rounds:
            new = centres.copy()
            for r in totals:
                c, d = divmod(r["i"], dims)
                if of[c]["c"]:
                    new[c, d] = int(r["s"]) // int(of[c]["c"])
            moved, centres = squares(new, centres), new

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                x = np.frombuffer(r.vectors, np.int16 if r.wide == 2 else np.int32).reshape(r.n, -1).astype(np.int64)
                cluster = np.frombuffer(r.cluster, np.int16)
                yield pd.DataFrame({"key": r.keys, "cluster": cluster.astype(np.int32), "distance": squares(x, centres[cluster])})

    out = blocks.join(state.select("block", "cluster").hint("merge"), "block").mapInPandas(unpack, "key string, cluster int, distance long")
    return out.select(F.col("key").cast(kind).alias(key), "cluster", "distance"), centres, [int(of[c]["d"]) for c in range(k)], skipped


def op12_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and exact distance of every kept vector, inertia by cluster and in all, and a digest of the cluster's centre; see clusters() for odd rows."""
    out, centres, inertia, _ = clusters(table(spark, sf_dir, "embeddings"))
    of = [(c, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centre.tolist())).encode()).hexdigest()) for c, centre in enumerate(centres)]
    facts = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centre


def _sql(k: int = 8, rounds: int = 10) -> str:
    dims = "range(1, 65)"
    parts = [
        "v as materialized (select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as v, row_number() over () as r from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)",
        f"c0 as materialized (select row_number() over (order by vec_id is null, sha256('3:' || vec_id), v) - 1 as c, v from v qualify c < {k})",
    ]
    near = f"cast(list_sum(list_transform({dims}, lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i]))) as bigint)"
    for t in range(rounds + 1):
        parts.append(f"a{t} as materialized (select r, vec_id, v.v, c, {near} as d from v cross join c{t} c qualify row_number() over (partition by r order by d, c) = 1)")
        if t < rounds:
            each = f"select c, i, sum(x) as s, count(*) as n from (select c, unnest(v) as x, unnest({dims}) as i from a{t}) group by c, i"
            mean = f"select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from ({each}) group by c"
            parts.append(f"c{t + 1} as materialized (select c.c, coalesce(m.v, c.v) as v from c{t} c left join ({mean}) m on m.c = c.c)")
    return "with " + ", ".join(parts) + f" select vec_id, cast(a.c as integer) as cluster, d as distance, cast(sum(d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256 from a{rounds} a join c{rounds} c on a.c = c.c"


SQL = _sql()
