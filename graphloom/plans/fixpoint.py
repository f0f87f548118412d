"""Iteration to a fixpoint: pointer jumping, closure, components, mark and sweep."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; a local one only where none is named and all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = shared_dir.own = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="graphloom-")
    return base


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back; the files go when the session's JVM ends.

    Unlike checkpoint() this starts with the size of what was written: a checkpoint keeps the estimate of its plan,
    and over rounds of joins those multiply to numbers of millions of digits.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/graphloom/cut-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path.getParent())
    fs.deleteOnExit(path)
    df.write.parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())


def resolve(nodes: DataFrame, limit: int = 12) -> DataFrame:
    """(k, root, hops) of a functional graph (k, nxt), nxt null at a root; pointer jumping in log rounds.

    Only rows that haven't reached a root jump again. What points outside the table ends there. limit rounds reach
    chains of 2 ** limit; a longer chain or a cycle is an error.
    """
    at = cut(nodes.select("k", F.coalesce("nxt", "k").alias("root"), F.when(F.col("nxt").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.col("nxt").isNull().alias("done")))
    done, left = at.where("done"), at.where("not done")
    for _ in range(limit + 1):
        on = done.union(left).select(F.col("k").alias("root"), F.col("root").alias("r2"), F.col("hops").alias("h2"), F.col("done").alias("d2"))
        moved = left.join(on, "root", "left").select("k", F.coalesce("r2", "root").alias("root"), (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"), F.coalesce("d2", F.lit(True)).alias("done"))
        moved = cut(moved)
        done, left = done.union(moved.where("done")), moved.where("not done")
        if left.isEmpty():
            return done.select("k", "root", "hops")
    raise ValueError("alias chain too deep or cyclic")


def resolve_rows(nodes: DataFrame) -> DataFrame:
    """(k, root, hops, cycle) of a functional graph (k, nxt) of any depth, nxt null at a root; a walk that runs into a cycle has no root, and the cycle's least node.

    Walks double each round and carry the least node they passed (low) and that of the walk from where they end
    (ahead). While some row still has a root further off, each round brings one there, so a round without any leaves
    only rows of cycles. If doubling then changes no low, no walk meets a lower node ever; if it changes no ahead
    either, all that is ahead of a walk is its cycle. So rounds grow with the longest walk, not with the rows. What
    points outside the table ends there; null k have no row.
    """
    own = nodes.where("k is not null").select("k", F.coalesce("nxt", "k").alias("root"), F.when(F.col("nxt").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.col("k").alias("low"), F.col("k").alias("ahead"), F.col("nxt").isNull().alias("done"))
    at = cut(own.withColumn("still", F.lit(False)))
    done, left = at.where("done"), at.where("not done")
    while True:
        on = done.union(left).select(F.col("k").alias("root"), F.col("root").alias("r2"), F.col("hops").alias("h2"), F.col("low").alias("l2"), F.col("done").alias("d2"))
        low = F.least("low", "l2")
        moved = left.join(on, "root", "left").select("k", F.coalesce("r2", "root").alias("root"), (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"), low.alias("low"), F.col("l2").alias("ahead"), F.coalesce("d2", F.lit(True)).alias("done"), ((low == F.col("low")) & F.col("l2").eqNullSafe(F.col("ahead"))).alias("still"))
        moved = cut(moved)
        done, left = done.union(moved.where("done")), moved.where("not done")
        counts = moved.agg(F.count("*").alias("n"), F.count_if("done").alias("new"), F.count_if("still").alias("still")).first()
        if counts["n"] == counts["new"] or counts["new"] == 0 and counts["n"] == counts["still"]:
            break
    none = F.lit(None).cast("bigint")
    return done.select("k", "root", "hops", none.alias("cycle")).union(left.select("k", none, none, F.col("ahead").alias("cycle")))


def reach(edges: DataFrame, roots: DataFrame, limit: int = 1000) -> DataFrame:
    """(k) reachable from roots over (src, dst), roots included; a frontier a round."""
    edges, seen = cut(edges.select("src", "dst").distinct()), cut(roots.select("k").distinct())
    front = seen
    for _ in range(limit):
        front = cut(front.join(edges, front.k == edges.src).select(F.col("dst").alias("k")).distinct().join(seen, "k", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.union(front))
    raise ValueError("closure too deep")


def sweep(rows: DataFrame, refs: DataFrame, always: DataFrame, limit: int = 1000) -> DataFrame:
    """(k) that survive: marked by roots or by a surviving row, until stable; a row marks itself where refs says so.

    After the first round only what the rows just removed had marked is looked at again.
    """
    refs = cut(refs.select("src", "dst").distinct())
    live, kept = cut(rows.select("k").distinct()), cut(always.select("k").distinct())
    marked = refs.join(live.withColumnRenamed("k", "src"), "src", "left_semi").select(F.col("dst").alias("k")).union(kept)
    dead = cut(live.join(marked, "k", "left_anti"))
    for _ in range(limit):
        if dead.isEmpty():
            return live
        live = cut(live.join(dead, "k", "left_anti"))
        hit = refs.join(dead.withColumnRenamed("k", "src"), "src", "left_semi").select(F.col("dst").alias("k")).distinct()
        hit = cut(hit.join(live, "k", "left_semi").join(kept, "k", "left_anti"))
        still = refs.join(hit.withColumnRenamed("k", "dst"), "dst", "left_semi").join(live.withColumnRenamed("k", "src"), "src", "left_semi").select(F.col("dst").alias("k"))
        dead = cut(hit.join(still, "k", "left_anti"))
    raise ValueError("sweep did not settle")


def components(edges: DataFrame, limit: int = 200) -> DataFrame:
    """(k, component) with the least node reachable over undirected (src, dst).

    Each round orders nodes anew by a hash, and each node joins the first of itself and its neighbours; edges then
    run between those, once each and none within one. So edges and nodes shrink by a share each round, whatever
    the shape of the graph, and only the first round sees them all.
    """
    pairs = edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    every = cut(pairs.distinct())
    left, steps = every.where("a <> b"), []
    for i in range(limit):
        if left.isEmpty():
            break
        order = lambda c: F.struct(F.xxhash64(F.lit(i), c).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        both = left.select(F.col("a").alias("k"), F.col("b").alias("o")).union(left.select("b", "a"))
        step = cut(both.groupBy("k").agg(F.min(order("o")).alias("m")).select("k", F.least("m", order("k"))["v"].alias("to")))
        steps.append(step)
        moved = left.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").where("x <> y")
        left = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise ValueError("components did not settle")
    alone = every.where("a = b").select(F.col("a").alias("k"), F.col("a").alias("component")).distinct()
    if not steps:
        return cut(alone)
    at = steps[-1]
    for step in reversed(steps[:-1]):
        at = step.join(at.select(F.col("k").alias("to"), F.col("to").alias("last")), "to", "left").select("k", F.coalesce("last", "to").alias("to"))
    at = cut(at)
    found = at.join(at.groupBy("to").agg(F.min("k").alias("component")), "to").select("k", "component")
    return cut(found.union(alone.join(at, "k", "left_anti")))
