"""Shared pieces: tables, shared folders, ASCII words, packed arrays, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is named and all run on one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="graphloom-")
        shared_dir.own = base
    return base


def _place(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new place in the shared folder; what is written there goes when the session's JVM ends, unless kept."""
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    if not keep:
        fs, at = _place(spark, path)
        fs.mkdirs(at.getParent())
        fs.deleteOnExit(at)
    return path


def drop(spark: SparkSession, path: str) -> None:
    fs, at = _place(spark, path)
    fs.delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with pos, their place in the order among the rows of one g, and n, how many those are.

    Rows are dealt out by ranges of (g, order) and written once, so a group of any size is spread; a place is the
    row's place in its part and the counts of the parts before.
    """
    s = stored(rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("at", F.monotonically_increasing_id()), name)
    s = s.withColumn("part", F.shiftright("at", 33))
    of = Window.partitionBy("g")
    spans = s.groupBy("part", "g").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    spans = spans.withColumn("n", F.sum("m").over(of)).withColumn("before", F.sum("m").over(of.orderBy("part")) - F.col("m"))
    return s.join(spans, ["part", "g"]).select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n")


def words(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D; bytes.split() has exactly that set."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def trim() -> None:
    """Gives memory that was freed back to the system, on the driver too."""
    pyarrow.default_memory_pool().release_unused()
    if hasattr(c := ctypes.CDLL(None), "malloc_trim"):
        c.malloc_trim(0)


_RESIDENT: dict = {}


def resident(key=None, make: Callable | None = None):
    """What a Python worker keeps from task to task, made anew if missing. Only one thing is kept: asking for another, or for none, frees it."""
    if key not in _RESIDENT:
        had = len(_RESIDENT)
        _RESIDENT.clear()
        if had:
            trim()
        if key is not None:
            _RESIDENT[key] = make()
    return _RESIDENT.get(key)


class Hashes(dict):
    """64-bit hash of each word met, as long as `most` bytes last; then it starts anew. It lives as long as its task."""

    def __init__(self, of: Callable[[bytes], int], most: int = 24 << 20):
        self.hash, self.most, self.held = of, most, 0
        resident()

    def __missing__(self, word: bytes) -> int:
        h = self.hash(word)
        if len(word) < 256:
            self.held += len(word) + 200
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[word] = h
        return h

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def pack(x: np.ndarray) -> bytes:
    """x as little-endian byte planes, compressed: what small numbers leave empty costs nothing."""
    x = np.ascontiguousarray(x)
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_rising(x: np.ndarray) -> bytes:
    """A sorted array of uint64, as steps."""
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node reachable.

    Alternating large-star and small-star steps. Only minima per node are aggregated, so a hub
    costs one partial row a task; the fan-out is an equi-join that AQE can split.
    Nodes without an edge aren't listed. An empty edge table gives an empty result.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).withColumn("m", F.least("k", "m"))
        out = both.join(low, both.u == low.k)
        if large:
            out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    e, before = cut(edges.where("u <> v").select("u", "v").distinct()), None
    for _ in range(max_rounds):
        e = cut(star(star(e, True), False))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v")).distinct()
