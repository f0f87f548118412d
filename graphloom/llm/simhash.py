"""SimHash near-duplicates: pigeonhole blocks, verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, resident, table, words

CHUNK = 8192


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the shingles' XXH64 (seed 42). No words: 0. Fewer than width words: one shingle."""
    w = words(text)
    w = [x.lower() for x in w] if len(w) < width else (b" ".join(w)).lower().split(b" ")
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    grams = [b" ".join(w)] if len(w) < width else map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False))
    values = np.fromiter((h(g, 42) for g in grams), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), CHUNK):
        part = values[i : i + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp signed long) for each row; whole texts, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resident()
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    # as text: pandas would make doubles of ids beside a null
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, fp long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "fp")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of `blocks - distance` whole blocks; a pair within the distance agrees on one of them at least."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(one, blocks - distance)]


def links(fps: DataFrame, distance: int = 3, blocks: int = 6, hub_rounds: int = 3) -> DataFrame:
    """(fp, component fp) of distinct fingerprints that link with another; nothing is capped.

    Each fingerprint goes to one bucket a block choice. A few rounds first link every member of a
    bucket with one hub, where the distance allows it. After that only members of one bucket that
    lie in different components can still add a link, and just those are paired and verified. So a
    dense bucket costs a number of rows linear in its size unless it really holds separate groups.
    """
    masks = block_masks(distance, blocks)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= distance
    fps = cut(fps.select("fp").distinct())
    bucketed = fps.select("fp", F.explode(keys).alias("b")).select("fp", "b.t", "b.k")
    shared = cut(bucketed.groupBy("t", "k").agg(F.count("*").alias("n"), *[F.min_by("fp", F.xxhash64("fp", F.lit(r))).alias(f"hub{r}") for r in range(hub_rounds)]).where("n > 1"))
    members = cut(bucketed.join(shared, ["t", "k"]))
    hubs = F.array_distinct(F.array(*[f"hub{r}" for r in range(hub_rounds)]))
    stars = members.select("fp", F.explode(hubs).alias("h")).where((F.col("fp") != F.col("h")) & near(F.col("fp"), F.col("h")))
    comp = components(stars.select(F.col("fp").alias("u"), F.col("h").alias("v")))
    held = members.join(comp, members.fp == comp.node, "left").select("t", "k", "fp", F.coalesce("component", "fp").alias("c"))
    mixed = held.groupBy("t", "k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("t", "k")
    held = cut(held.join(mixed, ["t", "k"]))
    a, b = held.toDF("t", "k", "fa", "ca"), held.toDF("t", "k", "fb", "cb")
    rest = a.join(b, ["t", "k"]).where((F.col("ca") < F.col("cb")) & near(F.col("fa"), F.col("fb")))
    more = rest.select(F.col("ca").alias("u"), F.col("cb").alias("v")).distinct()
    both = more.union(comp.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return components(both).select(F.col("node").alias("fp"), F.col("component").alias("cfp"))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links) for every row.

    Null and empty texts have fingerprint 0 and link like any other; rows with one doc_id stay rows.
    Extra columns are ignored. Copies meet as one fingerprint before any pairing.
    """
    fps = cut(fingerprints(docs, width))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    comp = links(fps, distance)
    named = first.join(comp, "fp", "left").withColumn("cfp", F.coalesce("cfp", "fp"))
    least = cut(named.groupBy("cfp").agg(F.min("low").alias("component_id")))
    of = cut(named.join(least, "cfp").select("fp", "component_id"))
    return fps.join(of, "fp")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see near_duplicates() for nulls and repeats. Rows without doc_id take part, and give a component no name but where it has none else."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
