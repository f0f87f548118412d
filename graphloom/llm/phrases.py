"""Lempel-Ziv phrase fingerprints: minimum hashes over the set of phrases that a text's own dictionary splits it into.

Each phrase is the longest one already in the dictionary and one byte more, and joins the dictionary; so texts that
compress each other well share phrases, whatever their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, resident, stored, table

PHRASES = 1 << 16  # phrases of a dictionary; the next one begins a new dictionary
SLOTS = 64  # minima of a fingerprint
CHUNK = 1 << 13  # phrases that are hashed at once
PART_BYTES = 64 << 20  # text of a partition
SAMPLED = 24  # keys sampled for each partition's bound
# 64-bit FNV-1a.
START, STEP, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1
_rng = np.random.default_rng(13)
TIMES, PLUS = (_rng.integers(0, 1 << 32, (SLOTS, 1), dtype=np.uint32) for _ in range(2))
TIMES |= 1
EMPTY = np.full(SLOTS, 0xFFFFFFFF, dtype=np.uint32)


class Phrases:
    """A parse that can be continued: the dictionary's tree, the hash and the key of each phrase in it."""

    def __init__(self):
        self.tree: dict[int, int] = {}
        self.hashes, self.keys, self.node = [START], [-1], 0

    def read(self, data: bytes) -> list[int]:
        """FNV-1a of each phrase that ends in data. What is left open at the end goes on with the next data."""
        found, node, tree, hashes, keys = [], self.node, self.tree, self.hashes, self.keys
        get = tree.get
        for b in data:
            key = node | b
            node = get(key)
            if node is None:
                h = ((hashes[key >> 8] ^ b) * STEP) & MASK
                found.append(h)
                if len(hashes) > PHRASES:
                    tree, hashes, keys = {}, [START], [-1]
                    get = tree.get
                else:
                    tree[key] = len(hashes) << 8
                    hashes.append(h)
                    keys.append(key)
                node = 0
        self.tree, self.hashes, self.keys, self.node = tree, hashes, keys, node
        return found

    def fork(self) -> tuple:
        return self.tree, self.hashes, self.keys, self.node, len(self.keys)

    def back(self, at: tuple) -> None:
        """The state that fork() saw; what was read since is taken out again."""
        self.tree, self.hashes, self.keys, self.node, n = at
        for key in self.keys[n:]:
            del self.tree[key]
        del self.hashes[n:], self.keys[n:]


def minima(found: list[int]) -> np.ndarray:
    """The least of each of SLOTS hashes over the phrases."""
    out = EMPTY
    for i in range(0, len(found), CHUNK):
        x = np.array(found[i : i + CHUNK], dtype=np.uint64)
        x ^= x >> np.uint64(33)  # FNV's low bits spread badly
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x = (x >> np.uint64(32)).astype(np.uint32)
        out = np.minimum(out, (TIMES * x + PLUS).min(axis=1))
    return out


def signature(text: str | None) -> np.ndarray:
    """Fingerprint of a text; null and empty texts have EMPTY."""
    return minima(Phrases().read((text or "").encode("utf-8", "surrogatepass")))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal minima: about the share of phrases that two texts have in common. 1 for two texts without phrases."""
    return float((a == b).mean())


def spelled(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint for each row, whole texts, no shuffle; extra columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fingerprint": [spelled(signature(t)) for t in b["text"]]})

    kind = docs.schema["doc_id"].dataType
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, fingerprint string")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def bounds(keys: DataFrame, total: int, least: tuple, n: int) -> list[tuple]:
    """At most n keys (has, id, h) of rows that part the rows about evenly, the least key of all among them."""
    share = min(1.0, SAMPLED * n / total)
    some = keys.where(F.pmod(F.xxhash64("id", "h"), F.lit(1 << 30)) < int(share * (1 << 30)))  # only where partitions end follows from it
    some = ranked(some.select(F.lit("").alias("g"), "has", "id", "h"), ["has", "id", "h"], "bounds")
    got = some.where(F.col("pos") % F.greatest(F.ceil(F.col("n") / n), F.lit(1)) == 0).select("has", "id", "h").collect()  # n rows
    return sorted({tuple(r) for r in [least, *got]})


def sortable(has: np.ndarray, id_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Keys as text of one length that sorts as they do."""
    out = np.empty((len(id_), 18), dtype=np.uint8)
    out[:, 0], out[:, 17] = np.where(has, 2, 1), 1
    for at, x in ((1, id_), (9, h)):
        out[:, at : at + 8] = (x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S18").ravel()


def compared_with_next(docs: DataFrame, share: int = 4, keep_texts: bool = False) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; with keep_texts also edited.

    The next row is that of the next doc_id, null doc_ids first, those of one doc_id by hash and text; after the last
    comes the first. The edited text ends in the next one's beginning: floor(n_chars / share) code points, or all that
    it has. Null texts count as empty. An empty table gives no rows, a single row is its own next. Other columns are
    ignored.

    Texts are shuffled once, by ranges that begin at keys of rows; the row that a range begins with goes to the range
    before it, too, so each task has the next of every row.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    rows = docs.select(F.col("doc_id").isNotNull().alias("has"), id_.alias("id"), F.xxhash64("text").alias("h"), "text")
    keys = stored(rows.select("has", "id", "h", F.octet_length("text").alias("size")), "keys")
    total, least, size = keys.agg(F.count("*"), F.min(F.struct("has", "id", "h")), F.sum("size")).first()
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // PART_BYTES)
    ends = bounds(keys, total, tuple(least), n) if total else [(False, 0, 0)]
    n = len(ends)
    starts = spark.sparkContext.broadcast(sortable(*(np.array([e[i] for e in ends]) for i in range(3))))  # 18 bytes a partition

    @F.pandas_udf("array<int>")
    def places(has: pd.Series, id_: pd.Series, h: pd.Series) -> pd.Series:
        """Twice the partition of a row; and one more than twice the partition that needs it as the row after its last."""
        key = sortable(has.to_numpy(bool), id_.to_numpy(), h.to_numpy())
        at = np.searchsorted(starts.value, key, side="right") - 1
        first = starts.value[at] == key
        return pd.Series([[2 * p, 2 * ((p - 1) % n) + 1] if f else [2 * p] for p, f in zip(at.tolist(), first.tolist(), strict=True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resident()
        before, closed = None, False

        def opened(has: bool, id_: int, text: str | None) -> tuple:
            text = text or ""
            cut = len(text) - len(text) // share
            head, parse = text[:cut], Phrases()
            start = minima(parse.read(head.encode("utf-8", "surrogatepass")))
            at = parse.fork()
            own = np.minimum(start, minima(parse.read(text[cut:].encode("utf-8", "surrogatepass"))))
            parse.back(at)
            return (str(id_) if has else None), text, head, parse, start, own

        def row(last: tuple, text: str, own: np.ndarray) -> tuple:
            key, whole, head, parse, start, mine = last
            tail = text[: len(whole) - len(head)]
            other = np.minimum(start, minima(parse.read(tail.encode("utf-8", "surrogatepass"))))
            edited = head + tail
            out = (key, len(whole), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), spelled(mine), spelled(other), likeness(mine, other), likeness(mine, own))
            return out + ((edited,) if keep_texts else ())

        for b in batches:
            out = []
            for has, key, text, ghost in zip(b["has"], b["id"], b["text"], b["ghost"], strict=True):
                if ghost:
                    if before is not None and not closed:
                        out.append(row(before, text or "", signature(text)))
                    closed = True
                    continue
                now = opened(has, key, text)
                if before is not None:
                    out.append(row(before, now[1], now[5]))
                before = now
            if out:
                yield pd.DataFrame(out, columns=names)
        if before is not None and not closed:
            raise RuntimeError("a partition lacks the row after its last")

    schema = "key string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double" + ", edited string" * keep_texts
    names = [c.split()[0] for c in schema.split(", ")]
    rows = rows.withColumn("place", F.explode(places("has", "id", "h"))).withColumns({"part": F.shiftright("place", 1), "ghost": F.col("place") % 2 == 1})
    rows = rows.repartitionById(n, "part").sortWithinPartitions("ghost", "has", "id", "h", "text")
    out = rows.select("has", "id", "text", "ghost").mapInPandas(run, schema)
    return out.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", "doc_id")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's phrase fingerprint, and its likeness to its edited text's and the next document's; see compared_with_next() for odd rows."""
    return compared_with_next(table(spark, sf_dir, "documents"))
