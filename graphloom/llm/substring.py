"""Substring dedup over a log-structured fingerprint index of word windows."""

from __future__ import annotations

import hashlib
import uuid
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Hashes, drop, pack, pack_rising, scratch, stored, table, unpack, unpack_rising, words

WINDOW, PART = 20, 10  # words of a window, and of the anchor in it
BLOCK = 4 << 20  # bytes of text of a block, about
RANGE = 8 << 20  # bytes of text, of the batch and of the history, for each part of the key space
BATCHES = 2  # ranges of documents that dedup() sends through the index one after another
_MIX = np.uint64(0x9E3779B97F4A7C15)
REPLY = "kind int, b int, part int, n int, bits binary"


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, 7)


def polynomial(h: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Of each run of `width` words, a polynomial of their hashes."""
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    f, out = np.uint64(factor), h[:n].copy()
    for i in range(1, width):
        out *= f
        out += h[i : i + n]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def doubled(x: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Polynomials of runs twice as long, from those of `width` words."""
    return x[:-width] * np.uint64(pow(factor, width, 1 << 64)) + x[width:] if len(x) > width else x[:0]


def least_places(v: np.ndarray, width: int) -> np.ndarray:
    """Place of the least among v[i : i + width], for each i; the first of ties."""
    place = np.arange(len(v), dtype=np.int64)
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = place[:-step], place[step:]
        place = np.where(v[a] <= v[b], a, b)
        reach += step
    return place


class Block:
    """The texts of a block as one array of word hashes. Its rows are taken in the order of (doc_id, text)."""

    def __init__(self, rows: pd.DataFrame, known: Hashes, window: int, part: int):
        if 2 * part != window:
            raise ValueError("a window is two anchors long")
        self.window, self.part = window, part
        keys, texts = rows["key"].tolist(), rows["text"].tolist()
        self.order = sorted(range(len(rows)), key=lambda i: (keys[i], texts[i] or ""))
        self.texts = [texts[i] for i in self.order]
        each = [known.array(words(t)) for t in self.texts]
        self.size = np.array([len(x) for x in each], dtype=np.int64)
        self.end = np.cumsum(self.size)
        self.h = np.concatenate([*each, np.zeros(0, np.uint64)])
        left = np.repeat(self.end, self.size) - np.arange(len(self.h))
        self.start = np.flatnonzero(left >= window)  # of the windows

    @cached_property
    def short(self) -> np.ndarray:
        return polynomial(self.h, self.part, 0xD1B54A32D192ED03)

    @cached_property
    def anchor(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted anchors, how often each occurs, and the anchor of each window.

        A window's anchor is the least hash among its parts. It depends on its words alone, so equal windows have
        equal anchors, and windows in a row share one: there are a fifth as many.
        """
        if not len(self.start):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        v = mixed(self.short)
        place = least_places(v, self.window - self.part + 1)[self.start]
        new = np.concatenate([[True], place[1:] != place[:-1]])
        keys, of, n = np.unique(v[place[new]], return_inverse=True, return_counts=True)
        return keys, n, of[np.cumsum(new) - 1]

    def windows(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct fingerprints (h1 sorted, h2), which windows have them (places among `some`), and whether such a window is its fingerprint's first.

        h2 verifies h1; it comes from other hashes of the words.
        """
        at = self.start[some]
        one = mixed(doubled(self.short, self.part, 0xD1B54A32D192ED03)[at])
        two = doubled(polynomial(mixed(self.h ^ _MIX), self.part, 0x94D049BB133111EB), self.part, 0x94D049BB133111EB)[at]
        two = (mixed(two) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((two, one))  # stable: the first window comes first
        one, two = one[order], two[order]
        first = np.ones(len(order), dtype=bool)
        first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        of, head = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=bool)
        of[order], head[order] = np.cumsum(first) - 1, first
        return one[first], two[first], of, head


def edges(keys: np.ndarray, bits: int) -> list[int]:
    """Where the sorted keys of each part, by their first bits, begin and end."""
    inner = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return [0, *np.searchsorted(keys, inner).tolist(), len(keys)]


def _said(right: pd.DataFrame, kind: int) -> np.ndarray:
    """The replies of one kind, by part, as one array of flags."""
    some = right[right["kind"] == kind].sort_values("part")
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(some["bits"], some["n"], strict=True))])


def _bits_for(size: int) -> int:
    return max(0, (int(size) // RANGE).bit_length())


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints under a folder, with a manifest of the runs that count.

    A fingerprint is h1 (64 bits, sorted, split in parts by its first bits) and h2 (32 bits), which verifies what
    h1 finds. Each part of a batch is merged with the same part of every run, and what the runs lack becomes a new
    run. compact() merges the runs to one and deletes the old ones. A run counts once the manifest names it, so a
    job that dies leaves the index as it was. FingerprintIndex(spark, path) opens an index again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, part: int = PART):
        self.spark, self.window, self.part = spark, window, part
        self.path = path or scratch(spark, "index")
        self.version, self.runs = 0, []
        try:
            last = spark.read.parquet(f"{self.path}/manifest").orderBy(F.desc("version")).first()
            self.version, self.runs = last["version"], [tuple(r) for r in last["runs"]]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise

    def _commit(self, runs: list[tuple[str, int, int]]) -> None:
        """runs: name, bits and number of fingerprints of each run."""
        self.version, self.runs = self.version + 1, runs
        schema = "version long, runs array<struct<name: string, bits: int, n: long>>"
        self.spark.createDataFrame([(self.version, runs)], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def history(self, bits: int) -> DataFrame:
        """Every run's (part, h1, h2), each run in parts of so many bits."""
        out = self.spark.createDataFrame([], "part int, h1 binary, h2 binary")

        def split(batches):
            for b in batches:
                for r in b.itertuples():
                    one, two = unpack_rising(r.h1), unpack(r.h2, "<u4")
                    edge = edges(one, bits)
                    rows = [(k, pack_rising(one[i:j]), pack(two[i:j])) for k, (i, j) in enumerate(zip(edge, edge[1:])) if j > i]
                    yield pd.DataFrame(rows, columns=["part", "h1", "h2"])

        for name, own, _ in self.runs:
            run = self.spark.read.schema(out.schema).parquet(f"{self.path}/{name}")
            out = out.union(run if own == bits else run.mapInPandas(split, out.schema))
        return out

    def _append(self, run: DataFrame, bits: int) -> tuple[str, int, int]:
        """Writes a run of rows (part, h1, h2, n)."""
        name = f"run-{uuid.uuid4().hex}"
        run.select("part", "h1", "h2", "n").write.parquet(f"{self.path}/{name}")
        return name, bits, self.spark.read.parquet(f"{self.path}/{name}").agg(F.sum("n")).first()[0] or 0

    def compact(self) -> None:
        """All runs as one."""
        if len(self.runs) < 2:
            return
        bits = _bits_for(8 * sum(r[2] for r in self.runs))

        def merged(key, b: pd.DataFrame) -> pd.DataFrame:
            one, two = np.concatenate([unpack_rising(x) for x in b["h1"]]), np.concatenate([unpack(x, "<u4") for x in b["h2"]])
            order = np.lexsort((two, one))
            return pd.DataFrame([(key[0], pack_rising(one[order]), pack(two[order]), len(one))], columns=["part", "h1", "h2", "n"])

        old = self.runs
        self._commit([self._append(self.history(bits).groupBy("part").applyInPandas(merged, "part int, h1 binary, h2 binary, n long"), bits)])
        for name, _, _ in old:
            drop(self.spark, f"{self.path}/{name}")

    def blocks(self, docs: DataFrame) -> DataFrame:
        """(doc_id, key, text, carry, b): the rows in blocks b by ranges of doc_id, bucketed by block, so that later passes need no shuffle of texts.

        key orders the rows of a block; rows without doc_id come before all others. carry: the other columns as JSON, where there are any.
        """
        spark, more = self.spark, [c for c in docs.columns if c not in ("doc_id", "text")]
        carry = F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(more)])) if more else F.lit(None).cast("string")
        docs = docs.select("doc_id", "text", carry.alias("carry"))
        self.size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = 1 + self.size // BLOCK
        files = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 8)))
        rows = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).withColumn("b", F.spark_partition_id())
        rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "text", "carry", "b")
        name = f"graphloom_{uuid.uuid4().hex}"
        rows.write.bucketBy(files, "b").option("compression", "zstd").option("path", scratch(spark, "blocks")).saveAsTable(name)
        return spark.table(name)

    def repeated_anchors(self, texts: DataFrame) -> DataFrame:
        """REPLY rows of kind 0: which of a block's anchors another block has."""
        window, part, bits = self.window, self.part, _bits_for(self.size // 4)

        def send(b: pd.DataFrame) -> pd.DataFrame:
            keys = Block(b, Hashes(word_hash), window, part).anchor[0]
            edge = edges(keys, bits)
            rows = [(int(b["b"].iat[0]), k, pack_rising(keys[i:j])) for k, (i, j) in enumerate(zip(edge, edge[1:])) if j > i]
            return pd.DataFrame(rows, columns=["b", "part", "keys"])

        def twice(b: pd.DataFrame) -> pd.DataFrame:
            each = [unpack_rising(x) for x in b["keys"]]
            _, of, n = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
            flags = np.split((n > 1)[of], np.cumsum([len(x) for x in each])[:-1])
            return pd.DataFrame({"kind": 0, "b": b["b"], "part": b["part"], "n": [len(x) for x in each], "bits": [np.packbits(x).tobytes() for x in flags]})

        sent = texts.groupBy("b").applyInPandas(send, "b int, part int, keys binary")
        return stored(sent.groupBy("part").applyInPandas(twice, REPLY), "anchors")

    def merge(self, texts: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
        """REPLY rows of kind 1: which of a block's fingerprints an earlier block or the history has; appends a run of the new ones.

        With anchors, only windows whose anchor repeats are looked up and kept, which is enough where no later
        batch has others than those that the anchors come from.
        """
        window, part, every = self.window, self.part, anchors is None
        bits = _bits_for(self.size + 8 * sum(r[2] for r in self.runs))
        replies = anchors if anchors is not None else self.spark.createDataFrame([], REPLY)

        def send(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            rows = []
            if len(left):
                own = Block(left, Hashes(word_hash), window, part)
                one, two, _, _ = own.windows(wanted(own, right, every))
                edge = edges(one, bits)
                rows = [(int(left["b"].iat[0]), k, pack_rising(one[i:j]), pack(two[i:j])) for k, (i, j) in enumerate(zip(edge, edge[1:])) if j > i]
            return pd.DataFrame(rows, columns=["b", "part", "h1", "h2"])

        def merged(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            left = left.sort_values("b")
            each = [*left["h1"], *right["h1"]]
            if not len(left):
                return pd.DataFrame([], columns=["kind", "b", "part", "n", "bits", "h1", "h2"])
            one = [unpack_rising(x) for x in each]
            size = [len(x) for x in one]
            one, two = np.concatenate(one), np.concatenate([unpack(x, "<u4") for x in [*left["h2"], *right["h2"]]])
            turn = np.repeat(np.concatenate([np.arange(len(left)), np.full(len(right), -1)]).astype(np.int32), size)  # the history comes first
            order = np.lexsort((turn, two, one))
            one, two = one[order], two[order]
            first = np.ones(len(order), dtype=bool)
            first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            later = np.empty(len(order), dtype=bool)
            later[order] = ~first
            out = [(1, b, key[0], n, np.packbits(x).tobytes(), None, None) for b, n, x in zip(left["b"], size, np.split(later, np.cumsum(size)[:-1]), strict=False)]
            new = first & (turn[order] >= 0)
            if new.any():
                out.append((2, -1, key[0], int(new.sum()), None, pack_rising(one[new]), pack(two[new])))
            return pd.DataFrame(out, columns=["kind", "b", "part", "n", "bits", "h1", "h2"])

        sent = texts.groupBy("b").cogroup(replies.groupBy("b")).applyInPandas(send, "b int, part int, h1 binary, h2 binary")
        got = stored(sent.groupBy("part").cogroup(self.history(bits).groupBy("part")).applyInPandas(merged, REPLY + ", h1 binary, h2 binary"), "merged")
        self._commit([*self.runs, self._append(got.where("kind = 2"), bits)])
        return got.where("kind = 1").drop("h1", "h2")

    def kept(self, texts: DataFrame, replies: DataFrame, every: bool, what: str) -> DataFrame:
        """For each row what is left of it: "digest", "text" (also the text, and carry), or "starts" of the windows that go, with the row's turn among those of one doc_id."""
        window, part = self.window, self.part

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            own = Block(left, Hashes(word_hash), window, part) if len(left) else None
            ids, out, turn = left["doc_id"].tolist(), [], {}
            carry = left["carry"].tolist()
            gone, starts = np.zeros(len(own.h) + 1 if own else 1, dtype=np.int64), np.zeros(0, np.int64)
            if own and len(some := wanted(own, right, every)):
                _, _, of, head = own.windows(some)
                later = _said(right, 1)
                starts = own.start[some[~head | later[of]]]
                gone[starts] += 1
                gone[starts + window] -= 1
            gone = np.cumsum(gone) > 0
            for k, i in enumerate(own.order if own else []):
                end, n = int(own.end[k]), int(own.size[k])
                turn[ids[i]] = turn.get(ids[i], 0) + 1
                if what == "starts":
                    a, z = np.searchsorted(starts, [end - n, end])
                    out.append((ids[i], turn[ids[i]], (starts[a:z] - (end - n)).tolist()))
                    continue
                w, lost = words(own.texts[k]), gone[end - n : end]
                if lost.any():
                    w = [x for x, go in zip(w, lost.tolist(), strict=True) if not go]
                kept = b" ".join(w)
                row = (ids[i], n, n - len(w), hashlib.sha256(kept).hexdigest())
                # a text that loses nothing stays as it was
                out.append((*row, own.texts[k] if n == len(w) else kept.decode("utf-8", "replace"), carry[i]) if what == "text" else row)
            return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

        schema = "doc_id string, turn int, starts array<long>" if what == "starts" else "doc_id string, n_words long, n_removed long, kept_sha256 string" + ", kept string, carry string" * (what == "text")
        out = texts.groupBy("b").cogroup(replies.groupBy("b")).applyInPandas(run, schema)
        return out.withColumn("doc_id", F.col("doc_id").cast("long"))

    def repeats(self, batch: DataFrame) -> DataFrame:
        """(doc_id, turn, starts) of the batch's rows: windows that also start earlier, in it or in a batch before.

        Batches count in the order in which they come; in a batch earlier is a smaller (doc_id, start). The new
        run holds every window, as later batches need. turn numbers the rows of one doc_id by their texts.
        """
        texts = self.blocks(batch)
        return self.kept(texts, self.merge(texts), True, "starts")


def wanted(own: Block, right: pd.DataFrame, every: bool) -> np.ndarray:
    """Which windows are looked up: all, or those whose anchor repeats in the block or elsewhere."""
    if every:
        return np.arange(len(own.start))
    keys, n, of = own.anchor
    return np.flatnonzero(((n > 1) | _said(right, 0))[of]) if len(keys) else np.zeros(0, np.int64)


def remove(docs: DataFrame, repeats: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row, by the starts that FingerprintIndex.repeats gave for the same rows."""

    def run(batches):
        for b in batches:
            out = []
            for key, t, starts in zip(b["doc_id"], b["text"], b["starts"], strict=True):
                w = words(t)
                edge = np.zeros(len(w) + 1, dtype=np.int64)
                s = np.asarray([] if starts is None else starts, dtype=np.int64)
                edge[s] += 1
                edge[s + window] -= 1
                left = [x for x, n in zip(w, np.cumsum(edge).tolist(), strict=False) if not n]
                out.append((key, len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])

    numbered = docs.select("doc_id", "text").withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce("text", F.lit("")))))
    r = repeats.select(F.col("doc_id").alias("k"), F.col("turn").alias("t"), "starts")
    both = numbered.join(r, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("turn") == F.col("t")), "left")
    return both.select(F.col("doc_id").cast("string"), "text", "starts").mapInPandas(run, "doc_id string, n_words long, n_removed long, kept_sha256 string").withColumn("doc_id", F.col("doc_id").cast("long"))


def dedup(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (with keep_text also kept, and the other columns) for each row: each word covered by a window of 20 words that also starts earlier goes.

    Earlier is a smaller doc_id, or the same row and an earlier start; rows without doc_id come before all others,
    and rows of one doc_id count in the order of their texts. Windows are judged on the texts as given. Null,
    empty and short texts have no window and lose nothing; a null text has no words. Extra columns are ignored;
    an empty table gives no rows. Columns of docs must not bear the names of the result's. Ranges of doc_id go through an index of their own one after another; since no
    other batch follows, it holds only windows whose anchor repeats in the table.
    """
    more = [f for f in docs.schema if f.name not in ("doc_id", "text")] if keep_text else []
    index = FingerprintIndex(docs.sparkSession)
    texts = index.blocks(docs if keep_text else docs.select("doc_id", "text"))
    replies = anchors = index.repeated_anchors(texts)
    n = 1 + (texts.agg(F.max("b")).first()[0] or 0)
    inner = sorted({n * i // BATCHES for i in range(1, BATCHES)} - {0})
    for lo, hi in zip([0, *inner], [*inner, n], strict=True):
        some = F.col("b").between(lo, hi - 1)
        replies = replies.union(index.merge(texts.where(some), anchors.where(some)))
    index.compact()
    out = index.kept(texts, replies, False, "text" if keep_text else "digest")
    if not more:
        return out.drop("carry")
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(more))
    at = out.withColumn("carry", F.from_json("carry", kinds))
    return at.select(*out.drop("carry").columns, *[F.col(f"carry.c{i}").alias(f.name) for i, f in enumerate(more)])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What dedup() leaves of every document; its docstring says how nulls, ties and short texts count."""
    return dedup(table(spark, sf_dir, "documents"))
