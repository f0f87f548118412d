"""Cross-entropy difference: target and background bigram models over one vocabulary, from exact counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Hashes, pack, pack_rising, stored, table, unpack, unpack_rising

START = 1  # the word before a text's first
DISCOUNT, FLOOR = 0.4, 0.5
BLOCK = 180_000  # tokens after which a task closes a block of texts; larger rows cost the JVM much memory
PART = 1 << 23  # bytes of text for each part of the key space
LISTED = 1 << 20  # so many target ids are broadcast at most; more are joined


def key(word: bytes) -> int:
    """64-bit key of a word, odd."""
    return xxhash.xxh3_64_intdigest(word, 3) | 1


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit key of each bigram, even."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    for m in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(m)
    return (h ^ (h >> np.uint64(32))) & ~np.uint64(1)


def blocks(docs: DataFrame) -> DataFrame:
    """Texts of about BLOCK tokens a row: ids, lengths and target marks of the texts, distinct words and each token's place among them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, ids, marks, held, n, at, known = TaskContext.get().partitionId(), [], [], [], 0, 0, Hashes(key)

        def out() -> pd.DataFrame:
            word, token = np.unique(np.concatenate(held), return_inverse=True)
            size = np.array([len(x) for x in held], "<i8")
            return pd.DataFrame({"block": [task << 32 | at], "ids": [ids], "sizes": [pack(size)], "marks": [pack(np.array(marks, "u1"))], "words": [pack_rising(word)], "tokens": [pack(token.astype("<i4"))]})

        for b in batches:
            for name, t, good in zip(b["doc_id"], b["text"], b["target"], strict=True):
                w = [] if t is None else t.encode("utf-8", "replace").split()
                held.append(np.concatenate([np.array([START], np.uint64), known.array(w)]))
                ids.append(name)
                marks.append(good)
                n += len(held[-1])
                if n >= BLOCK:
                    yield out()
                    ids, marks, held, n, at = [], [], [], 0, at + 1
        if held:
            yield out()

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "target").mapInPandas(run, "block long, ids array<string>, sizes binary, marks binary, words binary, tokens binary")


class Block:
    """A block's distinct keys: words first, then bigrams; `order` sorts them."""

    def __init__(self, r) -> None:
        self.size, self.mark = unpack(r.sizes, "<i8"), unpack(r.marks, "u1")
        self.word, self.token = unpack_rising(r.words), unpack(r.tokens, "<i4")
        self.text = np.repeat(np.arange(len(self.size)), self.size)
        self.at = np.flatnonzero(self.text[1:] == self.text[:-1]) + 1  # tokens after the first of their text
        x = self.word[self.token]
        two, self.first, self.pair = np.unique(pair(x[self.at - 1], x[self.at]), return_index=True, return_inverse=True)
        self.key = np.concatenate([self.word, two])
        self.order = np.argsort(self.key)

    def edges(self, parts: int) -> list[int]:
        """Where the sorted keys of each part begin and end."""
        inner = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
        return [0, *np.searchsorted(self.key[self.order], inner).tolist(), len(self.key)]


def counts(held: DataFrame, parts: int) -> DataFrame:
    """(block, part, background, target, v, n_background, n_target): for each block and part the corpus counts of its keys, in their order.

    v, n_background and n_target, in one row of each part, count the part's different words and their tokens.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                own = Block(r)
                count = []
                for weight in (None, own.mark[own.text]):
                    word = np.bincount(own.token, weight, len(own.word))
                    two = np.bincount(own.pair, None if weight is None else weight[own.at], len(own.key) - len(own.word))
                    count.append(np.concatenate([word, two])[own.order].astype("<u4"))
                key, edge = own.key[own.order], own.edges(parts)
                rows = [(r.block, i, pack_rising(key[a:z]), pack(count[0][a:z]), pack(count[1][a:z])) for i, (a, z) in enumerate(zip(edge, edge[1:])) if z > a]
                yield pd.DataFrame(rows, columns=["block", "part", "keys", "background", "target"])

    def total(b: pd.DataFrame) -> pd.DataFrame:
        each = [unpack_rising(x) for x in b["keys"]]
        size = [len(x) for x in each]
        key, of = np.unique(np.concatenate(each), return_inverse=True)
        word = key & np.uint64(1) == 1
        out = pd.DataFrame({"block": b["block"], "part": b["part"]})
        for side in ("background", "target"):
            n = np.bincount(of, np.concatenate([unpack(x, "<u4") for x in b[side]]), len(key)).astype("<i8")
            out[side] = [pack(x) for x in np.split(n[of], np.cumsum(size)[:-1])]
            out[f"n_{side}"] = [int(n[word].sum())] + [0] * (len(b) - 1)
        return out.assign(v=[int(word.sum())] + [0] * (len(b) - 1))

    sent = held.mapInPandas(send, "block long, part int, keys binary, background binary, target binary")
    return sent.groupBy("part").applyInPandas(total, "block long, part int, background binary, target binary, v long, n_background long, n_target long")


def losses(own: Block, n: np.ndarray, total: float, v: int) -> np.ndarray:
    """Negative log probability of each distinct bigram, backed off to a smoothed word model; n: corpus counts of the block's keys."""
    word, two = n[: len(own.word)], n[len(own.word) :]
    at = own.at[own.first]
    uni, before = (word[own.token[at]] + FLOOR) / (total + FLOOR * v), word[own.token[at - 1]]
    return -np.log((two * (1 - DISCOUNT) + DISCOUNT * before * uni + uni) / (before + 1))


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (target less background, per token) for each row.

    target: doc_id of texts of the wanted kind; the background is every text. Lower is nearer the target. The
    models share one vocabulary and are matched in size: target counts are weighted so that both hold as many
    tokens, else smoothing alone would set them apart. Without target texts that model is uniform.
    Null, empty and white texts have losses and score 0. Rows that repeat count as often as they occur and each
    get a row; a null doc_id is never a target. Other columns are ignored; an empty table gives no rows.
    Counts are exact but for words or bigrams whose 64-bit hashes agree. Each block of texts sends its distinct
    keys to their parts of the key space and gets the corpus counts back; the number of parts grows with the
    texts, and no table is gathered whole.
    """
    own = target.select("doc_id").where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    if own.count() <= LISTED:
        own = F.broadcast(own)
    docs = docs.select("doc_id", "text")
    parts = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART
    held = stored(blocks(docs.join(own, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))), "lm-blocks")
    found = stored(counts(held, parts), "lm-counts")
    v, few, all_ = (x or 0 for x in found.agg(F.sum("v"), F.sum("n_target"), F.sum("n_background")).first())

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        r = next(left.itertuples())
        own, right = Block(r), right.sort_values("part")
        n = own.size - 1
        mean = []
        for side, weight in (("target", all_ / few if few else 0.0), ("background", 1.0)):
            count = np.empty(len(own.key))
            count[own.order] = np.concatenate([unpack(x, "<i8") for x in right[side]])
            mean.append(np.bincount(own.text[own.at], losses(own, count * weight, all_ if weight else 0, v)[own.pair], len(n)) / np.maximum(n, 1))
        return pd.DataFrame({"doc_id": list(r.ids), "n_tokens": n, "target_loss": mean[0], "background_loss": mean[1], "score": mean[0] - mean[1]})

    out = held.groupBy("block").cogroup(found.select("block", "part", "target", "background").groupBy("block")).applyInPandas(score, "doc_id string, n_tokens long, target_loss double, background_loss double, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, both losses and score of every document; the target is the texts labelled good and not toxic."""
    labels = table(spark, sf_dir, "labels")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), labels.where("quality = 1 and toxic = 0"))
