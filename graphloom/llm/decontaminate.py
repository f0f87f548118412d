"""Benchmark decontamination: latent semantic and exact TF-IDF candidates, then longest common subsequence and answer checks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import resident, stored, table, trim

SLOTS, BASIS = 1 << 16, 1 << 13  # hashed terms, of idf and of the basis
RANK, OVERSAMPLE, POWERS = 64, 8, 2
STEP, SPAN = 10, 3  # a passage is SPAN steps of words; passages start at each step
COSINE = 0.4  # of a passage and an item: latent product over the passage's whole TF-IDF norm
TAIL = 0.2  # norm of an item's lightest terms that the index may leave out; its threshold falls by as much
LCS = 0.6  # share of the item's words, in order, in the text around the passage
LCS_ANSWER = 0.45  # the same, where the item's answer (its last words) is there in full
ANSWER_WORDS = 6
SHORT = 5  # an item of fewer words is found only where it is the whole text
ITEMS, ITEM_BYTES = 20_000, 16 << 20  # items held at once, and bytes of them; more are searched in further passes
CELLS = 1 << 16  # passages times points that are compared at once, as a processor's cache holds
COMMON = 64  # terms of most points, which are multiplied out instead of looked up
SEED = 9
WORDS = 1 << 18  # different words that a task counts at once
PAGE = 1 << 15  # words of texts that are compared at once
LATENT_GROUPS, EXACT_GROUPS = 8, 16  # of points that share an upper bound a term
NEAR = 64  # words of an item that are sought in words shared by all items of a passage
SLACK = 1e-4  # of a bound in single precision, in shares of a passage's norm


# ASCII bytes that stand between words, and other such characters.
BETWEEN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
OTHER = "\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u00a0\u00ab\u00bb"


def term(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, SEED) or 1


def split(text: str | None) -> list[bytes]:
    """Lower-cased words: what stands between white space and punctuation."""
    if text is None:
        return []
    if not text.isascii():
        for c in OTHER:
            if c in text:
                text = text.replace(c, " ")
    return text.lower().encode("utf-8", "replace").translate(BETWEEN).split()


def terms(text: str | None) -> np.ndarray:
    """term() of each word. Hashing a word again is cheaper than finding it among many."""
    words = split(text)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    h[h == 0] = 1
    return h


def slots(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(SLOTS)).astype(np.int64)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := where.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def overlap(item: list[int], h: np.ndarray, at: int) -> float:
    """Share of the item's words in the best stretch of the text around the passage at `at`; 0 where it isn't held.

    First come upper bounds of that share: the item's words that occur around, and their longest common
    subsequence with all of the words around. Only what passes them is looked at stretch by stretch.
    """
    n, answer = len(item), item[-ANSWER_WORDS:]
    around = h[max(0, at - n) : at + STEP * SPAN + n].tolist()
    near = set(around)
    most = sum(map(near.__contains__, item))
    if most < LCS_ANSWER * n:
        return 0.0
    whole = all(x in near for x in answer) and any(around[i : i + len(answer)] == answer for i in range(len(around) - len(answer) + 1))
    least = (LCS_ANSWER if whole else LCS) * n
    if most < least or lcs(item, around) < least:
        return 0.0
    best, width = lcs(item, around[-(n + n // 4 + 2) :]), n + n // 4 + 2
    for i in range(0, max(1, len(around) - width + 1), max(1, n // 8)):
        best = max(best, lcs(item, around[i : i + width]))
    return best / n if best >= least else 0.0


class Index:
    """Inverted index of points' TF-IDF terms: finds every (passage, point) whose exact cosine reaches COSINE, whatever the number of points.

    A point's lightest terms, TAIL of its norm at most, have no postings. They can add no more than that norm to
    the cosine, so the point's threshold is lower by it and no pair is lost; some of less than COSINE come along.
    """

    def __init__(self, points: list[np.ndarray], idf: np.ndarray) -> None:
        self.idf, self.n = idf, len(points)
        self.least = np.full(self.n, np.inf)
        slot, point, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for k, h in enumerate(points):
            at, n = np.unique(slots(h), return_counts=True)
            x = n * idf[at]
            x = x / np.linalg.norm(x)
            order = np.argsort(x)
            tail = np.sqrt(np.cumsum(x[order] ** 2))
            cut = np.searchsorted(tail, TAIL, side="right")
            self.least[k] = COSINE - (tail[cut - 1] if cut else 0) - 1e-6
            keep = order[cut:]
            slot.append(at[keep])
            point.append(np.full(len(keep), k))
            weight.append(x[keep] * idf[at[keep]])
        self.lowest = self.least.min(initial=np.inf)
        slot, point, weight = np.concatenate(slot), np.concatenate(point), np.concatenate(weight)
        order = np.argsort(slot, kind="stable")
        self.slot, self.point, self.weight = slot[order], point[order], weight[order]
        self.degree = np.bincount(slot, minlength=SLOTS + 1)
        self.start = np.cumsum(self.degree) - self.degree
        common = np.argsort(self.degree)[-COMMON:]
        common = common[self.degree[common] > 8]
        self.dense, self.rank = np.zeros((len(common), self.n)), np.full(SLOTS + 1, -1)
        for i, c in enumerate(common):
            at = slice(self.start[c], self.start[c] + self.degree[c])
            self.dense[i, self.point[at]] = self.weight[at]
        self.rank[common] = np.arange(len(common))
        self.degree[common] = 0

    def pairs(self, s: np.ndarray, norm: np.ndarray, doc: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(passage, point) numbers; s: slots, SLOTS for none; norm: each passage's TF-IDF norm; doc: each step's text, all one if not given."""
        found, most = [], max(SPAN, CELLS // max(1, self.n))
        steps = -(-len(s) // STEP)
        for i in range(0, steps, most):  # a table of steps by points, of so many cells
            j = min(i + most, steps)
            end = min(j + SPAN - 1, steps)  # the last passages run on
            part = s[i * STEP : end * STEP]
            held = np.flatnonzero(self.degree[part])
            n = self.degree[part[held]]
            at = np.arange(n.sum()) + np.repeat(self.start[part[held]] - np.cumsum(n) + n, n)
            each = np.bincount(np.repeat(held // STEP * self.n, n) + self.point[at], self.weight[at], (end - i) * self.n).reshape(end - i, self.n).astype(float, copy=False)
            k = len(self.dense)
            if k:
                of = np.flatnonzero(self.rank[part] >= 0)
                each += np.bincount(of // STEP * k + self.rank[part[of]], minlength=(end - i) * k).reshape(end - i, k) @ self.dense
            sums = each[: j - i].copy()
            for k in range(1, SPAN):
                last = min(j - i, end - i - k)
                if doc is None or doc[i] == doc[i + k + last - 1]:
                    sums[:last] += each[k : k + last]
                else:
                    sums[:last] += each[k : k + last] * (doc[i : i + last] == doc[i + k : i + k + last])[:, None]
            # no point asks for less than the least threshold
            some = np.flatnonzero(sums.max(axis=1, initial=-1) >= self.lowest * norm[i:j])
            passage, point = np.nonzero(sums[some] >= self.least * norm[i:j][some, None])
            passage = some[passage]
            found.append((passage + i, point))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def grouped(points: np.ndarray, n: int) -> np.ndarray:
    """Number of each point's group, of n (a power of two) or fewer: halves along the widest coordinate, then halves of those."""
    groups = [np.arange(len(points))]
    while 0 < len(groups) < min(n, len(points)):
        each = []
        for g in groups:
            order = g[np.argsort(points[g, np.argmax(np.ptp(points[g], axis=0))], kind="stable")] if len(g) else g
            each += [order[: len(g) // 2], order[len(g) // 2 :]]
        groups = each
    out = np.zeros(len(points), dtype=np.int64)
    for i, g in enumerate(groups):
        out[g] = i
    return out


class Bounds:
    """What a slot can add at most to a passage's product with any point of a group, over what the point asks for.

    A passage whose sums stay below its norm in each group reaches no point, so nothing is lost by leaving it out.
    The columns are those of the latent products, then those of the index, then the slot's squared weight.
    """

    def __init__(self, basis: np.ndarray, weight: np.ndarray, points: np.ndarray, index: Index) -> None:
        self.table = np.zeros((SLOTS + 1, LATENT_GROUPS + EXACT_GROUPS + 1), np.float32)
        self.table[:SLOTS, -1] = weight**2
        if not len(points):
            return
        group = grouped(points, LATENT_GROUPS)
        order = np.argsort(group, kind="stable")
        first = np.searchsorted(group[order], np.arange(group.max() + 1))
        some = points[order].T / np.float32(COSINE)
        most = np.zeros((BASIS, len(first)), np.float32)
        step = max(1, (CELLS << 4) // len(points))
        for i in range(0, BASIS, step):
            most[i : i + step] = np.maximum.reduceat(basis[i : i + step] @ some, first, axis=1)
        self.table[:SLOTS, : len(first)] = most[np.arange(SLOTS) % BASIS] * weight[:, None]
        exact = np.zeros((SLOTS + 1, EXACT_GROUPS))
        np.maximum.at(exact, (index.slot, grouped(points, EXACT_GROUPS)[index.point]), index.weight / np.maximum(index.least[index.point], 1e-9))
        self.table[:, LATENT_GROUPS:-1] = exact

    def passing(self, s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each passage: its TF-IDF norm, and whether it may reach a point in the latent space, and by the index."""
        each = self.table.take(s, axis=0).reshape(len(doc), STEP, -1).sum(axis=1)
        wide = each.copy()
        for i in range(1, SPAN):
            wide[:-i] += each[i:] * (doc[i:] == doc[:-i])[:, None]
        norm = np.maximum(np.sqrt(wide[:, -1]), 1e-12)
        most = (1 - SLACK) * norm
        return norm, wide[:, :LATENT_GROUPS].max(axis=1) >= most, wide[:, LATENT_GROUPS:-1].max(axis=1) >= most


def pieces(h: np.ndarray) -> list[np.ndarray]:
    """The whole item and, of one longer than a text's passage, passages of that length, the last one to its end."""
    width = STEP * SPAN
    return [h, *(h[min(i, len(h) - width) :][:width] for i in range(0, len(h) - width + STEP, STEP))] if len(h) > width else [h]


def inverse_frequency(docs: DataFrame) -> np.ndarray:
    """idf of each slot over every document: each document counts for each of its different words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resident()
        held, seen = np.zeros(SLOTS + 1, dtype=np.int64), Counter()

        def add() -> None:
            at = slots(np.fromiter(map(term, seen), np.uint64, len(seen)))
            held[:SLOTS] += np.bincount(at, np.fromiter(seen.values(), np.int64, len(seen)), SLOTS).astype(np.int64)
            seen.clear()

        for b in batches:
            for t in b["text"]:
                seen.update(set(split(t)))
                held[SLOTS] += 1
                if len(seen) > WORDS:
                    add()
        add()
        at = np.flatnonzero(held)
        yield pd.DataFrame({"slot": at.astype(np.int32), "n": held[at]})

    got = docs.select("text").mapInPandas(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # SLOTS rows at most
    df = np.zeros(SLOTS + 1)
    df[got["slot"].to_numpy()] = got["n"].to_numpy()
    return np.log((df[SLOTS] + 1) / (np.minimum(df[:SLOTS], df[SLOTS]) + 1)) + 0.1


def passages(benchmark: DataFrame) -> DataFrame:
    """(text) of the basis's passages: all those of every item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            split = [t.split() for t in b["text"]]
            if out := [" ".join(w[i : i + STEP * SPAN]) for w in split for i in range(0, len(w), STEP * SPAN)]:
                yield pd.DataFrame({"text": out})

    return benchmark.select("text").mapInPandas(run, "text string")


def _summed(passages: DataFrame, idf: np.ndarray, right: np.ndarray, gram: bool) -> np.ndarray:
    """A' A right, or with gram right' A' A right, A being the passages' normalised TF-IDF rows: partial sums of each task, added up by row."""
    held = passages.sparkSession.sparkContext.broadcast((idf, right))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, r = held.value
        out = np.zeros((r.shape[1] if gram else BASIS, r.shape[1]))
        resident()
        for b in batches:
            for t in b["text"]:
                s = slots(terms(t))
                if not len(s):
                    continue
                at, of = np.unique(s % BASIS, return_inverse=True)
                x = np.bincount(of, weight[s])
                x = x / np.linalg.norm(x)
                y = x @ r[at]
                if gram:
                    out += np.outer(y, y)
                else:
                    out[at] += np.outer(x, y)
        at = np.flatnonzero(np.abs(out).sum(axis=1))
        if len(at):  # a task may have no passage
            yield pd.DataFrame({"row": at.astype(np.int32), "x": list(out[at])})

    k = right.shape[1]
    part = passages.select("text").mapInPandas(run, "row int, x array<double>")
    got = part.groupBy("row").agg(*[F.sum(F.get("x", F.lit(i))).alias(f"c{i}") for i in range(k)]).toPandas()  # BASIS rows at most
    out = np.zeros((k if gram else BASIS, k))
    if len(got):
        out[got["row"].to_numpy()] = got[[f"c{i}" for i in range(k)]].to_numpy()
    del got
    held.destroy()
    trim()
    return out


def latent_basis(passages: DataFrame, idf: np.ndarray, seed: int = 17) -> np.ndarray:
    """BASIS x RANK right singular vectors of the passages' TF-IDF matrix, by distributed randomised SVD."""
    q = np.random.default_rng(seed).normal(size=(BASIS, RANK + OVERSAMPLE))
    for _ in range(POWERS):
        q, _ = np.linalg.qr(_summed(passages, idf, q, False))
    value, vector = np.linalg.eigh(_summed(passages, idf, q, True))
    return (q @ vector[:, np.argsort(value)[::-1][:RANK]]).astype(np.float32)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, overlap: documents that hold a benchmark item or a paraphrase of it; one row a pair.

    Every passage of every whole text is projected and compared with every item by cosine; since a basis of
    fixed rank loses items as their number grows, an exact index of the items' terms is searched too. Passages that by
    an upper bound reach no item in either (see Bounds) are neither projected nor looked up. Items longer
    than a passage are also compared passage by passage, so that their length doesn't matter. A candidate is
    verified on the words around it: the longest common subsequence must hold LCS of the item's words, or
    LCS_ANSWER of them and the whole answer in one piece. Items of fewer than SHORT words could be there by chance
    and match only a text that is nothing else. idf counts all documents; the basis is fitted to all of the
    benchmark's passages, since only products with items are asked of it. Null and empty texts and items, and items without item_id, match
    nothing; rows of one doc_id give one row an item, with the larger overlap; an empty table gives no rows.
    """
    docs, items = docs.select("doc_id", "text"), benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    idf = inverse_frequency(docs)
    basis = latent_basis(stored(passages(items), "passages"), idf)
    own, out, last = items.distinct(), None, None
    longest = own.agg(F.max(F.octet_length("text"))).first()[0] or 1
    page = max(1, min(ITEMS, ITEM_BYTES // longest))
    while True:  # an item_id may have several texts, on both sides of a block's end
        later = own if last is None else own.where((F.col("item_id") > last["item_id"]) | (F.col("item_id") == last["item_id"]) & (F.col("text") > F.lit(last["text"])))
        batch = later.orderBy("item_id", "text").limit(page).collect()
        last = batch[-1] if batch else None
        found = _search(docs, basis, idf, [(r["item_id"], h) for r in batch if len(h := terms(r["text"]))])
        out = found if out is None else out.union(found)
        if len(batch) < page:
            return out.groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap"))


def pages(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(doc_ids, terms) of texts that have any, PAGE words at a time or one text more."""
    keys, each, n = [], [], 0
    for b in batches:
        for key, t in zip(b["doc_id"], b["text"], strict=True):
            h = terms(t)
            if len(h):
                keys.append(key)
                each.append(h)
                n += len(h)
            if n >= PAGE:
                yield keys, each
                keys, each, n = [], [], 0
    if keys:
        yield keys, each


def _search(docs: DataFrame, basis: np.ndarray, idf: np.ndarray, items: list[tuple[int, np.ndarray]]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast((basis, items, idf))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resident()
        basis, every, weight = held.value
        base = basis[np.arange(SLOTS) % BASIS] * weight[:, None].astype(np.float32)
        own = [x for x in every if len(x[1]) >= SHORT]
        whole: dict[bytes, list[int]] = {}
        for i, h in every:
            if len(h) < SHORT:
                whole.setdefault(h.tobytes(), []).append(i)
        parts = [(k, x) for k, (_, h) in enumerate(own) for x in pieces(h)]
        item = np.array([k for k, _ in parts], dtype=np.int64)
        index = Index([x for _, x in parts], weight)
        base = np.concatenate([base, np.zeros((1, base.shape[1]), np.float32)])
        points = np.array([base[slots(x)].sum(axis=0) for _, x in parts], dtype=np.float32).reshape(len(parts), base.shape[1])
        points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
        bounds, lists = Bounds(basis, weight, points, index), [h.tolist() for _, h in own]
        reach = max((len(x) for x in lists if len(x) <= NEAR), default=0)

        for keys, each in pages(batches):
            rows = [(key, i, 1.0) for key, h in zip(keys, each, strict=True) if len(h) < SHORT for i in whole.get(h.tobytes(), [])]
            size = np.array([len(h) for h in each])
            steps = -(-size // STEP)
            start = np.cumsum(steps) - steps
            doc = np.repeat(np.arange(len(each)), steps)
            s = np.full(len(doc) * STEP, SLOTS)
            s[np.arange(size.sum()) + np.repeat(start * STEP - np.cumsum(size) + size, size)] = slots(np.concatenate(each))
            span, latent, near = bounds.passing(s, doc)
            some = np.flatnonzero(latent)
            wide = np.zeros((len(some), base.shape[1]), np.float32)
            s, end = s.reshape(len(doc), STEP), len(doc) - 1
            for i in range(SPAN):
                at = np.minimum(some + i, end)
                same = np.flatnonzero((some + i <= end) & (doc[at] == doc[some]))
                wide[same] += base[s[at[same]]].sum(axis=1)
            at, of = np.nonzero(wide @ points.T >= COSINE * span[some, None])
            # steps of the passages that the index may find; where others lie between, a text falls into several
            look = near.copy()
            for i in range(1, SPAN):
                look[i:] |= near[:-i]
            look = np.flatnonzero(look)
            apart = (np.diff(look, prepend=-1) > 1) | (np.diff(doc[look], prepend=-1) > 0)
            passage, point = index.pairs(s[look].ravel(), span[look], np.cumsum(apart)) if len(look) else (look, look)
            passage = look[passage]
            exact = passage[near[passage]], point[near[passage]]
            done: dict[tuple[int, int], float] = {}
            found = {(i, k) for a, b in ((some[at], of), exact) for i, k in zip(a.tolist(), item[b].tolist(), strict=True)} if own else set()
            last, around = -1, set()
            for i, k in sorted(found):
                d = int(doc[i])
                at = (i - int(start[d])) * STEP
                if i != last:  # words near the passage, for the first upper bound of overlap() at once for its items
                    last, around = i, set(each[d][max(0, at - reach) : at + STEP * SPAN + reach].tolist())
                n = len(lists[k])
                if n <= reach and sum(map(around.__contains__, lists[k])) < LCS_ANSWER * n:
                    continue
                if (d, k) not in done and (share := overlap(lists[k], each[d], at)):
                    done[d, k] = share
            rows += [(keys[d], own[k][0], share) for (d, k), share in done.items()]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "overlap"])

    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return named.mapInPandas(run, "doc_id string, item_id long, overlap double").withColumn("doc_id", F.col("doc_id").cast("long"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, overlap of every document that holds an item of the benchmark; see leaks() for nulls, short items and repeated rows."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
