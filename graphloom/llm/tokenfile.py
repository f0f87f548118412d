"""Token-id files: concatenated ids, with document boundaries in Elias-Fano code."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import resident, scratch, table

BLOCK_IDS = 1 << 16  # a block of the file is closed at so many ids; larger rows cost the JVM much memory
SHARD_BYTES = 256 << 20  # bytes of text a shard, about; there is one for each shuffle partition at least
SAMPLE = 256  # select: one stored position for so many ones
MEMO, TOGETHER = 1 << 18, 256  # pre-tokens that an encoder keeps; new ones in one call
PAGE = 128  # texts that are encoded together
FILE = "shard int, block int, at long, n_ids long, n_docs long, n_null long, first_id long, ids binary, low_bits int, low binary, high binary, picks binary, key_low_bits int, key_low binary, key_high binary, key_picks binary"
_KIND = {k: "".join(re.escape(chr(c)) for c in range(0x21, 0x300) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
# The tokenizer's pre-tokens of a lower-cased text.
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_KIND['L']}]+|[{_KIND['N']}]|[^\s{_KIND['L']}{_KIND['N']}]+")
# Characters that NFC and lower case leave one character each, and the usual white space.
SAFE = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u02ff\u2010-\u2027\u2030-\u205e\u20ac]*").fullmatch
SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], dtype=np.int64)  # place of the k-th one in a byte


class EliasFano:
    """A rising sequence in about 2 + log2(last / n) bits an entry; select(i) is entry i."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, picks: bytes):
        self.n, self.low_bits, self.low, self.high, self.picks = n, low_bits, low, high, picks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        bits = max(0, int(values[-1] // n).bit_length() - 1) if n else 0
        low = (((values & ((1 << bits) - 1))[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
        ones = (values >> bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """Entry i, from the nearest stored position; reads a few bytes only."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(np.frombuffer(self.picks, "<u4")[i // SAMPLE]), i % SAMPLE
        byte, value = at >> 3, self.high[at >> 3] >> (at & 7) << (at & 7)
        while (c := value.bit_count()) <= left:
            left -= c
            byte += 1
            value = self.high[byte]
        for _ in range(left):
            value &= value - 1
        one = 8 * byte + (value & -value).bit_length() - 1
        first = i * self.low_bits
        chunk = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], "little")
        return (one - i) << self.low_bits | chunk >> (first & 7) & ((1 << self.low_bits) - 1)

    @cached_property
    def _ones(self) -> tuple[np.ndarray, np.ndarray]:
        """The upper bits' bytes, and the number of ones up to each byte's end."""
        high = np.frombuffer(self.high, np.uint8)
        return high, np.cumsum(np.bitwise_count(high), dtype=np.int64)

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """Entries i: a search over the ones of whole bytes, then a table within the byte."""
        i = np.asarray(i, dtype=np.int64)
        if not len(i):
            return i
        high, upto = self._ones
        byte = np.searchsorted(upto, i, side="right")
        before = upto[byte] - np.bitwise_count(high[byte])
        value = 8 * byte + SELECT[high[byte], i - before] - i << self.low_bits
        if self.low_bits:
            low = np.frombuffer(self.low + bytes(8), np.uint8)
            first = i * self.low_bits
            got = np.zeros(len(i), dtype=np.int64)
            for k in range((self.low_bits + 14) // 8):  # low_bits is under 56 for any sequence of this file
                got |= low[(first >> 3) + k].astype(np.int64) << 8 * k
            value |= got >> (first & 7) & ((1 << self.low_bits) - 1)
        return value

    def all(self) -> np.ndarray:
        """Every entry."""
        return self.select_many(np.arange(self.n))


class WordEncoder:
    """Ids of whole texts as the tokenizer gives them, from its pre-tokens, which are kept.

    Texts of plain characters are taken apart here as the tokenizer does it. Of other texts only the words with
    such characters go to the tokenizer whole: it drops white space, so words are encoded apart. New pre-tokens
    are encoded many at once; each ends with its only token of a word end.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces: dict[str, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocab.values()), dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def split(self, text: str, odd: set[str]) -> list[str]:
        """Pre-tokens; a word that isn't plain stays whole, with a space before it, and goes to odd."""
        plain = not any(t in text for t in self.added)
        if plain and SAFE(text):
            return PIECE.findall(text.lower())
        out = []
        for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
            if SAFE(w) and (plain or not any(t in w for t in self.added)):
                out += PIECE.findall(w.lower())
            elif w:
                out.append(" " + w)
                odd.add(out[-1])
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        odd: set[str] = set()
        lists = ["" if t is None else self.split(t, odd) for t in texts]
        new = set().union(*lists).difference(self.pieces)
        if len(self.pieces) + len(new) > MEMO:
            self.pieces, new = {}, set().union(*lists)
        self.learn(list(new.difference(odd)), list(new.intersection(odd)))
        return [b"".join(map(self.pieces.__getitem__, x)) for x in lists]

    def learn(self, new: list[str], odd: list[str]) -> None:
        groups = [new[i : i + TOGETHER] for i in range(0, len(new), TOGETHER)]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            end = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            if len(end) == len(g) and end[-1] == len(raw):
                self.pieces.update(zip(g, (raw[i:j] for i, j in zip([0, *end], end, strict=False)), strict=True))
            else:  # a vocabulary without word ends
                odd += g
        self.pieces.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(odd, self.tokenizer.encode_batch_fast([w.removeprefix(" ") for w in odd], add_special_tokens=False), strict=True))


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Writes the ids of the rows, in ascending doc_id order, as blocks of shards under path.

    Shards follow doc_id ranges, so shard and block order is document order; rows without doc_id come first,
    and rows of one doc_id in the order of their texts. Each block holds at most BLOCK_IDS ids and one
    document more; its boundaries and doc_ids are Elias-Fano coded. Null and empty texts have the end id
    alone. Other columns are ignored; an empty table gives no block.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, shard, block, start = resident(("ids", tokenizer), lambda: WordEncoder(tokenizer)).encode, TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], dtype="<u4").tobytes()
        total, ids, sizes, keys, null = 0, [], [], [], 0

        def close():
            ends = EliasFano.of(np.cumsum(np.array(sizes, dtype=np.int64)))
            first = keys[0] if keys else 0
            of = EliasFano.of(np.array(keys, dtype=np.int64) - first)
            row = (shard, block, start, sum(sizes), len(sizes), null, first, b"".join(ids), ends.low_bits, ends.low, ends.high, ends.picks, of.low_bits, of.low, of.high, of.picks)
            return pd.DataFrame([row], columns=[c.split()[0] for c in FILE.split(", ")])

        def rows() -> Iterator[tuple]:
            for b in batches:
                for i in range(0, len(b), PAGE):
                    p = b.iloc[i : i + PAGE]
                    yield from zip(p["doc_id"].isna(), p["key"], encode(list(p["text"])), strict=True)

        for none, key, x in rows():
            ids += (x, end)
            sizes.append(len(x) // 4 + 1)
            if none:
                null += 1
            else:
                keys.append(key)
            total += sizes[-1]
            if total >= BLOCK_IDS:
                yield close()
                start, block, total = start + total, block + 1, 0
                ids, sizes, keys, null = [], [], [], 0
        if sizes:
            yield close()

    ordered = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    # doc_id is null-able, and pandas would make doubles of it
    ordered = ordered.withColumn("key", F.coalesce("doc_id", F.lit(0)))
    ordered.mapInPandas(run, FILE).write.option("parquet.enable.dictionary", "false").option("parquet.block.size", 16 << 20).parquet(path)


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary) from the files under path; with digest, ids_crc32 instead of ids."""
    blocks = spark.read.schema(FILE).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row for each shard
    base, at = {}, 0
    for r in totals:
        base[r["shard"]] = at
        at += r["n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ends = EliasFano(r.n_docs, r.low_bits, r.low, r.high, r.picks)
                of = EliasFano(r.n_docs - r.n_null, r.key_low_bits, r.key_low, r.key_high, r.key_picks)
                first, held = base[r.shard] + r.at, memoryview(r.ids)
                for i in range(0, r.n_docs, 2048):
                    e = ends.select_many(np.arange(i, min(i + 2048, r.n_docs)))
                    s = np.concatenate([[ends.select(i - 1) if i else 0], e[:-1]])
                    own = np.arange(i, i + len(e)) - r.n_null
                    keys = pd.array(np.where(own >= 0, r.first_id + of.select_many(np.maximum(own, 0)) if of.n else 0, 0), dtype="Int64")
                    keys[own < 0] = pd.NA
                    out = {"doc_id": keys, "start": first + s, "n_tokens": e - s}
                    texts = [held[4 * x : 4 * y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                    yield pd.DataFrame(out | ({"ids_crc32": [zlib.crc32(x) for x in texts]} if digest else {"ids": [bytes(x) for x in texts]}))

    return blocks.mapInPandas(run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; null doc_ids come first, see write()."""
    path = scratch(spark, "tokens")
    write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, path)
    return read(spark, path, digest=True)
