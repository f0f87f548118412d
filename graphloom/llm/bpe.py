"""BPE encoding and decoding with content-defined chunks that documents share."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import resident, table

WINDOW = 16  # bytes under the rolling hash
MEAN_CHUNK = 128  # spaces between two cuts, on average
CACHE_BYTES = 96 << 20  # chunks that a worker keeps
WHITE = frozenset(bytes([b]) for b in b" \t\n\v\f\r\x1c\x1d\x1e\x1f") | {b""}
JOIN_MEMO = 1 << 16  # joins, and words at joins, that a worker keeps
_POWERS = (np.uint32(0x01000193) ** np.arange(WINDOW, dtype=np.uint32)).astype(np.uint32)


def cuts(data: bytes) -> list[int]:
    """Byte positions of spaces at which the rolling hash of the bytes before asks for a cut."""
    if len(data) <= WINDOW:
        return []
    raw = np.frombuffer(data, dtype=np.uint8)
    at = np.flatnonzero(raw[WINDOW:] == 0x20) + WINDOW
    h = np.zeros(len(at), dtype=np.uint32)
    for i in range(WINDOW):
        h += raw[at - 1 - i] * _POWERS[i]
    return at[(h * np.uint32(0x9E3779B1)) >> np.uint32(16) < 65536 // MEAN_CHUNK].tolist()


def may_join(before: bytes, after: bytes) -> bool:
    """Whether a space with no white space around it stands at the cut: only there can a boundary be looked for."""
    return before[-1:] not in WHITE and after[:1] == b" " and len(after) > 1 and after[1:2] not in WHITE


def token_bytes(tokenizer: Tokenizer) -> list[bytes]:
    """Bytes that each id stands for: a byte-level token spells byte values with printable characters, an added one itself."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    alphabet = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted({*range(0x100)} - {*plain}))}
    added = tokenizer.get_added_tokens_decoder()
    out = [b""] * (1 + max(tokenizer.get_vocab().values()))
    for token, i in tokenizer.get_vocab().items():
        out[i] = token.encode() if i in added else bytes(map(alphabet.__getitem__, token))
    return out


class ChunkCoder:
    """Encodes and decodes whole texts; each chunk once while it is cached."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: OrderedDict[bytes, tuple[int, bytes, bytes]] = OrderedDict()
        self.held = 0
        self.joins: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[bytes, list[int]] = {}
        self.spelled = token_bytes(self.tokenizer)
        self.digits = [b"%d" % i for i in range(len(self.spelled))]

    def chunks(self, text: str) -> list[bytes]:
        """The text cut where its bytes say so."""
        data, out, start = text.encode("utf-8", "replace"), [], 0
        for at in cuts(data):
            if may_join(data[at - 1 : at], data[at : at + 2]):
                out.append(data[start:at])
                start = at
        return [*out, data[start:]] if len(data) > start else out

    def encoded(self, new: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)]

    def repaired(self, texts: list[list[bytes]]) -> list[list[bytes]]:
        """Chunks whose joins agree: the last word before and the first after give the ids together that they give apart.

        A pre-token holds no space but its first byte, so what those two words say holds for the chunks. Chunks
        whose join doesn't agree become one, until all do.
        """
        while True:
            sides = [[(a[max(a.rfind(b" "), 0) :], b[: b.find(b" ", 1) if b.find(b" ", 1) > 0 else len(b)]) for a, b in zip(t, t[1:])] for t in texts]
            new = {j for s in sides for j in s}.difference(self.joins)
            if len(self.joins) + len(new) > JOIN_MEMO:
                self.joins, new = {}, {j for s in sides for j in s}
            if len(self.words) > JOIN_MEMO:
                self.words = {}
            some = list({w for j in new for w in j}.difference(self.words))
            self.words.update(zip(some, self.encoded(some), strict=True))
            new = list(new)
            for j, ids in zip(new, self.encoded([a + b for a, b in new]), strict=True):
                self.joins[j] = ids == self.words[j[0]] + self.words[j[1]]
            if all(self.joins[j] for s in sides for j in s):
                return texts
            texts = [self.merged(t, s) for t, s in zip(texts, sides, strict=True)]

    def merged(self, chunks: list[bytes], sides: list[tuple[bytes, bytes]]) -> list[bytes]:
        out = chunks[:1]
        for c, j in zip(chunks[1:], sides, strict=True):
            if self.joins[j]:
                out.append(c)
            else:
                out[-1] += c
        return out

    def learn(self, pieces: list[bytes]) -> dict[bytes, tuple[int, bytes, bytes]]:
        """piece: number of ids, ids as text, decoded bytes."""
        found, new = {}, []
        for p in dict.fromkeys(pieces):
            if hit := self.cache.get(p):
                self.cache.move_to_end(p)
                found[p] = hit
            else:
                new.append(p)
        for p, i in zip(new, self.encoded(new), strict=True):
            d = b"".join(map(self.spelled.__getitem__, i))
            d = p if d == p else d.decode("utf-8", "replace").encode()
            found[p] = self.cache[p] = (len(i), b",".join(map(self.digits.__getitem__, i)), d)
            self.held += 4 * len(p) + 300
        while self.held > CACHE_BYTES and self.cache:
            self.held -= 4 * len(self.cache.popitem(last=False)[0]) + 300
        return found


def encode_decode(docs: DataFrame, path: str, keep_texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; with keep_texts also ids and decoded. An empty table gives no rows.

    Null counts as empty: no ids. Rows that repeat stay rows, extra columns are ignored. No shuffle:
    a worker keeps the chunks it has met, up to CACHE_BYTES, over all the tasks that it runs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = resident(("bpe", path), lambda: ChunkCoder(path))
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                split = c.repaired([[] if t is None else c.chunks(t) for t in part["text"]])
                known = c.learn([p for s in split for p in s])
                got = [[known[p] for p in s] for s in split]
                ids, text = [b",".join(x[1] for x in g) for g in got], [b"".join(x[2] for x in g) for g in got]
                out = {"doc_id": part["doc_id"], "n_tokens": [sum(x[0] for x in g) for g in got], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in text]}
                if keep_texts:
                    out |= {"ids": [[int(y) for y in x.split(b",") if y] for x in ids], "decoded": [x.decode() for x in text]}
                yield pd.DataFrame(out)

    # doc_id as text: pandas would make doubles of ids beside a null
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_texts)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_tokens and digests of the ids and the decoded text of every document; a null text counts as empty, null doc_ids and repeated rows stay."""
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
