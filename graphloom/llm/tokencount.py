"""Unigram token counts: dynamic programming that words share along the prefixes of a trie."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import resident, table

MEMO = 1 << 18  # words that a worker keeps
BYTE_SCORE = -30.0  # of each byte of a character without a piece


class TrieCounter:
    """Number of pieces on the best unigram path of a word with its leading mark.

    A piece scores the negative logarithm of its rank plus two, since the vocabulary is ranked. The
    path with the largest sum wins, then the one of fewer pieces. A character that is no piece costs
    one piece a UTF-8 byte. Distinct words are taken in sorted order, which is the depth-first order of
    their trie: the forward scores of a prefix are computed once and kept while its subtree lasts.
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.score = {sp.id_to_piece(i): -math.log(k + 2) for k, i in enumerate(own)}
        self.longest = max(map(len, self.score))
        self.memo: dict[str, int] = {}

    def insert(self, words: list[str]) -> None:
        """Terminal counts of these distinct words into memo."""
        if len(self.memo) + len(words) > MEMO:
            self.memo = {}
        last, forward = "", [(0.0, 0)]
        for w in sorted(words):
            marked = "▁" + w
            k = 0
            for x, y in zip(last, marked, strict=False):
                if x != y:
                    break
                k += 1
            del forward[k + 1 :]
            for j in range(k + 1, len(marked) + 1):
                n = len(marked[j - 1].encode("utf-8", "replace"))
                s, c = forward[j - 1]
                best = (s + n * BYTE_SCORE, c - n)
                for i in range(max(0, j - self.longest), j):
                    if (p := self.score.get(marked[i:j])) is not None:
                        s, c = forward[i]
                        best = max(best, (s + p, c - 1))
                forward.append(best)
            last = marked
            self.memo[w] = -forward[-1][1]

    def counts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        split = [[] if t is None else t.split() for t in texts]
        if new := {w for s in split for w in s if w not in self.memo}:
            if len(self.memo) + len(new) > MEMO:
                new = {w for s in split for w in s}
                self.memo = {}
            self.insert(list(new))
        return [(len(s), sum(map(self.memo.__getitem__, s))) for s in split]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens for each row; null and empty texts have 0 of both. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = resident(("count", path), lambda: TrieCounter(path))
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                got = counter.counts(list(part["text"]))
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_words": [x[0] for x in got], "n_tokens": [x[1] for x in got]})

    # doc_id as text: pandas would make doubles of ids beside a null
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, n_words long, n_tokens long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of every document; null doc_ids and repeated rows stay, see token_counts()."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
