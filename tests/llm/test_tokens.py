"""Token operators against whole-text encoding and brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import bpe, tokencount, tokenfile

DOCS = "doc_id long, text string, ids string"
TEXTS = [None, "", " ", "a  b", "x<|endoftext|> y " * 30, "it's \n\n the  end 12 " * 200, "Émile ΣΑΣ   q́ " * 90, "<|startoftext|>A b\t\r\nc" * 60, "word " * 4000, "\x1c \x85 a" * 50]


def docs(spark, own, sf):
    rows = [(3 * i + 1, t, "x") for i, t in enumerate(TEXTS)]
    rows += [(1000 + r.doc_id, r.text, None) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    return rows, spark.createDataFrame(rows, DOCS)


def test_bpe_is_that_of_whole_texts(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, df = docs(spark, None, "sf0.001")
    got = {r.doc_id: r for r in bpe.encode_decode(df, public_tokenizers.path("byte_bpe_50k.json"), True).collect()}
    for k, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[k].ids == ids, k
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded == t.decode(ids, skip_special_tokens=False) and got[k].n_tokens == len(ids)


def test_token_file(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows, df = docs(spark, None, "sf0.001")
    path = tokenfile.scratch(spark, "t")
    tokenfile.write(df, public_tokenizers.path("word_bpe_49k.json"), 2, path)
    got, at = {r.doc_id: r for r in tokenfile.read(spark, path).collect()}, 0
    for k, text, _ in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[k].start, got[k].n_tokens, zlib.crc32(bytes(got[k].ids))) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), k
        at += len(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=700))
def test_elias_fano(steps):
    values = np.cumsum(steps)
    ef = tokenfile.EliasFano.of(values)
    assert ef.all().tolist() == values.tolist() == [ef.select(i) for i in range(len(values))]


def test_counts_are_those_of_each_word_alone(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows, df = docs(spark, None, "sf0.001")
    c = tokencount.TrieCounter(path)

    def alone(w):
        best = [(0.0, 0)]
        w = "▁" + w
        for j in range(1, len(w) + 1):
            n = len(w[j - 1].encode())
            best.append(max([(best[j - 1][0] + n * tokencount.BYTE_SCORE, best[j - 1][1] - n)] + [(best[i][0] + c.score[w[i:j]], best[i][1] - 1) for i in range(j) if w[i:j] in c.score]))
        return -best[-1][1]

    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(df, path).collect()}
    for k, text, _ in rows[:40]:
        assert got[k] == sum(map(alone, (text or "").split()))
