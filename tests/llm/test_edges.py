"""Odd rows: nulls, ties, repeats, clashing columns, very long texts, empty tables."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from graphloom.llm import common, decontaminate, embedding, quality, simhash, substring, tokenfile

PASSAGE = " ".join(f"w{i}" for i in range(40))
ROWS = [(5, PASSAGE, "a"), (5, "x " + PASSAGE, "b"), (5, PASSAGE, "c"), (None, PASSAGE + " y", "d"), (1, None, "e"), (1, "", "f"), (7, "z " * 30, None)]


def digest(words):
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def test_substring_with_clashing_and_null_ids(spark):
    """Rows without doc_id come first, then rows of one doc_id in the order of their texts."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, starts string")
    want = sorted([(None, 41, 0), (1, 0, 0), (1, 0, 0), (5, 40, 40), (5, 40, 40), (5, 41, 40), (7, 30, 29)], key=str)  # the first z is in no later window
    got = substring.dedup(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in got), key=str) == want
    assert {r.kept_sha256 for r in got if (r.n_words, r.n_removed) == (41, 40)} == {digest(["x"])}
    index = substring.FingerprintIndex(spark)
    again = substring.remove(df, index.repeats(df)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)
    kept = substring.dedup(df.withColumnRenamed("starts", "my col"), keep_text=True).collect()
    assert {r["my col"] for r in kept} == {"a", "b", "c", "d", "e", "f", None} and len(kept) == len(ROWS)


def test_index_opens_again(spark):
    first = substring.FingerprintIndex(spark)
    first.repeats(spark.createDataFrame([(9, PASSAGE)], "doc_id long, text string"))
    second = substring.FingerprintIndex(spark, first.path)
    assert second.runs == first.runs and second.version == 1
    got = second.repeats(spark.createDataFrame([(1, "q " + PASSAGE)], "doc_id long, text string")).first()  # a batch counts after the history
    assert got.starts == list(range(1, 22))
    second.repeats(spark.createDataFrame([(2, " ".join(f"v{i}" for i in range(25)))], "doc_id long, text string"))
    old = second.runs
    second.compact()
    assert len(old) == 3 and len(second.runs) == 1 and second.runs[0][2] == sum(r[2] for r in old)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{first.path}/{old[0][0]}")


def test_pipeline_keeps_one_row_a_row(spark):
    df = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.without_repeats(spark, df, "")
    got = sorted(((r.doc_id, r.text, r.source, r.n_chars) for r in out.collect()), key=str)
    assert got == sorted([(None, PASSAGE + " y", "d", len(PASSAGE) + 2), (1, None, "e", 0), (1, "", "f", 0), (5, "x", "b", 1), (7, "z", None, 1)], key=str)
    assert out.columns == df.columns
    one = cp.one_of_each_group(spark, df, "")
    assert one.where("doc_id is null").count() == 1 and one.where("doc_id = 5").count() == 3
    empty = df.limit(0)
    assert cp.without_repeats(spark, empty, "").count() == cp.one_of_each_group(spark, empty, "").count() == 0


def test_token_file_of_odd_rows(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(5, "b", 1), (None, "n 1", 1), (5, "a", 1), (None, None, 1), (2**60, "ẞİ x́ <|endoftext|>'S", 1), (-7, "word " * 3000, 1)]
    path = common.scratch(spark, "odd")
    tokenfile.write(spark.createDataFrame(rows, "doc_id long, text string, key int"), public_tokenizers.path("word_bpe_49k.json"), 2, path)
    at, want = 0, []
    for k, text in [(None, None), (None, "n 1"), (-7, "word " * 3000), (5, "a"), (5, "b"), (2**60, rows[4][1])]:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokenfile.read(spark, path, digest=True).collect()), key=lambda r: r[1]) == want
    path = common.scratch(spark, "none")
    tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), 2, path)
    assert tokenfile.read(spark, path).count() == 0


def test_selects_of_any_sequence():
    rng = np.random.default_rng(1)
    for top in (1, 300, 10**6, 10**12):
        values = np.sort(rng.integers(0, top, 1000))
        ef = tokenfile.EliasFano.of(values)
        at = rng.integers(0, 1000, 300)
        assert ef.select_many(at).tolist() == values[at].tolist() == [ef.select(int(i)) for i in at]
    assert tokenfile.EliasFano.of(np.zeros(0)).all().tolist() == []


def test_short_items_and_odd_rows_of_leaks(spark):
    items = spark.createDataFrame([(1, "cat"), (2, "the cat sat down"), (3, None), (None, PASSAGE), (4, "..."), (5, PASSAGE)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the cat sat", 0), (2, "Cat!", 0), (3, "the cat sat down", 0), (3, "the cat sat down", 0), (None, "q " + PASSAGE, 0), (4, "word " * 200_000 + PASSAGE, 0)], "doc_id long, text string, overlap int")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()), key=str)
    assert got == sorted([(2, 1), (3, 2), (None, 5), (4, 5)], key=str)


def test_quality_on_held_out_labels(spark):
    """Documents of the given tables that training doesn't see; clashing labels, no labels, odd texts."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where(quality.held_out(docs.doc_id)).select("score", "predicted", "quality").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in good for b in bad]
    assert len(rows) > 50 and sum(pairs) / len(pairs) > 0.95
    assert sum(r.predicted for r in good) >= 0.97 * len(good)
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "text", 0), (2, "text", 0)], "doc_id long, text string, quality int")
    none = quality.train(odd, labels.limit(0))
    assert [r.score for r in quality.score(odd, none).collect()] == [0.5] * 4
    some = quality.train(odd, spark.createDataFrame([(2, 0), (2, 1), (2, None)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in quality.score(odd, some).collect())
    assert quality.score(odd.limit(0), none).count() == 0


def test_character_ngrams_are_of_characters():
    known = common.Hashes(quality.word_bucket)
    text = "äöü \U0001f600x"
    padded = f" {text} "
    grams = [padded[i : i + n] for n in quality.GRAMS for i in range(len(padded) - n + 1)]
    got = quality.features(text, known)
    assert len(got) == 2 + len(grams)
    assert len(set(got[2:].tolist())) == len(set(grams))


def test_repeated_ids_of_vectors_and_texts(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=32).tolist()
    df = spark.createDataFrame([(1, v, 1, 0), (1, v, 1, 0), (2, v, 1, 0), (3, rng.normal(size=32).tolist(), 1, 0)], "vec_id long, embedding array<double>, label int, key int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding.near_vectors(df).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    docs = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (3, "A b c d")], "doc_id long, text string")
    assert sorted(r.component_id for r in simhash.near_duplicates(docs).collect()) == [3, 3, 3]


def test_recall_of_links_near_the_threshold(spark):
    """Pairs planted at cosines just above 0.98, in several dimensions and among many other vectors: at least 0.9 are found."""
    rng, rows = np.random.default_rng(3), []
    for d in (24, 64, 200):
        for c in (0.9805, 0.985, 0.99) * 60:
            a, b = rng.normal(size=(2, d))
            a /= np.linalg.norm(a)
            b -= (b @ a) * a
            b /= np.linalg.norm(b)
            rows += [(len(rows), a.tolist(), 1), (len(rows) + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 1)]
        rows += [(len(rows) + i, x.tolist(), 1) for i, x in enumerate(rng.normal(size=(700, d)))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    planted = [i for i in range(0, len(rows) - 1) if len(rows[i][1]) == len(rows[i + 1][1]) and np.dot(rows[i][1], rows[i + 1][1]) >= 0.98 * np.linalg.norm(rows[i][1]) * np.linalg.norm(rows[i + 1][1])]
    found = [i for i in planted if got[i + 1][1] == i and got[i][0] == 1]
    assert len(planted) == 540 and len(found) >= 0.97 * len(planted)
    assert sum(n for n, _ in got.values()) == 2 * len(found)


def test_null_ids_beside_large_ones(spark):
    """A batch that holds a null id keeps the others whole: 2 ** 60 + 1 is no double."""
    from graphloom.llm import bpe, tokencount

    big = 2**60 + 1
    df = spark.createDataFrame([(big, "one two three", 1), (None, "one two four", 2), (None, None, 3)], "doc_id long, text string, fp long").coalesce(1)
    path = public_tokenizers.path
    for out in (bpe.encode_decode(df, path("byte_bpe_50k.json")), tokencount.token_counts(df, path("piece_bpe_32k.model")), simhash.near_duplicates(df), simhash.fingerprints(df)):
        assert sorted((r.doc_id for r in out.collect()), key=str) == [big, None, None]
    assert {r.component_id for r in simhash.near_duplicates(df).where(f"doc_id = {big}").collect()} == {big}
    none = df.limit(0)
    assert [bpe.encode_decode(none, path("byte_bpe_50k.json")).count(), tokencount.token_counts(none, path("piece_bpe_32k.model")).count(), simhash.near_duplicates(none).count()] == [0, 0, 0]
    rows = spark.createDataFrame([(big, PASSAGE, "en", "s", 1), (None, "other", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    assert sorted((r.doc_id for r in cp.encoded(spark, cp.without_repeats(spark, cp.one_of_each_group(spark, rows, ""), ""), "").collect()), key=str) == [big, None]
