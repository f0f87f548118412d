"""Phrase fingerprints against a parse with a set of substrings, and the next document by a plain sort."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import phrases

SCHEMA = "doc_id long, text string, key string"
LONG = "".join(chr(97 + (i * i // 7 + i // 3) % 26) for i in range(60_000))


def plain(text):
    """LZ78 phrases as byte strings; dictionaries of PHRASES."""
    data, at, seen, found = (text or "").encode(), 0, set(), []
    for end in range(1, len(data) + 1):
        if (p := data[at:end]) not in seen:
            found.append(p)
            if len(seen) < phrases.PHRASES:
                seen.add(p)
            else:
                seen = set()
            at = end
    return found


def minima(text):
    out = np.full(phrases.SLOTS, 0xFFFFFFFF, np.uint32)
    for p in set(plain(text)):
        h = 0xCBF29CE484222325
        for b in p:
            h = ((h ^ b) * 0x100000001B3) % 2**64
        h = ((h ^ h >> 33) * 0xFF51AFD7ED558CCD) % 2**64 >> 32
        out = np.minimum(out, np.array([(int(a) * h + int(b)) % 2**32 for a, b in zip(phrases.TIMES.ravel(), phrases.PLUS.ravel())], np.uint32))
    return out


def expected(rows):
    turn = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1] or ""))
    out = []
    for (k, t, *_), (_, nxt, *_) in zip(turn, turn[1:] + turn[:1]):
        t, nxt = t or "", nxt or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        a, b, c = minima(t), minima(edited), minima(nxt)
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.astype(">u4").tobytes().hex(), b.astype(">u4").tobytes().hex(), float((a == b).mean()), float((a == c).mean())))
    return out


def checked(df):
    rows = [tuple(r) for r in df.select("doc_id", "text", F.xxhash64("text")).collect()]
    got = [tuple(r) for r in phrases.compared_with_next(df).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)
    return got


def test_odd_rows(spark):
    rows = [(5, "abc abd", "x"), (5, "abc abd", "y"), (5, "other", "x"), (None, "n one two", None), (None, None, "x"), (1, "", "f"), (2**60 + 1, "Émile 🎈🎈🎈 ẞ", "x"), (-7, LONG, "x"), (9, "a" * 3000, "x"), (10, "ab", "")]
    got = checked(spark.createDataFrame(rows, SCHEMA))
    assert {r[0] for r in got if r[3] == "ff" * 4 * phrases.SLOTS} == {None, 1}
    one = checked(spark.createDataFrame(rows[:1], SCHEMA))
    assert one[0][6] == 1.0
    assert checked(spark.createDataFrame([(1, None, ""), (2, "", "")], SCHEMA))[0][5:] == (1.0, 1.0)
    assert phrases.compared_with_next(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents_and_likeness(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = checked(docs)
    assert np.mean([r[5] for r in got if r[1] > 500]) > 0.5 > 0.3 > np.median([r[6] for r in got])
    kept = phrases.compared_with_next(docs, keep_texts=True).where("n_chars > 0").first()
    assert hashlib.sha256(kept.edited.encode()).hexdigest() == kept.edited_sha256
    again = {r.doc_id: r.fingerprint for r in phrases.fingerprints(docs).collect()}
    assert again == {r[0]: r[3] for r in got}


@pytest.mark.parametrize("most", [7, 1 << 16])
def test_parse_continues_and_goes_back(monkeypatch, most):
    monkeypatch.setattr(phrases, "PHRASES", most)
    text = LONG[:900].encode()
    for cut in (0, 1, 450, 899, 900):
        p = phrases.Phrases()
        head = p.read(text[:cut])
        at = p.fork()
        whole = head + p.read(text[cut:])
        p.back(at)
        assert head + p.read(text[cut:]) == whole == phrases.Phrases().read(text)
        p.back(at)
        other = head + p.read(b"other" * 40)
        assert other == phrases.Phrases().read(text[:cut] + b"other" * 40)
    assert len(plain(text.decode())) == len(phrases.Phrases().read(text))
