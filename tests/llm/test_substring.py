"""Substring dedup against a dictionary of all windows."""

import hashlib
import re

from graphloom.llm import substring

DOCS = "doc_id long, text string, start int"


def brute(rows):
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in rows}
    first, gone = {}, {k: set() for k in split}
    for k in sorted(split):
        for i in range(len(split[k]) - 19):
            w = tuple(split[k][i : i + 20])
            if w in first:
                gone[k].update(range(i, i + 20))
            else:
                first[w] = (k, i)
    return {k: (len(w), len(gone[k]), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone[k]).encode()).hexdigest()) for k, w in split.items()}


def rows(spark):
    got = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    return got + [(9000, None), (9001, ""), (9002, "a " * 300), (9003, "b c d " * 9), (9004, " ".join(map(str, range(90))) + " " + " ".join(map(str, range(70)))), (9005, got[0][1])]


def test_removed_words(spark):
    data = rows(spark)
    want = brute(data)
    out = substring.dedup(spark.createDataFrame([(*r, 1) for r in data], DOCS)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == want
    assert sum(x[1] for x in want.values()) > 500
    assert substring.dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_batches_meet_history(spark):
    data = rows(spark)
    want = brute(data)
    index = substring.FingerprintIndex(spark)
    got = {}
    for part in ([r for r in data if r[0] < 60], [r for r in data if 60 <= r[0] < 150], [r for r in data if r[0] >= 150]):
        df = spark.createDataFrame([(*r, 1) for r in part], DOCS)
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove(df, index.repeats(df)).collect()}
        index.compact()
        assert len(index.runs) == 1
    assert got == want
