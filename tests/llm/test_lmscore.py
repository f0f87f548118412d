"""Losses against models counted word by word."""

import math
import random
from collections import Counter

import pytest

from graphloom.llm import lmscore


def brute(rows, wanted):
    texts = [(k, ["<s>", *(t or "").split()]) for k, t in rows]
    word, two = {}, {}
    for side, some in (("background", texts), ("target", [x for x in texts if x[0] in wanted])):
        word[side] = Counter(w for _, x in some for w in x)
        two[side] = Counter(p for _, x in some for p in zip(x, x[1:]))
    v = len(word["background"])
    for k, x in texts:
        mean = []
        for side in ("target", "background"):
            total, out = sum(word["background"].values()), 0.0
            scale = total / sum(word[side].values())  # the models are matched in size
            w = {k: n * scale for k, n in word[side].items()}
            for a, b in zip(x, x[1:]):
                uni = (w.get(b, 0) + lmscore.FLOOR) / (total + lmscore.FLOOR * v)
                out -= math.log((two[side][a, b] * scale * (1 - lmscore.DISCOUNT) + lmscore.DISCOUNT * w.get(a, 0) * uni + uni) / (w.get(a, 0) + 1))
            mean.append(out / max(1, len(x) - 1))
        yield (-1 if k is None else k, len(x) - 1, *mean, mean[0] - mean[1])


@pytest.mark.parametrize("block", [1 << 20, 5000])
def test_losses_are_those_of_exact_counts(spark, monkeypatch, block):
    monkeypatch.setattr(lmscore, "BLOCK", block)
    monkeypatch.setattr(lmscore, "PART", 1 << 18)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(150_000)}" if rng.random() < 0.8 else f"c{rng.randrange(50)}"
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 200)))) for i in range(1500)]
    rows += [(7, rows[3][1]), (2**60 + 1, rows[4][1]), (None, rows[5][1]), (5000, None), (5001, " \n")]
    wanted = {i for i in range(0, 1500, 3)} | {2**60 + 1}
    got = lmscore.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in wanted], "doc_id long"))
    got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got.select("doc_id", "n_tokens", "target_loss", "background_loss", "score").collect())
    want = sorted(brute(rows, wanted))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a - b) < 1e-6 for x, y in zip(got, want) for a, b in zip(x[2:], y[2:]))


def test_no_texts(spark):
    assert lmscore.cross_entropy_difference(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long")).count() == 0
