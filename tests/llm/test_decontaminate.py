"""Verification against a plain search; leaks on planted passages."""

import random

import numpy as np

from graphloom.llm import decontaminate as D


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_overlap(item, h, at):
    n = len(item)
    around = h[max(0, at - n) : at + D.STEP * D.SPAN + n]
    width = n + n // 4 + 2
    starts = [*range(0, max(1, len(around) - width + 1), max(1, n // 8)), max(0, len(around) - width)]
    best = max(plain_lcs(item, around[i : i + width]) for i in starts) / n
    answer = item[-D.ANSWER_WORDS :]
    whole = any(around[i : i + len(answer)] == answer for i in range(len(around)))
    return best if best >= D.LCS or (whole and best >= D.LCS_ANSWER) else 0.0


def test_overlap_is_that_of_a_plain_search():
    rng = random.Random(3)
    found = 0
    for _ in range(300):
        item = [rng.randrange(1, 60) for _ in range(rng.randint(1, 30))]
        kept = [x for x in item if rng.random() < rng.choice([0.5, 0.7, 1])]
        text = [rng.randrange(1, 60) for _ in range(rng.randint(0, 40))] + kept + item[-6:] * rng.randint(0, 1) + [rng.randrange(1, 60) for _ in range(30)]
        at = rng.randrange(0, len(text), D.STEP)
        want = plain_overlap(item, text, at)
        found += want > 0
        assert abs(D.overlap(item, np.array(text, dtype=np.uint64), at) - want) < 1e-12
    assert 20 < found < 290


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    fill = lambda n: " ".join(word() for _ in range(n))
    docs = [(1, f"{fill(100)} {items[2][1]} {fill(50)}"), (2, fill(200)), (3, None), (4, ""), (5, items[4][1].upper()), (6, items[0][1]), (6, items[0][1])]
    got = D.leaks(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame([*items, (9, None), (10, "")], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 2), (5, 4), (6, 0)]
    assert D.leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def prose(rng, n):
    """Words of a skewed vocabulary."""
    return [f"w{int(4000 ** rng.random())}" if rng.random() < 0.5 else f"r{rng.randrange(20000)}" for _ in range(n)]


def idf_of(texts):
    df = np.zeros(D.SLOTS)
    for t in texts:
        df[np.unique(D.slots(D.terms(" ".join(t))))] += 1
    return np.log((len(texts) + 1) / (df + 1)) + 0.1


def recall(items, planted, idf, rng):
    """Share of the planted items that the index proposes at a passage that holds them."""
    index, found = D.Index([D.terms(" ".join(x)) for x in items], idf), 0
    for k, x in planted:
        text = prose(rng, rng.randrange(5, 60)) + x + prose(rng, 40)
        h = D.terms(" ".join(text))
        w = idf[D.slots(h)] ** 2
        norm = np.sqrt([w[i : i + D.STEP * D.SPAN].sum() for i in range(0, len(h), D.STEP)])
        passage, point = index.pairs(D.slots(h), norm)
        found += k in point[passage >= 0].tolist()
    return found / len(planted)


def test_candidates_do_not_thin_out_as_items_grow():
    rng = random.Random(7)
    for n in (200, 1000, 5000):
        items = [prose(rng, rng.randint(15, 59)) for _ in range(n)]
        idf = idf_of(items + [prose(rng, 300) for _ in range(300)])
        some = rng.sample(range(n), 150)
        assert recall(items, [(k, items[k]) for k in some], idf, rng) == 1
        reworded = [(k, [w if rng.random() < 0.7 else prose(rng, 1)[0] for w in items[k]]) for k in some]
        assert recall(items, reworded, idf, rng) >= 0.95, n


def test_leaks_of_many_items(spark):
    rng = random.Random(8)
    items = [(i, " ".join(prose(rng, 30))) for i in range(1000)]
    docs = [(i, " ".join([*prose(rng, 50), items[i][1], *prose(rng, 50)])) for i in range(1000)]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i in range(1000)]


def test_leaks_of_long_items(spark):
    rng = random.Random(9)
    items = [(i, " ".join(prose(rng, n))) for i, n in enumerate([30, 31, 60, 100, 200, 400, 800] * 4)]
    docs = [(i, " ".join([*prose(rng, 45), t, *prose(rng, 50)])) for i, t in items]
    docs += [(100 + i, " ".join([*prose(rng, 45), *(w for w in t.split() if rng.random() < 0.8), *prose(rng, 50)])) for i, t in items]
    other = [(k, " ".join(prose(rng, 300))) for k in range(200, 400)]
    got = D.leaks(spark.createDataFrame(docs + other, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(k, k % 100) for k, _ in docs]


def test_blocks_of_items_may_split_an_item_id(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEMS", 2)
    rng = random.Random(10)
    items = [(i // 3, " ".join(prose(rng, 30))) for i in range(6)]
    docs = [(k, " ".join([*prose(rng, 40), t, *prose(rng, 40)])) for k, (_, t) in enumerate(items)]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, items[0]], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(k, i) for k, (i, _) in enumerate(items)]


def test_basis_is_of_the_whole_benchmark(spark, monkeypatch):
    """The model is fitted to every item and to no choice of texts."""
    seen = []
    fit = D.latent_basis
    monkeypatch.setattr(D, "latent_basis", lambda p, idf: seen.append(sorted(r.text for r in p.collect())) or fit(p, idf))
    items = [" ".join(f"w{i}x{j}" for j in range(45)) for i in range(30)]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(items)] + [(100, "none of this")], "doc_id long, text string")
    got = D.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i in range(30)]
    assert seen == [sorted(" ".join(t.split()[i : i + 30]) for t in items for i in (0, 30))]


def test_bounds_leave_out_no_passage_that_reaches_an_item():
    """Against every product: what the bounds pass over reaches no point, and of texts without items they pass over most."""
    rng = random.Random(12)
    items = [prose(rng, rng.randint(15, 59)) for _ in range(300)]
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(150)]
    for t in texts[::2]:
        x = rng.choice(items)
        t[len(t) // 2 : len(t) // 2] = [w if rng.random() < rng.choice([0.4, 0.6, 0.8, 1]) else prose(rng, 1)[0] for w in x]
    idf = idf_of(items + texts)
    parts = [p for x in items for p in D.pieces(D.terms(" ".join(x)))]
    rows = np.zeros((len(parts), D.BASIS))
    for row, p in zip(rows, parts, strict=True):
        np.add.at(row, D.slots(p) % D.BASIS, idf[D.slots(p)])
    basis = np.linalg.svd(rows, full_matrices=False)[2][: D.RANK].T.astype(np.float32)
    base = np.concatenate([basis[np.arange(D.SLOTS) % D.BASIS] * idf[:, None].astype(np.float32), np.zeros((1, D.RANK), np.float32)])
    points = np.array([base[D.slots(p)].sum(axis=0) for p in parts])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    index = D.Index(parts, idf)
    bounds = D.Bounds(basis, idf, points, index)

    doc, s = [], []
    for i, t in enumerate(texts):
        h = D.slots(D.terms(" ".join(t)))
        steps = -(-len(h) // D.STEP)
        doc += [i] * steps
        s.append(np.concatenate([h, np.full(steps * D.STEP - len(h), D.SLOTS)]))
    doc, s = np.array(doc), np.concatenate(s)
    norm, latent, near = bounds.passing(s, doc)
    square, by_step = np.append(idf**2, 0), s.reshape(len(doc), D.STEP)
    reached = 0
    for i in range(len(doc)):
        own = np.concatenate([by_step[j] for j in range(i, min(i + D.SPAN, len(doc))) if doc[j] == doc[i]])
        assert abs(norm[i] - np.sqrt(square[own].sum())) < 1e-3 * norm[i]
        if (points @ base[own].sum(axis=0) >= D.COSINE * norm[i]).any():
            reached += 1
            assert latent[i]
    passage, _ = index.pairs(s, norm, doc)
    assert reached > 10 and len(passage) > 50 and near[passage].all()
    plain = np.isin(doc, np.arange(1, len(texts), 2))
    assert latent[plain].mean() < 0.5 and near[plain].mean() < 0.5
    assert len(np.bincount(D.grouped(points, 16))) == 16 and np.bincount(D.grouped(points[:5], 16)).sum() == 5


def test_terms_are_those_of_term():
    text = "Words – of a text, twice: words of été a TEXT."
    assert D.terms(text).tolist() == [D.term(w) for w in D.split(text)] and len(D.terms(None)) == 0
