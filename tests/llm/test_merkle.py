"""The manifest against a plain tree over all rows; odd rows, many groups, and top trees that don't fit the driver."""

import hashlib
import zlib

import duckdb
import pytest

from graphloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def climbed(level):
    """Root, and for each leaf its (left, right) siblings."""
    at, paths = list(range(len(level))), [[] for _ in level]
    while len(level) > 1:
        for i, p in enumerate(at):
            a = p - p % 8
            paths[i].append(("".join(level[a:p]), "".join(level[p + 1 : a + 8])))
        at = [p // 8 for p in at]
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def plain(rows):
    low = str.maketrans(merkle.UPPER, merkle.UPPER.lower())
    groups = {}
    for r in rows:
        d, t, g, s, n = r[:5]
        seen = leaf(d, t.translate(low), g, s, n) if t is not None and d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else leaf(*r[:5])
        groups.setdefault(g, []).append((d is not None, d or 0, leaf(*r[:5]), seen))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: climbed([x[2] for x in sorted(groups[g])]) for g in order}
    root, over = climbed([tops[g][0] for g in order])
    out = []
    for g, last in zip(order, over):
        for (has, d, own, seen), path in zip(sorted(groups[g]), tops[g][1]):
            steps, fold = path + last, seen
            for x, y in steps:
                fold = h(x, fold, y)
            out.append((d if has else None, own, tops[g][0], root, h(*[x + y for x, y in steps]), fold, fold == root))
    return out


ROWS = [(i * 7 % 1500, f"Text {i} " + "ÄBC"[: i % 3], "en", f"s{i % 4}", i, "x") for i in range(1500)]
ROWS += [(5, "A", "en", None, 1, "x"), (5, "A", "en", None, 1, "y"), (5, "B", "en", None, None, None), (None, "C", "en", "", 3, "x"), (None, None, "en", "s", 3, "x"), (12, None, "fr", "s", 0, "x")]
ROWS += [(2**60 + i, "Zz", None, "s", 2, "x") for i in range(9)] + [(0, "", "", None, 0, "x"), (-4, "É" * 9000 + "Q", "zz", "s", 1, "x")]


def checked(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in merkle.op11_merkle(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    return got


def test_odd_rows(spark, tmp_path):
    got = checked(spark, ROWS, tmp_path)
    assert 0 < sum(not r[6] for r in got) < len(got) / 2
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(merkle.SQL).fetchall(), key=str) == sorted(got, key=str)


@pytest.mark.parametrize("n", [0, 1, 8, 9])
def test_small_tables(spark, tmp_path, n):
    got = checked(spark, ROWS[:n], tmp_path) if n else merkle.manifest(spark.createDataFrame([], SCHEMA), merkle.FIELDS, "lang", "doc_id").collect()
    assert len(got) == n


def test_tops_in_blocks(spark, tmp_path, monkeypatch):
    """With a driver that takes 3 nodes only, top trees are reduced in blocks, too; 200 groups of their own."""
    monkeypatch.setattr(merkle, "TOP", 3)
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "SIZE", 8)
    rows = ROWS[:700] + [(i, "T", f"lang{i}", "s", 1, "x") for i in range(20)]
    checked(spark, rows, tmp_path)


def test_paths_fold_to_the_root(spark):
    df = spark.createDataFrame(ROWS[:100], SCHEMA)
    for r in merkle.manifest(df, merkle.FIELDS, "lang", "doc_id", keep_paths=True).collect():
        fold = r.leaf
        for s in r.path:
            fold = h(s.left, fold, s.right)
        assert fold == r.root == r.folded_root and r.verified
