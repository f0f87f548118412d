"""Units that arrive in files: only changed ones are run again."""

from graphloom.functions import trees as T
from graphloom.operators import cache, dies
from graphloom.streaming import units

SCHEMA = f"cu bigint, goff bigint, kind string, members array<{dies.MEMBER}>"


def test_follow(spark, tmp_path):
    member = lambda g: (0, "x", [("BASE", g, None, None)], None, None)
    source, ran = str(tmp_path / "in"), []
    put = lambda *rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def stage(df):
        ran.append(sorted(r.cu for r in df.select("cu").distinct().collect()))
        return df

    kept = cache.StageCache(spark, str(tmp_path / "kept"), "h")
    put((0, 10, "struct", [member(11)]), (0, 11, "struct", []), (1, 50, "struct", []))
    for rows in (None, [(0, 20, "struct", [member(21)]), (0, 21, "struct", []), (1, 60, "struct", [member(60)])]):
        if rows:
            put(*rows)
        q = units.follow(spark.readStream.schema(SCHEMA).parquet(source), kept, stage, str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    assert ran == [[0, 1], [1]]
    out, rest = kept.lookup(spark.createDataFrame([(0, 30, "struct", [member(31)]), (0, 31, "struct", [])], SCHEMA))
    assert {r.goff for r in out.collect()} == {30, 31} and rest.isEmpty() and T.FIRST_PRIM
