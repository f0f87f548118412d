"""Symbol lists, compile commands, configuration, documents and stores."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import trees as T
from graphloom.operators import rows
from graphloom.sources import compile_db, config, sinks, tables


def test_symbol_list(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text("header,x,y,z\n0x7100000010,Q,4,f\n0x7100000020,Q,4, g \n0x7100000030,Q,4,f\n0x7100000040,Q,4, \n")
    got = {r.symbol: r.addr for r in tables.symbol_list(spark, str(f), 0, 3, 0x7100000000, 1).collect()}
    assert got == {"f": 0x30, "g": 0x20}
    f.write_text("0x10,f\n0x7200000010,g\nxyz,h\n0x7100000000\n0x7100000001,ok\n")
    with pytest.raises(ValueError, match="line 1"):
        tables.symbol_list(spark, str(f), 0, 1, 0x7100000000)
    lines = spark.read.text(str(f)).withColumn("at", F.monotonically_increasing_id())
    good, wrong = tables.symbol_rows(lines, 0, 1, 0x7100000000)
    assert [tuple(r) for r in good.collect()] == [("ok", 1)]
    assert [r.code for r in wrong.orderBy("at").collect()] == ["below the base", "too far from the base", "no number", "no symbol column"]


def test_compile_commands(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps([{"file": "a", "command": "cc -x"}, {"file": "b", "command": "cc '-D A' -c b"}, {"file": "a", "command": "cc -y"}]))
    got = {r.file: r.args for r in compile_db.read(spark, str(f)).collect()}
    assert got == {"a": ["-y"], "b": ["-D A", "-c", "b"]}
    units = spark.createDataFrame([(1, "a"), (2, "z")], "cu bigint, name string")
    with_, without = compile_db.commands_of(units, compile_db.read(spark, str(f)))
    assert [r.cu for r in with_.collect()] == [1] and [r.cu for r in without.collect()] == [2]
    f.write_text(json.dumps([{"file": "a", "command": ""}, {"file": "b", "command": "cc 'x"}]))
    with pytest.raises(ValueError):
        compile_db.read(spark, str(f))
    assert {r.file for r in compile_db.read(spark, str(f), strict=False).where("error is not null").collect()} == {"a", "b"}


GOOD = """
[paths]
build-command = ["make"]
elf = "out/x.elf"
functions = { path = "f.csv", address-column = 0, symbol-column = 3, base-address = 0x7100000000, skip-rows = 1 }
[extract]
pointer-width = 64
ptmd-repr = ["i64", 1]
ptmf-repr = ["i64", 2]
[extract.name-resolution]
rules = ["^std", "<default>", "detail"]
test = [["std::a", "b"], ["b", "detail::b"]]
[[extract.type-optimizer.pick-union-member]]
regex = "^U$"
members = ["a", "b"]
pick = 1
"""


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text(GOOD)
    c = config.load(str(f))
    assert c.symbols["functions"]["path"] == str(tmp_path / "f.csv") and c.build_output == str(tmp_path / "out/x.elf")
    assert (c.pointer_type, c.pointer_size, c.member_pointer_size("ptmd"), c.member_pointer_size("ptmf")) == ("u64", 8, 8, 16)
    assert c.rules() == (["^std"], ["detail"]) and c.hash != config.parse(GOOD + "\n", "/").hash


@pytest.mark.parametrize(
    "old, new",
    [("= 64", "= 24"), ('["make"]', "[]"), ('["i64", 1]', '["void", 1]'), ('["i64", 2]', '["i64", 0]'), ('["std::a", "b"]', '["b", "std::a"]'), ("pick = 1", "pick = 2"), ('["a", "b"]', "[]"), ('"^std"', '"("')],
)
def test_bad_config(old, new):
    with pytest.raises(config.ConfigError):
        config.parse(GOOD.replace(old, new), "/")
    again = GOOD + GOOD[GOOD.index("[[extract.type") :]
    with pytest.raises(config.ConfigError):
        config.parse(again, "/")


def test_documents_and_stores(spark, tmp_path):
    u = [("BASE", 0xFFFF1104, None, "u32")]
    ty = f"goff bigint, kind string, name string, byte_size bigint, enumerators array<struct<name:string,value:bigint>>, members array<struct<offset:bigint,name:string,ty:{T.TYPE},special:string,bit_bytes:bigint>>, vtable array<struct<idx:bigint,name:string,fn:array<{T.TYPE}>>>"
    df = spark.createDataFrame([(1, "struct", 'S"x', 8, None, [(0, None, u, "Base", None), (4, "a", [*u, ("PTR", None, None, None)], None, None)], [(0, "f", [u])]), (2, "enum", "E", 4, [("A", 1)], None, None), (3, "alias", None, None, None, None, None)], ty)
    docs = {r.goff: json.loads(r.document) for r in sinks.documents(df).collect()}
    assert docs[1]["name"] == 'S"x' and [(x["name"], x["type"]) for x in docs[1]["members"]] == [("base", "[ u32 ]"), ("a", "[ u32,'*' ]")] and docs[1]["vtable"][0]["slot"] == 0
    assert docs[2]["enumerators"] == [{"name": "A", "value": 1}] and set(docs) == {1, 2}
    sinks.write_documents(sinks.documents(df), str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).count() == 2
    sym = spark.createDataFrame([("f", [*u, ("SUB", None, 1, None)], [], 5), ("d", u, [], 6)], f"link_name string, ty {T.TYPE}, param_names array<string>, address bigint")
    assert {r.link_name: json.loads(r.document)["kind"] for r in sinks.symbol_documents(sym).collect()} == {"f": "func", "d": "data"}
    name = spark.createDataFrame([([("BASE", 7, None, None)], {7: "N"})], f"t {T.TYPE}, m map<bigint,string>").select(T.display(sinks.named(F.col("t"), F.col("m")))).first()[0]
    assert name == "N"
    store = sinks.Store(spark, str(tmp_path / "s"))
    store.put(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), "k")
    store.put(spark.createDataFrame([("a", 3)], "k string, v int"), "k")
    assert {(r.k, r.v) for r in store.get().collect()} == {("a", 3), ("b", 2)}
    sinks.dump(sym.select("link_name"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert sinks.summary(spark.createDataFrame([(1, 22)], "types int, x int")) == "types: 1\n    x: 22"
    sinks.save_demangled(spark.createDataFrame([("b", "B"), ("a", "A")], "symbol string, text string"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2


T_ROWS = [[("BASE",), ("SUB",)], [("BASE",)]]


def test_counts_while_written(spark, tmp_path):
    """The counts are those of a scan, and writing takes the one job that it takes without them."""
    kinds = ["struct", "struct", "enum", "tree", None]
    types = spark.createDataFrame([(i, kinds[i % 5]) for i in range(1000)], "goff long, kind string").repartition(3)
    ty = spark.createDataFrame([(T_ROWS[i % 2],) for i in range(10)], "ty array<struct<op:string>>")

    def jobs(group, f):
        spark.sparkContext.setJobGroup(group, group)
        out = f()
        spark.sparkContext.setJobGroup("other", "other")
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    got, n = jobs("counted", lambda: sinks.dump_counted(types, str(tmp_path / "a"), rows.type_counts()))
    assert n == jobs("plain", lambda: sinks.dump(types, str(tmp_path / "b")))[1]
    more = sinks.dump_counted(ty, str(tmp_path / "c"), rows.symbol_counts())
    assert got | more == rows.stage_counts(types, ty).first().asDict()
    assert (got["types"], got["struct"], got["alias"], more["functions"]) == (1000, 400, 0, 5)
    assert sinks.summary(more) == "  symbols: 10\nfunctions: 5\n     data: 5"
    assert spark.read.json(str(tmp_path / "a")).count() == 1000
    assert sinks.dump_counted(types.limit(0), str(tmp_path / "d"), rows.type_counts())["types"] == 0
