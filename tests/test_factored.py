"""The graph of spellings against spellings written out."""

import pytest
from test_types import U8, U32, b, ptr, row, types

from graphloom.operators import factored, spelling


def targ(tree):
    return ("Type", None, tree)


def graph_of(spark):
    method = [*b(U8), *b(2), ("PTMF", 1, 2, None)]
    return types(
        spark,
        row(1, "struct", name="A", decl_names=["A2", "x::A"]),
        row(2, "struct", name="V", targs=[targ(b(1)), ("Const", 3, None)]),
        row(3, "struct", name="W", targs=[targ(ptr(b(2))), targ(b(1))], decl_names=["W0"]),
        row(4, "struct", name="F", targs=[targ([*b(1), *b(2), ("SUB", None, 2, None), ("PTR", None, None, None)]), targ(method)]),
        row(5, "struct", name="R", targs=[targ(b(5))], decl_names=["self"]),
        row(6, "struct", name="S", targs=[targ(b(99))]),
        row(7, "struct"),
        row(8, "struct", name="Q", targs=[targ(b(5)), targ([*b(U32), ("ARRAY", None, 4, None)])]),
    )


def test_as_written_out(spark):
    df = graph_of(spark)
    want = {r.goff: r.spelled for r in spelling.spellings(spelling.full_names(df)).collect() if r.spelled}
    graph = factored.alternatives(df)
    assert {r.goff: r.spelled for r in factored.expanded(graph).collect() if r.spelled} == want
    assert {r.goff: int(r.n) for r in factored.counts(graph).collect() if r.n} == {g: len(s) for g, s in want.items()}
    asked = [(g, s) for g in (1, 2, 3, 4, 5) for s in want.get(g, [])] + [(2, "V<A, 4>"), (2, "V<A, 3"), (2, "V<A, 3>>"), (1, ""), (1, None), (None, "A"), (77, "A"), (6, "S<>"), (U32, "u32"), (U32, "u3")]
    got = {(r.goff, r.text): r.found for r in factored.members(graph, spark.createDataFrame(asked + asked[:3], "goff long, text string")).collect()}
    assert got == {(g, s): s is not None and s in want.get(g, []) for g, s in asked}


def test_namespaces(spark):
    seg = lambda k, s, g=None: (k, g, s, False)
    df = types(
        spark,
        row(1, "struct", name="N", name_ns=[seg("Name", "a"), seg("Name", "b")], decl_names=["N", "N2"]),
        row(2, "struct", name="I", name_ns=[seg("Name", "a"), seg("Type", "N", 1)], targs=[targ(b(1))], decl_names=["plain"]),
        row(3, "struct", name="L", name_ns=[seg("Name", "a"), seg("Subprogram", "f()")]),
    )
    graph = factored.alternatives(df)
    got = {r.goff: r.spelled for r in factored.expanded(graph).where("goff < 9").collect()}
    own = ["N", "N2", "a::b::N"]
    assert got == {1: own, 2: sorted([f"{n}::I<{t}>" for n in own for t in own] + ["plain"]), 3: ["a::(function f())::L"]}


def test_more_than_can_be_written_out(spark):
    """Ten types of sixteen names as arguments of one: 2^40 spellings."""
    rows = [row(i, "struct", name=f"t{i}", decl_names=[f"t{i}_{j}" for j in range(15)]) for i in range(1, 11)]
    top = row(20, "struct", name="top", targs=[targ(b(i)) for i in range(1, 11)])
    graph = factored.alternatives(types(spark, *rows, top))
    assert {r.goff: int(r.n) for r in factored.counts(graph).collect()}[20] == 2**40
    yes = "top<" + ", ".join(f"t{i}_{i}" for i in range(1, 11)) + ">"
    asked = spark.createDataFrame([(20, yes), (20, yes.replace("t3_3", "t4_3"))], "goff long, text string")
    assert {r.text: r.found for r in factored.members(graph, asked).collect()} == {yes: True, yes.replace("t3_3", "t4_3"): False}


def test_marks_in_names(spark):
    with pytest.raises(Exception, match="code point"):
        factored.alternatives(types(spark, row(1, "struct", name="a\x01")))


def test_rounds_carry_no_texts(spark, monkeypatch):
    """Questions to names that nest six deep: each text is written with its question and its types, not with every round; what is built from itself has no spelling."""
    wrote, cut = [], factored.cut
    monkeypatch.setattr(factored, "cut", lambda df: (wrote.append(df.columns), cut(df))[1])
    graph = spark.createDataFrame([(i, 0, ["<", str(i - 1), ">"] if i else ["x"]) for i in range(7)] + [(6, 1, ["y"]), (8, 0, ["", "9", ""]), (9, 0, ["", "8", ""]), (9, 1, ["z"])], "goff bigint, alt int, pieces array<string>")
    texts = [(6, "<<<<<<x>>>>>>"), (6, "y"), (6, "<y>"), (2, "<<x>>"), (2, "x"), (8, "z"), (9, "z"), (7, "x"), (0, None)]
    got = factored.members(graph, spark.createDataFrame(texts, "goff bigint, text string"))
    yes = texts[:2] + texts[3:4] + [(9, "z")]
    assert sorted((r.goff, r.text or "", r.found) for r in got.collect()) == sorted((g, t or "", (g, t) in yes) for g, t in texts)
    assert sum("text" in c for c in wrote) <= 2
    assert {r.goff: int(r.n) for r in factored.counts(graph).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, 8: 0, 9: 1}
