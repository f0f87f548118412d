"""Names: identifiers, namespaces, spellings, constructors' twins, template names."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.functions import templates
from graphloom.functions import trees as T
from graphloom.operators import spelling


def one(spark, col, **cols):
    kinds = {str: "string", list: "array<string>"}
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in cols.items()))
    return df.select(col).first()[0]


def test_mangled(spark):
    codes = dict(N.MANGLED)
    assert len(N.MANGLED) == 30
    for text in ["a::b<c, d>", "x$y", "~T()", "", "é::*"]:
        want = N.PREFIX + "".join("".join(codes.get(c, c) for c in s) + f"$${len(s.encode())}_" for s in text.split("::"))
        assert one(spark, N.mangled(F.col("n")), n=text) == want


def test_split_and_parse(spark):
    get = lambda n: one(spark, N.split_namespace(F.col("n")), n=n)
    assert tuple(get("a::b::c")) == ("a::b", "c") and tuple(get("c")) == ("", "c") and tuple(get("a<b>::c")) == ("a<b>", "c")
    assert get("a::c<d>") is None
    with pytest.raises(Exception, match="templates"):
        one(spark, N.split_namespace(F.col("n"), True), n="a::c<d>")
    assert one(spark, N.parse_untemplated(F.col("n")), n="a:: b ::c") == ["a", "b", "c"]
    assert one(spark, N.parse_untemplated(F.col("n")), n="a<b>::c") is None
    assert one(spark, N.filled_parameters(F.col("n")), n=["", "a0", "", "x"]) == ["a1", "a0", "a2", "x"]


SEG = N.SEGMENTS


@pytest.mark.parametrize(
    "segs, want",
    [
        ([("Name", None, "a", False), ("Anonymous", None, None, False), ("Name", None, "b", False)], ["a::b"]),
        ([("Name", None, "a", False), ("Type", 1, "t", False), ("Name", None, "b", False)], ["p::q::b", "r::b"]),
        ([("Name", None, "a", False), ("Subprogram", 5, "f", False)], ["a::(function f)"]),
        ([("Name", None, "a", False), ("Subprogram", 5, "_Zf", True), ("Name", None, "b", False)], ["_Zf::b"]),
        ([("Subprogram", 5, "f", False)], []),
        ([("Anonymous", None, None, False)], []),
        ([("Type", 2, "none", False), ("Name", None, "b", False)], []),
    ],
)
def test_namespace_spellings(spark, segs, want):
    df = spark.createDataFrame([(segs, {1: ["r", "p::q"]})], f"s {SEG}, m map<bigint,array<string>>")
    of = lambda g: F.try_element_at("m", g)
    assert df.select(N.namespace_spellings(F.col("s"), of)).first()[0] == want
    source = df.select(N.namespace_source(F.col("s"))).first()[0]
    assert source == (None if any(x[0] == "Subprogram" for x in segs) else "::".join(x[2] for x in segs if x[0] != "Anonymous"))


def test_tree_spellings(spark):
    tree = [("BASE", 1, None, None), ("BASE", 2, None, None), ("BASE", 1, None, None), ("PTR", None, None, None), ("SUB", None, 3, None), ("PTR", None, None, None), ("ARRAY", None, 4, None)]
    method = [("BASE", 1, None, None), ("BASE", 2, None, None), ("PTMF", 2, 2, None)]
    known = {1: ["a", "b"], 2: ["c", "d"]}
    df = spark.createDataFrame([(tree, method, known)], f"t {T.TYPE}, u {T.TYPE}, m map<bigint,array<string>>")
    of = lambda g: F.try_element_at("m", g)
    r = df.select(N.tree_spellings(F.col("t"), of), N.tree_spellings(F.col("u"), of), N.templated(F.array(F.lit("N")), F.array(F.col("m")[1], F.col("m")[2]))).first()
    assert r[0] == sorted(f"{x}(*)({y}, {z}*)[4]" for x, y, z in product("ab", "cd", "ab"))
    assert r[1] == sorted(f"{x} ({y}::*)({z})" for x, y, z in product("ab", "cd", "cd"))
    assert r[2] == sorted(f"N<{x}, {y}>" for x, y in product("ab", "cd"))


def test_spellings_level_by_level(spark):
    arg = lambda g: ("Type", None, [("BASE", g, None, None)])
    u32 = 0xFFFF1104
    rows = [(1, [("A", []), ("X", [])]), (2, [("V", [arg(1), ("Const", 3, None)])]), (3, [("W", [arg(2), arg(u32)])]), (4, [("S", [arg(4)])]), (5, [("P", [arg(4)]), ("Q", [])])]
    got = {r.goff: r.spelled for r in spelling.spellings(spark.createDataFrame(rows, f"goff bigint, fqnames {spelling.NAMES}")).collect()}
    assert got[1] == ["A", "X"] and got[2] == ["V<A, 3>", "V<X, 3>"] and got[3] == ["W<V<A, 3>, u32>", "W<V<X, 3>, u32>"]
    assert got[4] == [] and "Q" not in got[4] and got[u32] == ["u32"]
    df = spark.createDataFrame([(k, v) for k, v in got.items() if k < 4], "goff bigint, spelled array<string>")
    assert spelling.unique_match(df, "^W") == (3, got[3][0]) and spelling.unique_match(df, "zzz") is None
    with pytest.raises(ValueError):
        spelling.unique_match(df, "[VW]")


def test_name_graph_and_rules(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "c"), ("b", "d")], "derived string, base string")
    assert sorted(map(tuple, spelling.name_graph(e).collect())) == [("a", "b"), ("b", "d")]
    with pytest.raises(ValueError):
        spelling.name_graph(e.union(spark.createDataFrame([("b", "a")], e.schema)))
    pairs = spark.createDataFrame([("std::x", "y"), ("y", "std::x")], "better string, worse string")
    assert [r.better for r in N.rule_failures(pairs, ["^std"], []).collect()] == ["y"]


def test_twins(spark):
    text = {"_ZN1AC1Ev": "A::A()", "_ZN1AC2Ev": "A::A()", "_ZN1AC3Ev": "A::A()", "_ZN1AD0Ev": "A::~A()", "_ZN1AD1Ev": "A::~A()", "_ZN1AD2Ev": "A::~A()", "_Z1fC1": "f", "main": "main"}
    known = spark.createDataFrame(list(text.items()), "symbol string, text string")
    some = spark.createDataFrame([(s,) for s in ["_ZN1AC2Ev", "_ZN1AC3Ev", "_ZN1AD1Ev", "_ZN1AD0Ev", "_Z1fC1", "main", "_Zother"]], "symbol string")
    got = {}
    for r in N.twins(some, known).collect():
        got.setdefault(r.symbol, set()).add(r.twin)
    assert got == {"_ZN1AC2Ev": {"_ZN1AC1Ev", "_ZN1AC2Ev"}, "_ZN1AC3Ev": {"_ZN1AC3Ev"}, "_ZN1AD1Ev": {"_ZN1AD1Ev", "_ZN1AD2Ev"}, "_ZN1AD0Ev": {"_ZN1AD0Ev"}, "_Z1fC1": {"_Z1fC1"}, "main": {"main"}, "_Zother": {"_Zother"}}


def test_namespaced(spark):
    by = spark.createDataFrame([("a<x>", [("Type", 7, "a<x>", False)])], f"ns string, segments {SEG}")
    rows = spark.createDataFrame([("a<x>::c", None), ("p::q::c", None), ("c", None), ("u<v>::c", "w::c"), ("u<v>::c2", None)], "source string, fallback string")
    got = {r.source: (None if r.segments is None else [s.s for s in r.segments], r.base) for r in N.namespaced(rows, by).collect()}
    assert got == {"a<x>::c": (["a<x>"], "c"), "p::q::c": (["p", "q"], "c"), "c": ([], "c"), "u<v>::c": (["w"], "c"), "u<v>::c2": (None, None)}


def test_template_names(spark):
    parse = templates.parser(char="i8", wchar="u32")
    cases = {
        "a::b<int, unsigned long>": ("a::b", ["i32", "u64"]),
        "v<char const*, wchar_t&, 3, -4, true, (E)2>": ("v", ["i8*", "u32*", "#3", "#-4", "#1", "#2"]),
        "f<void (*)(int, x::y), int [3], int C::*, void (C::*)(bool) const>": ("f", ["void(i32, x::y)*", "i32[3]", "i32 C::*", "void (C::*)(bool)"]),
        "p<q<r<int>, s>, t<u>::w>": ("p", ["q<r<i32>, s>", "t<u>::w"]),
        "plain": ("plain", []),
    }

    def show(tokens):
        stack = []
        for t in tokens:
            if t.op == "BASE":
                stack.append(t.s)
            elif t.op == "CONST":
                stack.append(f"#{t.g}")
            elif t.op == "PTR":
                stack.append(stack.pop() + "*")
            elif t.op == "ARRAY":
                stack.append(f"{stack.pop()}[{t.n}]")
            elif t.op == "PTMD":
                stack.append(f"{stack.pop()} {t.s}::*")
            else:
                ops = stack[len(stack) - t.n :]
                del stack[len(stack) - t.n :]
                inner = ", ".join(ops if t.op == "NAME" else ops[1:])
                stack.append({"NAME": f"{t.s}<{inner}>", "SUB": f"{ops[0]}({inner})", "PTMF": f"{ops[0]} ({t.s}::*)({inner})"}[t.op])
        return stack[0]

    df = spark.createDataFrame([(k,) for k in [*cases, "a<", "a<b>>"]], "n string")
    got = {r.n: r.x for r in df.select("n", parse("n").alias("x")).collect()}
    for k, want in cases.items():
        assert (got[k].name, [show(a) for a in got[k].args]) == want, k
    assert got["a<"].error and got["a<b>>"].error and got["a<"].name is None
