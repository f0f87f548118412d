"""Type trees: the cases that the reference tests (display, flow sequence, parse, serialise and parse again), and the functions over them."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import trees as T

GOFF = {p[0]: p[3] for p in T.PRIMS}


def base(s):
    return [("BASE", GOFF.get(s), None, s)]


def ptr(t):
    return [*t, ("PTR", None, None, None)]


def arr(t, n):
    return [*t, ("ARRAY", None, n, None)]


def sub(*ts):
    return [x for t in ts for x in t] + [("SUB", None, len(ts), None)]


def ptmd(c, t):
    return [*t, ("PTMD", None, None, c)]


def ptmf(c, *ts):
    return [x for t in ts for x in t] + [("PTMF", None, len(ts), c)]


FORMS = [
    (lambda b: b, "{}", "[ {} ]"),
    (ptr, "{}*", "[ {},'*' ]"),
    (lambda b: arr(b, 5), "{}[5]", "[ {},[5] ]"),
    (lambda b: ptr(ptr(b)), "{}**", "[ {},'*','*' ]"),
    (lambda b: arr(arr(b, 5), 5), "{}[5][5]", "[ {},[5],[5] ]"),
    (lambda b: ptr(arr(b, 5)), "{}[5]*", "[ {},[5],'*' ]"),
    (lambda b: arr(ptr(b), 5), "{}*[5]", "[ {},'*',[5] ]"),
]
CASES = [(f(base(n)), show.format(n), yaml.format(n)) for n in T.NAMES for f, show, yaml in FORMS]
FOO, VOID, BOOL, U64 = base("Foo"), base("void"), base("bool"), base("u64")
CASES += [
    (FOO, "Foo", "[ '\"Foo\"' ]"),
    (ptr(FOO), "Foo*", "[ '\"Foo\"','*' ]"),
    (ptr(ptr(FOO)), "Foo**", "[ '\"Foo\"','*','*' ]"),
    (arr(arr(FOO, 7), 8), "Foo[7][8]", "[ '\"Foo\"',[7],[8] ]"),
    (ptr(arr(FOO, 7)), "Foo[7]*", "[ '\"Foo\"',[7],'*' ]"),
    (arr(ptr(FOO), 8), "Foo*[8]", "[ '\"Foo\"','*',[8] ]"),
]
for ops, show, marked, yaml in [
    ([VOID], "void()", "void (*)()", "void,'()',[]"),
    ([FOO], "Foo()", "Foo (*)()", "'\"Foo\"','()',[]"),
    ([ptr(VOID)], "void*()", "void* (*)()", "void,'*','()',[]"),
    ([VOID, BOOL], "void(bool)", "void (*)(bool)", "void,'()',[[ bool ]]"),
    ([VOID, BOOL, ptr(BOOL)], "void(bool, bool*)", "void (*)(bool, bool*)", "void,'()',[[ bool ],[ bool,'*' ]]"),
]:
    CASES += [(sub(*ops), show, f"[ {yaml} ]"), (ptr(sub(*ops)), marked, f"[ {yaml},'*' ]")]
FN = ptr(sub(U64, BOOL))
CASES += [
    (ptmd("A", U64), "u64 A::*", "[ u64,'\"A\"','::','*' ]"),
    (ptmd("A", FN), "u64 (*)(bool) A::*", "[ u64,'()',[[ bool ]],'*','\"A\"','::','*' ]"),
    (ptmf("A", U64), "u64 (A::*)()", "[ u64,'\"A\"','::','()',[],'*' ]"),
    (ptmf("A", FN, U64), "u64 (*)(bool) (A::*)(u64)", "[ u64,'()',[[ bool ]],'*','\"A\"','::','()',[[ u64 ]],'*' ]"),
    # beside the reference's: pointers to pointers to functions, function pointers as arguments
    (ptr(FN), "u64 (*)(bool)*", "[ u64,'()',[[ bool ]],'*','*' ]"),
    (ptr(sub(VOID, FN)), "void (*)(u64 (*)(bool))", "[ void,'()',[[ u64,'()',[[ bool ]],'*' ]],'*' ]"),
    (arr(ptr(sub(VOID, sub(VOID))), 3), "void (*)(void())[3]", "[ void,'()',[[ void,'()',[] ]],'*',[3] ]"),
]


def test_cases(spark):
    rows = [(i, t, show, yaml) for i, (t, show, yaml) in enumerate(CASES)]
    df = spark.createDataFrame(rows, f"i int, t {T.TYPE}, show string, yaml string")
    got = df.withColumn("d", T.display(F.col("t"))).withColumn("y", T.to_yaml(F.col("t"))).withColumn("p", T.from_yaml("yaml"))
    got = got.withColumn("q", T.from_yaml(T.to_sequence("y"))).collect()
    assert len(got) == len(CASES) > 104
    for r in got:
        assert (r.d, r.y) == (r.show, r.yaml)
        assert [tuple(x) for x in r.p] == [tuple(x) for x in r.q] == CASES[r.i][0], r.show


@pytest.mark.parametrize("bad", ["[ void,'*'", "void", "[ nothing ]", "[ void,'()' ]", "[ void ] x"])
def test_bad_sequences(spark, bad):
    with pytest.raises(Exception, match="PythonException|ValueError"):
        spark.createDataFrame([(bad,)], "y string").select(T.from_yaml("y")).collect()


def test_functions(spark):
    tree = [("BASE", 1, None, "a"), ("BASE", 2, None, "b"), ("PTR", None, None, None), ("SUB", None, 2, None), ("PTMD", 3, None, "C")]
    df = spark.createDataFrame([(tree,)], f"t {T.TYPE}")
    one = T.ptr(T.base(9, "n"))
    r = df.select(
        T.contains(F.col("t"), F.lit(3)).alias("c"),
        T.contains(F.col("t"), F.lit(4)).alias("d"),
        F.transform(T.references(F.col("t")), lambda x: x["g"]).alias("refs"),
        T.member_classes(F.col("t")).alias("owners"),
        T.display(T.replaced(F.col("t"), 2, one)).alias("r"),
        T.display(T.replaced(F.col("t"), 3, T.base(9, "n"))).alias("owner"),
        F.transform(T.mapped(F.col("t"), lambda g: g + 10), lambda x: x["g"]).alias("m"),
    ).first()
    assert r.c and not r.d and r.refs == [1, 2, 3] and r.owners == [3]
    assert r.r == "a(n**) C::*" and r.owner == "a(b*) n::*" and [g for g in r.m if g] == [11, 12, 13]
    with pytest.raises(Exception, match="pointer to member"):
        df.select(T.replaced(F.col("t"), 3, one)).collect()


def test_sizes(spark):
    sized = {"void": None, "u32": 4}
    df = spark.createDataFrame([(arr(arr(base("u32"), 3), 2),), (arr(ptr(base("void")), 5),), (sub(U64, U64),), (ptmd("A", U64),), (ptmf("A", U64),), (base("void"),)], f"t {T.TYPE}")
    size = lambda t: F.when(t["s"] == "u32", sized["u32"])
    got = [r[0] for r in df.select(T.byte_size(F.col("t"), size, 8, 8, 16)).collect()]
    assert got == [24, 40, None, 8, 16, None]
