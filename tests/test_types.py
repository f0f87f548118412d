"""Fixtures of types and entries: loading, aliases, flattening, dedupe, linking, rules, cache."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import trees as T
from graphloom.operators import cache, dies, merge, optimize, rows, spelling
from graphloom.plans import fixpoint

G = {p[0]: p[3] for p in T.PRIMS}
U8, U32, U64, VOID = G["u8"], G["u32"], G["u64"], G["void"]


def b(g):
    return [("BASE", g, None, None)]


def ptr(t):
    return [*t, ("PTR", None, None, None)]


def m(offset, name, ty, special=None, bits=None):
    return (offset, name, ty, special, bits)


FIELDS = {"goff": None, "kind": None, "cu": 0, "name": None, "name_ns": [], "enclosing": [], "target": None, "byte_size": None, "base_goff": None, "enumerators": [], "targs": [], "members": [], "vtable": [], "tree": None, "decl_names": []}
SCHEMA = "goff bigint, kind string, cu bigint, " + ", ".join(f"{k} {v}" for k, v in dies.PAYLOAD.items()) + ", decl_names array<string>"


def types(spark, *given):
    return spark.createDataFrame([tuple((FIELDS | r).values()) for r in given], SCHEMA)


def row(goff, kind, **more):
    return {"goff": goff, "kind": kind} | more


def by_goff(df):
    return {r.goff: r for r in df.collect()}


def tree(t):
    return None if t is None else [tuple(x) for x in t]


def test_aliases(spark):
    df = types(
        spark,
        row(1, "alias", target=2),
        row(2, "typedef", name="T", target=3),
        row(3, "struct", name="S", members=[m(0, "x", b(1)), m(8, "y", b(5))]),
        row(4, "tree", tree=ptr(b(1))),
        row(5, "typedef", name="P", target=4),
        row(6, "typedef", name="N", target=U32),
        row(7, "typedef", name="TT", target=2),
        row(8, "tree", tree=b(3)),
    )
    p = by_goff(rows.predicates(df))
    assert [p[k].is_tree for k in (1, 4, 5, 6)] == [False, True, True, False] and [p[k].is_primitive for k in (3, 6)] == [False, True]
    got = by_goff(rows.clean_typedefs(df))
    assert set(got) == {2, 3, 4, 7}  # names of trees and primitives go, T and TT stay
    assert [tree(x.ty) for x in got[3].members] == [b(2), b(4)] and tree(got[4].tree) == ptr(b(2)) and got[7].target == 2
    assert {r.goff: r.names for r in rows.typedef_names(df).collect()}[3] == ["T", "TT"]
    with pytest.raises(ValueError):
        rows.clean_typedefs(types(spark, row(1, "alias", target=2), row(2, "alias", target=1)))


def test_enum_sizes(spark):
    df = types(spark, row(1, "enum", byte_size=2), row(2, "enum", base_goff=3), row(3, "alias", target=U64), row(4, "enum", base_goff=1), row(5, "enum", base_goff=VOID))
    got = {r.goff: (r.byte_size, r.error) for r in rows.enum_sizes(df).collect()}
    assert got == {1: (2, None), 2: (8, None), 4: (2, None), 5: (None, "no size")}


def test_cycles_are_rows(spark):
    df = types(spark, row(1, "alias", target=2), row(2, "alias", target=1), row(3, "typedef", name="T", target=2), row(4, "alias", target=9), row(5, "enum", base_goff=6), row(6, "enum", base_goff=5), row(7, "enum", base_goff=9), row(9, "enum", byte_size=4))
    assert {tuple(r) for r in rows.alias_errors(df).collect()} == {(g, 1, "alias cycle") for g in (1, 2, 3)}
    to, roots = rows.resolved_aliases(df, strict=False)
    assert {tuple(r) for r in to.collect()} == {(4, 9)} and {r.goff: r.root for r in roots.collect()}[4] == 9
    with pytest.raises(ValueError, match="cycle"):
        rows.resolved_aliases(df)
    assert {tuple(r) for r in rows.enum_sizes(df).collect()} == {(5, None, "size cycle"), (6, None, "size cycle"), (7, 4, None), (9, 4, None)}


def test_random_walks(spark):
    """Roots and cycles of random graphs against a walk from each node; a chain and a cycle longer than any power that a round starts with."""
    rng = random.Random(5)
    steps = {k: rng.choice([None, *range(400)]) if k % 7 else rng.randrange(900) for k in range(300)}
    steps |= {1000 + i: 1000 + (i + 1) % 77 for i in range(77)} | {2000 + i: 2001 + i if i < 5000 else None for i in range(5001)} | {8000 + i: 8001 + i for i in range(40)} | {8040: 1005}

    def walk(k):
        seen = []
        while k not in seen:
            seen.append(k)
            nxt = steps.get(k)
            if nxt is None:
                return k, len(seen) - 1, None
            k = nxt
        return None, None, min(seen[seen.index(k) :])

    got = {r.k: (r.root, r.hops, r.cycle) for r in fixpoint.resolve_rows(spark.createDataFrame(list(steps.items()), "k long, nxt long")).collect()}
    assert len(got) == len(steps)
    assert got == {k: (7000, 7000 - k, None) if 2000 <= k <= 7000 else walk(k) for k in steps}
    assert fixpoint.resolve_rows(spark.createDataFrame([], "k long, nxt long")).count() == 0


def test_union_errors(spark):
    ok = [m(0, "a", b(U64)), m(0, "b", ptr(b(9))), m(0, "c", b(3))]
    df = types(spark, row(1, "union", byte_size=8, members=ok), row(2, "union", byte_size=16, members=ok), row(3, "enum", base_goff=4), row(4, "alias", target=U32), row(5, "union", byte_size=8, members=[*ok, m(0, "d", b(9))]), row(9, "struct_decl"), row(10, "union", byte_size=4, members=[m(0, "a", b(3))]))
    assert {(r.goff, r.largest, r.error) for r in rows.union_errors(df).collect()} == {(2, 8, "not as large as its largest member"), (5, 8, "member without a size")}


def test_flatten(spark):
    sub = [*b(U32), *b(U8), ("SUB", None, 2, None)]
    df = types(
        spark,
        row(1, "tree", tree=[*b(3), ("ARRAY", None, 1, None)]),
        row(2, "tree", tree=sub),
        row(3, "tree", tree=ptr(b(9))),
        row(4, "tree", tree=[*b(2), ("PTMD", 9, None, None)]),
        row(9, "struct", members=[m(0, "a", b(1)), m(8, "b", b(4)), m(24, "c", b(U8))], targs=[("Type", None, b(3))], vtable=[(0, "f", [b(1), b(2)])]),
    )
    got = by_goff(rows.flatten_trees(df))
    assert set(got) == {9}
    r = got[9]
    assert [tree(x.ty) for x in r.members] == [ptr(b(9)), [*b(U32), *b(U8), ("PTMF", 9, 2, None)], b(U8)]
    assert tree(r.targs[0].tree) == ptr(b(9)) and [tree(x) for x in r.vtable[0].fn] == [ptr(b(9)), sub]
    with pytest.raises(ValueError):
        rows.flatten_trees(types(spark, row(1, "tree", tree=ptr(b(2))), row(2, "tree", tree=ptr(b(1)))))


def test_dedupe_to_the_end(spark):
    one = lambda inner: [m(0, "x", ptr(b(inner)))]
    df = types(spark, row(1, "struct", byte_size=1), row(2, "struct", byte_size=1), row(3, "struct", byte_size=8, members=one(1)), row(4, "struct", byte_size=8, members=one(2)), row(5, "union", byte_size=8, members=[m(0, "p", b(3)), m(0, "q", b(4))]), row(6, "struct", byte_size=8, members=one(6)))
    got, gone = rows.dedupe(df)
    assert set(by_goff(got)) == {1, 3, 5, 6} and {tuple(r) for r in gone.collect()} == {(2, 1), (4, 3)}
    assert [tree(x.ty) for x in by_goff(got)[5].members] == [b(3), b(3)]
    again, none = rows.dedupe(got)
    assert by_goff(again) == by_goff(got) and none.isEmpty()


def test_marks_and_groups(spark):
    df = types(spark, row(1, "struct", members=[m(0, "a", ptr(b(2)))]), row(2, "struct_decl"), row(3, "struct", members=[m(0, "a", b(4))]), row(4, "union"), row(5, "struct_decl"), row(6, "struct", members=[m(0, "s", ptr(b(6)))]), row(7, "struct", members=[m(0, "p", [*b(U8), ("PTMD", 4, None, None)])], vtable=[(0, "f", [b(VOID)])]))
    roots = spark.createDataFrame([(5,)], "k bigint")
    assert set(by_goff(rows.mark_and_sweep(df, roots, "M"))) == {1, 2, 3, 4, 5, 6, 7}
    assert set(by_goff(rows.mark_and_sweep(df, roots, "H"))) == {5, 6}  # 6 refers to itself
    sym = spark.createDataFrame([("f", ptr(b(3)))], f"link_name string, ty {T.TYPE}")
    assert set(by_goff(rows.prune(df, sym))) == {3, 4}
    assert {r.goff: r.component for r in rows.linked_groups(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 3}
    assert {r.goff for r in rows.non_eliminateable(df).collect()} == {4, 6, 7}
    got, two = rows.buckets(spark.createDataFrame([(9, U8), (9, 8), (3, 4), (U32, 11), (11, U64)], "src bigint, dst bigint"))
    assert {r.goff: r.primary for r in got.collect()} == {9: U8, 8: U8, U8: U8, 3: 3, 4: 3, U32: U32, 11: U32, U64: U32} and two.count() == 1
    at, mutual = rows.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4)], "src bigint, dst bigint"))
    assert {tuple(r) for r in at.collect()} == {(1, 2), (1, 3), (1, 4), (2, 2), (2, 3), (2, 4), (3, 2), (3, 3), (3, 4)} and {tuple(r) for r in mutual.where("src <> dst").collect()} == {(2, 3), (3, 2)}
    r = rows.stage_counts(df, sym.withColumn("ty", F.col("ty"))).first()
    assert (r.types, r.struct, r.struct_decl, r.symbols, r.functions, r.data) == (7, 4, 2, 1, 0, 1)


def spelled(df):
    return spelling.spellings(spelling.full_names(df))


def test_link(spark):
    df = types(
        spark,
        row(10, "struct", name="A", byte_size=8, members=[m(0, "p", ptr(b(11)))], vtable=[(0, "~A", [b(VOID)]), (2, "f", [b(U8)])]),
        row(11, "union", byte_size=4, members=[m(0, "x", b(U32))]),
        row(20, "struct", name="A", cu=1, byte_size=8, members=[m(0, "p", ptr(b(21)))], vtable=[(1, "~A", [b(VOID)]), (3, "g", [b(U8)])]),
        row(21, "union", cu=1, byte_size=4, members=[m(0, "x", b(U32))]),
        row(22, "struct_decl", name="B", cu=1),
        row(12, "struct", name="B", byte_size=1),
        row(23, "struct", name="C", cu=1, byte_size=4),
        row(13, "struct", name="C", byte_size=5),
        row(14, "struct", name="unused", byte_size=1),
    )
    sym = spark.createDataFrame([("f", [*ptr(b(20)), *b(22), *b(13), *b(23), ("SUB", None, 4, None)])], f"link_name string, ty {T.TYPE}")
    got, s, wrong = merge.link(df.where("goff not in (13, 23)"), sym, spelled, strict=True)
    got = by_goff(got)
    assert set(got) == {10, 11, 12, 14} and wrong.isEmpty()
    assert [(v.idx, v.name) for v in got[10].vtable] == [(0, "~A"), (2, "f"), (3, "g")]
    assert tree(s.first().ty)[:3] == [*ptr(b(10)), *b(12)] and got[12].decl_names == []
    assert {(r.code, r.a, r.b) for r in merge.plan_merges(df, spelled(df))[1].collect()} == {("shape", 13, 23)}
    bad = types(spark, row(1, "struct", name="A", members=[m(0, "p", b(2))]), row(2, "struct", name="X", byte_size=1), row(3, "struct", name="A", members=[m(0, "p", b(4))]), row(4, "struct", name="Y", byte_size=1))
    groups, wrong = merge.plan_merges(bad, spelled(bad))
    assert {(r.code, r.a, r.b) for r in wrong.collect()} == {("orphan", 2, 4)} and groups.isEmpty()


def test_symbols(spark):
    schema = f"cu bigint, link_name string, ty {T.TYPE}, param_names array<string>, targs array<{dies.TARG}>, address bigint"
    arg = [("Const", 3, None)]
    df = spark.createDataFrame([(0, "f", b(1), ["a"], [], 7), (0, "f", b(1), ["a"], arg, 7), (0, "g", b(1), [], [], 8), (0, "g", b(2), [], [], 8), (1, "f", b(9), ["a"], arg, 7), (1, "h", b(1), ["x"], [], 1), (2, "h", b(1), ["y"], [], 1)], schema)
    own, clash = merge.symbols_of_unit(df.drop("address"))
    got = {(r.cu, r.link_name): len(r.targs) for r in own.collect()}
    assert got == {(0, "f"): 1, (1, "f"): 1, (1, "h"): 0, (2, "h"): 0} and [tuple(r) for r in clash.collect()] == [(0, "g")]
    one, clash = merge.symbols_across(df.where("link_name <> 'g'"))
    assert [(r.link_name, tree(r.ty)) for r in one.collect()] == [("f", b(1))] and [r.link_name for r in clash.collect()] == ["h"]
    listed = spark.createDataFrame([("f", 5)], "symbol string, addr bigint")
    assert {(r.link_name, r.address) for r in merge.symbol_join(df.drop("address"), listed).collect()} == {("f", 5)}


def stage(spark, *given, symbols=()):
    df = types(spark, *given)
    sym = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(symbols or [b(VOID)])], f"link_name string, ty {T.TYPE}")
    return optimize.Stage(optimize.from_units(df), sym)


def test_rules(spark):
    st = stage(
        spark,
        row(1, "struct", name="Outer", byte_size=24, members=[m(0, "a", b(2)), m(8, "b", b(3)), m(16, "c", b(4))]),
        row(2, "struct", name="Wrap", byte_size=8, members=[m(0, "v", ptr(b(U8)))]),
        row(3, "union", name="Same", byte_size=4, members=[m(0, "x", b(U32)), m(0, "y", b(U32))]),
        row(4, "union", name="Pick", byte_size=4, members=[m(0, "x", b(5)), m(0, "y", [*b(U8), ("ARRAY", None, 4, None)])]),
        row(5, "enum", name="Color", byte_size=4),
        row(6, "struct", name="ColorBox", byte_size=4, members=[m(0, "x", b(U32)), m(2, "y", b(U8))]),
        row(7, "union", name="Empty", byte_size=1),
        row(8, "struct_decl", name="Open"),
        symbols=[ptr(b(6)), ptr(b(4)), b(1)],
    )
    out = optimize.optimize(st, optimize.Rules(pick=[("^Pick$", ["x", "y"], 0)], enums=[("Box$", "^Color$")]))
    got = by_goff(out.types)
    assert set(got) == {1, 5, 7, 8} and got[7].kind == "struct" and got[8].kind == "struct"
    assert [tree(x.ty) for x in got[1].members] == [ptr(b(U8)), b(U32), b(5)]
    assert {n.name for n in got[5].fqnames} == {"Color", "Pick", "ColorBox"}
    assert sorted(tree(r.ty) for r in out.symbols.collect()) == sorted([ptr(b(5)), ptr(b(5)), b(1)])
    assert out.derived.count() >= 2
    assert set(by_goff(optimize.optimize(st, optimize.Rules(), prune=True).types)) == {1, 5, 6}


def test_guards(spark):
    vt = row(1, "struct", name="V", byte_size=8, members=[m(0, "v", ptr(b(U8)))], vtable=[(0, "f", [b(VOID)])])
    owner = row(2, "struct", name="O", byte_size=8, members=[m(0, "v", ptr(b(U8)))])
    of = row(3, "struct", name="H", byte_size=16, members=[m(0, "p", [*b(U8), ("PTMD", 2, None, None)]), m(8, "q", b(U64))])
    st = stage(spark, vt, owner, of)
    assert set(by_goff(optimize.optimize(st, optimize.Rules()).types)) == {1, 2, 3}
    with pytest.raises(ValueError):
        optimize.optimize(stage(spark, row(2, "struct", name="O", byte_size=9, members=[m(0, "v", ptr(b(U8)))])), optimize.Rules())
    same = stage(spark, row(2, "struct", name="O", byte_size=9, members=[m(0, "v", ptr(b(U8)))]))
    assert set(by_goff(optimize.optimize(same, optimize.Rules(strict=False)).types)) == {2}
    with pytest.raises(ValueError):
        optimize.optimize(stage(spark, row(4, "union", name="Pick", byte_size=4, members=[m(0, "x", b(U32))])), optimize.Rules(pick=[("Pick", ["x", "y"], 0)]))
    chain = stage(spark, row(1, "struct", name="A", byte_size=4, members=[m(0, "x", b(2))]), row(2, "union", name="B", byte_size=4, members=[m(0, "x", b(3))]), row(3, "struct", name="C", byte_size=4, members=[m(0, "x", b(U32)), m(2, "y", b(U8))]))
    got = by_goff(optimize.optimize(chain, optimize.Rules()).types)
    assert set(got) == {3} and {n.name for n in got[3].fqnames} == {"A", "B", "C"}


def entry(cu, goff, parent, ord_, tag, **attrs):
    return (cu, goff, parent, ord_, tag, {k: str(v) for k, v in attrs.items()})


ENTRIES = [
    entry(0, 1, None, 0, "compile_unit", name="a.cpp"),
    entry(0, 2, 1, 0, "namespace", name="ns"),
    entry(0, 3, 2, 0, "class_type", name="S<int>", byte_size=24),
    entry(0, 4, 3, 0, "member", name="late", type=20, data_member_location=16),
    entry(0, 5, 3, 1, "member", name="_vptr$S", type=20, data_member_location=0),
    entry(0, 6, 3, 2, "inheritance", type=30, data_member_location=16),
    entry(0, 7, 3, 3, "member", name="static", type=20, external=1),
    entry(0, 8, 3, 4, "member", name="b1", type=20, data_member_location=8, bit_size=3, byte_size=4),
    entry(0, 9, 3, 5, "member", name="b2", type=20, data_member_location=8, bit_size=5, byte_size=4),
    entry(0, 10, 3, 6, "subprogram", name="f", virtuality="virtual", vtable_elem_location=1, type=20),
    entry(0, 11, 10, 0, "formal_parameter", type=21),
    entry(0, 12, 3, 7, "template_type_parameter", type=20),
    entry(0, 13, 3, 8, "GNU_template_parameter_pack"),
    entry(0, 14, 13, 0, "template_value_parameter", const_value=5),
    entry(0, 15, 13, 1, "template_type_parameter"),
    entry(0, 20, 1, 1, "base_type", encoding="signed", byte_size=4),
    entry(0, 21, 1, 2, "pointer_type", type=3),
    entry(0, 22, 1, 3, "array_type", type=20),
    entry(0, 23, 22, 0, "subrange_type", count=3),
    entry(0, 24, 22, 1, "subrange_type", count=4),
    entry(0, 25, 1, 4, "subroutine_type", type=20),
    entry(0, 26, 25, 0, "formal_parameter", type=21),
    entry(0, 27, 1, 5, "ptr_to_member_type", type=25, containing_type=3),
    entry(0, 28, 1, 6, "typedef", name="T", type=3),
    entry(0, 29, 1, 7, "const_type", type=28),
    entry(0, 30, 1, 8, "structure_type", name="Base", byte_size=1),
    entry(0, 31, 1, 9, "enumeration_type", name="E", type=20),
    entry(0, 32, 31, 1, "enumerator", name="B", const_value=2),
    entry(0, 33, 31, 0, "enumerator", name="A", const_value=1),
    entry(0, 34, 1, 10, "union_type", name="U", byte_size=4),
    entry(0, 35, 34, 0, "member", type=20),
    entry(0, 36, 34, 1, "member", type=31, name="e"),
    entry(0, 37, 34, 2, "member", type=20, name="i"),
    entry(0, 38, 1, 11, "structure_type", name="D", declaration=1),
    entry(0, 39, 1, 12, "base_type", encoding="odd", byte_size=3),
    entry(0, 40, 1, 13, "structure_type", name="Clash", byte_size=8),
    entry(0, 41, 40, 0, "member", name="a", type=20, data_member_location=0),
    entry(0, 42, 40, 1, "member", name="b", type=20, data_member_location=0),
    entry(0, 50, 1, 20, "subprogram", linkage_name="_Zdecl", declaration=1, name="m", type=20),
    entry(0, 51, 50, 0, "formal_parameter", type=21, name="x"),
    entry(0, 52, 1, 21, "subprogram", specification=50, low_pc=4096),
    entry(0, 53, 52, 0, "formal_parameter", abstract_origin=51),
    entry(0, 54, 52, 1, "formal_parameter", type=20),
    entry(0, 55, 1, 22, "variable", linkage_name="_Zv", specification=56),
    entry(0, 56, 1, 23, "variable", type=34),
    entry(0, 57, 52, 2, "lexical_block"),
    entry(0, 58, 57, 0, "typedef", name="local", type=20),
]


def test_entries(spark):
    d = spark.createDataFrame(ENTRIES, dies.DIE)
    got = by_goff(dies.types(d))
    S = got[3]
    assert S.kind == "struct" and S.name == "S" and [s.s for s in S.name_ns] == ["ns"] and S.byte_size == 24
    assert [(x.offset, x.name, x.special, x.bit_bytes) for x in S.members] == [(0, None, "Vfptr", None), (8, "b2", "Bitfield", 4), (16, "late", None, None)]
    assert tree(S.members[0].ty) == [("BASE", U64, None, "u64")]
    assert [(a.k, a.const, tree(a.tree)) for a in S.targs] == [("Type", None, b(20)), ("Const", 5, None), ("Type", None, b(VOID))]
    assert [(v.idx, v.name, [tree(x) for x in v.fn]) for v in S.vtable] == [(1, "f", [b(20), b(21)])]
    assert got[20].kind == "alias" and got[20].target == G["i32"]
    assert tree(got[21].tree) == ptr(b(3)) and tree(got[22].tree) == [*b(20), ("ARRAY", None, 12, None)]
    assert tree(got[25].tree) == [*b(20), *b(21), ("SUB", None, 2, None)] and tree(got[27].tree) == [*b(20), *b(21), ("PTMF", 3, 2, None)]
    assert (got[28].kind, got[28].name, got[28].target) == ("typedef", "T", 3) and (got[29].kind, got[29].target) == ("alias", 28)
    assert got[58].kind == "alias"  # a typedef in a function
    assert [(e.name, e.value) for e in got[31].enumerators] == [("A", 1), ("B", 2)] and got[31].base_goff == 20
    assert [(x.name, tree(x.ty)) for x in got[34].members] == [("i", b(20)), ("e", b(31))]
    assert got[38].kind == "struct_decl" and 40 not in got and 39 not in got
    assert {(r.goff, r.code) for r in dies.errors(d).collect()} == {(39, "primitive"), (40, "layout")}
    assert dies.types(d, abandon=["^T$"]).where("goff = 28").first().kind == "alias"
    f = dies.functions(d).collect()
    assert [(r.link_name, tree(r.ty), r.param_names) for r in f] == [("_Zdecl", [*b(20), *b(21), *b(20), ("SUB", None, 3, None)], ["x", "a1"])]
    v = dies.data(d).collect()
    assert [(r.link_name, tree(r.ty)) for r in v] == [("_Zv", b(34))]
    ns = {r.ns: r.clash for r in dies.namespaces_by_source(dies.namespaces(d)).collect()}
    assert ns == {"ns": False}
    named, lost = dies.qualified(d)
    assert {(r.goff, r.base) for r in named.where("goff in (3, 28)").collect()} == {(3, "S"), (28, "T")} and lost.isEmpty()


def test_unit_to_the_end(spark):
    """Entries to rows without aliases and trees, to fqnames, to rules."""
    d = spark.createDataFrame(ENTRIES, dies.DIE)
    unit = by_goff(optimize.to_units(dies.types(d).drop("cu")))
    assert set(unit) == {3, 30, 31, 34, 38} and unit[31].byte_size == 4 and unit[3].decl_names == ["T"]
    i32 = [("BASE", G["i32"], None, None)]
    assert [tree(x.ty) for x in unit[34].members] == [i32, b(31)] and tree(unit[3].targs[0].tree) == i32


def test_cache(spark, tmp_path):
    def unit(shift, size=4):
        return [row(100 + shift, "struct", name="A", byte_size=size, members=[m(0, "x", ptr(b(101 + shift)))]), row(101 + shift, "struct", name="B", byte_size=1)]

    keep = ["cu", "goff", "kind", "name", "byte_size", "members"]
    both = lambda s, size=4: types(spark, *unit(s), *[r | {"cu": 1} for r in unit(500 + s, size)]).select(keep)
    c = cache.StageCache(spark, str(tmp_path), "h")
    first = both(0)
    assert c.lookup(first)[0] is None and c.hits(first) == (0, 2)
    c.save(first, first)
    assert c.hits(both(7)) == (2, 2) and c.hits(both(7, 8)) == (1, 2)
    out, rest = c.lookup(both(7, 8))
    assert {(r.cu, r.goff) for r in out.collect()} == {(0, 107), (0, 108)} and {r.cu for r in rest.collect()} == {1}
    assert tree(out.where("goff = 107").first().members[0].ty) == ptr(b(108))
    assert cache.StageCache(spark, str(tmp_path), "other").hits(first) == (0, 2)
    plain, number = cache.normalised(first)
    assert sorted(cache.restored(plain, number).collect(), key=str) == sorted(first.collect(), key=str)
    assert spark.range(1).select(cache.cache_key(F.lit("/a/b.cpp"))).first()[0].startswith("b.cpp_")


def test_cache_after_a_crash_and_beside_a_writer(spark, tmp_path, monkeypatch):
    one = lambda size, cu=0: types(spark, row(100 + cu, "struct", name="A", byte_size=size, cu=cu)).select("cu", "goff", "kind", "name", "byte_size")
    c = cache.StageCache(spark, str(tmp_path), "h")
    c.save(one(4), one(4))
    real = c._commit
    monkeypatch.setattr(c, "_commit", lambda n, parts: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        c.save(one(99), one(99))  # dies with rows and prints written
    again = cache.StageCache(spark, str(tmp_path), "h")
    assert again.hits(one(99)) == (0, 1) and again.lookup(one(4))[0].first().byte_size == 4
    # another writer takes the number first: both are there
    monkeypatch.setattr(c, "_commit", lambda n, parts: (monkeypatch.setattr(c, "_commit", real), again.save(one(8, 1), one(8, 1)), real(n, parts))[2])
    c.save(one(99), one(99), "b1")
    assert c.hits(one(99).union(one(8, 1))) == (2, 2) and c.hits(one(4)) == (0, 1) and c.version()[0] == 3
    c.save(one(99), one(5), "b1")  # the same batch
    assert c.version()[0] == 3 and c.lookup(one(99))[0].first().byte_size == 99
    c.compact()
    c.vacuum()
    assert len(c.version()[1]) == 1 and c.hits(one(99).union(one(8, 1))) == (2, 2)
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("part-")]) == 1
