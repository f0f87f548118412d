"""Type trees in postfix: ARRAY<STRUCT<op, g, n, s>>, with higher-order functions only.

op is BASE, PTR, ARRAY (n elements), SUB (n operands: return type, then arguments), PTMD (a pointee) or PTMF (n operands).
g is the goff of a BASE, or of the class of a PTMD or PTMF; s is its name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<struct<op:string,g:bigint,n:int,s:string>>"
# Primitive, its C++ spelling, its size in bytes, its goff.
PRIMS = [
    ("void", "void", None, 0xFFFF1000),
    ("bool", "bool", 1, 0xFFFF1001),
    ("u8", "uint8_t", 1, 0xFFFF1101),
    ("u16", "uint16_t", 2, 0xFFFF1102),
    ("u32", "uint32_t", 4, 0xFFFF1104),
    ("u64", "uint64_t", 8, 0xFFFF1108),
    ("u128", "uint128_t", 16, 0xFFFF1110),
    ("i8", "int8_t", 1, 0xFFFF1201),
    ("i16", "int16_t", 2, 0xFFFF1202),
    ("i32", "int32_t", 4, 0xFFFF1204),
    ("i64", "int64_t", 8, 0xFFFF1208),
    ("i128", "int128_t", 16, 0xFFFF1210),
    ("f32", "float32_t", 4, 0xFFFF1304),
    ("f64", "float64_t", 8, 0xFFFF1308),
    ("f128", "float128_t", 16, 0xFFFF1310),
]
NAMES = [p[0] for p in PRIMS]
FIRST_PRIM = 0xFFFF0000


def is_prim(goff: Column) -> Column:
    return goff >= FIRST_PRIM


def token(op: str, g=None, n=None, s=None) -> Column:
    """A tree of one token."""
    c = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.array(F.struct(F.lit(op).alias("op"), c(g, "bigint").alias("g"), c(n, "int").alias("n"), c(s, "string").alias("s")))


def base(g=None, s=None) -> Column:
    return token("BASE", g, None, s)


def prim(name: str) -> Column:
    return base(next(p[3] for p in PRIMS if p[0] == name), name)


def ptr(tree: Column) -> Column:
    return F.concat(tree, token("PTR"))


def array(tree: Column, n) -> Column:
    return F.concat(tree, token("ARRAY", None, n))


def sub(*operands: Column) -> Column:
    return F.concat(*operands, token("SUB", None, len(operands)))


def ptmd(g, s, pointee: Column) -> Column:
    return F.concat(pointee, token("PTMD", g, None, s))


def ptmf(g, s, *operands: Column) -> Column:
    return F.concat(*operands, token("PTMF", g, len(operands), s))


def contains(tree: Column, goff: Column) -> Column:
    return F.exists(tree, lambda t: t["g"].eqNullSafe(goff))


def references(tree: Column) -> Column:
    """Tokens that name a type, classes of pointers to members included."""
    return F.filter(tree, lambda t: t["g"].isNotNull())


def member_classes(tree: Column) -> Column:
    """goffs of the classes of pointers to members."""
    return F.transform(F.filter(tree, lambda t: t["op"].isin("PTMD", "PTMF")), lambda t: t["g"])


def mapped(tree: Column, goff_of) -> Column:
    """Every goff g as goff_of(g)."""
    return F.transform(tree, lambda t: F.struct(t["op"].alias("op"), F.when(t["g"].isNotNull(), goff_of(t["g"])).alias("g"), t["n"].alias("n"), t["s"].alias("s")))


def replaced(tree: Column, goff: Column, by: Column) -> Column:
    """Each BASE of goff gives way to the tree `by`; a class of a pointer to member only to a single BASE, else it is an error."""
    goff, by = (x if isinstance(x, Column) else F.lit(x) for x in (goff, by))

    def one(t: Column) -> Column:
        of = F.struct(t["op"].alias("op"), by[0]["g"].alias("g"), t["n"].alias("n"), by[0]["s"].alias("s"))
        whole = (F.size(by) == 1) & (by[0]["op"] == "BASE")
        return F.when(~t["g"].eqNullSafe(goff), F.array(t)).when(t["op"] == "BASE", by).when(whole, F.array(of)).otherwise(F.raise_error(F.lit("the class of a pointer to member can't become a tree")).cast(TYPE))

    return F.flatten(F.transform(tree, one))


def byte_size(tree: Column, size_of, pointer: int, data_member: int, function_member: int) -> Column:
    """Size of the tree, null where it has none; size_of gives that of a BASE token."""

    def step(size: Column, t: Column) -> Column:
        fixed = F.when(t["op"] == "PTR", pointer).when(t["op"] == "PTMD", data_member).when(t["op"] == "PTMF", function_member)
        return F.when(t["op"] == "ARRAY", size * t["n"]).when(t["op"] == "BASE", size_of(t)).otherwise(fixed.cast("bigint")).cast("bigint")

    return F.aggregate(tree, F.lit(None).cast("bigint"), step)


def _fold(tree: Column, leaf, ptr_, array_, sub_, ptmd_, ptmf_, join: tuple[str, str, str]) -> Column:
    """Stack fold to text. An entry keeps a subroutine's arguments apart, since a pointer puts its mark before them."""
    before, between, after = join
    whole = lambda e: F.when(e["args"].isNull(), e["text"]).otherwise(sub_(e["text"], e["args"]))

    def entry(text: Column, args: Column | None = None) -> Column:
        return F.struct(text.cast("string").alias("text"), (F.lit(None) if args is None else args).cast("string").alias("args"))

    def step(stack: Column, t: Column) -> Column:
        n = F.when(t["op"].isin("SUB", "PTMF"), t["n"]).when(t["op"] == "BASE", 0).otherwise(1)
        under, top = F.slice(stack, 1, F.size(stack) - n), F.slice(stack, F.size(stack) - n + 1, n)
        first = F.try_element_at(top, F.lit(1))
        args = F.array_join(F.transform(F.slice(top, 2, F.greatest(n - 1, F.lit(0))), lambda e: F.concat(F.lit(before), whole(e), F.lit(after))), between)
        new = (
            F.when(t["op"] == "BASE", entry(leaf(t)))
            .when(t["op"] == "PTR", entry(F.when(first["args"].isNull(), ptr_(first["text"], None)).otherwise(ptr_(first["text"], first["args"]))))
            .when(t["op"] == "ARRAY", entry(array_(whole(first), t["n"].cast("string"))))
            .when(t["op"] == "SUB", entry(whole(first), args))
            .when(t["op"] == "PTMD", entry(ptmd_(whole(first), leaf(t))))
            .otherwise(entry(ptmf_(whole(first), leaf(t), args)))
        )
        return F.array_append(under, new)

    stack = F.aggregate(tree, F.array().cast("array<struct<text:string,args:string>>"), step)
    return whole(F.element_at(stack, -1))


def display(tree: Column) -> Column:
    """C++-like spelling: R(A, B), R (*)(A, B) of a pointer to it, T[n], T C::*, R (C::*)(A)."""
    lit = F.lit
    return _fold(
        tree,
        lambda t: t["s"],
        lambda x, args: F.concat(x, lit("*")) if args is None else F.concat(x, lit(" (*)("), args, lit(")")),
        lambda x, n: F.concat(x, lit("["), n, lit("]")),
        lambda r, args: F.concat(r, lit("("), args, lit(")")),
        lambda x, c: F.concat(x, lit(" "), c, lit("::*")),
        lambda r, c, args: F.concat(r, lit(" ("), c, lit("::*)("), args, lit(")")),
        ("", ", ", ""),
    )


def to_yaml(tree: Column) -> Column:
    """The tree as a flow sequence: [ u32,'()',[[ u32 ],[ u32,'*' ]],'*' ]."""
    lit = F.lit
    name = lambda t: F.when(t["s"].isin(*NAMES), t["s"]).otherwise(F.concat(lit("'\""), t["s"], lit("\"'")))
    text = _fold(
        tree,
        name,
        lambda x, args: F.concat(x, lit(",'*'")) if args is None else F.concat(x, lit(",'()',["), args, lit("],'*'")),
        lambda x, n: F.concat(x, lit(",["), n, lit("]")),
        lambda r, args: F.concat(r, lit(",'()',["), args, lit("]")),
        lambda x, c: F.concat(x, lit(","), c, lit(",'::','*'")),
        lambda r, c, args: F.concat(r, lit(","), c, lit(",'::','()',["), args, lit("],'*'")),
        ("[ ", ",", " ]"),
    )
    return F.concat(lit("[ "), text, lit(" ]"))


def _sequence(text: str) -> list:
    """A YAML flow sequence of plain and quoted scalars, numbers and sequences."""
    at = 0

    def space() -> None:
        nonlocal at
        while at < len(text) and text[at].isspace():
            at += 1

    def value():
        nonlocal at
        space()
        if at >= len(text):
            raise ValueError(f"unfinished type: {text}")
        c = text[at]
        if c == "[":
            at += 1
            out: list = []
            space()
            while text[at : at + 1] != "]":
                out.append(value())
                space()
                if text[at : at + 1] == ",":
                    at += 1
                    space()
                elif text[at : at + 1] != "]":
                    raise ValueError(f"no , or ] at {at}: {text}")
            at += 1
            return out
        if c == "'":
            out_, at = "", at + 1
            while True:
                end = text.index("'", at)
                out_ += text[at:end]
                at = end + 1
                if text[at : at + 1] != "'":
                    return out_
                out_, at = out_ + "'", at + 1
        if c == '"':
            got, end = json.JSONDecoder().raw_decode(text, at)
            at = end
            return got
        start = at
        while at < len(text) and text[at] not in ",[]" and not text[at].isspace():
            at += 1
        word = text[start:at]
        return int(word) if word.isdigit() else word

    got = value()
    space()
    if at != len(text) or not isinstance(got, list):
        raise ValueError(f"not one sequence: {text}")
    return got


def _postfix(seq: list) -> list[tuple]:
    goffs = {p[0]: p[3] for p in PRIMS}

    def leaf(x) -> tuple:
        if isinstance(x, str) and x in goffs:
            return (goffs[x], None, x)
        if isinstance(x, str) and len(x) > 1 and x[0] == x[-1] == '"':
            return (None, None, x[1:-1])
        raise ValueError(f"not a type: {x}")

    g, _, s = leaf(seq[0])
    out, i = [("BASE", g, None, s)], 1

    def operands(x) -> int:
        if not isinstance(x, list) or not all(isinstance(a, list) for a in x):
            raise ValueError(f"not arguments: {x}")
        for a in x:
            out.extend(_postfix(a))
        return 1 + len(x)

    while i < len(seq):
        x = seq[i]
        if x == "*":
            out.append(("PTR", None, None, None))
        elif isinstance(x, list) and len(x) == 1 and isinstance(x[0], int):
            out.append(("ARRAY", None, x[0], None))
        elif x == "()":
            i += 1
            out.append(("SUB", None, operands(seq[i] if i < len(seq) else None), None))
        elif seq[i + 1 : i + 3] == ["::", "*"]:
            g, _, s = leaf(x)
            out.append(("PTMD", g, None, s))
            i += 2
        elif seq[i + 1 : i + 3] == ["::", "()"] and seq[i + 4 : i + 5] == ["*"]:
            g, _, s = leaf(x)
            out.append(("PTMF", g, operands(seq[i + 3]), s))
            i += 4
        else:
            raise ValueError(f"{x} can't stand here")
        i += 1
    return out


def from_yaml(text: Column | str) -> Column:
    """The tree of a flow sequence, as to_yaml() and to_sequence() write it; null stays null, anything else is an error."""

    @F.pandas_udf(TYPE)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in texts:
            yield pd.Series([None if t is None else [{"op": o, "g": g, "n": n, "s": s} for o, g, n, s in _postfix(_sequence(t))] for t in b])

    return run(text)


def to_sequence(text: Column | str) -> Column:
    """What to_yaml() wrote, serialised with one quoting style, as a sequence that any YAML or JSON reader takes."""

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in texts:
            yield pd.Series([None if t is None else json.dumps(_sequence(t)) for t in b])

    return run(text)
