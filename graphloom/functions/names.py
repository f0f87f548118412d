"""Name functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def untemplated(name: Column) -> Column:
    """What stands before the first <."""
    return F.substring_index(name, "<", 1)


def first_match(name: Column, rules: list[str]) -> Column:
    """0-based position of the first pattern found in the name; the number of patterns where none is."""
    out = F.lit(len(rules))
    for i, r in reversed(list(enumerate(rules))):
        out = F.when(name.rlike(r), i).otherwise(out)
    return out.cast("long")


def sort_key(name: Column, prefer: list[str], dislike: list[str]) -> Column:
    """Lower is better: preference first, then dislikes; no dislike is 0."""
    d = first_match(name, dislike)
    return F.shiftleft(first_match(name, prefer), 16).bitwiseOR(F.when(d == len(dislike), 0).otherwise(d + 1))


# Character, what stands for it in an identifier. The dollar comes first.
MANGLED = [
    ("$", "$$"),
    ("<", "$lt"),
    (">", "$gt"),
    ("=", "$eq"),
    ("+", "$add"),
    ("-", "$sub"),
    ("*", "$mul"),
    ("/", "$div"),
    ("(", "$l1"),
    (" ", "$sp"),
    (")", "$r1"),
    ("&", "$ap"),
    ("^", "$ca"),
    ("%", "$per"),
    ("[", "$l2"),
    ("]", "$r2"),
    ("{", "$l3"),
    ("}", "$r3"),
    (":", "$cl"),
    (",", "$cm"),
    (".", "$pe"),
    ("?", "$qu"),
    (";", "$se"),
    ("|", "$or"),
    ("~", "$ti"),
    ("'", "$q1"),
    ('"', "$q2"),
    ("!", "$ex"),
    ("`", "$bt"),
    ("@", "$at"),
]
PREFIX = "____stage0_parse_"  # fixed value


def mangled(name: Column) -> Column:
    """An identifier for the name: each segment with its odd characters spelled out and its length in bytes."""

    def segment(s: Column) -> Column:
        out = s
        for c, code in MANGLED:
            out = F.replace(out, F.lit(c), F.lit(code))
        return F.concat(out, F.lit("$$"), F.octet_length(s).cast("string"), F.lit("_"))

    return F.concat(F.lit(PREFIX), F.array_join(F.transform(F.split(name, "::"), segment), ""))


def split_namespace(source: Column, strict: bool = False) -> Column:
    """struct(ns, base) at the last ::; null, or with strict an error, where the base holds a >."""
    base = F.when(F.instr(source, "::") > 0, F.substring_index(source, "::", -1)).otherwise(source)
    ns = F.when(F.instr(source, "::") > 0, F.substr(source, F.lit(1), F.length(source) - F.length(base) - 2)).otherwise(F.lit(""))
    bad = (F.instr(source, "::") > 0) & base.contains(">")
    wrong = F.raise_error(F.concat(F.lit("base name holds templates: "), source)).cast("struct<ns:string,base:string>") if strict else F.lit(None).cast("struct<ns:string,base:string>")
    return F.when(bad, wrong).when(source.isNotNull(), F.struct(ns.alias("ns"), base.alias("base")))


def parse_untemplated(source: Column) -> Column:
    """Trimmed segments of a namespace; null where it holds one of <>*&."""
    return F.when(~source.rlike("[<>*&]"), F.transform(F.split(source, "::"), lambda x: F.trim(x)))


SEGMENTS = "array<struct<k:string,goff:bigint,s:string,is_linkage:boolean>>"


def namespace_source(segments: Column) -> Column:
    """C++ source of a namespace, without anonymous ones; null where it runs through a function."""
    own = F.transform(F.filter(segments, lambda n: n["k"].isin("Name", "Type")), lambda n: n["s"])
    return F.when(~F.exists(segments, lambda n: n["k"] == "Subprogram"), F.array_join(own, "::"))


def _none() -> Column:
    return F.array().cast("array<string>")


def as_set(x: Column) -> Column:
    return F.array_sort(F.array_distinct(x))


def namespace_spellings(segments: Column, names_of) -> Column:
    """Every spelling of a namespace: a type stands for all before it, by its own names; a type without names gives none."""

    def step(st: Column, n: Column) -> Column:
        v = st["v"]
        grown = F.when(F.size(v) == 0, F.array(n["s"])).otherwise(F.transform(v, lambda x: F.concat(x, F.lit("::"), n["s"])))
        of = F.coalesce(names_of(n["goff"]), _none())
        inside = F.transform(v, lambda x: F.concat(x, F.lit("::(function "), n["s"], F.lit(")")))
        new = F.when(n["k"] == "Name", grown).when(n["k"] == "Type", of).when((n["k"] == "Subprogram") & n["is_linkage"], F.array(n["s"])).when(n["k"] == "Subprogram", inside).otherwise(v)
        dead = st["dead"] | ((n["k"] == "Type") & (F.size(of) == 0))
        return F.struct(F.when(dead, _none()).otherwise(new).alias("v"), dead.alias("dead"))

    return as_set(F.aggregate(segments, F.struct(_none().alias("v"), F.lit(False).alias("dead")), step, lambda st: st["v"]))


def name_spellings(segments: Column, base: Column, names_of) -> Column:
    """Spellings of a name in its namespace."""
    inner = F.transform(namespace_spellings(segments, names_of), lambda x: F.concat(x, F.lit("::"), base))
    return F.when(F.size(segments) == 0, F.array(base)).otherwise(as_set(inner))


def product(sets: Column) -> Column:
    """Every choice of one from each set, in order; of no sets, none."""
    one = F.array(_none())
    all_ = F.aggregate(sets, one, lambda acc, s: F.flatten(F.transform(acc, lambda a: F.transform(s, lambda x: F.array_append(a, x)))))
    return F.when(F.size(sets) == 0, F.array().cast("array<array<string>>")).otherwise(all_)


def templated(names: Column, arguments: Column) -> Column:
    """Spellings N<A, B> from those of the name and of each argument; without arguments those of the name."""
    full = F.flatten(F.transform(names, lambda n: F.transform(product(arguments), lambda a: F.concat(n, F.lit("<"), F.array_join(a, ", "), F.lit(">")))))
    return as_set(F.when(F.size(arguments) == 0, names).otherwise(full))


def tree_spellings(tree: Column, names_of) -> Column:
    """Every spelling of a type tree: T[n], T*, R(A, B), R(*)(A, B), T C::*, R (C::*)(A); names_of gives a goff's names."""
    entry = "struct<v:array<string>,args:array<array<string>>>"
    no_args = F.lit(None).cast("array<array<string>>")

    def called(e: Column, before: Column) -> Column:
        return F.flatten(F.transform(e["v"], lambda r: F.transform(e["args"], lambda a: F.concat(r, before, F.lit("("), F.array_join(a, ", "), F.lit(")")))))

    def whole(e: Column) -> Column:
        return F.when(e["args"].isNull(), e["v"]).otherwise(called(e, F.lit("")))

    def make(v: Column, args: Column = no_args) -> Column:
        return F.struct(v.alias("v"), args.alias("args"))

    def step(stack: Column, t: Column) -> Column:
        n = F.when(t["op"].isin("SUB", "PTMF"), t["n"]).when(t["op"] == "BASE", 0).otherwise(1)
        under, top = F.slice(stack, 1, F.size(stack) - n), F.slice(stack, F.size(stack) - n + 1, n)
        first = F.try_element_at(top, F.lit(1))
        own = F.coalesce(names_of(t["g"]), _none())
        sets = F.transform(F.slice(top, 2, F.greatest(n - 1, F.lit(0))), lambda e: whole(e))
        args = F.when(F.size(sets) == 0, F.array(_none())).otherwise(product(sets))
        each = lambda f: F.transform(whole(first), f)
        member = F.flatten(F.transform(own, lambda c: each(lambda x: F.concat(x, F.lit(" "), c, F.lit("::*")))))
        method = F.flatten(F.transform(own, lambda c: F.flatten(F.transform(whole(first), lambda r: F.transform(args, lambda a: F.concat(r, F.lit(" ("), c, F.lit("::*)("), F.array_join(a, ", "), F.lit(")")))))))
        new = (
            F.when(t["op"] == "BASE", make(own))
            .when(t["op"] == "PTR", make(F.when(first["args"].isNull(), each(lambda x: F.concat(x, F.lit("*")))).otherwise(called(first, F.lit("(*)")))))
            .when(t["op"] == "ARRAY", make(each(lambda x: F.concat(x, F.lit("["), t["n"].cast("string"), F.lit("]")))))
            .when(t["op"] == "SUB", make(whole(first), args))
            .when(t["op"] == "PTMD", make(member))
            .otherwise(make(method))
        )
        return F.array_append(under, new)

    return as_set(whole(F.element_at(F.aggregate(tree, F.array().cast(f"array<{entry}>"), step), -1)))


def filled_parameters(names: Column) -> Column:
    """Empty parameter names become a{i}; the number goes up until no given name has it."""

    def fill(x: Column, i: Column) -> Column:
        free = F.filter(F.sequence(i.cast("int"), i.cast("int") + F.size(names)), lambda j: ~F.array_contains(names, F.concat(F.lit("a"), j.cast("string"))))
        return F.when(x != "", x).otherwise(F.concat(F.lit("a"), free[0].cast("string")))

    return F.transform(names, fill)


def rule_failures(pairs: DataFrame, prefer: list[str], dislike: list[str]) -> DataFrame:
    """(better, worse) pairs that the rules don't sort strictly."""
    return pairs.where(~(sort_key(F.col("better"), prefer, dislike) < sort_key(F.col("worse"), prefer, dislike)))


def namespaced(names: DataFrame, by_source: DataFrame) -> DataFrame:
    """(source, segments, base) of names (source, fallback): the namespace by its source, else parsed where it has no templates.

    by_source: (ns, segments). The fallback is tried where the source gives nothing; rows for which both fail have null segments.
    """

    def tried(df: DataFrame, col: str) -> DataFrame:
        part = split_namespace(F.col(col))
        df = df.withColumn("part", part).withColumn("ns", F.col("part.ns"))
        df = df.join(by_source.select("ns", F.col("segments").alias("known")), "ns", "left")
        parsed = F.transform(parse_untemplated(F.col("ns")), lambda s: F.struct(F.lit("Name").alias("k"), F.lit(None).cast("bigint").alias("goff"), s.alias("s"), F.lit(False).alias("is_linkage")))
        segments = F.when(F.col("ns") == "", F.array().cast(SEGMENTS)).otherwise(F.coalesce("known", parsed.cast(SEGMENTS)))
        return df.withColumn(f"{col}_segments", segments).withColumn(f"{col}_base", F.col("part.base")).drop("part", "ns", "known")

    both = tried(tried(names.select("source", "fallback"), "source"), "fallback")
    ok = F.col("source_segments").isNotNull()
    return both.select("source", F.coalesce("source_segments", "fallback_segments").alias("segments"), F.when(ok, F.col("source_base")).otherwise(F.col("fallback_base")).alias("base"))


def demangled(symbols: DataFrame, known: DataFrame) -> DataFrame:
    """(symbol, text): what the table known (symbol, text) says of mangled names; others, and those it lacks, stay as they are."""
    looked = symbols.select("symbol").join(known.select("symbol", "text"), "symbol", "left")
    return looked.select("symbol", F.when(F.col("symbol").rlike(r"^(\?|_Z)"), F.coalesce("text", "symbol")).otherwise(F.col("symbol")).alias("text"))


def twin_candidates(symbols: DataFrame) -> DataFrame:
    """(symbol, is_dtor, at, digit, variant) for every place where a constructor's or destructor's number may stand; symbols: (symbol, text)."""
    is_dtor = F.col("text").startswith("~") | F.col("text").contains("::~")
    rows = symbols.where("text <> symbol").select("symbol", is_dtor.alias("is_dtor"), F.explode(F.sequence(F.lit(2), F.greatest(F.length("symbol"), F.lit(2)))).alias("at"))
    before, own = F.substr("symbol", F.col("at") - 1, F.lit(1)), F.substr("symbol", F.col("at"), F.lit(1))
    place = F.when(F.col("is_dtor"), (before == "D") & own.isin("0", "1", "2")).otherwise((before == "C") & own.isin("1", "2", "3"))
    digit = F.explode(F.when(F.col("is_dtor"), F.array(*map(F.lit, "012"))).otherwise(F.array(*map(F.lit, "123"))))
    rows = rows.where(place).withColumn("digit", digit)
    variant = F.concat(F.substr("symbol", F.lit(1), F.col("at") - 1), F.col("digit"), F.substr("symbol", F.col("at") + 1, F.length("symbol")))
    return rows.withColumn("variant", variant)


def twins(symbols: DataFrame, known: DataFrame) -> DataFrame:
    """(symbol, twin): each symbol and, for a constructor or destructor of number 1 or 2, both numbers' symbols.

    A place counts if all its numbers demangle alike, the first such place wins; deleting destructors (0) and
    allocating constructors (3) have no twin. known: (symbol, text), the demangled text of each candidate.
    """
    text = demangled(symbols, known)
    cand = twin_candidates(text).join(known.select(F.col("symbol").alias("variant"), F.col("text").alias("v")), "variant", "left")
    good = cand.join(text, "symbol").groupBy("symbol", "is_dtor", "at").agg(F.min(F.coalesce(F.col("v") == F.col("text"), F.lit(False))).alias("alike")).where("alike")
    place = good.groupBy("symbol", "is_dtor").agg(F.min("at").alias("at"))
    single = F.substr("symbol", F.col("at"), F.lit(1)) == F.when(F.col("is_dtor"), "0").otherwise("3")
    two = place.where(~single).join(twin_candidates(text).where("digit in ('1', '2')"), ["symbol", "is_dtor", "at"]).select("symbol", F.col("variant").alias("twin"))
    return text.select("symbol", F.col("symbol").alias("twin")).union(two).distinct()
