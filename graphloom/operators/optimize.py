"""Rules that rewrite types in order of priority; a change starts again at the first rule.

The meaning is that of one change at a time, the least goff first. The rules over shapes run in batches that give the
same result: all that a rule finds changes at once, but for what depends on the order, which waits for a later batch
(see waiting()). Trees that stand for each other are composed, chains twice as far a round. Batches read and write only
what the rules look at (see Shapes); the types themselves are rewritten once, after the last batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import trees
from ..plans.fixpoint import cut
from . import rows, spelling
from .dies import PAYLOAD


@dataclass
class Stage:
    """Types of kinds prim, enum, union and struct with fqnames, and symbols; derived: (derived, base) names."""

    types: DataFrame
    symbols: DataFrame
    derived: DataFrame | None = None

    @cached_property
    def sizes(self) -> DataFrame:
        return rows.sizes(self.types)

    @cached_property
    def spelled(self) -> DataFrame:
        """(goff, spelled, kind) of this state; every rule that matches names reads it."""
        return cut(spelling.spellings(self.types.select("goff", "fqnames")).join(self.types.select("goff", "kind"), "goff"))


@dataclass
class Rules:
    """pick: (pattern, member names, place of the one to take); enums: (struct pattern, enum pattern); pointer sizes."""

    pick: list[tuple[str, list[str], int]] = field(default_factory=list)
    enums: list[tuple[str, str]] = field(default_factory=list)
    pointer: int = 8
    data_member: int = 8
    function_member: int = 16
    strict: bool = True


@dataclass
class Shapes:
    """What rules over shapes look at, and what batches have decided so far.

    types: unions and structs of a single member without virtual functions, with no more of their members than the types;
    sizes: of what those refer to. by: (goff, tree) of types that went, written out; empty: (goff) of unions that became
    structs; pairs: (lower, upper) of a type, or one that had gone to it before, and the named type that stood for it.
    """

    types: DataFrame
    sizes: DataFrame
    by: DataFrame | None = None
    empty: DataFrame | None = None
    pairs: DataFrame | None = None


Change = tuple[int, list | None]  # the goff that goes, and the tokens of what stands for it; None: becomes an empty struct


def from_units(types: DataFrame) -> DataFrame:
    """Rows of the linked stage with fqnames; declarations become structs without members, of size 1."""
    named = types.withColumn("fqnames", spelling.own_names(types))
    decl = F.col("kind").endswith("_decl")
    out = named.withColumn("byte_size", F.when(decl, 1).otherwise(F.col("byte_size")).cast("bigint")).withColumn("kind", F.when(decl, "struct").otherwise(F.col("kind")))
    for c in ("members", "vtable", "targs"):
        out = out.withColumn(c, F.when(decl, F.array().cast(PAYLOAD[c])).otherwise(F.col(c)))
    return out.select("goff", "kind", "fqnames", "byte_size", "enumerators", "targs", "members", "vtable")


def to_units(types: DataFrame, declared_names: DataFrame | None = None) -> DataFrame:
    """A unit's rows without aliases, trees and typedefs: sizes of enums, aliases, flattening, names of typedefs as decl_names, then dedupe."""
    sized = rows.enum_sizes(types).select("goff", F.col("byte_size").alias("own"))
    types = cut(types.join(sized, "goff", "left").withColumn("byte_size", F.coalesce("own", "byte_size")).drop("own"))
    given = rows.typedef_names(types)
    cleaned = cut(rows.clean_typedefs(types))
    chains = rows.resolved_aliases(cleaned)[1].join(cleaned.where("kind = 'typedef'").select("goff"), "goff", "left_semi").select("goff", F.col("root").alias("to"))
    flat = cut(rows.flatten_trees(rows.map_goffs(cleaned.where("kind <> 'typedef'"), cut(chains), own=False)))
    if declared_names is not None:
        given = given.union(declared_names).groupBy("goff").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    out = flat.join(given.withColumnRenamed("names", "decl_names"), "goff", "left").drop("target", "tree", "base_goff")
    return rows.dedupe(out)[0]


def _size(tree: str, df: DataFrame, st: Stage | Shapes, r: Rules) -> DataFrame:
    return rows.tree_sizes(df, tree, ["goff"], st.sizes, r.pointer, r.data_member, r.function_member)


def guarded(df: DataFrame, fixed: DataFrame) -> DataFrame:
    """(goff, to, held) that may go: a composite tree can't stand for a type that fixed has; held says whether it has it."""
    held = fixed.select("goff", F.lit(True).alias("held"))
    return df.join(held, "goff", "left").withColumn("held", F.coalesce("held", F.lit(False))).where(rows.single_base(F.col("to")).isNotNull() | ~F.col("held") | (F.size("to") == 0))


def _first(df: DataFrame, fixed: DataFrame) -> Change | None:
    """The change of the least goff among (goff, to) that the guard lets through."""
    got = guarded(df, fixed).orderBy("goff").limit(1).collect()
    if not got:
        return None
    if any(t["g"] == got[0]["goff"] for t in got[0]["to"]):
        raise ValueError(f"what stands for {got[0]['goff']} holds it")
    return got[0]["goff"], [tuple(t) for t in got[0]["to"]]


def pick_member(st: Stage, r: Rules, fixed: DataFrame) -> Change | None:
    """A configured union becomes the member picked; what doesn't fit the rule is an error."""
    if not r.pick:
        return None
    unions = cut(st.types.where("kind = 'union'"))
    spelled = st.spelled.where("kind = 'union'").drop("kind")
    for pattern, wanted, at in r.pick:
        hit = spelling.unique_match(spelled, pattern)
        if hit is None:
            continue
        row = unions.where(F.col("goff") == hit[0])
        own = [m["name"] or "" for m in row.first()["members"]]
        if own != wanted or at >= len(own):
            raise ValueError(f"members of {hit[1]} are {own}, not {wanted}")
        cand = _size("to", row.withColumn("to", F.col("members")[at]["ty"]), st, r)
        if cand.where("tree_size = byte_size").isEmpty():
            raise ValueError(f"the picked member of {hit[1]} has another size")
        got = _first(cand.select("goff", "to"), fixed)
        if got is None:
            raise ValueError(f"{hit[1]} can't be eliminated")
        return got
    return None


def enumeratorize(st: Stage, r: Rules, fixed: DataFrame) -> Change | None:
    """The first struct or union that a rule finds becomes the rule's enum."""
    if not r.enums:
        return None
    spelled = st.spelled
    for record, enum in r.enums:
        hit = spelling.unique_match(spelled.where("kind = 'enum'").drop("kind"), enum)
        if hit is None:
            continue
        some = spelling.matches(spelled.where("kind in ('struct', 'union')").drop("kind"), record).select("goff", trees.base(hit[0]).alias("to"))
        if (got := _first(some, fixed)) is not None:
            return got
    return None


def single_members(st: Stage | Shapes, r: Rules) -> DataFrame:
    """(goff, to) of structs of one member without virtual functions, of the member's size; another size is an error if strict."""
    one = st.types.where("kind = 'struct' and size(members) = 1 and size(vtable) = 0").select("goff", "byte_size", F.get("members", F.lit(0))["ty"].alias("to"))
    one = cut(_size("to", one, st, r))
    fits = F.col("byte_size").eqNullSafe(F.col("tree_size"))
    if r.strict and (bad := one.where(~fits).orderBy("goff").first()):
        raise ValueError(f"struct {bad['goff']} has size {bad['byte_size']}, its member {bad['tree_size']}")
    return one.where(fits).select("goff", "to")


def few_members(st: Stage | Shapes, r: Rules) -> DataFrame:
    """(goff, to, odd) of unions: without members, which become empty structs (to is empty), of a single member, and of two of which one is a named type of the union's size. odd: a single member of another size."""
    n = st.types.where("kind = 'union' and size(members) <= 2")
    named = lambda i: F.coalesce(rows.single_base(F.get("members", F.lit(i))["ty"]) < trees.FIRST_PRIM, F.lit(False))
    two = F.when(named(0) & ~named(1), F.get("members", F.lit(0))["ty"]).when(named(1) & ~named(0), F.get("members", F.lit(1))["ty"])
    to = F.when(F.size("members") == 1, F.get("members", F.lit(0))["ty"]).when(F.size("members") == 2, two)
    cand = cut(_size("to", n.select("goff", "byte_size", F.size("members").alias("n"), F.coalesce(to, F.array().cast(trees.TYPE)).alias("to")), st, r))
    if r.strict and not cand.where("n = 0 and not byte_size <=> 1").isEmpty():
        raise ValueError("a union without members has a size other than 1")
    ok = cand.where("(n = 0 and byte_size = 1) or n = 1 or (n = 2 and size(to) > 0 and tree_size = byte_size)")
    return ok.select("goff", "to", ((F.col("n") == 1) & ~F.col("byte_size").eqNullSafe(F.col("tree_size"))).alias("odd"))


def same_types(st: Stage | Shapes, r: Rules) -> DataFrame:
    """(goff, to) of unions whose members are all of one type."""
    ty = F.transform("members", lambda m: m["ty"])
    return st.types.where("kind = 'union' and size(members) > 0").where(F.size(F.array_distinct(ty)) == 1).select("goff", F.get("members", F.lit(0))["ty"].alias("to"))


def single_member(st: Stage, r: Rules, fixed: DataFrame) -> Change | None:
    return _first(single_members(st, r), fixed)


def number_of_members(st: Stage, r: Rules, fixed: DataFrame) -> Change | None:
    cand = few_members(st, r)
    empty = cand.where("size(to) = 0").agg(F.min("goff")).first()[0]
    got = _first(cand.where("size(to) > 0"), fixed)
    return (empty, None) if empty is not None and (got is None or empty < got[0]) else got


def same_type_members(st: Stage, r: Rules, fixed: DataFrame) -> Change | None:
    return _first(same_types(st, r), fixed)


BY_NAME: list[Callable[[Stage, Rules, DataFrame], Change | None]] = [pick_member, enumeratorize]
BY_SHAPE = [(single_member, single_members), (number_of_members, few_members), (same_type_members, same_types)]


def waiting(st: Stage | Shapes, cand: DataFrame, rule: Callable) -> DataFrame:
    """(goff) of candidates whose turn comes later, since what they become depends on which of two goes first.

    These are: one that only a single type may replace, and the type that would is to go before it (or, where same
    types are looked for, may go); a union of two, one of them a named type that is to go before it; and the second of
    the two named members of a union, where that union might be reduced to it in between. The least goff never waits.
    """
    base = rows.single_base(F.col("to"))
    own = cand.select("goff", "held", base.alias("base"))
    is_cand = cand.select(F.col("goff").alias("base"), F.lit(True).alias("goes"))
    unions = st.types.where("kind = 'union'").select(F.col("goff").alias("base"), F.size("members").alias("n"))
    sizes = st.types.where("kind = 'union'").select("goff", F.size("members").alias("own_n"))
    at = own.join(is_cand, "base", "left").join(unions, "base", "left").join(sizes, "goff", "left")
    late = F.coalesce(F.col("goes"), F.lit(False)) & (F.col("base") < F.col("goff"))
    if rule is same_type_members:
        least = cand.agg(F.min("goff").alias("least"))
        at = at.crossJoin(F.broadcast(least))  # one row
        return at.where(F.col("held") & (late | (F.col("n").isNotNull() & (F.col("goff") > F.col("least"))))).select("goff").union(_second(st, cand, always=True)).distinct()
    out = at.where((F.col("held") | ((F.col("own_n") == 2) if rule is number_of_members else F.lit(False))) & late).select("goff")
    return out.union(_second(st, cand, always=False)).distinct() if rule is number_of_members else out.distinct()


def _second(st: Stage | Shapes, cand: DataFrame, always: bool) -> DataFrame:
    """(goff) of the greater of two candidates that are the members of one union; not where the union comes after both, unless always."""
    m = lambda i: rows.single_base(F.get("members", F.lit(i))["ty"])
    two = st.types.where("kind = 'union' and size(members) = 2").select(F.col("goff").alias("u"), F.least(m(0), m(1)).alias("a"), F.greatest(m(0), m(1)).alias("b"), (m(0).isNotNull() & m(1).isNotNull()).alias("both")).where("both and a < b")
    two = two.join(cand.select(F.col("goff").alias("a")), "a", "left_semi").join(cand.select(F.col("goff").alias("b")), "b", "left_semi")
    return (two if always else two.where("u < b")).select(F.col("b").alias("goff"))


def shapes(types: DataFrame) -> Shapes:
    member = types.schema["members"].dataType.simpleString()
    ty = lambda m: F.struct(F.lit(None).alias("offset"), F.lit(None).alias("name"), m["ty"].alias("ty"), F.lit(None).alias("special"), F.lit(None).alias("bit_bytes"))
    some = types.where("kind = 'union' or (kind = 'struct' and size(members) = 1 and size(vtable) = 0)")
    own = cut(some.select("goff", "kind", "byte_size", F.transform("members", ty).cast(member).alias("members"), F.array().cast(types.schema["vtable"].dataType).alias("vtable")))
    used = own.select(F.explode(rows.goffs(own)).alias("goff")).distinct()
    return Shapes(own, cut(rows.sizes(types).join(used, "goff", "left_semi")))


def together(sh: Shapes, go: DataFrame) -> Shapes:
    """All of go (goff, to) give way at once, to what their trees are once composed; those with an empty tree become empty structs.

    Pairs that follow through the type that stood for another directly, or from names that it had been given, aren't kept.
    """
    union = lambda a, b: b if a is None else cut(a.union(b))
    direct = cut(go.where("size(to) > 0").select("goff", F.col("to").alias("tree")))
    by = rows.composed(direct, strict=True)
    left = cut(rows.unlost(rows.substituted(sh.types.join(go.select("goff"), "goff", "left_anti"), by, strict=True)))
    to = direct.select("goff", rows.single_base(F.col("tree")).alias("base")).where(F.col("base") < trees.FIRST_PRIM)
    # names of a base that ends in a tree are lost with it, so only what goes before it is derived from them
    ends = by.select(F.col("goff").alias("base"), F.coalesce(rows.single_base(F.col("tree")) < trees.FIRST_PRIM, F.lit(False)).alias("named"))
    to = cut(to.join(ends, "base", "left").where(F.coalesce(F.col("named"), F.lit(True)) | (F.col("goff") < F.col("base"))).select(F.col("goff").alias("lower"), F.col("base").alias("upper")))
    if sh.by is not None:
        before = sh.by.select("goff", rows.single_base(F.col("tree")).alias("lower"))
        to = to.union(before.join(to, "lower").select("goff", "upper"))
        by = cut(rows.substituted(sh.by, by, strict=True).union(by))
    return Shapes(left, sh.sizes, by, union(sh.empty, go.where("size(to) = 0").select("goff")), union(sh.pairs, to))


def settled(st: Stage, sh: Shapes) -> Stage:
    """The stage after all that the batches decided; types and symbols are plans over what is written, for whoever reads them to write or to narrow.

    A class of a pointer to member that would become a tree is an error where such a pointer is left. Names of types
    that end in a named type go to that, their own before others'. derived has a row for a name of a pair's lower type
    and each own name of its upper type.
    """
    kind, cols = st.types.schema["fqnames"].dataType, st.types.columns
    named = cut(rows.substituted(st.types.select("goff", "fqnames"), sh.by, strict=True))
    text = lambda df, to: df.select(to, F.explode("fqnames").alias("x")).withColumn("text", F.to_json("x"))
    ends = sh.by.select("goff", rows.single_base(F.col("tree")).alias("root")).where(F.col("root") < trees.FIRST_PRIM)
    own = named.join(ends.select(F.col("root").alias("goff")).distinct(), "goff", "left_semi")
    # one row a name: distinct on arrays of structs would take the square of a type's names
    more = text(named.join(ends, "goff"), "root").groupBy(F.col("root").alias("goff"), "text").agg(F.first("x").alias("x"))
    more = more.join(text(own, "goff").select("goff", "text"), ["goff", "text"], "left_anti")
    given = cut(more.groupBy("goff").agg(F.transform(F.array_sort(F.collect_list(F.struct("text", "x"))), lambda p: p["x"]).alias("given")))

    empty = sh.empty.select("goff", F.lit(True).alias("empty"))
    left = rows.substituted(st.types.drop("fqnames"), sh.by, strict=True).join(sh.by.select("goff"), "goff", "left_anti")
    left = left.join(empty, "goff", "left").withColumn("kind", F.when(F.col("empty"), "struct").otherwise(F.col("kind"))).drop("empty")
    none = F.array().cast(kind)
    left = left.join(named, "goff", "left").join(given, "goff", "left").withColumn("fqnames", F.concat(F.coalesce("fqnames", none), F.coalesce("given", none)))
    types, symbols = rows.unlost(left.select(cols)), rows.unlost(rows.substituted(st.symbols, sh.by, ["link_name"], strict=True))
    classes = [df.select(F.explode(trees.member_classes(rows.tokens(df))).alias("goff")) for df in (st.types, st.symbols)]
    trees_ = sh.by.where(rows.single_base(F.col("tree")).isNull())
    if not trees_.join(classes[0].union(classes[1]), "goff", "left_semi").isEmpty() or not trees_.where(F.exists("tree", lambda t: t["op"] == "LOST")).isEmpty():
        types, symbols = cut(types), cut(symbols)  # fails where such a pointer is left

    lower = text(named.join(sh.pairs.withColumnRenamed("lower", "goff"), "goff"), "upper").select("upper", F.col("text").alias("derived"))
    upper = text(named.join(sh.pairs.select(F.col("upper").alias("goff")).distinct(), "goff", "left_semi"), "goff").select(F.col("goff").alias("upper"), F.col("text").alias("base"))
    if st.derived is not None:  # a base's own names only, not those that it was given
        upper = upper.join(st.derived.select(F.col("derived").alias("base")).distinct(), "base", "left_anti")
    edge = lower.join(upper, "upper").select("derived", "base")
    derived = cut(edge if st.derived is None else st.derived.union(edge))
    spelling.name_graph(derived)
    return Stage(types, symbols, derived)


def batch(st: Stage, r: Rules, fixed: DataFrame, limit: int) -> tuple[Stage | None, bool]:
    """The stage after up to limit batches, each what the first rule over shapes that finds anything changes as far as it can go together, None where none finds anything; and whether none would find more."""
    sh, made = shapes(st.types), 0
    while made < limit:
        for rule, candidates in BY_SHAPE:
            cand = cut(guarded(candidates(sh, r), fixed))
            if not cand.isEmpty():
                break
        else:
            return (settled(st, sh) if made else None), True
        if "odd" in cand.columns and not cand.where("odd").isEmpty():  # sizes change, which other rules look at
            return (settled(st, sh) if made else eliminate(st, rule(st, r, fixed))), False
        sh = together(sh, cut(cand.join(waiting(sh, cand, rule), "goff", "left_anti").select("goff", "to")))
        made += 1
    return settled(st, sh), False


def literal(tokens: list) -> Column:
    return F.concat(*[trees.token(*t) for t in tokens])


def eliminate(st: Stage, change: Change) -> Stage:
    """The type gives way everywhere; if a named type stands for it, that one gets its names too, but a primitive gets none."""
    goff, tokens = change
    types = st.types
    if tokens is None:
        kind = F.when(F.col("goff") == goff, "struct").otherwise(F.col("kind"))
        return Stage(cut(types.withColumn("kind", kind)), st.symbols, st.derived)
    by = literal(tokens)
    derived = st.derived
    out = rows.replace(types.where(F.col("goff") != goff), goff, by)
    if len(tokens) == 1 and tokens[0][1] is not None and tokens[0][1] < trees.FIRST_PRIM:
        own = rows.replace(types.where(F.col("goff") == goff).select("fqnames"), goff, by).first()["fqnames"] or []
        if own:
            spark, kind = types.sparkSession, types.schema["fqnames"].dataType
            given = spark.createDataFrame([(tokens[0][1], own)], f"goff bigint, given {kind.simpleString()}")
            base = out.where(F.col("goff") == tokens[0][1]).select(F.explode("fqnames").alias("b")).select(F.to_json("b").alias("base"))
            edge = base.crossJoin(given.select(F.explode("given").alias("d")).select(F.to_json("d").alias("derived"))).select("derived", "base")  # the names of two types
            derived = cut(edge if derived is None else derived.union(edge))
            spelling.name_graph(derived)
            out = out.join(given, "goff", "left").withColumn("fqnames", F.array_distinct(F.concat("fqnames", F.coalesce("given", F.array().cast(kind))))).drop("given")
    return Stage(cut(out), cut(rows.replace(st.symbols, goff, by)), derived)


def optimize(st: Stage, r: Rules, prune: bool = False, limit: int = 100_000, batches: bool = True) -> Stage:
    """Rules until none changes anything. The types that only a named type may stand for are found once, before.

    Rules over names change one type at a time. After a batch that makes one of them match, the batch is taken back,
    and one change is made instead; without batches every change is made alone.
    """
    st, done = Stage(cut(st.types), cut(st.symbols), st.derived), False
    fixed = cut(rows.non_eliminateable(st.types, st.symbols))
    named = bool(r.pick or r.enums)
    for _ in range(limit):
        change = next((c for rule in BY_NAME if (c := rule(st, r, fixed)) is not None), None)
        if change is not None:
            st = eliminate(st, change)
            continue
        if batches:
            new, done = batch(st, r, fixed, 1 if named else limit)
            if new is not None and not done:
                new = Stage(cut(new.types), cut(new.symbols), new.derived)
            if new is not None and named and any(rule(new, r, fixed) is not None for rule in BY_NAME):
                new = eliminate(st, next(c for rule, _ in BY_SHAPE if (c := rule(st, r, fixed)) is not None))
        else:
            change = next((c for rule, _ in BY_SHAPE if (c := rule(st, r, fixed)) is not None), None)
            new = None if change is None else eliminate(st, change)
        if new is None or done:
            st = st if new is None else new
            return Stage(rows.prune(cut(st.types), st.symbols), st.symbols, st.derived) if prune else st
        st = new
    raise ValueError("rules did not settle")
