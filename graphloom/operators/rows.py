"""Operators over rows of types: references, goff rewriting, replacement, aliases, sizes, flattening, dedupe, marks.

A row has goff, kind and any of the payload columns of operators.dies; fqnames, where present, is an array of
(name, targs). Each operator takes and gives DataFrames; loops cut their lineage once a round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import trees
from ..plans import fixpoint
from ..plans.fixpoint import cut

TREES = "array<" + trees.TYPE + ">"


def _targs(c: Column, f: Callable) -> Column:
    return F.transform(c, lambda a: F.struct(a["k"].alias("k"), a["const"].alias("const"), F.when(a["tree"].isNotNull(), f(a["tree"])).alias("tree")))


def rewritten(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """Every type tree of the rows as f gives it: trees, template arguments, members, virtual functions, names, symbols."""
    put = {}
    for c in ("tree", "ty"):
        if c in df.columns:
            put[c] = F.when(F.col(c).isNotNull(), f(F.col(c)))
    if "targs" in df.columns:
        put["targs"] = _targs(F.col("targs"), f)
    if "members" in df.columns:
        put["members"] = F.transform("members", lambda m: F.struct(m["offset"].alias("offset"), m["name"].alias("name"), f(m["ty"]).alias("ty"), m["special"].alias("special"), m["bit_bytes"].alias("bit_bytes")))
    if "vtable" in df.columns:
        put["vtable"] = F.transform("vtable", lambda v: F.struct(v["idx"].alias("idx"), v["name"].alias("name"), F.transform(v["fn"], f).alias("fn")))
    if "fqnames" in df.columns:
        put["fqnames"] = F.transform("fqnames", lambda n: F.struct(n["name"].alias("name"), _targs(n["targs"], f).alias("targs")))
    return df.withColumns(put)


def tokens(df: DataFrame, with_names: bool = True) -> Column:
    """All tokens of a row's trees in one array."""
    none = F.array().cast(trees.TYPE)
    parts = [F.coalesce(F.col(c), none) for c in ("tree", "ty") if c in df.columns]
    of_args = lambda c: F.flatten(F.transform(c, lambda a: F.coalesce(a["tree"], none)))
    if "targs" in df.columns:
        parts.append(F.coalesce(of_args(F.col("targs")), none))
    if "members" in df.columns:
        parts.append(F.coalesce(F.flatten(F.transform("members", lambda m: m["ty"])), none))
    if "vtable" in df.columns:
        parts.append(F.coalesce(F.flatten(F.transform("vtable", lambda v: F.flatten(v["fn"]))), none))
    if with_names and "fqnames" in df.columns:
        parts.append(F.coalesce(F.flatten(F.transform("fqnames", lambda n: of_args(n["targs"]))), none))
    return F.concat(none, *parts)


def goffs(df: DataFrame) -> Column:
    """Distinct goffs that the row's payload refers to."""
    extra = [F.col(c) for c in ("target", "base_goff") if c in df.columns]
    segs = [F.coalesce(F.transform(c, lambda n: n["goff"]), F.array().cast("array<bigint>")) for c in ("name_ns", "enclosing") if c in df.columns]
    own = F.transform(tokens(df), lambda t: t["g"])
    return F.array_compact(F.array_distinct(F.concat(own, F.array(*extra).cast("array<bigint>"), *segs)))


def references(df: DataFrame, key: str = "goff") -> DataFrame:
    """(src, dst) for each goff that a row refers to."""
    return df.select(F.col(key).alias("src"), F.explode(goffs(df)).alias("dst")).distinct()


def contains_goff(df: DataFrame, goff: int) -> Column:
    return F.array_contains(goffs(df), F.lit(goff))


def looked_up(df: DataFrame, mapping: DataFrame, value: str, key: list[str]) -> DataFrame:
    """df with `found`, a map from the goffs that the row refers to, and that mapping (goff, value) has, to their values."""
    refs = df.select(*key, F.explode(goffs(df)).alias("g"))
    found = refs.join(mapping.select(F.col("goff").alias("g"), F.col(value).alias("v")), "g")
    kind = mapping.schema[value].dataType.simpleString()
    per = found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("g", "v"))).alias("found"))
    return df.join(per, key, "left").withColumn("found", F.coalesce("found", F.create_map().cast(f"map<bigint,{kind}>")))


def map_goffs(df: DataFrame, mapping: DataFrame, key: list[str] = ["goff"], own: bool = True) -> DataFrame:
    """Every goff through mapping (goff, to); those it lacks stay. own: the row's goff as well."""
    cols = df.columns
    to = lambda g: F.coalesce(F.try_element_at("found", g), g)
    out = rewritten(looked_up(df, mapping, "to", key), lambda t: trees.mapped(t, to))
    for c in ("target", "base_goff"):
        if c in cols:
            out = out.withColumn(c, F.when(F.col(c).isNotNull(), to(F.col(c))))
    for c in ("name_ns", "enclosing"):
        if c in cols:
            out = out.withColumn(c, F.transform(c, lambda n: F.struct(n["k"].alias("k"), F.when(n["goff"].isNotNull(), to(n["goff"])).alias("goff"), n["s"].alias("s"), n["is_linkage"].alias("is_linkage"))))
    if own and "goff" in cols:
        m = mapping.select(F.col("goff"), F.col("to").alias("new_goff"))
        out = out.join(m, "goff", "left").withColumn("goff", F.coalesce("new_goff", "goff"))
    return out.select(cols)


def substituted(df: DataFrame, by: DataFrame, key: list[str] = ["goff"], strict: bool = False) -> DataFrame:
    """Every BASE whose goff by (goff, tree) has gives way to that tree; classes of pointers to members only to a single BASE.

    strict: names that hold a goff whose tree isn't a single BASE go, and a class that would become another tree is
    marked LOST; see unlost().
    """
    cols = df.columns
    whole = lambda new: (F.size(new) == 1) & (F.get(new, F.lit(0))["op"] == "BASE")

    def one(t: Column) -> Column:
        new = F.try_element_at("found", t["g"])
        owner = F.array(F.struct(t["op"].alias("op"), new[0]["g"].alias("g"), t["n"].alias("n"), new[0]["s"].alias("s")))
        rest = trees.token("LOST") if strict else F.array(t)
        return F.when(t["g"].isNull() | new.isNull(), F.array(t)).when(t["op"] == "BASE", new).when(whole(new), owner).otherwise(rest)

    at = looked_up(df, by, "tree", key)
    if strict and "fqnames" in cols:
        lost = lambda t: F.coalesce(~whole(F.try_element_at("found", t["g"])), F.lit(False))
        at = at.withColumn("fqnames", F.filter("fqnames", lambda n: ~F.exists(n["targs"], lambda a: F.coalesce(F.exists(a["tree"], lost), F.lit(False)))))
    return rewritten(at, lambda tree: F.flatten(F.transform(tree, one))).select(cols)


def unlost(df: DataFrame) -> DataFrame:
    """df; an error where a tree still has a class that would have become a tree."""
    fail = F.raise_error(F.lit("the class of a pointer to member can't become a tree")).cast(trees.TYPE)
    return rewritten(df, lambda t: F.when(F.exists(t, lambda x: x["op"] == "LOST"), fail).otherwise(t))


def replace(df: DataFrame, goff: int, tree: Column) -> DataFrame:
    """The goff replaced by a tree everywhere; names that hold it go where the tree isn't a single BASE."""
    single = (F.size(tree) == 1) & (tree[0]["op"] == "BASE")
    if "fqnames" in df.columns:
        holds = lambda n: F.exists(n["targs"], lambda a: F.coalesce(trees.contains(a["tree"], F.lit(goff)), F.lit(False)))
        df = df.withColumn("fqnames", F.filter("fqnames", lambda n: single | ~holds(n)))
    return rewritten(df, lambda t: trees.replaced(t, F.lit(goff), tree))


def peephole(tree: Column) -> Column:
    """T[1] is T; a pointer to a data member that is a subroutine is one to a member function."""
    plain = F.filter(tree, lambda t: ~((t["op"] == "ARRAY") & F.coalesce(t["n"] == 1, F.lit(False))))

    def one(t: Column, i: Column) -> Column:
        after, before = F.get(plain, i + 1), F.get(plain, i - 1)
        method = F.struct(F.lit("PTMF").alias("op"), t["g"].alias("g"), before["n"].alias("n"), t["s"].alias("s"))
        is_sub = F.coalesce(before["op"] == "SUB", F.lit(False))
        gone = (t["op"] == "SUB") & F.coalesce(after["op"] == "PTMD", F.lit(False))
        return F.when(gone, F.lit(None)).when((t["op"] == "PTMD") & is_sub, method).otherwise(t)

    return F.array_compact(F.transform(plain, one))


def single_base(tree: Column) -> Column:
    return F.when((F.size(tree) == 1) & (F.get(tree, F.lit(0))["op"] == "BASE"), F.get(tree, F.lit(0))["g"])


def alias_steps(types: DataFrame) -> DataFrame:
    """(k, nxt) of aliases, typedefs and trees of a single type; primitives that they name have rows too."""
    step = F.when(F.col("kind").isin("alias", "typedef"), F.col("target")).otherwise(F.when(F.col("kind") == "tree", single_base(F.col("tree"))))
    return _with_prims(types.select(F.col("goff").alias("k"), step.alias("nxt")))


def _with_prims(nodes: DataFrame) -> DataFrame:
    prims = nodes.where(trees.is_prim(F.col("nxt"))).select(F.col("nxt").alias("k"), F.lit(None).cast("bigint").alias("nxt")).distinct()
    return cut(nodes.union(prims.join(nodes.select("k"), "k", "left_anti")))


def alias_ends(types: DataFrame) -> DataFrame:
    """(goff, root, cycle, error) of all rows through aliases, typedefs and trees of a single type, in one walk: where each ends or, with an error, the least goff of the cycle it runs into."""
    at = fixpoint.resolve_rows(alias_steps(types))
    return at.select(F.col("k").alias("goff"), "root", "cycle", F.when(F.col("cycle").isNotNull(), "alias cycle").alias("error"))


def alias_errors(types: DataFrame) -> DataFrame:
    """(goff, cycle, error) of aliases, typedefs and trees of a single type that end nowhere; cycle: the least goff of the cycle they run into."""
    return alias_ends(types).where("cycle is not null").select("goff", "cycle", "error")


def resolved_aliases(types: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(goff, to) of aliases, trees of a single type, and typedefs that end in a tree or a primitive, which lose their names; and (goff, root) of all rows through aliases and typedefs.

    Rows that run into a cycle are an error; with strict off they are in neither, and in alias_errors.
    """
    nodes = alias_steps(types)
    at = fixpoint.resolve_rows(nodes)
    if strict and (bad := at.where("cycle is not null").first()):
        raise ValueError(f"{bad['k']} runs into a cycle of aliases through {bad['cycle']}")
    roots = at.where("cycle is null").select(F.col("k").alias("goff"), "root")
    kinds = types.select(F.col("goff").alias("root"), F.col("kind").alias("root_kind"))
    ends = roots.join(kinds, "root", "left").withColumn("plain", trees.is_prim(F.col("root")) | F.coalesce(F.col("root_kind").isin("tree", "prim"), F.lit(False)))
    lost = types.where("kind = 'typedef'").join(ends.where("plain").select("goff"), "goff", "left_semi").select("goff", F.lit(True).alias("lost"))
    steps = nodes.join(types.where("kind = 'typedef'").select(F.col("goff").alias("k"), F.lit(True).alias("named")), "k", "left").join(lost.withColumnRenamed("goff", "k"), "k", "left")
    edges = cut(steps.select("k", F.when(F.col("named").isNull() | F.col("lost"), F.col("nxt")).alias("nxt")))
    to = fixpoint.resolve_rows(edges).where("cycle is null and k <> root").select(F.col("k").alias("goff"), F.col("root").alias("to"))
    return cut(to), cut(roots)


def clean_typedefs(types: DataFrame) -> DataFrame:
    """Rows without aliases: each reference goes to where its alias ends, and typedefs of typedefs point there too."""
    to, _ = resolved_aliases(types)
    left = types.join(to.select("goff"), "goff", "left_anti")
    return map_goffs(left, to, own=False)


def predicates(types: DataFrame) -> DataFrame:
    """(goff, is_tree, is_primitive) through aliases and typedefs."""
    _, roots = resolved_aliases(types)
    kinds = types.select(F.col("goff").alias("root"), F.col("kind").alias("k"))
    at = roots.join(kinds, "root", "left")
    return at.select("goff", F.coalesce(F.col("k") == "tree", F.lit(False)).alias("is_tree"), (trees.is_prim(F.col("root")) | F.coalesce(F.col("k") == "prim", F.lit(False))).alias("is_primitive"))


def typedef_names(types: DataFrame) -> DataFrame:
    """(goff, names): names of the typedefs that end at each type, sorted."""
    _, roots = resolved_aliases(types)
    named = types.where("kind = 'typedef'").select("goff", "name").join(roots, "goff")
    return named.groupBy(F.col("root").alias("goff")).agg(F.array_sort(F.collect_set("name")).alias("names"))


def enum_sizes(types: DataFrame) -> DataFrame:
    """(goff, byte_size, error) of enums: their own size, else that of the type they are based on, through aliases and enums.

    A cycle of bases and a base without a size are error rows; the other enums have their sizes.
    """
    nxt = F.when(F.col("kind").isin("alias", "typedef"), F.col("target")).when((F.col("kind") == "enum") & F.col("byte_size").isNull(), F.col("base_goff"))
    roots = fixpoint.resolve_rows(_with_prims(types.select(F.col("goff").alias("k"), nxt.alias("nxt"))))
    known = sizes(types).withColumnRenamed("goff", "root")
    got = roots.join(known, "root", "left").join(types.where("kind = 'enum'").select(F.col("goff").alias("k")), "k", "left_semi")
    error = F.when(F.col("cycle").isNotNull(), "size cycle").when(F.col("size").isNull(), "no size")
    return got.select(F.col("k").alias("goff"), F.col("size").alias("byte_size"), error.alias("error"))


def union_errors(types: DataFrame, pointer: int = 8, data_member: int = 8, function_member: int = 16) -> DataFrame:
    """(goff, byte_size, largest, error) of unions that aren't as large as their largest member; a member whose type has no size is an error too.

    A member's size goes through aliases, typedefs and enums; bit fields count as their types.
    """
    nxt = F.when(F.col("kind").isin("alias", "typedef"), F.col("target")).when((F.col("kind") == "enum") & F.col("byte_size").isNull(), F.col("base_goff"))
    roots = fixpoint.resolve_rows(_with_prims(types.select(F.col("goff").alias("k"), nxt.alias("nxt")))).where("cycle is null")
    known = roots.join(sizes(types).withColumnRenamed("goff", "root"), "root").select(F.col("k").alias("goff"), "size")
    known = known.union(sizes(types).join(known.select("goff"), "goff", "left_anti"))
    unions = types.where("kind = 'union'").select("goff", "byte_size", F.posexplode("members").alias("at", "m")).select("goff", "byte_size", "at", F.col("m.ty").alias("ty"))
    sized = tree_sizes(unions, "ty", ["goff", "at"], cut(known), pointer, data_member, function_member)
    each = sized.groupBy("goff").agg(F.first("byte_size").alias("byte_size"), F.max("tree_size").alias("largest"), F.count_if(F.col("tree_size").isNull()).alias("unsized"))
    error = F.when(F.col("unsized") > 0, "member without a size").when(~F.col("byte_size").eqNullSafe(F.col("largest")), "not as large as its largest member")
    return each.select("goff", "byte_size", "largest", error.alias("error")).where("error is not null")


def sizes(types: DataFrame) -> DataFrame:
    """(goff, size) of primitives and of every row with a size; void and declarations have none."""
    spark = types.sparkSession
    prims = spark.createDataFrame([(p[3], p[2]) for p in trees.PRIMS], "goff bigint, size bigint")
    own = types.where("kind not in ('alias', 'typedef', 'tree', 'prim')").select("goff", F.col("byte_size").alias("size"))
    return own.unionByName(prims)


def tree_sizes(df: DataFrame, tree: str, key: list[str], size: DataFrame, pointer: int = 8, data_member: int = 8, function_member: int = 16) -> DataFrame:
    """df with tree_size, the size of the tree column by the types' sizes."""
    used = df.select(*key, F.explode(F.array_distinct(F.transform(tree, lambda t: t["g"]))).alias("g")).join(size.withColumnRenamed("goff", "g"), "g")
    per = used.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("g", "size"))).alias("size_of"))
    out = df.join(per, key, "left").withColumn("size_of", F.coalesce("size_of", F.create_map().cast("map<bigint,bigint>")))
    return out.withColumn("tree_size", trees.byte_size(F.col(tree), lambda t: F.try_element_at("size_of", t["g"]), pointer, data_member, function_member)).drop("size_of")


def composed(flat: DataFrame, limit: int = 60, strict: bool = False) -> DataFrame:
    """(goff, tree) with every goff of its own written out, chains twice as far a round; a tree that holds itself is an error."""
    flat = cut(flat.select("goff", "tree"))
    for _ in range(limit):
        inner = cut(references(flat).join(flat.select(F.col("goff").alias("dst")), "dst", "left_semi"))
        if inner.isEmpty():
            return flat
        if not inner.where("src = dst").isEmpty():
            raise ValueError("a tree holds itself")
        flat = cut(substituted(flat, flat, strict=strict))
    raise ValueError("trees nest too deep")


def flatten_trees(types: DataFrame) -> DataFrame:
    """Rows without tree rows: each reference to one is written out, then tidied. Trees write each other out until none refers to another."""
    flat = composed(types.where("kind = 'tree'"))
    flat = cut(flat.withColumn("tree", peephole(F.col("tree"))))
    rest = types.where("kind <> 'tree'")
    return rewritten(substituted(rest, flat), peephole)


def canonical(df: DataFrame) -> Column:
    """Text that two rows share if all but their goff is equal."""
    cols = [c for c in df.columns if c not in ("goff", "cu")]
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def dedupe(types: DataFrame, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Rows with equal payloads become the row of the least goff, and references follow, until nothing changes; and (goff, to) of those that went."""
    at, gone = cut(types), None
    for _ in range(limit):
        named = cut(at.select("goff", canonical(at).alias("c")))
        step = cut(named.join(named.groupBy("c").agg(F.min("goff").alias("to")), "c").where("goff <> to").select("goff", "to"))
        if step.isEmpty():
            empty = at.sparkSession.createDataFrame([], "goff bigint, to bigint")
            return at, empty if gone is None else gone
        if gone is None:
            gone = step
        else:
            onward = step.select(F.col("goff").alias("to"), F.col("to").alias("further"))
            gone = cut(gone.join(onward, "to", "left").select("goff", F.coalesce("further", "to").alias("to")).union(step))
        at = cut(map_goffs(at.join(step.select("goff"), "goff", "left_anti"), step, own=False))
    raise ValueError("dedupe did not settle")


def marks(df: DataFrame, stage: str, key: str = "goff") -> DataFrame:
    """(src, dst) as the sweep needs them. Rows mark themselves at stage L unless trees or primitives, at stage M if defined, at stage H never."""
    own = {"L": ~F.col("kind").isin("tree", "prim"), "M": ~F.col("kind").endswith("_decl") & (F.col("kind") != "prim"), "H": F.lit(False)}[stage]
    return references(df, key).union(df.where(own).select(F.col(key).alias("src"), F.col(key).alias("dst"))).distinct()


def mark_and_sweep(types: DataFrame, roots: DataFrame, stage: str) -> DataFrame:
    """Rows that roots (k) or a surviving row mark, itself included where its stage says so, until stable."""
    rows = types.select(F.col("goff").alias("k")).union(roots.select("k")).distinct()
    live = fixpoint.sweep(rows, marks(types, stage), roots)
    return types.join(live.withColumnRenamed("k", "goff"), "goff", "left_semi")


def prune(types: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows that symbols reach."""
    roots = symbols.select(F.explode(goffs(symbols)).alias("k")).distinct()
    live = fixpoint.reach(references(types), roots)
    return types.join(live.withColumnRenamed("k", "goff"), "goff", "left_semi")


def linked_groups(types: DataFrame) -> DataFrame:
    """(goff, component): weakly connected rows; primitives connect nothing."""
    e = references(types).where(~trees.is_prim(F.col("dst")) & ~trees.is_prim(F.col("src")))
    got = fixpoint.components(e).select(F.col("k").alias("goff"), "component")
    return types.select("goff").join(got, "goff", "left").select("goff", F.coalesce("component", "goff").alias("component"))


def buckets(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(goff, primary) of pairs (src, dst): the primitive of the group, else its least goff; and (primary) of groups with two primitives."""
    at = fixpoint.components(pairs).select(F.col("k").alias("goff"), "component")
    per = at.groupBy("component").agg(F.min("goff").alias("low"), F.min(F.when(trees.is_prim(F.col("goff")), F.col("goff"))).alias("prim"), F.max(F.when(trees.is_prim(F.col("goff")), F.col("goff"))).alias("last"))
    out = at.join(per, "component").select("goff", F.coalesce("prim", "low").alias("primary"))
    return out, per.where("prim <> last").select(F.col("prim").alias("primary"))


def non_eliminateable(types: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(goff) of classes of pointers to members, types with a vtable, and types that refer to themselves."""
    owners = lambda df: df.select(F.explode(trees.member_classes(tokens(df))).alias("goff"))
    parts = [owners(types), types.where(F.array_contains(goffs(types), F.col("goff"))).select("goff")]
    if "vtable" in types.columns:
        parts.append(types.where(F.size("vtable") > 0).select("goff"))
    if symbols is not None:
        parts.append(owners(symbols))
    return reduce(DataFrame.union, parts).distinct()


def closure(edges: DataFrame, limit: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(src, dst) reachable over one edge or more, one edge further each round; and the mutual pairs.

    A round goes on only from pairs that its last round gave, so each pair is joined with its end's edges about once.
    An edge from a node to itself adds no further pair and isn't followed. Pairs seen in earlier rounds leave
    a round when their number is a power of two: enough to come to an end on cycles, and they aren't compared each time.
    """
    edges = cut(edges.select("src", "dst").distinct())
    on = edges.where("src <> dst").select(F.col("src").alias("mid"), F.col("dst").alias("end"))
    levels = [front := cut(on.select(F.col("mid").alias("src"), F.col("end").alias("dst")))]
    for i in range(1, limit):
        further = front.join(on.hint("merge"), front.dst == on.mid).select("src", F.col("end").alias("dst")).distinct()
        if i & i - 1 == 0:
            further = further.join(reduce(DataFrame.union, levels).hint("merge"), ["src", "dst"], "left_anti")
        front = cut(further)
        if front.isEmpty():
            at = cut(reduce(DataFrame.union, levels + [edges.where("src = dst")]).distinct())
            back = at.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            return at, at.join(back, ["src", "dst"], "left_semi")
        levels.append(front)
    raise ValueError("closure did not settle")


# The kinds of rows.
KINDS = ("prim", "typedef", "alias", "tree", "enum", "enum_decl", "union", "union_decl", "struct", "struct_decl")


def type_counts() -> list[Column]:
    """How many rows there are and how many of each kind, as aggregates over types."""
    return [F.count(F.lit(1)).alias("types"), *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS]]


def symbol_counts() -> list[Column]:
    """How many symbols there are, and how many are functions and data, as aggregates over symbols."""
    is_fn = F.element_at("ty", -1)["op"] == "SUB"
    return [F.count(F.lit(1)).alias("symbols"), F.count_if(is_fn).alias("functions"), F.count_if(~is_fn).alias("data")]


def stage_counts(types: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: how many rows of each kind, and how many functions and data there are."""
    return types.agg(*type_counts()).crossJoin(symbols.agg(*symbol_counts()))  # one row each
