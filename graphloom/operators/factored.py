"""Spellings as a graph: a type is any of its alternatives, an alternative is texts and other types in a row.

Counts and membership are told from the graph, so products of spellings aren't written out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, trees
from ..plans.fixpoint import cut
from .spelling import full_names

OPEN, SHUT = "\x01", "\x02"  # around a goff that stands for any of its spellings


def _hole(goff: Column) -> Column:
    return F.array(F.concat(F.lit(OPEN), goff.cast("string"), F.lit(SHUT)))


def alternatives(types: DataFrame) -> DataFrame:
    """(goff, alt, pieces): the ways to spell each row's name, numbered within the row; pieces hold texts at even places and goffs, as text, between them.

    An own name stands in its namespace (name_ns, where the column is there) with its template arguments; names from
    decl_names stand as they are. A type among the namespace's segments or the arguments is a goff. Primitives have
    their names. A text that holds the marks (code points 1 and 2) is an error.
    """
    none = F.array().cast(names.SEGMENTS)
    space = F.coalesce("name_ns", none) if "name_ns" in types.columns else none
    each = full_names(types.drop("decl_names")).select("goff", F.explode("fqnames").alias("f")).join(types.select("goff", space.alias("ns")), "goff")
    if "decl_names" in types.columns:
        more = full_names(types.withColumn("name", F.lit(None).cast("string"))).select("goff", F.explode("fqnames").alias("f"), none.alias("ns"))
        each = each.union(more.select(*each.columns))
    arg = lambda a: F.when(a["k"] == "Const", F.array(a["const"].cast("string"))).when(a["k"] == "StaticConst", F.array(F.lit("[static]"))).otherwise(names.tree_spellings(a["tree"], _hole))
    marked = f"[{OPEN}{SHUT}]"
    clean = F.when(F.col("f.name").rlike(marked) | F.exists("ns", lambda n: n["s"].rlike(marked)), F.raise_error(F.lit("a name holds code point 1 or 2")).cast("string")).otherwise(F.col("f.name"))
    whole = F.explode(names.templated(F.array(clean), F.transform("f.targs", arg)))
    each = each.withColumn("base", whole)
    text = F.explode(names.name_spellings(F.col("ns"), F.col("base"), _hole))
    prims = types.sparkSession.createDataFrame([(p[3], p[0]) for p in trees.PRIMS], "goff bigint, text string")
    rows = each.select("goff", text.alias("text")).union(prims).distinct()
    numbered = rows.groupBy("goff").agg(F.array_sort(F.collect_list("text")).alias("texts")).select("goff", F.posexplode("texts").alias("alt", "text"))
    return cut(numbered.select("goff", "alt", F.split("text", marked).alias("pieces")))


def _references(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, p.cast("bigint"))), lambda g: g.isNotNull())


def levelled(graph: DataFrame, limit: int = 1000) -> DataFrame:
    """(goff, alts, level): a row a type with all its alternatives; the level is one above those of its parts, and the last one has what is built from itself.

    Rounds are as many as names nest, and go over edges between types that are still open.
    """
    edges = cut(graph.select("goff", F.explode(_references(F.col("pieces"))).alias("g")).distinct())
    left, open_, n, levels = cut(graph.select("goff").distinct()), edges, -1, []
    for i in range(limit):
        open_ = cut(open_.join(left.withColumnRenamed("goff", "g"), "g", "left_semi"))
        waits = cut(open_.select("goff").distinct())
        last, n = n, waits.count()
        if n == last or n == 0:  # no type was settled, or all are
            levels.append(left.select("goff", F.lit(i).alias("level")))
            break
        levels.append(left.join(waits, "goff", "left_anti").select("goff", F.lit(i).alias("level")))
        left = waits
    else:
        raise ValueError("names nest too deep")
    alts = graph.groupBy("goff").agg(F.collect_list("pieces").alias("alts"))
    return cut(alts.join(reduce(DataFrame.union, levels), "goff"))


def settled(nodes: DataFrame, key: list[str], value: Callable[[Column, Column], Column], total: Callable[[Column], Column], kind: str) -> DataFrame:
    """(*key, goff, v) bottom up: value gives an alternative's, from its pieces and the map found of its goffs' values; total gathers those of a type.

    nodes: (*key, goff, alts, level and what value needs). A round settles a level: a type's parts are all below it, but
    for what is built from itself, where open parts have no value.
    """
    node, none = [*key, "goff"], F.create_map().cast(f"map<bigint,{kind}>")
    top = nodes.agg(F.max("level")).first()[0]
    done = []
    for i in range((-1 if top is None else top) + 1):
        at = nodes.where(F.col("level") == i)
        if done:
            refs = F.array_distinct(F.flatten(F.transform("alts", _references)))
            used = at.select(*node, F.explode(refs).alias("g")).join(reduce(DataFrame.union, done).withColumnRenamed("goff", "g"), [*key, "g"])
            found = used.groupBy(*node).agg(F.map_from_entries(F.collect_list(F.struct("g", "v"))).alias("found"))
            at = at.join(found, node, "left").withColumn("found", F.coalesce("found", none))
        else:
            at = at.withColumn("found", none)
        done.append(cut(at.select(*node, total(F.transform("alts", lambda p: value(p, F.col("found")))).cast(kind).alias("v"))))
        if len(done) > 16:
            done = [cut(reduce(DataFrame.union, done))]
    return reduce(DataFrame.union, done) if done else nodes.select(*node, F.lit(None).cast(kind).alias("v"))


def counts(graph: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """(goff, n decimal(38)): in how many ways each type is spelled, which is the number of its spellings unless one comes about in two ways. Over 38 digits is an error. levels: those of the graph, where they are known."""
    kind = "decimal(38,0)"

    def ways(pieces: Column, found: Column) -> Column:
        return F.aggregate(_references(pieces), F.lit(1).cast(kind), lambda n, g: (n * F.coalesce(F.try_element_at(found, g), F.lit(0).cast(kind))).cast(kind))

    add = lambda v: F.aggregate(v, F.lit(0).cast(kind), lambda n, x: (n + x).cast(kind))
    return settled(levelled(graph) if levels is None else levels, [], ways, add, kind).select("goff", F.col("v").alias("n"))


def expanded(graph: DataFrame) -> DataFrame:
    """(goff, spelled): every spelling written out, sorted; for graphs whose counts are small."""

    def texts(pieces: Column, found: Column) -> Column:
        def add(acc: Column, p: Column) -> Column:
            own = F.when(p["odd"], F.coalesce(F.try_element_at(found, p["g"]), F.array().cast("array<string>"))).otherwise(F.array(p["s"]))
            return F.flatten(F.transform(acc, lambda a: F.transform(own, lambda s: F.concat(a, s))))

        return F.aggregate(_typed(pieces), F.array(F.lit("")), add)

    return settled(levelled(graph), [], texts, lambda v: names.as_set(F.flatten(v)), "array<string>").select("goff", F.col("v").alias("spelled"))


def _typed(pieces: Column) -> Column:
    return F.transform(pieces, lambda p, i: F.struct((i % 2 == 1).alias("odd"), F.when(i % 2 == 1, p.cast("bigint")).alias("g"), p.alias("s")))


def members(graph: DataFrame, questions: DataFrame, limit: int = 1000, levels: DataFrame | None = None) -> DataFrame:
    """(goff, text, found) of each distinct question (goff, text): whether the text is a spelling of the type.

    Only types that a question's type is built from are looked at, each with the spans of the text that it spells; there are
    at most as many of them as the text has pairs of places. Null texts are of no type. levels: as for counts().
    """
    spans = "array<struct<a:int,z:int>>"
    asked = cut(questions.select("goff", "text").distinct().withColumn("q", F.monotonically_increasing_id()))  # written, so a question keeps its number
    edges = cut(graph.select("goff", F.explode(_references(F.col("pieces"))).alias("g")).distinct())
    seen = front = cut(asked.where("text is not null and goff is not null").select("q", "goff"))
    for _ in range(limit):
        front = cut(front.join(edges, "goff").select("q", F.col("g").alias("goff")).distinct().join(seen, ["q", "goff"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.union(front)
    else:
        raise ValueError("names nest too deep")
    text = F.col("text")

    def spelled(pieces: Column, found: Column) -> Column:
        def add(acc: Column, p: Column) -> Column:
            literal = F.transform(F.filter(acc, lambda x: F.substr(text, x["z"] + 1, F.length(p["s"])) == p["s"]), lambda x: F.struct(x["a"].alias("a"), (x["z"] + F.length(p["s"])).alias("z")))
            inner = F.coalesce(F.try_element_at(found, p["g"]), F.array().cast(spans))
            through = F.flatten(F.transform(acc, lambda x: F.transform(F.filter(inner, lambda s: s["a"] == x["z"]), lambda s: F.struct(x["a"].alias("a"), s["z"].alias("z")))))
            return F.array_distinct(F.when(p["odd"], through).otherwise(literal))

        start = F.transform(F.sequence(F.lit(0), F.length(text)), lambda i: F.struct(i.alias("a"), i.alias("z")))
        return F.aggregate(_typed(pieces), start.cast(spans), add)

    nodes = cut(seen.join(asked.select("q", "text"), "q").join(levelled(graph) if levels is None else levels, "goff").select("q", "goff", "text", "alts", "level"))
    got = settled(nodes, ["q"], spelled, lambda v: F.array_distinct(F.flatten(v)), spans)
    return asked.join(got, ["q", "goff"], "left").select("goff", "text", F.coalesce(F.exists("v", lambda s: (s["a"] == 0) & (s["z"] == F.length("text"))), F.lit(False)).alias("found"))
