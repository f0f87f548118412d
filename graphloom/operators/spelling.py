"""Every spelling of every type's names, resolved level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, trees
from ..plans.fixpoint import cut
from .rows import looked_up

NAMES = "array<struct<name:string,targs:array<struct<k:string,const:bigint,tree:" + trees.TYPE + ">>>>"


def own_names(types: DataFrame) -> Column:
    """Names of a row: the own name with its template arguments, then names from declarations and typedefs (decl_names)."""
    none = F.array().cast(NAMES[6:-1].split("targs:")[1][:-1])
    own = F.when(F.col("name").isNotNull(), F.array(F.struct(F.col("name").alias("name"), F.coalesce("targs", none).alias("targs")))).otherwise(F.array().cast(NAMES))
    more = F.transform(F.coalesce("decl_names", F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), none.alias("targs"))) if "decl_names" in types.columns else F.array().cast(NAMES)
    return F.array_distinct(F.concat(own.cast(NAMES), more.cast(NAMES)))


def full_names(types: DataFrame) -> DataFrame:
    """(goff, fqnames) of rows, see own_names()."""
    return types.select("goff", own_names(types).alias("fqnames"))


def spellings(named: DataFrame, limit: int = 1000) -> DataFrame:
    """(goff, spelled): sorted spellings of (goff, fqnames). Names wait for those that they are built from; names built from themselves have none.

    A round settles every type all of whose names' parts are settled, so there are as many rounds as names nest.
    """
    spark = named.sparkSession
    done = cut(spark.createDataFrame([(p[3], [p[0]]) for p in trees.PRIMS], "goff bigint, spelled array<string>"))
    left = cut(named.join(done.select("goff"), "goff", "left_anti"))
    for _ in range(limit):
        # a part that no row names can't be waited for
        open_ = left.select(F.col("goff").alias("g"), F.lit(True).alias("open"))
        refs = left.select("goff", F.explode(F.flatten(F.transform("fqnames", lambda n: F.flatten(F.transform(n["targs"], lambda a: F.coalesce(F.transform(a["tree"], lambda t: t["g"]), F.array().cast("array<bigint>"))))))).alias("g")).where("g is not null").distinct()
        waits = refs.join(open_, "g", "left_semi").select("goff").distinct()
        ready = left.join(waits, "goff", "left_anti")
        stuck = ready.isEmpty()
        if stuck:  # what is left is built from itself: one round more, where open parts have no spelling
            ready = left
        at = looked_up(ready, done, "spelled", ["goff"])
        of = lambda g: F.coalesce(F.try_element_at("found", g), F.array().cast("array<string>"))
        arg = lambda a: F.when(a["k"] == "Const", F.array(a["const"].cast("string"))).when(a["k"] == "StaticConst", F.array(F.lit("[static]"))).otherwise(names.tree_spellings(a["tree"], of))
        each = F.flatten(F.transform("fqnames", lambda n: names.templated(F.array(n["name"]), F.transform(n["targs"], arg))))
        done = cut(done.union(at.select("goff", names.as_set(each).alias("spelled"))))
        if stuck:
            return done
        left = cut(left.join(ready.select("goff"), "goff", "left_semi").join(done.select("goff"), "goff", "left_anti").union(left.join(waits, "goff", "left_semi"))).distinct()
        if left.isEmpty():
            return done
    raise ValueError("names nest too deep")


def matches(spelled: DataFrame, pattern: str) -> DataFrame:
    """(goff, text): the first spelling of each type that the pattern finds."""
    hit = F.filter("spelled", lambda s: s.rlike(pattern))
    return spelled.select("goff", F.get(hit, F.lit(0)).alias("text")).where("text is not null")


def unique_match(spelled: DataFrame, pattern: str) -> tuple[int, str] | None:
    """The only type that the pattern finds; None where there is none, an error where there are several."""
    got = matches(spelled, pattern).orderBy("goff").limit(2).collect()
    if len(got) > 1:
        raise ValueError(f"several types match {pattern}: {[r['text'] for r in got]}")
    return (got[0]["goff"], got[0]["text"]) if got else None


def add_names(a, b):
    """Sorted set union of two name arrays."""
    return names.as_set(F.array_union(a, b))


def name_graph(edges: DataFrame, strict: bool = True) -> DataFrame:
    """Distinct (derived, base) without a name to itself; a pair in both directions is an error, or with strict off has clash set."""
    e = edges.where("derived <> base").select("derived", "base").distinct()
    back = e.select(F.col("base").alias("derived"), F.col("derived").alias("base"), F.lit(True).alias("clash"))
    out = e.join(back, ["derived", "base"], "left").withColumn("clash", F.coalesce("clash", F.lit(False)))
    if strict and not out.where("clash").isEmpty():
        raise ValueError("names derive from each other")
    return out if not strict else out.drop("clash")
