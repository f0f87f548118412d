"""What is written: documents of types and symbols, dumps of a stage, counts, keyed stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import trees


def _quoted(c: Column) -> Column:
    return F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)


def named(tree: Column, names: Column) -> Column:
    """The tree with names (a map from goff) in place of goffs."""
    return F.transform(tree, lambda t: F.struct(t["op"].alias("op"), t["g"].alias("g"), t["n"].alias("n"), F.coalesce(t["s"], F.try_element_at(names, t["g"])).alias("s")))


def documents(types: DataFrame) -> DataFrame:
    """(goff, document) of enums, unions and structs: one JSON text a type, which is YAML too; types: trees with names, and name."""
    kind = F.col("kind")
    ty = lambda t: trees.to_yaml(t)
    special = lambda m: F.when(m["special"] == "Base", "base").when(m["special"] == "Vfptr", "vtable").otherwise(F.coalesce(m["name"], F.lit("")))
    members = F.transform("members", lambda m: F.struct(m["offset"].alias("offset"), special(m).alias("name"), ty(m["ty"]).alias("type")))
    slots = F.transform("vtable", lambda v: F.struct(v["idx"].alias("slot"), v["name"].alias("name"), F.transform(v["fn"], ty).alias("types")))
    some = types.where(kind.isin("enum", "union", "struct"))
    body = F.to_json(F.struct(kind.alias("kind"), "name", F.col("byte_size").alias("size"), F.when(kind == "enum", F.col("enumerators")).alias("enumerators"), F.when(kind != "enum", members).alias("members"), F.when(kind == "struct", slots).alias("vtable")))
    return some.select("goff", body.alias("document"))


def symbol_documents(symbols: DataFrame) -> DataFrame:
    """(link_name, document): a function's return type and arguments, or a datum's type."""
    is_fn = F.element_at("ty", -1)["op"] == "SUB"
    whole = trees.to_yaml(F.col("ty"))
    return symbols.select("link_name", F.to_json(F.struct(F.when(is_fn, "func").otherwise("data").alias("kind"), F.col("link_name").alias("name"), "address", whole.alias("type"), F.when(is_fn, F.col("param_names")).alias("args"))).alias("document"))


def write_documents(docs: DataFrame, path: str) -> None:
    docs.select("document").write.mode("overwrite").text(path)


def dump(df: DataFrame, path: str) -> None:
    """A stage's rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def dump_counted(df: DataFrame, path: str, counts: list[Column]) -> dict[str, int]:
    """As dump; and the counts, named aggregates over df such as operators.rows.type_counts, which are taken while it is written, without a scan of their own."""
    seen = Observation()
    dump(df.observe(seen, *counts), path)
    return seen.get


def summary(counts: DataFrame | dict[str, int]) -> str:
    """The one row of counts, or the counts, as aligned text."""
    row = counts if isinstance(counts, dict) else counts.first().asDict()
    wide = max(map(len, row))
    return "\n".join(f"{k.rjust(wide)}: {v}" for k, v in row.items())


class Store:
    """Rows kept under a folder by key; a key that is written again is replaced, others stay."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, df: DataFrame, key: str) -> None:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(self.path))

    def get(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def save_demangled(known: DataFrame, path: str) -> None:
    """(symbol, text), sorted, as JSON lines."""
    known.select("symbol", "text").distinct().orderBy("symbol").write.mode("overwrite").json(path)
