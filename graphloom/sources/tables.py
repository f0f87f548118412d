"""Tables and symbol lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(lines: DataFrame, address: int, symbol: int, base: int) -> DataFrame:
    """(symbol, addr) of comma-split `value` lines; no quoting, blank symbols left out; addresses are hex."""
    part = F.split("value", ",")
    out = lines.select(F.trim(F.get(part, F.lit(symbol))).alias("symbol"), (F.conv(F.regexp_replace(F.trim(F.get(part, F.lit(address))), "^0[xX]", ""), 16, 10).cast("long") - base).alias("addr"))
    return out.where("symbol <> ''")


def symbol_rows(lines: DataFrame, address: int, symbol: int, base: int, skip: int = 0) -> tuple[DataFrame, DataFrame]:
    """(symbol, addr) of lines (at, value) in the order of at, and errors (at, code). The last of equal symbols wins.

    The first `skip` lines are left out. A line without the columns, an address that is no number, below base or
    4 GiB and more above it is an error, blank symbols or not; blank symbols are then left out.
    """
    part, t = F.split("value", ",", -1), F.trim(F.get(F.split("value", ",", -1), F.lit(address)))
    hexa = F.conv(F.regexp_replace(t, "^0[xX]", ""), 16, 10)
    value = F.when(t.rlike("^0[xX][0-9a-fA-F]{1,15}$"), hexa.cast("long")).otherwise(F.expr("cast(null as bigint)"))
    value = F.coalesce(value, F.when(t.rlike("^[0-9]{1,18}$"), t.cast("long")))
    rows = lines.where(F.col("at") >= skip).select("at", F.trim(F.get(part, F.lit(symbol))).alias("symbol"), t.alias("t"), (value - base).alias("addr"))
    code = F.when(F.col("t").isNull(), "no address column").when(F.col("addr").isNull(), "no number").when(F.col("addr") < 0, "below the base").when(F.col("addr") > 0xFFFFFFFF, "too far from the base").when(F.col("symbol").isNull(), "no symbol column")
    rows = rows.withColumn("code", code)
    good = rows.where("code is null and symbol <> ''").groupBy("symbol").agg(F.max_by("addr", "at").alias("addr"))
    return good, rows.where("code is not null").select("at", "code")


def symbol_list(spark: SparkSession, path: str, address: int, symbol: int, base: int, skip: int = 0, strict: bool = True) -> DataFrame:
    """(symbol, addr) of one file; with strict any error ends it."""
    good, wrong = symbol_rows(spark.read.text(path).withColumn("at", F.monotonically_increasing_id()), address, symbol, base, skip)
    if strict and (bad := wrong.orderBy("at").first()):
        raise ValueError(f"{path}, line {bad['at'] + 1}: {bad['code']}")
    return good
