"""Compile commands: a JSON array of files and their shell commands."""

from __future__ import annotations

import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def arguments(command: Column | str) -> Column:
    """struct(args, error): the words of a shell command without its first, the compiler."""

    @F.pandas_udf("args array<string>, error string")
    def run(commands: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in commands:
            rows = []
            for c in b:
                try:
                    words = shlex.split(c or "")
                    rows.append((words[1:], None) if words else (None, "command must not be empty"))
                except ValueError as e:
                    rows.append((None, f"invalid shell command: {e}"))
            yield pd.DataFrame(rows, columns=["args", "error"])

    return run(command)


def compile_commands(entries: DataFrame) -> DataFrame:
    """(file, args, error) of entries (at, file, command); of several for one file the last wins."""
    last = entries.groupBy("file").agg(F.max_by("command", "at").alias("command"))
    return last.withColumn("x", arguments("command")).select("file", "x.args", "x.error")


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    entries = spark.read.schema("file string, command string").json(path, multiLine=True).withColumn("at", F.monotonically_increasing_id())
    out = compile_commands(entries)
    if strict and (bad := out.where("error is not null").first()):
        raise ValueError(f"{bad['file']}: {bad['error']}")
    return out


def commands_of(units: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units (cu, name) with their args, and the units that have no command."""
    c = commands.select(F.col("file").alias("name"), "args")
    return units.join(c, "name"), units.join(c, "name", "left_anti")
