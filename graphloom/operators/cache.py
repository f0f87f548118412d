"""Stages kept between runs: a unit whose rows are the same but for the numbering of goffs is taken from the store."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import cut
from . import rows


def cache_key(name: Column) -> Column:
    """The file's name and a hash of its whole path."""
    return F.concat(F.substring_index(name, "/", -1), F.lit("_"), F.lower(F.hex(F.xxhash64(name))))


def numbering(types: DataFrame) -> DataFrame:
    """(cu, goff, idx): place of each goff of a unit among all that it has or refers to, primitives left as they are."""
    all_ = types.select("cu", "goff").union(types.select("cu", F.explode(rows.goffs(types)).alias("goff"))).distinct()
    all_ = all_.where(F.col("goff") < rows.trees.FIRST_PRIM)
    return all_.withColumn("idx", (F.dense_rank().over(Window.partitionBy("cu").orderBy("goff")) - 1).cast("bigint"))


def _through(types: DataFrame, number: DataFrame, a: str, b: str) -> DataFrame:
    """Goffs of each unit by its own numbering, from a to b."""
    cols = types.columns
    refs = types.select("cu", "goff", F.explode(rows.goffs(types)).alias("g"))
    found = refs.join(number.select("cu", F.col(a).alias("g"), F.col(b).alias("v")), ["cu", "g"])
    per = found.groupBy("cu", "goff").agg(F.map_from_entries(F.collect_list(F.struct("g", "v"))).alias("found"))
    at = types.join(per, ["cu", "goff"], "left").withColumn("found", F.coalesce("found", F.create_map().cast("map<bigint,bigint>")))
    to = lambda g: F.coalesce(F.try_element_at("found", g), g)
    out = rows.rewritten(at, lambda t: rows.trees.mapped(t, to))
    for c in ("target", "base_goff"):
        if c in cols:
            out = out.withColumn(c, F.when(F.col(c).isNotNull(), to(F.col(c))))
    for c in ("name_ns", "enclosing"):
        if c in cols:
            out = out.withColumn(c, F.transform(c, lambda n: F.struct(n["k"].alias("k"), F.when(n["goff"].isNotNull(), to(n["goff"])).alias("goff"), n["s"].alias("s"), n["is_linkage"].alias("is_linkage"))))
    own = number.select("cu", F.col(a).alias("goff"), F.col(b).alias("own"))
    return out.join(own, ["cu", "goff"], "left").withColumn("goff", F.coalesce("own", "goff")).select(cols)


def normalised(types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with dense goffs, and the numbering that restored() takes."""
    number = cut(numbering(types))
    return _through(types, number, "goff", "idx"), number


def restored(types: DataFrame, number: DataFrame) -> DataFrame:
    return _through(types, number, "idx", "goff")


def fingerprint(types: DataFrame, config_hash: str) -> DataFrame:
    """(cu, print): hash of the configuration and all of a unit's rows, whatever their order."""
    each = types.select("cu", F.sha2(F.to_json(F.struct(*[c for c in types.columns if c != "cu"]), {"ignoreNullFields": "false"}), 256).alias("h"))
    return each.groupBy("cu").agg(F.sha2(F.concat(F.lit(config_hash), F.concat_ws(",", F.array_sort(F.collect_list("h")))), 256).alias("print"))


class StageCache:
    """Outputs of a stage by unit under a folder, with the print of the input that each came from.

    A save writes a part of its own, rows and prints, and then one commit file that names all parts in order; a unit's
    last part counts. What isn't named by the last commit isn't there, so a run that dies in between changes nothing.
    Commits are numbered and never replaced: of two writers that take the same number one gets it, and the other puts
    its part behind. Parts beyond MOST_PARTS are put together. Old parts stay until vacuum(), for readers that still
    hold an older version.
    """

    MOST_PARTS = 16

    def __init__(self, spark: SparkSession, path: str, config_hash: str):
        self.spark, self.path, self.hash = spark, path, config_hash

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def version(self) -> tuple[int, list[dict]]:
        """Number of the last commit, and its parts; 0 and none before the first."""
        fs, at = self._at("commits")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        names = [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        if not names:
            return 0, []
        text = self.spark.read.text(f"{self.path}/commits/{names[-1]}", wholetext=True).first()[0]
        return int(names[-1].removesuffix(".json")), json.loads(text)

    def _commit(self, n: int, parts: list[dict]) -> bool:
        """Whether commit n is this one; False if another writer was first."""
        own, jvm = uuid.uuid4().hex, self.spark._jvm
        fs, new = self._at(f"commits/_{own}")
        out = fs.create(new)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        _, to = self._at(f"commits/{n:012d}.json")
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(to), none)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(new, False)
            return False
        return True

    def _read(self, parts: list[dict], what: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{p['name']}/{what}").withColumn("seq", F.lit(i)) for i, p in enumerate(parts)])

    def _last(self, parts: list[dict]) -> DataFrame:
        """(cu, print, seq) of each unit's last part."""
        return self._read(parts, "prints").groupBy("cu").agg(F.max_by("print", "seq").alias("print"), F.max("seq").alias("seq"))

    def _write(self, prints: DataFrame, outputs: DataFrame, batch: str | None) -> dict:
        part = {"name": f"part-{uuid.uuid4().hex}", "batch": batch}
        outputs.write.parquet(f"{self.path}/{part['name']}/rows")
        prints.write.parquet(f"{self.path}/{part['name']}/prints")
        return part

    def lookup(self, types: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """Outputs of the units that haven't changed, with this run's goffs, and the rows of those that have."""
        plain, number = normalised(types)
        _, parts = self.version()
        if not parts:
            return None, types
        prints = cut(fingerprint(plain, self.hash))
        hits = cut(prints.join(self._last(parts), ["cu", "print"]).select("cu", "seq"))
        out = restored(self._read(parts, "rows").join(hits, ["cu", "seq"], "left_semi").drop("seq"), number)
        return out, types.join(hits, "cu", "left_anti")

    def save(self, types: DataFrame, outputs: DataFrame, batch: str | None = None) -> None:
        """Keeps outputs of the units that types has; outputs refer to types' goffs only. A batch that the last commit names is not saved again."""
        n, parts = self.version()
        if batch is not None and any(p["batch"] == batch for p in parts):
            return
        plain, number = normalised(types)
        part = self._write(fingerprint(plain, self.hash), _through(outputs, number, "goff", "idx"), batch)
        while not self._commit(n + 1, [*parts, part]):
            n, parts = self.version()
            if batch is not None and any(p["batch"] == batch for p in parts):
                return
        if len(parts) >= self.MOST_PARTS:
            self.compact()

    def compact(self) -> None:
        """All units' last parts as one; another writer's commit in between comes first, and this one is left out."""
        n, parts = self.version()
        if len(parts) < 2:
            return
        last = cut(self._last(parts))
        rows_ = self._read(parts, "rows").join(last.select("cu", "seq"), ["cu", "seq"], "left_semi").drop("seq")
        self._commit(n + 1, [self._write(last.drop("seq"), rows_, parts[-1]["batch"])])

    def vacuum(self) -> None:
        """Removes parts that the last commit doesn't name; nobody may be reading or writing."""
        _, parts = self.version()
        fs, at = self._at("")
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if name.startswith("part-") and name not in {p["name"] for p in parts}:
                fs.delete(s.getPath(), True)

    def hits(self, types: DataFrame) -> tuple[int, int]:
        """Unchanged units, and all."""
        out, rest = self.lookup(types)
        n, left = types.select("cu").distinct().count(), rest.select("cu").distinct().count()
        return (0 if out is None else n - left), n
