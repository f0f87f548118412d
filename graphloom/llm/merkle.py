"""Merkle manifest of a dataset: a tree a group over its rows in order, and one over the groups' roots.

Blocks of rows are reduced where they lie. What is left of the groups that fill several blocks is a small top tree,
which the driver builds; the paths from a block to the root go back to the executors by a broadcast, and they finish
the proofs. A top tree of more than TOP nodes is reduced in blocks again, so the driver never holds more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, stored, table

RUN = 8  # nodes that become one
LEVELS = 3  # levels of a block
SIZE = RUN**LEVELS
TOP = 4096  # nodes that the driver takes
PATH = "array<struct<left:string,right:string>>"  # the siblings before and after a node, level by level
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def reduced(level: list[str]) -> list[str]:
    return [digest("".join(level[i : i + RUN])) for i in range(0, len(level), RUN)]


def tree(leaves: list[str], levels: int | None = None) -> list[list[str]]:
    """The levels above and with the leaves: so many, else until one node is left."""
    out = [leaves]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        out.append(reduced(out[-1]))
    return out


def siblings(level: list[str], i: int) -> tuple[str, str]:
    a = i - i % RUN
    return "".join(level[a:i]), "".join(level[i + 1 : a + RUN])


def field(c: Column) -> Column:
    """UTF-8 byte count, colon and value; - for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(df: DataFrame, fields: list[str], put: dict[str, Column] | None = None) -> Column:
    parts = [field((put or {}).get(c, F.col(f"`{c}`"))) for c in fields]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, nothing else; ASCII texts take the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def climb(nodes: DataFrame, carry: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of nodes (g, pos, n, digest, carry): g, block, n, arrays of digests and of each carried column, and the path from the block to its group's root; and (g, digest) of the groups' roots."""
    row = F.struct("pos", "digest", *carry)
    packed = nodes.groupBy("g", F.floor(F.col("pos") / SIZE).alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(row)).alias("r"))
    blocks = stored(packed.select("g", "block", "n", *[F.col("r")[c].alias(c) for c in ("digest", *carry)]), name)

    def root(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            top = [tree(list(d), LEVELS if n > SIZE else None)[-1][0] for n, d in zip(b["n"], b["digest"], strict=True)]
            yield pd.DataFrame({"g": b["g"], "block": b["block"], "n": b["n"], "digest": top})

    roots = stored(blocks.select("g", "block", "n", "digest").mapInPandas(root, "g string, block long, n long, digest string"), name)
    up = paths(roots.where(f"n > {SIZE}").select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / SIZE).alias("n"), "digest"), name)
    tops = roots.where(f"n <= {SIZE}").select("g", "digest").union(up.where("pos = 0").select("g", "root"))
    return blocks.join(up.withColumnRenamed("pos", "block"), ["g", "block"], "left"), tops


def paths(nodes: DataFrame, name: str) -> DataFrame:
    """(g, pos, path, root) of nodes (g, pos, n, digest): by the driver if they are TOP at most, else in blocks."""
    spark, schema = nodes.sparkSession, f"g string, pos long, path {PATH}, root string"
    held = nodes.limit(TOP + 1).collect()
    if len(held) <= TOP:
        groups: dict[str, list] = {}
        for r in sorted(held, key=lambda r: (r["g"], r["pos"])):
            groups.setdefault(r["g"], []).append(r["digest"])
        out = []
        for g, leaves in groups.items():
            levels = tree(leaves)
            for i in range(len(leaves)):
                out.append((g, i, [siblings(level, i // RUN**k) for k, level in enumerate(levels[:-1])], levels[-1][0]))
        return F.broadcast(spark.createDataFrame(out, schema))

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                levels, over = tree(list(r.digest), LEVELS if r.n > SIZE else None), _steps(r.path)
                each = [[siblings(level, i // RUN**k) for k, level in enumerate(levels[:-1])] + over for i in range(len(r.digest))]
                yield pd.DataFrame({"g": r.g, "pos": r.block * SIZE + pd.RangeIndex(len(each)), "path": [[{"left": x, "right": y} for x, y in p] for p in each], "root": r.root if over else levels[-1][0]})

    return stored(climb(nodes, [], name)[0].mapInPandas(below, schema), name)


def _steps(path) -> list[tuple[str, str]]:
    return [] if path is None else [(s["left"], s["right"]) for s in path]


def manifest(docs: DataFrame, fields: list[str], group: str, key: str, put: dict[str, Column] | None = None, changed: Column | None = None, keep_paths: bool = False) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified for each row; with keep_paths also path, from the leaf to the root.

    A leaf is the hash of the row's fields. The rows of a group are leaves in ascending order of the key, null first;
    rows of one key in the order of their leaves. Groups come in bytewise order, null first. put and changed: the
    columns as somebody presents them, on rows where changed holds; folded_root is what the presented row and the
    original siblings give. An empty table gives no rows. Columns other than fields, key and group are ignored.
    """
    kind = docs.schema[key].dataType
    own = leaf(docs, fields)
    shown = F.when(F.coalesce(changed, F.lit(False)), leaf(docs, fields, put)) if changed is not None else F.lit(None).cast("string")
    g = F.when(F.col(f"`{group}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")))
    rows = docs.select(g.alias("g"), F.col(f"`{key}`").alias("key"), own.alias("digest"), shown.alias("shown"))
    nodes = ranked(stored(rows, "leaves"), ["key", "digest"], "order")
    blocks, tops = climb(nodes.withColumn("key", F.col("key").cast("string")), ["key", "shown"], "blocks")
    groups = stored(ranked(tops.select(F.lit("").alias("g"), F.col("g").alias("member"), "digest"), ["member"], "groups"), "groups")
    over = paths(groups.drop("member"), "groups").select("pos", F.col("path").alias("last"), F.col("root").alias("whole"))
    over = groups.select("pos", F.col("member").alias("g")).join(over, "pos").drop("pos")

    def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                leaves = list(r.digest)
                levels = tree(leaves, LEVELS if r.n > SIZE else None)
                rest = _steps(r.path) + _steps(r.last)
                subroot = r.root if r.n > SIZE else levels[-1][0]
                inner = [[siblings(level, i) for i in range(len(level))] for level in levels[:-1]]
                above = ["".join(x + y for x, y in rest)]  # siblings from a node of the level on
                for level in reversed(inner[1:]):
                    above = [x + y + above[i // RUN] for i, (x, y) in enumerate(level)]
                first = inner[0] if inner else [("", "")]
                proofs = [digest(x + y + above[i // RUN]) for i, (x, y) in enumerate(first)]
                folded, every = [], []
                for i, h in enumerate(r.shown):
                    h, steps = leaves[i] if h is None else h, [level[i // RUN**k] for k, level in enumerate(inner)]
                    for x, y in steps + rest:
                        h = digest(x + h + y)
                    folded.append(h)
                    if keep_paths:
                        every.append([{"left": x, "right": y} for x, y in steps + rest])
                out = {"key": list(r.key), "leaf": leaves, "subroot": subroot, "root": r.whole, "proof_sha256": proofs, "folded_root": folded, "verified": [h == r.whole for h in folded]}
                yield pd.DataFrame(out | ({"path": every} if keep_paths else {}))

    schema = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + f", path {PATH}" * keep_paths
    out = blocks.join(over, "g").mapInPandas(prove, schema)
    return out.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, with the text of every third row (by crc32 of its doc_id) presented with A-Z lowered.

    Null doc_ids come first in their language and aren't tampered with; repeated doc_ids follow the order of their
    leaves; null and empty fields give different leaves.
    """
    some = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(table(spark, sf_dir, "documents"), FIELDS, "lang", "doc_id", {"text": ascii_lower(F.col("text"))}, some)


def _sql(levels: int = 8) -> str:
    """The trees level by level, for at most 8 ** levels rows a language and as many languages."""
    f = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    row = lambda text: "sha256(" + " || ".join(f(text if c == "text" else f"cast({c} as varchar)") for c in FIELDS) + ")"
    crc = "xor(list_reduce(flatten([[4294967295], flatten([[ord(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(cast(doc_id as varchar), '')])]), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295)"
    low = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    parts = [
        f"d as materialized (select doc_id, case when lang is null then '' else '=' || lang end as g, {row('text')} as leaf, case when doc_id is not null and {crc} % 3 = 0 then {row(low)} else {row('text')} end as f from documents)",
        "p0 as materialized (select *, '' as g2, '' as s, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos from d)",
        "n0 as materialized (select g, pos, leaf as h from p0)",
    ]

    def climb(n: str, p: str, own: str) -> None:
        """Levels of the nodes n (g, pos, h); rows p (pos, siblings s, fold f, and g in the column own) go up with them."""
        for k in range(levels):
            parts.append(f"w{n}{k} as materialized (select g, pos // 8 as pos, list(h order by pos) as hs from {n}{k} where g in (select g from {n}{k} where pos > 0) group by g, pos // 8)")
            parts.append(f"{n}{k + 1} as materialized (select g, pos, sha256(array_to_string(hs, '')) as h from w{n}{k} union all select g, pos, h from {n}{k} where g not in (select g from w{n}{k}))")
            before, after = "array_to_string(hs[:p.pos % 8], '')", "array_to_string(hs[p.pos % 8 + 2:], '')"
            pick = lambda a, b: f"case when hs is null then {a} else {b} end"
            parts.append(f"{p}{k + 1} as materialized (select p.* exclude (pos, s, f), {pick('p.pos', 'p.pos // 8')} as pos, {pick('s', f's || {before} || {after}')} as s, {pick('f', f'sha256({before} || f || {after})')} as f from {p}{k} p left join w{n}{k} w on w.g = p.{own} and w.pos = p.pos // 8)")

    climb("n", "p", "g")
    parts.append(f"m0 as materialized (select '' as g, row_number() over (order by g) - 1 as pos, h, g as member from n{levels})")
    parts.append(f"q0 as materialized (select p.* exclude (pos), m0.h as subroot, m0.pos as pos from p{levels} p join m0 on p.g = m0.member)")
    climb("m", "q", "g2")
    return "with " + ", ".join(parts) + f" select doc_id, leaf, subroot, h as root, sha256(s) as proof_sha256, f as folded_root, f = h as verified from q{levels} cross join m{levels}"


SQL = _sql()
