"""Many patterns over many names: an index of n-grams fetches the patterns that can match, and only those run."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from functools import lru_cache, reduce
from re import _constants as C
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.fixpoint import cut

GRAM = 16  # longest n-gram of the index, in characters; a shorter text is posted whole
SHORT = 4  # texts of this length and more may each be the rarest, shorter ones aren't tried beside them
SAME_ESCAPES = "bBdDsSwWAZnrt"  # letters after a backslash that mean the same to Python's parser and to Spark's
ESCAPE, ODD_ESCAPE, ODD_CLASS = re.compile(rf"\\[{SAME_ESCAPES}]"), re.compile(r"\\([^\W_])"), re.compile(r"\[\^?\]|\[[^\]]*(\[|&&)")
MARK, MARKS = 0xE000, 64  # code points that stand for numbers of a pattern
MARKED, NUMBER = re.compile(f"[{chr(MARK)}-{chr(MARK + MARKS)}]"), re.compile(r"(?<=[A-Za-z_:<>])[0-9]+(?=[A-Za-z_:<>]|$)")


def _better(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    worth = lambda s: (0, 0) if not s else (min(SHORT, min(map(len, s))), -len(s))
    return b if worth(b) > worth(a) else a


def _sets(parsed) -> Iterator[frozenset]:
    """Sets of texts: a match of the sequence holds one of each set."""
    run = ""
    for op, arg in [*parsed, (C.ANY, None)]:
        if op is C.LITERAL:
            run += chr(arg)
            continue
        if op is C.AT:
            continue
        inner = None
        if op is C.SUBPATTERN and not arg[1] and not arg[2]:
            inner = _needed(arg[3])
        elif op is C.ATOMIC_GROUP:
            inner = _needed(arg)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
            inner = _needed(arg[2])
        elif op is C.BRANCH:
            each = [_needed(p) for p in arg[1]]
            inner = frozenset().union(*each) if all(each) else None
        if run:
            yield frozenset([run])
        if inner:
            yield inner
        run = ""


def _needed(parsed) -> frozenset | None:
    """Texts of which a match of the sequence holds one; None where nothing is known."""
    return reduce(_better, _sets(parsed), None)


def _parsed(pattern: str):
    """The pattern as Python's parser reads it; None where that could mean something else than Spark's, as with ignored case."""
    odd = "\\" in pattern and ODD_ESCAPE.search(ESCAPE.sub("", pattern.replace(r"\\", "")))
    if odd or "[" in pattern and ODD_CLASS.search(pattern):
        return None
    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    return None if parsed.state.flags & (re.IGNORECASE | re.VERBOSE) else parsed


def required(pattern: str) -> list[str]:
    """Texts of which every match of the pattern holds at least one, sorted; [""] where none is known."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        parsed = _parsed(pattern)
    return sorted((_needed(parsed) if parsed else None) or [""])


@lru_cache(1 << 12)
def _shape_sets(shape: str) -> tuple[frozenset, ...]:
    parsed = _parsed(shape)
    return tuple(dict.fromkeys(_sets(parsed))) if parsed else ()


def requirements(pattern: str) -> list[list[str]]:
    """Lists of texts: every match of the pattern holds at least one of each. The longest come first, beside them stand only those whose texts are no shorter than SHORT.

    Patterns that differ in numbers only are parsed once: a number between plain characters is a mark meanwhile.
    """
    numbers: list[str] = []

    def mark(m: re.Match) -> str:
        numbers.append(m[0])
        return chr(MARK + len(numbers) - 1)

    shape = pattern if MARKED.search(pattern) else NUMBER.sub(mark, pattern)
    if len(numbers) > MARKS:
        shape, numbers = pattern, []
    sets = _shape_sets(shape)
    if numbers and not sets:  # as in a group's name
        sets = _shape_sets(pattern)
    elif numbers:
        back = {MARK + i: n for i, n in enumerate(numbers)}
        sets = [frozenset(t.translate(back) for t in s) for s in sets]
    best = reduce(_better, sets, None)
    return [sorted(s) for s in [best, *(s for s in sets if s != best and min(map(len, s)) >= SHORT)]] if best else [[""]]


def rule_table(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """(pos, pattern) of a list, written as a table so that plans don't hold the patterns."""
    return cut(spark.createDataFrame(list(enumerate(patterns)), "pos long, pattern string"))


def grams(text: Column, n: Column):
    """Hashes of the distinct n-grams of a text; of a shorter text, none. The only one of no characters is the empty text."""
    at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.substring(text, i, n))))


def candidates(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, pos, pattern) of distinct names (name) and the rules (pos, pattern) that can match: one of a rule's required texts is in the name.

    A required text of GRAM characters or fewer is met whole, so it meets just the names that hold it, however many
    names and rules there are; a longer one is met by that of its n-grams that the fewest names hold. Of a rule's
    several requirements the one that the fewest names fulfil is posted. n-grams are joined by their hashes, and what
    meets is compared as text. Rules of which nothing is known are posted under the empty text, which every name holds.
    Null names and null patterns have no candidates. Neither side of a join is broadcast: rules and names compress
    well, so their size on disk says little of the memory they take.
    """

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        warnings.simplefilter("ignore")  # of the parser
        for b in batches:
            each = [(pos, p, i, t) for pos, p in zip(b["pos"], b["pattern"], strict=True) for i, s in enumerate(requirements(p)) for t in s]
            yield pd.DataFrame(each, columns=["pos", "pattern", "part", "text"])

    wide = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small file is a lot of work here
    posted = rules.select("pos", "pattern").where("pattern is not null").repartition(wide).mapInPandas(texts, "pos long, pattern string, part int, text string")
    posted = cut(posted.withColumn("size", F.least(F.length("text"), F.lit(GRAM))))
    sizes = sorted(r["size"] for r in posted.select("size").distinct().collect())  # at most GRAM + 1 numbers
    held = F.flatten(F.transform(F.lit(sizes).cast("array<int>"), lambda n: grams(F.col("name"), n)))
    spread = names.where("name is not null").repartition(wide, "name").select("name", F.explode(held).alias("gram"))
    common = spread.groupBy("gram").agg(F.count("*").alias("n"))
    choices = posted.select("pos", "pattern", "part", "text", F.explode(grams(F.col("text"), F.col("size"))).alias("gram")).join(common.hint("merge"), "gram", "left")
    rare = choices.groupBy("pos", "pattern", "part", "text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
    parts = rare.groupBy("pos", "pattern", "part").agg(F.sum("m.n").alias("n"), F.collect_list(F.struct("text", "m.gram", "m.n")).alias("texts"))
    least = parts.groupBy("pos", "pattern").agg(F.min_by("texts", F.struct("n", "part")).alias("texts"))
    posting = least.select("pos", "pattern", F.explode("texts").alias("t")).where("t.n > 0").select("pos", "pattern", "t.text", "t.gram")
    return spread.join(posting.hint("merge"), "gram").where(F.contains("name", "text")).select("name", "pos", "pattern")


def first_matches(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, pos) of each distinct name: the least pos of a rule (pos, pattern) found in it; null where none is."""
    own = cut(names.select("name").distinct())
    hit = candidates(own, rules).where(F.rlike("name", F.col("pattern"))).groupBy("name").agg(F.min("pos").alias("pos"))
    return own.join(hit.hint("merge"), "name", "left")


def sort_keys(names: DataFrame, prefer: list[str], dislike: list[str]) -> DataFrame:
    """(name, key) of each distinct name, as functions.names.sort_key gives it, for any number of rules up to 65,534 of a kind."""
    if max(len(prefer), len(dislike)) > 65_534:
        raise ValueError("too many name rules for a key of 16 bits a kind")
    spark = names.sparkSession
    good = first_matches(names, rule_table(spark, prefer)).withColumnRenamed("pos", "good")
    bad = first_matches(names, rule_table(spark, dislike)).withColumnRenamed("pos", "bad")
    both = good.join(bad.hint("merge"), good["name"].eqNullSafe(bad["name"]), "left").select(good["name"], "good", "bad")
    return both.select("name", F.shiftleft(F.coalesce("good", F.lit(len(prefer))).cast("long"), 16).bitwiseOR(F.coalesce(F.col("bad") + 1, F.lit(0))).alias("key"))


def preferred(named: DataFrame, prefer: list[str], dislike: list[str]) -> DataFrame:
    """(goff, name, key): of each goff's names (goff, name), the one of the least key, then the least name."""
    keys = sort_keys(named, prefer, dislike)
    return named.join(keys.hint("merge"), "name").groupBy("goff").agg(F.min(F.struct("key", "name")).alias("m")).select("goff", "m.name", "m.key")


def unique_matches(spelled: DataFrame, rules: DataFrame) -> DataFrame:
    """(pos, n, goff, text) of each rule (pos, pattern) found in a spelling of (goff, spelled): the number of types, the least goff and its first spelling found."""
    each = cut(spelled.select("goff", F.explode("spelled").alias("name")).distinct())
    hit = candidates(each.select("name").distinct(), rules).where(F.rlike("name", F.col("pattern"))).select("name", "pos").distinct()
    one = hit.join(each.hint("merge"), "name").groupBy("pos", "goff").agg(F.min("name").alias("text"))
    return one.groupBy("pos").agg(F.count("*").alias("n"), F.min(F.struct("goff", "text")).alias("m")).select("pos", "n", "m.goff", "m.text")
