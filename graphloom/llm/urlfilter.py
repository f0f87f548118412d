"""URL rules, indexed by their rarest literal token; DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

LITERALS = 64  # so many rules are literals of the plan; more are a table that is joined


@dataclass(frozen=True)
class Rule:
    """name; verdict; regex over host + path; literal tokens of which a matching url has every one."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]


def host_rule(verdict: str, spec: str) -> Rule:
    """spec: host/path; fits the host and its subdomains where the path starts with the rule's."""
    host, slash, rest = spec.partition("/")
    whole = (slash + rest).split("/")[1:-1]  # a last piece without its slash may be part of a longer one
    return Rule(spec, verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + rest)}", tuple(x for x in [*host.split("."), *whole] if x))


# The rules of the query.
RULES = [host_rule(v, s) for v, s in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))]
# What the method itself blocks where no host rule fits.
PATTERNS = [Rule("spam-farm", "block", r"\A(?:[^/]*\.)?spam-farm\.[^/]*", ("spam-farm",))]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(F.regexp_extract(rest, r"\A[^?#]*", 0), F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/]*", 0)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low, F.regexp_replace(rest, r"\A[^/]*", "")


def judge(pages: DataFrame, rules: list[Rule], patterns: list[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row; the longest fitting rule wins.

    Null urls and urls without :// have empty host and path, and the default verdict. Each rule is
    kept under the one of its tokens that the pages hold least often. A url's tokens fetch its
    candidates from that index, and only those run their regular expression. Few rules are part of
    the plan, and pages aren't shuffled; many are a table, joined with the tokens of distinct urls.
    Null page_ids and other columns' names don't matter; an empty table gives no rows.
    """
    known = rules + patterns
    host, path = host_and_path(F.col("url"))
    at = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    tokens = F.array_distinct(F.concat(F.split("host", r"\."), F.split("path", "/")))
    at = at.withColumn("tokens", tokens)
    own = {r.name for r in rules}
    if len(known) > LITERALS:
        return _said(at.drop("tokens").join(_best(at, known, own), ["host", "path"], "left"), default)
    wanted = sorted({t for r in known for t in r.tokens})
    seen = {r["t"]: r["n"] for r in at.select(F.explode("tokens").alias("t")).where(F.col("t").isin(wanted)).groupBy("t").agg(F.count("*").alias("n")).collect()}
    index: dict[str, list[Rule]] = {}
    for r in known:
        index.setdefault(min(r.tokens, key=lambda t: (seen.get(t, 0), t)) if r.tokens else "", []).append(r)
    entry = lambda r: F.struct(F.lit(len(r.name) if r.name in own else -1).alias("len"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"))
    lists = F.create_map(*[x for t, rs in index.items() for x in (F.lit(t), F.array(*[entry(r) for r in rs]))])
    held = F.array_intersect(F.array_append("tokens", F.lit("")), F.array(*[F.lit(t) for t in index]))
    found = F.flatten(F.transform(held, lambda t: F.element_at(lists, t)))
    url = F.concat("host", "path")
    fits = F.filter(found, lambda r: F.rlike(url, r["regex"]))
    return _said(at.withColumn("best", F.array_max(fits)), default)


def _said(at: DataFrame, default: str) -> DataFrame:
    return at.select("page_id", "host", "path", F.when(F.col("best.len") >= 0, F.col("best.name")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _best(at: DataFrame, known: list[Rule], own: set[str]) -> DataFrame:
    """host, path, best of the distinct urls that a rule fits, with the rules as a table; a rule whose tokens no url has is dropped."""
    rows = [(i, len(r.name) if r.name in own else -1, r.name, r.verdict, r.regex, list(r.tokens) or [""]) for i, r in enumerate(known)]
    kept = stored(at.sparkSession.createDataFrame(rows, "i long, len int, name string, verdict string, regex string, tokens array<string>"), "rules")
    spread = at.select("host", "path", F.explode(F.array_distinct(F.array_append("tokens", ""))).alias("token")).distinct()
    wanted = kept.select("i", F.explode("tokens").alias("token"))
    seen = spread.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    # a token that no url has comes first, and with it the rule finds nothing
    rare = wanted.join(seen, "token", "left").groupBy("i").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = stored(rare.join(kept.drop("tokens"), "i"), "rule-index")  # its size on disk decides on a broadcast
    found = spread.join(index, "token").where(F.rlike(F.concat("host", "path"), F.col("regex")))
    return found.groupBy("host", "path").agg(F.max(F.struct("len", "name", "verdict", "regex")).alias("best"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the five host rules, then by what the method itself blocks."""
    return judge(table(spark, sf_dir, "pages"), RULES, PATTERNS)


SQL = r"""
with u as (select page_id, case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/]*', 0)) + 1) as path from u),
r(verdict, rule, rhost, rpath) as (values ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
m as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from h join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select h.page_id, host, path, m.rule, coalesce(m.verdict, case when starts_with(host, 'spam-farm.') or strpos(host, '.spam-farm.') > 0 then 'block' else 'allow' end) as verdict from h left join m using (page_id)
"""
