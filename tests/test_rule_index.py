"""The index of patterns against every pattern on every name."""

import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.operators import rule_index, spelling

KNOWN = [
    ("abc", ["abc"]), ("^abc$", ["abc"]), ("ab?c", ["a"]), ("ab+cdef", ["cdef"]), ("(?:abcd|efgh)x", ["abcd", "efgh"]), ("(ab|c*)de", ["de"]),
    ("(?i)abc", [""]), ("(?i:abc)d", ["d"]), ("a|", [""]), (r"std::vector<\w+>", ["std::vector<"]), (r"a\vb", [""]), (r"\x41b", [""]), ("[a[b]]c", [""]),
    ("[]a]b", [""]), (".*", [""]), ("", [""]), ("(", [""]), ("a{2}bcd", ["bcd"]), (r"a\\vb", ["a\\vb"]), ("(?=abc)d", ["d"]), ("(?x) a b", [""]),
]


@pytest.mark.parametrize("pattern, texts", KNOWN)
def test_required(pattern, texts):
    assert rule_index.required(pattern) == texts


PARTS = ["ab", "ba", "abc", "c?", "[ab]", ".", "(a|b)", "(?:ab|cd)", "d+", "c*", r"\d", "^", "$", "(?i:A)", "::", "<", r"\.", "é", "a{2,3}", r"\bab"]


def test_random_patterns(spark):
    rng = random.Random(3)
    rules = ["".join(rng.choices(PARTS, k=rng.randint(1, 4))) for _ in range(60)] + ["", "zzzz"]
    texts = ["".join(rng.choices("abcd12A:<.é ", k=rng.randint(0, 9))) for _ in range(300)] + ["", None, "ab", "ab"]
    rows = spark.createDataFrame([(t,) for t in texts], "name string")
    got = {r["name"]: r["pos"] for r in rule_index.first_matches(rows, rule_index.rule_table(spark, rules)).collect()}
    assert got == {t: None if t is None else next((i for i, p in enumerate(rules) if re.search(p, t)), None) for t in texts}
    prefer, dislike = rules[:9], rules[20:29]
    want = {r["name"]: r["k"] for r in rows.distinct().select("name", names.sort_key(F.col("name"), prefer, dislike).alias("k")).collect()}
    assert {r["name"]: r["key"] for r in rule_index.sort_keys(rows, prefer, dislike).collect()} == want


def test_many_rules_in_a_small_plan(spark):
    """60,000 rules over names of which each fits two: the plan has the size that it has for 60."""
    rows = spark.range(3000).select(F.concat(F.lit("ns::t"), F.col("id") * 20 % 60_000, F.lit("<i32>")).alias("name"))

    def plan(n):
        out = rule_index.first_matches(rows, rule_index.rule_table(spark, [f"^ns::t{i}<.*>$" for i in reversed(range(n))]))
        return out, len(out._jdf.queryExecution().executedPlan().toString())

    many, size = plan(60_000)
    assert abs(size - plan(60)[1]) < 500
    got = many.collect()
    assert len(got) == 3000 and all(r["pos"] == 59_999 - int(r["name"][5:-5]) for r in got)


def test_unique_matches(spark):
    spelled = spark.createDataFrame([(1, ["ab", "x"]), (2, ["b", "cb"]), (3, []), (4, ["q", "qq"])], "goff long, spelled array<string>")
    rules = ["b$", "^q", "zz", "x", "c?b"]
    got = {r["pos"]: tuple(r)[1:] for r in rule_index.unique_matches(spelled, rule_index.rule_table(spark, rules)).collect()}
    assert got == {0: (2, 1, "ab"), 1: (1, 4, "q"), 3: (1, 1, "x"), 4: (2, 1, "ab")}
    assert spelling.unique_match(spelled, "^q") == got[1][1:]


def test_preferred(spark):
    named = spark.createDataFrame([(1, "b_t"), (1, "a"), (1, "detail::c"), (2, "z"), (2, "y"), (3, None)], "goff long, name string")
    got = rule_index.preferred(named, ["^a$"], ["detail", "^y"])
    assert sorted(map(tuple, got.collect())) == [(1, "a", 0), (2, "z", 1 << 16)]
    assert rule_index.preferred(named, [], []).count() == 2
    assert rule_index.first_matches(named.limit(0), rule_index.rule_table(named.sparkSession, ["a"])).count() == 0


def test_rules_meet_only_names_that_hold_their_text(spark):
    """Numbers share their n-grams: a rule over one number meets the names with that number, however many there are."""
    rows = spark.range(2000).select(F.concat(F.lit("c"), F.col("id") + 100_000, F.lit("::BUILDING<"), F.col("id") % 25, F.lit(">")).alias("name"))
    rules = rule_index.rule_table(spark, [f"^c{i}::(?:BUILDING|MACHINERY)<\\d*5>$" for i in range(100_000, 102_000)])
    assert rule_index.candidates(rows, rules).count() == 2000
    long = rule_index.rule_table(spark, ["^c100007::BUILDING<7>$", "::BUILDING<7>.*a text longer than the index's n-grams"])
    assert [tuple(r)[:2] for r in rule_index.candidates(rows, long).collect()] == [("c100007::BUILDING<7>", 0)]
    assert rule_index.requirements("ab(?:cdef|ghij)+kl") == [["cdef", "ghij"]]
    assert rule_index.requirements("^c1::(?:BUILDING|MACHINERY)<\\d*7>$") == [["c1::"], ["BUILDING", "MACHINERY"]]


def test_nothing_is_broadcast(spark):
    """Names and rules take many times their size on disk in memory."""
    rows = spark.range(10).select(F.col("id").cast("string").alias("name"))
    out = rule_index.first_matches(rows, rule_index.rule_table(spark, ["1", "2"]))
    out.collect()
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("pattern", [*(p for p, _ in KNOWN), "c12::a{12}b3", "c12+d34", r"\x41b12", r"a\12b", r"x\b12y|z34", "(?P<n1>a12)b", "a12", "[c12]d34::", "(?:a1b|c22d)e333", "12a", "a{1,12}b", "(a12)?c7c"])
def test_numbers_are_marks_meanwhile(pattern):
    """Marked or not, the requirements are the same; a text of which nothing is known stays so."""
    found = rule_index._parsed(pattern)
    sets = {frozenset(s) for s in (rule_index._sets(found) if found else [])}
    got = {frozenset(s) for s in rule_index.requirements(pattern)}
    assert got <= (sets or {frozenset([""])})
