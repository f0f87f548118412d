"""SimHash groups and URL verdicts against brute force."""

import random
import re

import duckdb
import numpy as np

from graphloom.llm import simhash, urlfilter
from graphloom.llm.common import components

DOCS = "doc_id long, text string, extra string"


def test_components(spark):
    got = components(spark.createDataFrame([(5, 4), (4, 9), (2, 1), (9, 3), (7, 7)], "u long, v long")).collect()
    assert {tuple(r) for r in got} == {(3, 3), (4, 3), (5, 3), (9, 3), (1, 1), (2, 1)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute(fps):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_simhash_groups(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = []
    for i in range(60):
        base = rng.choices(words, k=rng.choice([1, 2, 5, 80, 200]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy), "x"))
    rows += [(len(rows) + k, t, None) for k, t in enumerate([None, "", " \n", "A B", "a b", "\u00c4 \u00a0b"])]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    fps = [simhash.fingerprint(t) for _, t, _ in rows]
    assert [got[i].fp & (2**64 - 1) for i in range(len(rows))] == fps
    assert [got[i].component_id for i in range(len(rows))] == brute(fps)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_dense_buckets_lose_no_link(spark):
    rng = np.random.default_rng(5)
    fps = sorted({int(b) ^ int(sum(1 << int(x) for x in set(rng.integers(0, 64, 2)))) for b in rng.integers(0, 2**62, 8) for _ in range(40)})
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    got = {r.fp & (2**64 - 1): r.cfp & (2**64 - 1) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()}
    want = brute(fps)
    groups = lambda key: {frozenset(f for f in fps if key(f) == k) for k in {key(f) for f in fps}}
    assert groups(lambda f: got.get(f, f)) == groups(lambda f: want[fps.index(f)])


def test_urls(spark):
    urls = [None, "", "nothing", "http://A.com", "http://a.COM/x?y", "https://www.example.com/en/1", "https://b.example.com/en/1#t", "http://q.net/es/", "http://net/es", "x://net/fr/a?b", "http://examplecom/en/", "http://m.spam-farm.example.org/", "http://a.com:80/", "ftp://u@example.com/en//a/", "http://\n.net/es/\nb"]
    rows = [(i, u, "x") for i, u in enumerate(urls)]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, rule string"), urlfilter.RULES, urlfilter.PATTERNS)
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    want = con.execute(urlfilter.SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert [got.count(), dict((r.page_id, r.rule) for r in got.collect())[5]] == [len(urls), "www.example.com/en/"]


def test_many_url_rules(spark, monkeypatch):
    """20,000 rules, which are joined, and a few on both ways, against every rule on every url."""
    rng = random.Random(2)
    hosts = [".".join(rng.choices(["a", "b", "com", "net", "x-y", "shop"], k=rng.randint(1, 4))) for _ in range(400)]
    urls = [f"http://{h.upper() if i % 3 else h}/{rng.choice(['en/', 'en', 'fr/a?b', '', '#c'])}" for i, h in enumerate(hosts)] + [None, "", "no scheme", "x://", "http://a.com/(", "http://a.com/("]
    pages = spark.createDataFrame([(None if i % 50 == 0 else i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, best string")
    rules = [urlfilter.host_rule(rng.choice(["allow", "block"]), f"{h}/{p}") for h in sorted(set(hosts))[:40] for p in ("", "e")]
    patterns = [urlfilter.Rule("odd", "block", r"/.*\(", ()), *urlfilter.PATTERNS]
    many = rules + [urlfilter.host_rule("block", f"h{i}.org/") for i in range(20_000)]

    def plain(u):
        rest = re.match(r"[^?#]*", u.split("://", 1)[1])[0] if u and "://" in u else ""
        host, slash, path = rest.partition("/")
        url = host.lower() + slash + path
        fits = [(len(r.name), r.name, r.verdict) for r in rules if re.search(r.regex, url)]
        _, name, verdict = max(fits, default=(0, None, "block" if any(re.search(p.regex, url) for p in patterns) else "allow"))
        return host.lower(), slash + path, name, verdict

    want = sorted(((p.page_id, *plain(p.url)) for p in pages.collect()), key=str)
    got = urlfilter.judge(pages, many, patterns).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert sorted(map(tuple, urlfilter.judge(pages, rules, patterns).collect()), key=str) == want
    monkeypatch.setattr(urlfilter, "LITERALS", 1000)
    assert sorted(map(tuple, urlfilter.judge(pages, rules, patterns).collect()), key=str) == want
    assert urlfilter.judge(pages.limit(0), many, patterns).count() == 0
