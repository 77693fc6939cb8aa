"""URL parts and rules against plain Python."""

import itertools
import re

from scribelake.llm import url_rules as ur

URLS = [
    None, "", "no scheme/x", "HTTP://WWW.Example.COM/en/1?x=1#y", "http://a.example.com/en/7", "http://example.com/en", "https://b.net/es/12345", "https://b.net/fr/",
    "https://net/fr/x", "http://xnet/fr/", "ftp://É.NET/es/", "://com/", "http://com", "http://com/", "a://b://c/d", "http://u:p@h.org:80/p;q?r/s#t", "http://h.org?x/y", "http://h\n.com/\nx",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"(?s)[^?#]*", rest[len(host) :])[0]


def test_parts_and_given_rules(spark):
    pages = spark.createDataFrame([(i, u, "html") for i, u in enumerate(URLS)] + [(3, URLS[3], ""), (None, URLS[4], None)], "page_id long, url string, rule string")
    none = ur.mine_rules(spark.createDataFrame([], "tokens array<string>, blocked boolean"))
    rows = ur.judge(pages.select("page_id", "url"), none).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        host, path = parts(URLS[4 if r["page_id"] is None else r["page_id"]])
        fits = [(h + p, v) for h, p, v in ur.GIVEN_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_mined_rules(spark):
    hosts, sections = ["good.org", "bad.org", "mixed.org"], ["news", "spam"]
    rows = []
    for k, (h, s) in enumerate(itertools.product(hosts, sections * 20)):
        blocked = h == "bad.org" or (h == "mixed.org" and s == "spam")
        rows.append((f"https://{h}/{s}/{1000 + k}?id={k}", blocked))
    labelled = spark.createDataFrame(rows, "url string, blocked boolean").select(ur.tokens_of(ur.F.col("url")).alias("tokens"), "blocked")
    rules = ur.mine_rules(labelled, 0.05, 1.8)
    baskets = [(set(r["tokens"]), r["blocked"]) for r in labelled.collect()]
    every = set().union(*(t for t, _ in baskets))
    count = {t: sum(t in b for b, _ in baskets) for t in every}
    said = {("label:" + t[5:].split(".")[0], count[t]) for t in every if t.startswith("host:")}
    every = {t for t in every if count[t] >= 0.05 * len(baskets) and (t, count[t]) not in said}
    sure = {}
    for n in range(1, len(every) + 1):
        for a in map(frozenset, itertools.combinations(sorted(every), n)):
            has = [b for t, b in baskets if a <= t]
            p = sum(has) / max(1, len(has))
            if sum(has) / len(baskets) >= 0.05 and p >= 0.9 and p - 0.5 >= ur.MIN_Z * (0.25 / len(has)) ** 0.5:
                sure[a] = sum(has) / len(has)
    want = {a for a in sure if not any(b < a and sure[b] >= sure[a] for b in sure)}
    got = {frozenset(r["antecedent"]) for r in rules.collect()}
    assert got == want and {frozenset(["host:bad.org"]), frozenset(["host:mixed.org", "path:spam"])} <= got
    pages = spark.createDataFrame([(1, "https://bad.org/about"), (2, "https://mixed.org/spam/7"), (3, "https://mixed.org/news/7"), (4, None)], "page_id long, url string")
    verdicts = {r["page_id"]: r["verdict"] for r in ur.judge(pages, rules).collect()}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_rules_of_many_tokens(spark):
    """A combination that is sure with seven tokens only, and labels that hang on nothing."""
    import random

    rng = random.Random(5)
    names = [f"path:{c}" for c in "abcdefg"]
    rows = [(names, True) for _ in range(60)]
    rows += [(names[:k] + names[k + 1 :], rng.random() < 0.3) for k in range(7) for _ in range(60)]
    found = ur.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 0.05, 1.5).collect()
    assert [tuple(r["antecedent"]) for r in found if r["confidence"] == 1] == [tuple(names)]
    noise = [(rng.sample(names, 3), rng.random() < 0.3) for _ in range(400)]
    assert ur.mine_rules(spark.createDataFrame(noise, "tokens array<string>, blocked boolean"), 0.02).count() == 0


def test_long_urls_and_repeats(spark):
    long = "https://bad.org/" + "/".join(f"s{k}" for k in range(5000))
    rules = spark.createDataFrame([(["host:bad.org", "path:sN"], 0.9, 0.1)], "antecedent array<string>, confidence double, support double")
    pages = spark.createDataFrame([(1, long), (2, long), (2, "https://bad.org/s1"), (3, None), (4, None)], "page_id long, url string")
    got = sorted((r["page_id"], r["verdict"]) for r in ur.judge(pages, rules).collect())
    assert got == [(1, "block"), (2, "allow"), (2, "block"), (3, "allow"), (4, "allow")]


def test_nothing(spark):
    none = ur.mine_rules(spark.createDataFrame([], "tokens array<string>, blocked boolean"))
    assert ur.judge(spark.createDataFrame([], "page_id long, url string"), none).count() == 0
