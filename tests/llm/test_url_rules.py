"""Given rules against a loop, mined rules against counting."""

from itertools import combinations

from scanlake.llm import url_rules
from scanlake.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def given(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_query_against_a_loop(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").toPandas()
    out = QUERIES["op3_url_rules"](spark, SF).toPandas().merge(pages, on="page_id")
    assert len(out) == len(pages)
    for r in out.itertuples():
        assert (r.host, r.path) == parse(r.url)
        rule, verdict = given(r.host, r.path)
        assert (r.rule if isinstance(r.rule, str) else None) == rule and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict


def test_awkward_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http://ORG/x", "http://a.ORG", "https://Example.org/es/1", "https://notexample.org/es/1", "x://a.com/de/?q#f",
        "http://a.com/fr/../", "ftp://h://i/j", "http://a.com?x=/fr/", "http://É.com/de/É", "http://a..com/fr/" + "y/" * 3000, "http://a.com/fr/\nb",
    ]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls * 2)], "page_id long, url string, host string")
    out = {r.page_id: r for r in url_rules.judge(pages, URL_RULES).collect()}
    assert len(out) == len(urls) * 2
    for k, url in enumerate(urls * 2):
        assert (out[k].host, out[k].path) == parse(url)
        assert (out[k].rule, out[k].verdict) == (lambda g: g if g[0] else (None, out[k].verdict))(given(*parse(url)))
    assert url_rules.judge(pages.limit(0), URL_RULES).count() == 0


def test_mined_rules_against_counting(spark):
    import random

    rng = random.Random(1)
    baskets = {(tuple(sorted(rng.sample("abcdef", rng.randrange(1, 5)))), rng.choice(["block", "allow"])) for _ in range(60)}
    baskets |= {(tuple(sorted({"z", *rng.sample("abcdef", 2)})), "block") for _ in range(12)}
    rows = spark.createDataFrame([(list(t), s) for t, s in baskets] * 2, "tokens array<string>, said string")
    got = {(tuple(r.antecedent), r.verdict): round(r.confidence, 9) for r in url_rules.mine(rows, 0.05, 0.8).collect()}
    every = {}
    for size in range(1, 8):
        for some in combinations("abcdefz", size):
            with_all = [s for t, s in baskets if set(some) <= set(t)]
            for verdict in ("block", "allow"):
                n = with_all.count(verdict)
                if n / len(baskets) >= 0.05 and n / len(with_all) >= 0.8:
                    every[some, verdict] = round(n / len(with_all), 9)
    pruned = {
        k: c for k, c in every.items()
        if not any(every.get((tuple(x for x in k[0] if x != gone), k[1]), 0) >= c for gone in k[0])
    }
    assert got == pruned and got


def test_tokens_always_met_together_are_one_item(spark):
    many = [f"p:{k}" for k in range(40)]
    rows = spark.createDataFrame([(many + [f"q:{k}"], "block") for k in range(30)] + [([f"r:{k}"], "allow") for k in range(30)], "tokens array<string>, said string")
    rules = url_rules.mine(rows, 0.1, 0.9).collect()
    assert [(len(r.antecedent), r.verdict) for r in rules] == [(1, "block")]


def test_a_rule_holds_for_each_token_of_its_item(spark):
    """p:de and p:ware are met together in all labelled URLs; a URL with one of them fits the rule, whichever it is."""
    urls = [f"http://a.com/de/ware/{c}{c}" for c in "abcdefghijklmnopqrst"] + [f"http://a.org/fr/{c}" for c in "abcdefghij"]
    asked = ["http://b.net/de/1", "http://b.net/ware/1", "http://b.net/other/1"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls + asked)], "page_id long, url string")
    out = {r.url: r.verdict for r in url_rules.judge(pages, URL_RULES, min_support=0.1).collect()}
    assert [out[u] for u in asked] == ["block", "block", "allow"]
