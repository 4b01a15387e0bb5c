import random
import re
from itertools import combinations

import duckdb
import pytest

from tidemark.llm import url_filters as U

URLS = [None, "", "nonsense", "a://b://c/d", "https://X.Example.NET/en/1?q=/en/#t", "http://net", "http://net/", "http://a.net/x", "http://anet/x", "http://example.com/de/", "http://EXAMPLE.com/DE/", "ftp://a.b.org/fr/x", "http://org/fr/", "http://org/de/", "http://u@h:80/p#a?b", "://h/p", "http://example.net?/en/", "http://é.net/É\n/x"]


def slow(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max((r for r in U.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, "http://a.net/", "h")], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: tuple(r)[1:] for r in U.digest(pages, labels).collect()}
    assert len(got) == len(URLS) + 1
    for i, u in enumerate(URLS):
        host, path, rule, verdict = slow(u)
        assert got[i] == (host, path, rule, verdict or "allow"), u
    assert U.digest(pages.where("page_id < 0"), labels).count() == 0


@pytest.mark.parametrize("seed, sent", [(1, 10_000), (2, 0)])
def test_mined_rules_are_brute_force(spark, monkeypatch, seed, sent):
    monkeypatch.setattr(U, "SENT", sent)
    r = random.Random(seed)
    urls = [f"http://{r.choice('abc')}.{r.choice(['com', 'edu'])}/{r.choice(['shop', 'wiki'])}/{r.choice(['x', 'y', ''])}?{r.choice(['k', 'm'])}=1" for _ in range(150)]
    block = [("shop" in u and "k=" in u) or r.random() < 0.1 for u in urls]
    rows = spark.createDataFrame(list(zip(urls, block, strict=True)), "url string, block boolean")
    tokens = {x.url: frozenset(x.t) for x in rows.select("url", U.tokens_of(rows["url"]).alias("t")).collect()}
    every = [(tokens[u], b) for u, b in zip(urls, block, strict=True)]
    rules, base = {}, sum(block) / len(block)
    for k in range(1, 8):
        for s in combinations(sorted({t for ts, _ in every for t in ts}), k):
            n = [b for ts, b in every if ts.issuperset(s)]
            if sum(n) >= 20 and sum(n) / len(n) >= base + 0.5 * (1 - base):
                rules[s] = sum(n) / len(n)
    want = {s for s, c in rules.items() if not any(rules.get(p, 0) >= c for p in combinations(s, len(s) - 1))}
    mined = U.mine(rows)
    assert {tuple(x.tokens) for x in mined.collect()} == want and want
    assert all(x.lift == pytest.approx(rules[tuple(x.tokens)] / base) for x in mined.collect())
    got = {x.url for x in U.matched(rows, mined).collect()}
    assert got == {u for u in urls if any(tokens[u].issuperset(s) for s in want)}


def test_tokens_at_the_end_of_long_urls_are_mined(spark):
    r = random.Random(5)
    path = "/".join(f"w{i}" for i in range(18))  # in all URLs, before what tells
    urls = [f"http://{i}.net/{path}/{r.choice(['x', 'y'])}?{r.choice(['k', 'm'])}=1&z{i}=1" for i in range(120)]
    rows = spark.createDataFrame([(u, "?k=" in u) for u in urls] + [(f"http://c{i}.net/k?a=1", False) for i in range(40)], "url string, block boolean")
    mined = U.mine(rows)
    got = {tuple(x.tokens): x.confidence for x in mined.collect()}
    assert got == {("key:k",): 1.0}
    assert {x.url for x in U.matched(rows, mined).collect()} == {u for u in urls if "?k=" in u}


def test_rules_decide_pages_that_they_were_not_mined_from(spark):
    r = random.Random(11)
    made = []
    for i in range(600):  # a casino path on cheap hosts is toxic, few others are; half of the pages have labels
        bad = i % 5 == 0
        host = f"{r.choice(['win', 'top'])}{i}.{'xyz' if bad or r.random() < 0.2 else r.choice(['com', 'edu', 'info'])}"
        path = r.choice(["casino/play", "casino/slots"]) if bad or r.random() < 0.03 else r.choice(["wiki/a", "news/b", "shop"])
        made.append((i, f"https://{host}/{path}?id={i}", bad or r.random() < 0.02))
    made += [made[5], (None, made[5][1], True), (700, None, False)]
    pages = spark.createDataFrame(made, "page_id long, url string, toxic boolean")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, _, b in made if i is not None and i % 2] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = U.digest(pages, labels).collect()
    assert len(got) == len(made)
    toxic = {i: b for i, _, b in made}
    held = [(x.verdict == "block", toxic[x.page_id]) for x in got if x.page_id is not None and not x.page_id % 2]
    blocked = [t for v, t in held if v]
    assert len(blocked) > 40 and sum(blocked) / len(blocked) >= 0.9 and sum(v for v, t in held if t) / sum(t for _, t in held) >= 0.8
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", [(i, u) for i, u, _ in made])
    con.execute("create table labels(doc_id bigint, toxic int)")
    con.executemany("insert into labels values (?, ?)", [(x.doc_id, x.toxic) for x in labels.collect()])
    assert sorted(map(repr, con.execute(f"select page_id, host, path, rule, verdict from ({U.ORACLE})").fetchall())) == sorted(repr(tuple(x)) for x in got)
