import re
from itertools import combinations
from math import log

from pyspark.sql import functions as F

from llm import urls as u


def plain(url):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = low(host)
    fits = [(len(h + p), h + p, k) for k, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_and_verdicts(spark):
    urls = ["http://a.example.net/en/1", "http://A.Example.NET/de/1?x=/en/", "https://example.com/de/2#t", "http://b.org/fr/1", "http://org/fr/",
            "http://net", "http://net/", "http://xnet/", "http://cheappills.example.org/en/1", "http://good.example.org/en/1", None, "", "no scheme/net/",
            "http://?q", "://h/p://q", "HTTP://ÄB.example.com/Pfad\nX/de/", "http://casino-win.example.com/en/3", "http://" + "long" * 3000 + ".com/" + "x" * 9000]
    rows = [(i, x, "<p>good words of this page and long ones</p>" * 50, "x") for i, x in enumerate(urls)]
    rows += [(i + 100, f"http://good{i % 7}.example.org/en/{i}", None, "x") for i in range(60)] + [(1, urls[1], None, "x"), (None, "http://x.net/", "", "x")]
    got = u.judged(spark.createDataFrame(rows, "page_id long, url string, html string, tokens string")).collect()
    want = {r[0]: plain(r[1]) for r in rows}
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score > 0 else "allow"))


def test_learns_from_the_pages_that_rules_decide(spark):
    html = "<p>cheap pills casino good words of science and a very long word pneumonoultramicroscopicsilicovolcanoconiosis</p>"
    rows = [(i, f"http://cheappills{i % 9}.net/x/{i}", html) for i in range(60)] + [(i, f"http://goodwords{i % 9}.org/fr/{i}", html) for i in range(60, 120)]
    rows += [(200, "http://pillscheap.com/a", html), (201, "http://wordsscience.com/a", html), (202, "http://good.example.org/en/", html)]
    got = {r.page_id: r for r in u.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[200].rule, got[200].verdict, got[201].verdict, got[202].verdict) == (None, "block", "allow", "allow")
    held_out = u.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), learn=~F.col("host").rlike("[012]\\.")).where("rule is not null").collect()
    assert all((r.score > 0) == (r.verdict == "block") for r in held_out)


def test_long_words_are_known(spark):
    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    pages = spark.createDataFrame([(1, None, f"<p>{long} cheap {long[:30]} and more</p>" * 60)], "page_id long, url string, html string")
    hosts = spark.createDataFrame([(f"cheap{long}.com",), (f"{'z' * 50}.{long}cheap.com",), ("q" * 12_000 + ".com",)], "host string")
    got = {r.host: r.tokens for r in u.segments(hosts, pages).collect()}
    assert sorted(got.values(), key=len) == sorted([["cheap", long], ["z" * 50, long, "cheap"], ["q" * 12_000]], key=len)


def test_segmentation_is_the_best_split():
    counts = {"cheap": 50, "pills": 40, "chea": 1, "ppills": 2, "a": 9, "he": 7, "pill": 30, "s": 5}
    total = sum(counts.values())
    cost = lambda w: log(counts[w] / total) if w in counts else log(10 / total) - len(w) * log(10)
    for label in ("cheappills", "pillspill", "xyz", "ahex", ""):
        splits = [[label[a:b] for a, b in zip((0, *c), (*c, len(label)))] for k in range(max(1, len(label))) for c in combinations(range(1, len(label)), k)]
        best = max(sum(map(cost, s)) for s in splits if label) if label else 0
        assert abs(sum(map(cost, u.segment(label, counts, total))) - best) < 1e-9 and "".join(u.segment(label, counts, total)) == label


def test_naive_bayes_by_hand():
    a = u.ALPHA
    prior, weight = u.naive_bayes([(0, True, 3), (1, False, 5)], {True: 1, False: 3})
    assert abs(prior - log(2 / 4)) < 1e-12
    assert abs(weight[0] - (log((3 + a) / (a * u.BUCKETS + 3)) - log(a / (a * u.BUCKETS + 5)))) < 1e-9


def test_empty(spark):
    assert u.judged(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_every_token_has_its_own_weight(spark):
    path = lambda i: "/".join(f"w{i}x{k}" for k in range(450)) + f"/{i % 3}/Пример/q"
    rows = [(i, f"http://h.{'net' if i % 4 == 0 else 'org'}/{'' if i % 4 == 0 else 'fr/'}{path(i)}", "") for i in range(40)]
    tokens = {i: ["h", *url.lower().split("/")[3:]] for i, url, _ in rows}
    distinct = {t for x in tokens.values() for t in x}
    assert len(distinct) > u.BUCKETS
    counts = [(t, i % 4 == 0, 1) for i, x in tokens.items() for t in x]
    prior, weight = u.naive_bayes(counts, {True: 10, False: 30}, len(distinct))
    for r in u.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert abs(r.score - prior - sum(weight[t] for t in tokens[r.page_id])) < 1e-6
