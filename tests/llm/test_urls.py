import random

from tensorloom.llm import urls


def brute(url, rules=urls.RULES, model=None):
    weights, bias = model or urls.fitted()
    url = url or ""
    at = url.find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    stop = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:stop])
    path = rest[stop:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    framed = [ord(c) for c in f"^{host}{path}$"]
    margin = bias + sum(weights[(a * 961 + b * 31 + c) % urls.BUCKETS] for a, b, c in zip(framed, framed[1:], framed[2:]))
    if fit:
        _, rule, verdict = max(fit)
        return host, path, rule, verdict, margin
    return host, path, None, "block" if margin > 0 else "allow", margin


URLS = [
    None, "", "no scheme", "http://", "http:///", "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://sub.example.com/en/q", "http://www.example.com/en/a",
    "http://x.www.example.com/en/a", "http://notexample.com/en/a", "http://net/es/", "http://a.net/es/1", "http://a.net/es", "http://a.net/ES/1", "http://a.net:80/es/1", "http://u@net/fr/", "http://a.net/fr/?q", "http://a.net?x=/es/",
    "http://a.net#/es/", "a://b://c/d", "://casino.biz/play", "http://ÄÖ.com/ü", "http://a.com\n.net/es/\n", "http://😀.biz/😀?x", "http://\u0130I.net/es/", "mailto:x", "http://casino.bonus-win.biz/play", "  http://a.com/ ", "http://.com/", "http://com/", "http://acom/",
]


def test_against_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    bits = ["http://", "https://", "www.", "example.com", ".net", ".com", ".biz", "/en/", "/es/", "/fr/", "?", "#", "/", "a", "É", "😀", ":", "X", " ", "\t"]
    made = URLS + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(12))) for _ in range(500)] + URLS[5:9]
    rows = [(i, u, "x", "clash", i) for i, u in enumerate(made)] + [(None, "http://a.net/fr/", None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, host string, margin long").write.parquet(str(tmp_path / "pages.parquet"))
    out = urls.query(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    want = {i: brute(u) for i, u, *_ in rows}
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict, r.margin) == want[r.page_id], made[r.page_id]


def test_rules_of_equal_length_do_not_depend_on_their_order(spark):
    rules = [("b", "/x/", "allow"), ("a.b", "/", "block"), ("c", "/", "block")]
    df = spark.createDataFrame([(u,) for u in ("http://a.b/x/1", "http://b/x/1", "http://q.b/x/", "http://c", "http://c/")], "url string")
    model = [0] * urls.BUCKETS, 1
    for use in (rules, rules[::-1]):
        out = [(r.url_rule, r.url_verdict) for r in urls.judged(df, use, model).collect()]
        assert out == [("a.b/", "block"), ("b/x/", "allow"), ("b/x/", "allow"), (None, "block"), ("c/", "block")]


def test_very_long_urls_and_an_empty_table(spark, tmp_path):
    long = "http://host.biz/" + "free-casino/" * 40_000
    df = spark.createDataFrame([(1, long), (2, "http://" + "a" * 300_000)], "page_id long, url string")
    model = urls.fitted()
    assert [(r.url_verdict, r.url_margin) for r in urls.judged(df).orderBy("page_id").collect()] == [brute(u, model=model)[3:] for u in (long, "http://" + "a" * 300_000)]
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert urls.query(spark, str(tmp_path)).count() == 0


def test_plan_has_no_python_exchange_or_join(spark, sf):
    plan = urls.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange", "Join"))


def test_the_fitted_rows_are_judged_as_labelled():
    weights, bias = urls.fitted()
    for text, label in urls.LABELLED:
        assert (bias + sum(weights[g] for g in urls._buckets(text)) > 0) == bool(label), text
