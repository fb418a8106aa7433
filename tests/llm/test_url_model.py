import re

from wattline.llm.url_model import LABELLED, RULES, judge_urls, op10_url_model, score, split_url, train


def plain_split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]) if m else ("", "")


def plain_rule(host, path):
    fits = []
    for rule, allow in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, allow))
    return max(fits)[1:] if fits else None


ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com", "https://a.example.com?x=/en/", "https://www.example.com/en/", "http://xcom/", "http://a.net/es/1", "http://NET/fr/", "x://y://z/p#f", "https://ÀB.com/é", "http://example.com/en"]


def test_split_and_rules(spark):
    df = spark.createDataFrame([(u, "c") for u in ODD], "url string, host string")
    for r in df.select("url", judge_urls().alias("u")).collect():
        host, path = plain_split(r.url)
        rule = plain_rule(host, path)
        assert (r.u.host, r.u.path, r.u.rule) == (host, path, rule and rule[0])
        if rule:
            assert r.u.verdict == ("allow" if rule[1] else "block")
    assert df.limit(0).select(judge_urls()).collect() == [] and split_url(None) == ("", "")


def test_held_out_accuracy():
    right = 0
    for k in range(6):
        model = train([x for j, x in enumerate(LABELLED) if j % 6 != k])
        right += sum((score(model, *split_url(u)) >= 0.5) == bool(y) for j, (u, y) in enumerate(LABELLED) if j % 6 == k)
    assert right / len(LABELLED) > 0.7
    model = train()
    assert all((score(model, *split_url(u)) >= 0.5) == bool(y) for u, y in LABELLED)
    assert train([])[1] == 0.0


def test_query(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op10_url_model(spark, sf_dir).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = plain_split(urls[r.page_id])
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0]) and r.verdict in ("allow", "block")


def test_rules_of_long_hosts_are_linear_and_right():
    import time

    from wattline.llm.url_model import compile_rules, match_rule

    rules = (("com/", True), ("b.com/", False), ("a.b.com/x/", True), ("bb.com/", True))

    def plain(host, path):
        fits = [(r, allow) for r, allow in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        return max(fits, key=lambda x: len(x[0]), default=None)

    by_host = compile_rules(rules)
    for host in ("com", "b.com", "a.b.com", "x.a.b.com", "xa.b.com", "bb.com", "abb.com", ".com", "b..com", "", "net", "com.b", "a.a.a.a.a.b.com"):
        for path in ("", "/", "/x/", "/x/y"):
            assert match_rule(by_host, host, path) == plain(host, path), (host, path)
    assert match_rule(compile_rules(()), "a.com", "/") is None
    start = time.time()
    assert match_rule(by_host, "a." * 500_000 + "b.com", "/")[0] == "b.com/" and time.time() - start < 1
