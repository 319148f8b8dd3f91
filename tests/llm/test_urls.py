import random

from tests.llm.helpers import SF, agrees, odd_columns
from votecount.llm import urls


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_agrees_with_sql(spark):
    agrees(urls.judge(spark.read.parquet(f"{SF}/pages.parquet"), urls.rule_table(spark)), urls.SQL)


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([i for i, c in enumerate(path) if c in "?#"], default=len(path))]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if not fit:
        return host, path, None, "allow"
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"))
    return host, path, best[0] + best[1], best[2]


def test_precedence_and_odd_urls(spark):
    rules = [("net", "/", "block"), ("a.net", "/x/", "allow"), ("a.net", "/x/secret", "block"),
             ("b.a.net", "/x/", "block"), ("org", "/fr", "allow"), ("ORG", "/fr", "allow")]
    rnd = random.Random(3)
    hosts = ["a.net", "b.a.net", "c.b.A.net", "xa.net", "net", "org", "é.org", "", "a..net", "a.net.", "x." * 300 + "net"]
    paths = ["", "/", "/x", "/x/", "/x/secret", "/x/secrets/1", "/fr", "/french/", "//x/", "/x/?q", "#/x/", "/é/x/" * 900]
    made = [f"http://{rnd.choice(hosts)}{rnd.choice(paths)}" for _ in range(150)]
    made += [None, "", "no scheme", "://", "http://a.net?x=http://b.org/fr", "http://a.net/x/://", "a://b\n.net/\n"]
    got = urls.judge(pages(spark, [(i, u, "") for i, u in enumerate(made)]), urls.rule_table(spark, rules)).collect()
    lower = [(h.lower(), p, v) for h, p, v in rules]
    assert len(got) == len(made)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(made[r.page_id], lower), made[r.page_id]


def test_repeats_nulls_and_empty_tables(spark):
    df = pages(spark, [(1, "http://x.net/", ""), (1, "http://x.net/", ""), (None, None, None), (None, None, None)])
    df = odd_columns(df, "host", "path", "rule", "_full")
    got = urls.judge(df, urls.rule_table(spark))
    assert sorted((r.page_id or 0, r.verdict) for r in got.collect()) == [(0, "allow")] * 2 + [(1, "block")] * 2
    assert urls.judge(df.where("page_id = 7"), urls.rule_table(spark)).count() == 0
    none = urls.rule_table(spark).where("host = ''")
    assert {r.verdict for r in urls.judge(df, none).collect()} == {"allow"}
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_rules_too_long_are_refused(spark):
    rules = urls.rule_table(spark, [("a" * 300, "/", "block")])
    try:
        urls.judge(pages(spark, [(1, "http://x/", "")]), rules).collect()
    except Exception as e:
        assert "a rule needs" in str(e)
    else:
        raise AssertionError("accepted")
