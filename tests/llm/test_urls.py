import random
import re

from kpiforge.llm import queries, urls
from tests.llm.fixtures import SF, python_nodes  # noqa: F401


def brute(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:cut])
    rest = rest[cut:]
    path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_query_against_brute_force(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.QUERIES["op4_url_filter"](spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        host, path, rule, verdict = brute(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


EDGES = ["http://WWW.Example.COM/en/a", "http://example.com/en/", "http://example.com/en", "http://x.net/es/1?q#f", "ftp://a.b.net/fr/", "no scheme", "", None,
         "http://com/", "http://notexample.com/en/x", "http://x.com", "http://x.com?a/b", "a://b://c.com/", "http://\n.com/x", "http://example.com/en/" + "x" * 50_000, "http://é.net/es/"]


def pages(spark, rows, extra=""):
    return spark.createDataFrame(rows, "page_id long, url string, html string, score string, rule string, host string")


def test_edges(spark):
    df = pages(spark, [(i, u, None, "a", "b", "c") for i, u in enumerate(EDGES + EDGES[:2])] + [(None, "http://x.com/", "", None, None, None)])
    got = urls.judge(df).collect()
    assert len(got) == len(EDGES) + 3
    for r in got:
        u = "http://x.com/" if r.page_id is None else (EDGES + EDGES[:2])[r.page_id]
        assert (r.host, r.path, r.rule) == brute(u)[:3]
    assert urls.judge(pages(spark, [])).count() == 0
    assert {r.verdict for r in urls.judge(pages(spark, [(1, None, None, "", "", "")])).collect()} == {"allow"}


def test_trees_learn_lexical_signs(spark):
    """Labelled hosts teach what unlabelled ones are judged by."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("aeioubcdlmnrst") for _ in range(n))
    rows = []
    for i in range(800):
        bad = i % 2
        known = i % 4 < 2
        tld = ("spam" if bad else "good") if known else "org"
        path = "/" + "".join(rng.choice("0123456789") for _ in range(14)) + "/" + word(3) + "?a=1&b=2&c=3" if bad else "/" + word(6) + "/" + word(8) + ".html"
        rows.append((i, f"http://{word(5)}.{tld}{path}", None, "", "", ""))
    rules = [("block", "spam", "/"), ("allow", "good", "/")]
    got = {r.page_id: r for r in urls.judge(pages(spark, rows), rules=rules).collect()}
    rest = [i for i in range(800) if i % 4 >= 2]
    assert sum((got[i].verdict == "block") == bool(i % 2) for i in rest) >= 0.95 * len(rest)
    assert all(got[i].rule is None for i in rest)
