"""URL verdicts against their SQL, with redirects and canonical links."""

import duckdb
from oracle_check import compare, duck

from tillbook.llm import url_alias
from tillbook.llm.oracle import OP10
from tillbook.llm.queries import QUERIES

PAGES = [
    (1, "http://blog.a.net/x", ""), (2, "https://EXAMPLE.net/en/1#top", None), (3, "http://example.com/de/2?q=1", "<html>"),
    (4, "http://one.com/a", '<link rel="canonical" href="http://blocked.net/p">'),  # alias of a blocked URL
    (5, "http://two.com/b", "<META http-equiv='refresh' content='0; url=http://one.com/a'>"),  # two hops
    (6, "http://three.com/c/d", '<link href="/e" rel=canonical>'), (7, "https://three.com/e", "<link rel=canonical href=//other.net/z?a=1&amp;b=2>"),
    (8, "http://four.com/a", '<link rel="canonical" href="http://f.org/fr/ok"><meta http-equiv="refresh" content="5;url=http://bad.net/q">'),  # allowed alias
    (9, "http://five.com", '<link rel="canonical" href="x.html">'), (10, "http://five.com/x.html", "<link rel='canonical' href='?p=2'>"),
    (11, None, None), (12, "no scheme.net/a", '<link rel="canonical" href="http://bad.net/">'), (13, "", ""), (14, "http://", ""),
    (15, "HTTP://A.NET", ""), (16, "http://xnet/", ""), (17, "http://net/", ""), (18, "http://u.com/é?x", '<link rel="stylesheet" href="http://bad.net/">'),
    (5, "http://two.com/b", "<META http-equiv='refresh' content='0; url=http://one.com/a'>"), (None, "http://loop.com/", '<link rel=canonical href="http://loop.com/">'),
    (19, "http://f.org/fr/ok", ""), (20, "http://s.com/1", '<link rel="canonical" href="http://one.com/a#frag">'),
]


def run_both(spark, write_tables, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS host", "'c' AS node", "'c' AS rule", "'c' AS blocked_node")
    d = write_tables(pages=df)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{d}/pages.parquet/*.parquet')")
    return d, compare(spark, con, "op10", QUERIES["op10_url_filters"], OP10, d)


def test_given_tables(spark):
    res = compare(spark, duck("/root/testdata/sf0.01"), "op10", QUERIES["op10_url_filters"], OP10, "/root/testdata/sf0.01")
    assert res["values_match"] and res["spark_rows"] == 250, res


def test_aliases(spark, write_tables):
    d, res = run_both(spark, write_tables, PAGES)
    assert res["values_match"], res
    got = {r.page_id: r for r in QUERIES["op10_url_filters"](spark, d).collect()}
    want = {1: "block", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "block", 7: "block", 8: "allow", 9: "allow", 10: "allow", 11: "allow",
            12: "allow", 14: "allow", 15: "allow", 16: "allow", 17: "block", 18: "allow", 19: "allow", 20: "block"}
    assert {k: got[k].verdict for k in want} == want
    assert (got[2].rule, got[4].rule, got[11].host, got[11].path) == ("example.net/en/", None, "", "")


DOTTED = {
    "../../de/x": "block", "../de/y": "allow", "./../../de/./z": "block", "../../../../de/": "block", "/a/../de/": "block", "/de/../a": "allow",
    "../../d&#101;/x": "block", "..&#47;..&#x2F;de&sol;": "allow", "&#46;&#46;/../de/?a&#38;b": "block", "http://example.com/q/../de/n": "block",
    "//example.com/./de/n#.": "block", "?x=/../de/": "allow", "../../de/..": "allow", "../../de/.": "block", "&amp;#47;de/": "allow", "/de&#0;/": "allow",
    "../../%64e/": "allow", "/&#1114112;": "allow", "/d&#xe9;/": "allow",
}


def test_dot_segments_and_character_references(spark, write_tables):
    rows = [(i, f"http://x.example.com/a/b/page{i}", f'<link rel="canonical" href="{link}">') for i, link in enumerate(DOTTED)]
    d, res = run_both(spark, write_tables, rows)
    assert res["values_match"], res
    got = {r.page_id: r.verdict for r in QUERIES["op10_url_filters"](spark, d).collect()}
    assert {link: got[i] for i, link in enumerate(DOTTED)} == DOTTED


def test_unescape(spark):
    texts = {"&amp;amp;": "&amp;", "&#38;amp;": "&amp;", "&amp;#47;": "&#47;", "a&#x41;&#x1F600;&#233;": "aA\U0001F600é", "&#xD800;&#0;&#9999999;": "&#xD800;&#0;&#9999999;",
             "&lt;&gt;&quot;&apos; ": "<>\"'", "&#065;": "A"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.u for r in df.select("t", url_alias.unescape(df.t).alias("u")).collect()} == texts


def test_long_chain_and_empty(spark, write_tables):
    chain = [(i, f"http://c{i}.com/", f'<link rel="canonical" href="http://c{i + 1}.com/">') for i in range(60)] + [(99, "http://c60.com/", '<link rel="canonical" href="http://x.net/">')]
    d, res = run_both(spark, write_tables, chain)
    assert res["values_match"], res
    assert {r.verdict for r in QUERIES["op10_url_filters"](spark, d).collect()} == {"block"}
    assert run_both(spark, write_tables, [])[1]["spark_rows"] == 0


def test_redirect_table(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", None), (2, "http://b.com/", None)], "page_id long, url string, html string")
    hops = spark.createDataFrame([("http://a.com/", "http://x.net/1"), (None, "http://b.com/")], "`from` string, `to` string")
    assert {r.page_id: r.verdict for r in url_alias.judge(pages, redirects=hops).collect()} == {1: "block", 2: "allow"}
