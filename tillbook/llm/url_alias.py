"""URL filters with redirect equivalence.

Pages are judged by host and path rules. Redirects (meta refresh) and
canonical links make URLs aliases of each other; connected components over
these edges carry block decisions to the aliases that no rule judges, unless
a rule explicitly allows one of them.

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import Stage, ascii_lower, components


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Production rules.
RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``, or an empty string."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule] = RULES) -> Column:
    """The longest fitting rule as struct(size, verdict, name), or null. Of two
    rules with the same host and path, ``allow`` wins."""
    table = sorted(rules, key=lambda r: (-len(r.name), r.verdict, r.name))
    out = F.lit(None).cast("struct<verdict:string,name:string>")
    for r in reversed(table):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.name).alias("name"))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """Identity of a URL among aliases: host, path and query; neither scheme nor fragment."""
    rest = F.regexp_extract(_after_scheme(url), "^[^/?#]*([^#]*)", 1)
    return F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest))


def unescape(c: Column) -> Column:
    """A trimmed attribute value with its character references decoded: those
    by number, then the named ones of mark-up characters, with ``&`` in one
    last pass, so that nothing is decoded twice."""
    numbers = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});"), F.lit(0)))

    def decode(text: Column, ref: Column) -> Column:
        hexed = ref.rlike("^&#[xX]")
        digits = F.regexp_extract(ref, r"^&#[xX]?([0-9A-Fa-f]+);", 1)
        code = F.when(hexed, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF) & (code != 38)
        return F.when(known, F.replace(text, ref, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))).otherwise(text)

    c = F.aggregate(numbers, F.trim(c), decode)
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return F.regexp_replace(c, "&(?:amp|#0*38|#[xX]0*26);", "&")


def without_dots(path: Column) -> Column:
    """A path from ``/`` on with its ``.`` and ``..`` segments resolved."""
    parts = F.split(F.substring(path, 2, 2**30), "/")
    up = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"),
                       lambda kept, x: F.when(x == "..", up(kept)).when(x == ".", kept).otherwise(F.concat(kept, F.array(x))))
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    solved = F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), solved).otherwise(path)


def resolve(base: Column, link: Column) -> Column:
    """``link`` as an absolute URL, seen from the page at ``base``, without dot segments."""
    scheme = F.regexp_extract(base, "^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(_after_scheme(base), "^[^/?#]*", 0))
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    whole = (F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
             .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
             .when(link.startswith("/"), F.concat(root, link))
             .when(link.startswith("?") | link.startswith("#"), F.concat(root, path_of(base), link))
             .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link)))
    cut = lambda group: F.regexp_extract(whole, "^(.*?://[^/?#]*)(/[^?#]*)?(.*)$", group)
    return F.concat(cut(1), F.when(cut(2) == "", F.lit("")).otherwise(without_dots(cut(2))), cut(3))


def alias_links(html: Column) -> Column:
    """Array of the targets of canonical links and meta refreshes in ``html``."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<(?:link|meta)\s[^>]*>"), F.lit(0))
    canonical = F.filter(tags, lambda t: t.rlike(r"(?i)^<link\s") & t.rlike(r"(?i)\srel\s*=\s*[\"']?\s*canonical[\"'\s>/]"))
    refresh = F.filter(tags, lambda t: t.rlike(r"(?i)^<meta\s") & t.rlike(r"(?i)\shttp-equiv\s*=\s*[\"']?\s*refresh[\"'\s>/]"))
    href = F.transform(canonical, lambda t: F.regexp_extract(t, r"(?i)\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0))
    href = F.transform(href, lambda t: F.regexp_replace(t, r"(?i)^\s*href\s*=\s*[\"']?|[\"']$", ""))
    target = F.transform(refresh, lambda t: F.regexp_extract(t, r"(?i)[;,]\s*url\s*=\s*'?([^\"'>]*)", 1))
    return F.filter(F.transform(F.concat(href, target), unescape), lambda x: x != "")


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(a_url, b_url): pages and the URLs that their canonical links and
    redirects name, plus the rows (from, to) of a table of ``redirects``."""
    u = F.col(f"`{url}`")
    found = pages.select(u.alias("a_url"), F.explode(alias_links(F.col(f"`{html}`"))).alias("link"))
    found = found.filter(F.locate("://", "a_url") > 0).select("a_url", resolve(F.col("a_url"), F.col("link")).alias("b_url"))
    if redirects is not None:
        found = found.unionByName(redirects.select(F.col("from").alias("a_url"), F.col("to").alias("b_url")))
    return found.filter(F.col("a_url").isNotNull() & F.col("b_url").isNotNull())


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
          rules: Sequence[UrlRule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict.

    A page's own rule decides. A page without one is blocked if a rule blocks
    any URL of its component and no rule allows one there; else it is
    allowed. Null URLs and those without ``://`` have empty host and path and
    no aliases. Repeated rows are judged alike; an empty table gives no rows.
    Only URLs enter a shuffle, never the html.
    """
    stage = Stage(pages.sparkSession)
    edges = stage.write(alias_edges(pages, url, html, redirects).distinct())
    ends = edges.select(F.col("a_url").alias("u")).unionByName(edges.select(F.col("b_url").alias("u")))
    judged = ends.select(node_of(F.col("u")).alias("node"), rule_of(host_of(F.col("u")), path_of(F.col("u")), rules)["verdict"].alias("v")).distinct()
    roots = components(stage, edges.select(node_of(F.col("a_url")).alias("a"), node_of(F.col("b_url")).alias("b")))
    grouped = judged.join(roots, "node").groupBy("root").agg(
        F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
    spread = grouped.filter(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False)))
    blocked = stage.write(roots.join(spread, "root", "left_semi").select(F.col("node").alias("blocked_node")))

    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), node_of(u).alias("node"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    # no hint: the planner knows the size of the written table of blocked aliases
    rows = rows.join(blocked, F.col("node") == F.col("blocked_node"), "left")
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("blocked_node").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", F.col("found.name").alias("rule"), verdict.alias("verdict"))
