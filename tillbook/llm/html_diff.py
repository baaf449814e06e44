"""HTML extraction with nearest-URL page differencing.

A page is read once into text lines (blocks), menus, headers, footers and other
boxes included; only the head, scripts, styles and the like hold no lines.
Within a host, pages are ordered by URL path; a page is paired with the
neighbour of the longest common path, the lines of both are aligned by a
longest common subsequence, and the shared lines are deleted, for they come
from the site's template. What differencing left is then judged by rules:
lines of boxes whose element, class, id or role says that they are a menu, a
header, a footer, a sidebar, a notice, an advert, a form or reader comments go.

Shared lines inside an article element are quotations or repeated headings and
stay, unless a box around them has a doubtful name (a word of such a box in
it, but not as the word that says what the box is): then the name and
the neighbour vote together, and the line goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from html import unescape
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import Stage, running_totals
from tillbook.llm.url_alias import host_of, path_of

# HTML element names by their role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg textarea title".split())
DROPPED = frozenset("head nav header footer aside form button select dialog menu".split())
SELF_CLOSING = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
                "td": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}
# Words of class and id names that mark what isn't the article.
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb "
                        "breadcrumbs sidebar aside footer header masthead notice notices cookie cookies consent gdpr popup modal alert comment comments "
                        "disqus respond share sharing social related newsletter subscribe subscription widget".split())
# Words that beside those above only say which part or place of a box it is.
PLACES = frozenset("site page main top bottom left right container wrapper wrap box bar list area slot inner outer item items content body links buttons "
                   "posts articles title".split())
# Those of them that say what a box is whatever words stand before ("post-comments"); a header or banner may hold the heading.
HEADS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer "
                  "notice notices cookie cookies consent gdpr popup modal comment comments disqus social related newsletter subscribe "
                  "subscription".split())
# Words that, standing last, leave it to the word before what the box is ("related-stories", "comment-form").
CARRIERS = PLACES | frozenset("section panel block group row column form signup thread count leaderboard skyscraper rectangle unit media icons stories news "
                              "policy settings toggle".split())
# Words before a box's name that tell the state of what holds it ("has-sidebar").
STATES = frozenset("has with no without is show hide hidden open closed toggle js".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())
# Headings and text blocks; their ids are anchors, often made from the heading's words.
TEXT_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th blockquote pre figure figcaption".split())
ROOTS = frozenset(["html", "body", "article", "main"])

#: Pages, and bytes of html, that a task turns into Python objects at a time.
SLICE_PAGES, SLICE_BYTES = 500, 16 << 20

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|</?[a-zA-Z](?:[^'">]|"[^"]*"|'[^']*')*+>|<[/!?a-zA-Z][^>]*(?:>|\Z)|[^<]+|<""", re.S)
RAW_END = {name: re.compile(rf"</{name}(?![a-z0-9])", re.I) for name in RAW}
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARK = re.compile(r"""\s(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Line(NamedTuple):
    """A block with text: references decoded, white space runs as one space."""

    text: str
    inside: bool  # an article or main element
    boxed: bool  # in a box that the rules leave out
    doubtful: bool  # in a box of a doubtful name


KEEP, DOUBTFUL, LEAVE_OUT = range(3)


@lru_cache(maxsize=20_000)
def _judge_name(word: str, box: bool, whole: bool) -> int:
    """What a class or id name says. It leaves an element out if every part
    marks what isn't the article or, for a ``box``, is a number or the
    word of a place; for a box also if its head word does: the last part that is no
    carrier, number or (after "--") modifier. A box that only has such a word
    in it is doubtful. ``whole`` names are anchors, judged as a whole."""
    parts = [x.lower() for x in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", word.split("--")[0]) if x]
    rest = [x for x in parts if x not in BOILERPLATE]
    if len(rest) == len(parts):
        return KEEP
    if not rest or box and not whole and all(x in PLACES or x[0].isdigit() for x in rest):
        return LEAVE_OUT
    if not box or whole or STATES.intersection(parts):
        return KEEP
    while parts[-1] not in HEADS and (parts[-1] in CARRIERS or parts[-1][0].isdigit()):
        parts.pop()
    return LEAVE_OUT if parts[-1] in HEADS else DOUBTFUL


def _judge(name: str, tag: str) -> int:
    """What the name of an element and its class, id and role say of it."""
    if name in DROPPED:
        return LEAVE_OUT
    if name in ROOTS:
        return KEEP
    box = name not in TEXT_BLOCKS and name not in INLINE
    found = KEEP
    for key, *values in MARK.findall(tag):
        key = key.lower()
        if key == "id" and not box:
            continue
        for word in "".join(values).split():
            if key == "role":
                if word.lower() in BOILERPLATE_ROLES:
                    return LEAVE_OUT
            else:
                found = max(found, _judge_name(word, box, key == "id" and name == "section"))
                if found == LEAVE_OUT:
                    return found
    return found


def blocks(html: str) -> list[tuple[str, bool]]:
    """(text, inside an article or main element) of the lines that the rules keep."""
    return [(x.text, x.inside) for x in page_blocks(html) if not x.boxed]


def page_blocks(html: str) -> list[Line]:
    """Every block with text in page order, those of left-out boxes included.
    Only the head and raw elements (scripts, styles, ...) hold none."""
    found: list[Line] = []
    held: list[str] = []
    boxed: list[str] = []  # text of the element that is left out
    article = 0
    skipping, depth = "", 0  # the element that is left out, and how many of its name are open
    within: dict[str, int] = {}  # how many others are open in it, by name
    stack: list[tuple[str, bool]] = []  # open blocks around it, and whether their names are doubtful
    opened: dict[str, int] = {}  # how many of them, by name
    doubts = 0  # how many of them are doubtful

    def leave() -> None:
        nonlocal doubts
        last, doubtful = stack.pop()
        opened[last] -= 1
        doubts -= doubtful

    def put(parts: list[str], left_out: bool) -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                found.append(Line(text, article > 0, left_out, doubts > 0))
            parts.clear()

    def flush() -> None:
        put(boxed, True)
        put(held, False)

    at = 0
    while m := TOKEN.match(html, at):
        tag, at = m.group(), m.end()
        if tag[0] != "<" or len(tag) == 1:
            if skipping != "head":
                (boxed if skipping else held).append(tag)
            continue
        if tag[1] in "!?":
            continue
        name = NAME.match(tag)
        if not name:
            if skipping != "head":
                (boxed if skipping else held).append(tag)  # "</3" and the like are text
            continue
        name, closing = name.group(1).lower(), tag[1] == "/"
        if name in RAW:
            if not closing and not tag.endswith("/>"):
                end = RAW_END[name].search(html, at)  # no markup is read before the end tag
                at = end.start() if end else len(html)
            continue
        if skipping:
            if name == "br":
                boxed.append(" ")
            elif name not in INLINE:
                put(boxed, True)
            ends = False  # whether this tag ends it from outside, and is looked at below
            if closing:
                if name == skipping:
                    depth -= 1
                    if depth == 0:
                        put(boxed, True)
                        skipping = ""
                elif within.get(name):
                    within[name] -= 1
                else:  # an enclosing element ends
                    ends = (opened.get(name, 0) > 0 or skipping == "p" and name not in INLINE or skipping in SELF_CLOSING
                            and name in ("ul", "ol", "dl", "table", "tbody", "div", "section", "article", "body"))
            elif name in SELF_CLOSING.get(skipping, ()) or skipping == "p" and name not in INLINE and name not in VOID:
                ends = True  # the next item
            elif skipping == "nav" and name in ("article", "main") or skipping == "div" and name == "main":
                ends = True  # an unclosed menu, or a box around the whole page
            elif name not in VOID and not tag.endswith("/>"):
                if name == skipping:
                    depth += 1
                else:
                    within[name] = within.get(name, 0) + 1
            if not ends:
                continue
            put(boxed, True)
            skipping = ""
        if name == "br":
            held.append(" ")
        elif name in INLINE:
            if not closing and name not in VOID and _judge(name, tag) == LEAVE_OUT:
                skipping, depth, within = name, 1, {}
        else:
            flush()
            verdict = KEEP
            if stack and stack[-1][0] == "p" and not (closing and name == "p"):
                leave()  # a block ends the paragraph
            if name in ("article", "main"):
                article = max(0, article + (-1 if closing else 1))
            elif not closing and name not in VOID and not tag.endswith("/>"):
                verdict = _judge(name, tag)
                if verdict == LEAVE_OUT:
                    skipping, depth, within = name, 1, {}
            if closing:
                if opened.get(name):
                    while stack[-1][0] != name:
                        leave()
                    leave()
            elif not skipping and name not in VOID and not tag.endswith("/>"):
                if stack and stack[-1][0] in SELF_CLOSING.get(name, ()):
                    leave()
                doubtful = verdict == DOUBTFUL and article > 0  # of a box around the article it says nothing
                stack.append((name, doubtful))
                opened[name] = opened.get(name, 0) + 1
                doubts += doubtful
    flush()
    return found


def shared_lines(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Positions of ``a`` in a longest common subsequence with ``b``.

    Rows of the length table are kept as bit vectors (a zero bit where the
    length grows) for every few rows only; the rows between are made again
    while walking back, so memory grows with the square root of the rows.
    """
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    kept = [*range(lo), *range(n, len(a))]
    a, b = a[lo:n], b[lo:m]
    if not a or not b:
        return kept
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    step = isqrt(len(a)) + 1

    def rows(v: int, start: int, stop: int) -> list[int]:
        out = []
        for x in a[start:stop]:
            u = v & where.get(x, 0)
            v = ((v + u) | (v - u)) & full
            out.append(v)
        return out

    saved, v = [full], full
    for start in range(0, len(a), step):
        v = rows(v, start, start + step)[-1]
        saved.append(v)
    i, j, have, block = len(a) - 1, len(b) - 1, -1, []
    while i >= 0 and j >= 0:
        if i // step != have:
            have = i // step
            block = [saved[have], *rows(saved[have], have * step, min(len(a), (have + 1) * step))]
        at = i - have * step
        if block[at + 1] >> j & 1:
            j -= 1
        else:
            if block[at] >> j & 1:  # the length grows here since this row: a match
                kept.append(lo + i)
                j -= 1
            i -= 1
    return sorted(kept)


def _line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parsed_pages(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """One parse of every page: page_id, url, host, path; ``texts``, the lines that
    no rule leaves out; ``kept`` their hashes and ``marks`` whether they are
    protected (inside an article, no doubtful box around); ``lines`` and ``boxed``,
    hashes of all lines and whether a rule leaves them out; ``same``, one key
    for equal host and kept lines, and ``key`` for equal marks as well (128 bits).
    """
    source = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    one = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), host_of(source).alias("host"),
                       path_of(source).alias("path"), F.col(f"`{html}`").alias("html"))
    schema = (f"page_id {pages.schema[page_id].dataType.simpleString()}, url string, host string, path string, texts array<string>, "
              "kept array<long>, marks array<boolean>, lines array<long>, boxed array<boolean>, same binary, key binary")

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, kept, marks, lines, boxed, same, keys = [], [], [], [], [], [], []
        for host, html in zip(part.column(2).to_pylist(), part.column(4).to_pylist()):
            found = page_blocks(html or "")
            stay = [x for x in found if not x.boxed]
            texts.append([x.text for x in stay])
            kept.append([_line_hash(x.text) for x in stay])
            marks.append([x.inside and not x.doubtful for x in stay])
            lines.append([_line_hash(x.text) for x in found])
            boxed.append([x.boxed for x in found])
            same.append(xxhash.xxh3_128_digest(f"{host} {kept[-1]}"))
            keys.append(xxhash.xxh3_128_digest(f"{host} {kept[-1]} {marks[-1]}"))
        return pa.RecordBatch.from_arrays(
            [*part.columns[:4], pa.array(texts, pa.list_(pa.string())), pa.array(kept, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.bool_())),
             pa.array(lines, pa.list_(pa.int64())), pa.array(boxed, pa.list_(pa.bool_())), pa.array(same, pa.binary()), pa.array(keys, pa.binary())],
            names=["page_id", "url", "host", "path", "texts", "kept", "marks", "lines", "boxed", "same", "key"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.compute.binary_length(b.column(4)).fill_null(0).to_pylist()
            lo = held = 0
            for i, size in enumerate(sizes):  # a slice ends at 500 pages or where very long ones fill it
                if i > lo and (i - lo >= SLICE_PAGES or held + size > SLICE_BYTES):
                    yield rows(b.slice(lo, i - lo))
                    lo, held = i, 0
                held += size
            if lo < b.num_rows:
                yield rows(b.slice(lo))

    return one.mapInArrow(run, schema)


def template_lines(stage: Stage, parsed: DataFrame) -> DataFrame:
    """(key, shared, boxes): for pages of ``parsed_pages`` with that key, the
    positions among the kept lines of those that the nearest page of the host
    shares and nothing protects, and the hashes of shared lines in left-out boxes.

    Pages of a host with the same kept lines are copies; the first of them in
    URL order stands for all, so a page is never paired with its own copy and
    all copies lose the same lines. Neighbours come from a distributed sort by
    host and path, so a hot host spans partitions. All lines of the two pages
    are aligned, left-out boxes included. A page whose kept lines all stand in
    one neighbour is compared with the other, or keeps them.
    """
    found = parsed.filter(F.size("kept") > 0)
    # combined on the map side, so a large group of copies doesn't meet in one task; marks differ between copies only by their markup
    distinct = found.groupBy("same").agg(F.min(F.struct("host", "path", "url", "lines", "boxed")).alias("first"),
                                         F.collect_set(F.struct("key", "marks")).alias("variants"))
    distinct = distinct.select("same", "first.*", "variants")
    order = [F.col("host"), F.col("path"), F.col("url"), F.col("same")]
    ranked = running_totals(stage, distinct, order, {}, index="rank")

    def beside(step: int, name: str) -> DataFrame:
        return ranked.select((F.col("rank") - step).alias("rank"), F.col("host").alias(f"{name}_host"),
                             F.struct("path", "lines").alias(name))

    paired = ranked.join(beside(-1, "before"), "rank", "left").join(beside(1, "after"), "rank", "left")
    paired = paired.select("path", "lines", "boxed", "variants",
                           *[F.when(F.col("host") == F.col(f"{n}_host"), F.col(n)).alias(n) for n in ("before", "after")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, shared, boxes = [], [], []
            for path, lines, boxed, variants, *sides in zip(*[c.to_pylist() for c in b.columns]):
                near = sorted((s for s in sides if s), key=lambda s: -_common(path, s["path"]))  # the page before on a tie
                place, n_kept = [], 0  # a line's position among the kept ones
                for x in boxed:
                    place.append(n_kept)
                    n_kept += not x
                for s in near:
                    found = shared_lines(lines, s["lines"])
                    inner = [place[i] for i in found if not boxed[i]]
                    if len(inner) < n_kept:
                        outer = list({lines[i] for i in found if boxed[i]})
                        for v in variants:
                            left_out = [i for i in inner if not v["marks"][i]]
                            if left_out or outer:
                                keys.append(v["key"])
                                shared.append(left_out)
                                boxes.append(outer)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shared, pa.list_(pa.int32())), pa.array(boxes, pa.list_(pa.int64()))],
                                             names=["key", "shared", "boxes"])

    return stage.write(paired.mapInArrow(run, "key binary, shared array<int>, boxes array<long>"))


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``main_text`` plus n_shared and n_boxed: the lines that differencing
    deleted, and those that the rules for boxes took from the rest."""
    stage = Stage(pages.sparkSession)
    parsed = stage.write(parsed_pages(pages, page_id, url, html), codec="zstd")  # it holds the corpus' texts
    shared = template_lines(stage, parsed.drop("page_id", "texts")).select(F.col("key").alias("shared_key"), "shared", "boxes")
    # no hint: the planner knows the sizes of the written tables
    joined = parsed.join(shared, F.col("key") == F.col("shared_key"), "left")
    left = F.when(F.coalesce(F.size("shared"), F.lit(0)) < 1, F.col("texts")).otherwise(
        F.filter("texts", lambda x, i: ~F.array_contains("shared", i)))
    n_boxes = F.size(F.filter("lines", lambda x, i: F.get("boxed", i)))
    in_boxes = F.when(F.coalesce(F.size("boxes"), F.lit(0)) < 1, 0).otherwise(
        F.size(F.filter("lines", lambda x, i: F.get("boxed", i) & F.array_contains("boxes", x))))
    n_shared = F.greatest(F.coalesce(F.size("shared"), F.lit(0)), F.lit(0)) + in_boxes
    out = joined.select("page_id", "url", F.array_join(left, "\n\n").alias("text"), n_shared.cast("long").alias("n_shared"),
                        (n_boxes - in_boxes).cast("long").alias("n_boxed"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_boxed")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each page: page_id, url, text, n_chars.

    The text holds the blocks of the page but those that the nearest page of
    its host shares and those of boxes; blocks of an article (or main) element
    stay even if shared, except in a box of a doubtful name. A header element
    is left out inside an article too, with a heading in it; a ``div`` named
    "post-header" is not. Null and empty html give an empty text, null URLs
    have the empty host. Repeated rows get equal texts; an empty table gives
    no rows.
    """
    return extract(pages, page_id, url, html).select("page_id", "url", "text", "n_chars")
