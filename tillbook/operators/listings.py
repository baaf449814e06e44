"""Listings: optional date range, fixed order, page (Q-*-INDEX, *-LIST, parent tree).

Predicates are added only for bounds that are set, so the parquet reader
sees plain comparisons. Pages plan as TakeOrderedAndProject (each task keeps
offset + limit rows); keyset paging (``after_id``) is a pushed-down filter;
a caller with a far offset may ask for ``strategy="positions"`` (a
distributed sort that numbers every id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.functions.nested import date_between, date_text, ordered_collect
from tillbook.ledger import Ledger
from tillbook.params import DateRange, Page, TagFilter
from tillbook.plans.positions import with_positions


def in_range(df: DataFrame, r: DateRange) -> DataFrame:
    return date_between(df, r.start, r.end)


def page_of(df: DataFrame, order: list[Column], page: Page) -> DataFrame:
    """Generic page: ``orderBy(order).offset().limit()`` (top-k, offset+limit rows per task)."""
    return df.orderBy(*order).offset(page.offset).limit(page.limit)


def with_page_positions(df: DataFrame, order: list[Column], page: Page, name: str = "pos") -> DataFrame:
    """Page plus each row's global position (offset + rank within the page of <= 100 rows)."""
    rows = page_of(df, order, page)
    pos = F.lit(page.offset).cast("long") + F.row_number().over(Window.orderBy(*order)) - 1
    return rows.withColumn(name, pos.cast("long"))


def _by_id_page(df: DataFrame, page: Page, strategy: str) -> DataFrame:
    if strategy == "topk":
        return page_of(df, [F.col("id")], page)
    if strategy != "positions":
        raise ValueError(f"unknown strategy {strategy!r}")
    # ids alone are sorted and numbered; the page's rows are read by their ids
    ids = with_positions(df.select("id"), [F.col("id")], "_pos")
    ids = ids.filter(F.col("_pos").between(page.offset, page.offset + page.limit - 1)).select("id")
    return df.join(ids, "id", "left_semi").orderBy("id")


def _index(table: DataFrame, r: DateRange, page: Page, strategy: str, after_id: int | None) -> DataFrame:
    rows = in_range(table, r).select("id", "amount", "date", "description")
    if after_id is not None:  # keyset page: the next `limit` ids after the last one seen
        rows = rows.filter(F.col("id") > F.lit(after_id))
        page = Page(page.limit, 0)
    out = _by_id_page(rows, page, strategy)
    return out.select("id", "amount", date_text("date").alias("date"), "description")


def expense_index(ledger: Ledger, r: DateRange = DateRange(), page: Page = Page(),
                  strategy: str = "topk", after_id: int | None = None) -> DataFrame:
    """Q-EXP-INDEX: id, amount, date text, description; ordered by id."""
    return _index(ledger.expense, r, page, strategy, after_id)


def income_index(ledger: Ledger, r: DateRange = DateRange(), page: Page = Page(),
                 strategy: str = "topk", after_id: int | None = None) -> DataFrame:
    """Q-INC-INDEX: same shape over incomes."""
    return _index(ledger.income, r, page, strategy, after_id)


def _name_order(collation: str | None = None) -> list[Column]:
    # LOWER(name) as in the ledger, or the name under a collation; name then id make ties deterministic
    first = F.lower(F.col("name")) if collation is None else F.collate(F.col("name"), collation)
    return [first, F.col("name"), F.col("id")]


def category_list(ledger: Ledger, page: Page = Page(), collation: str | None = None) -> DataFrame:
    """Q-CAT-LIST: categories (id, name) by lower-case name, paged. Names that
    are ordered under a ``collation`` (as ``UNICODE_CI_AI``: neither case nor
    accents) are sorted by it instead, also in the lists below."""
    return with_page_positions(ledger.category.select("id", "name"), _name_order(collation), page)


def wallet_list(ledger: Ledger, page: Page = Page(), collation: str | None = None) -> DataFrame:
    """Q-WALLET-LIST: wallets (id, name) by lower-case name, paged."""
    return with_page_positions(ledger.wallet.select("id", "name"), _name_order(collation), page)


def tag_list(ledger: Ledger, f: TagFilter = TagFilter(), page: Page = Page(), collation: str | None = None) -> DataFrame:
    """Q-TAG-LIST: tags, optional is_important filter, important first then
    lower-case name, paged."""
    tags = ledger.tag.select("id", "name", "is_important")
    if f.important is not None:
        tags = tags.filter(F.col("is_important") == F.lit(f.important))
    order = [F.when(F.col("is_important"), 0).otherwise(1)] + _name_order(collation)
    return with_page_positions(tags, order, page)


def parent_tree(ledger: Ledger, page: Page = Page()) -> DataFrame:
    """Q-PARENT-TREE: a page of parent categories (by name, case-sensitive)
    each with the array of its categories ordered by lower-case name; a
    parent without categories gets ``[]``. The page is cut first; only its
    parents are joined to their (dimension-bounded) child lists."""
    parents = with_page_positions(ledger.parent_category.select("id", "name"),
                                  [F.col("name"), F.col("id")], page)
    children = ledger.category.groupBy(F.col("parent_category_id").alias("id")).agg(
        ordered_collect(F.struct("id", "name"), F.lower(F.col("name")), F.col("name"), F.col("id"))
        .alias("categories"))
    joined = parents.join(children, "id", "left")
    return joined.select("id", "name", F.coalesce(F.col("categories"), F.array()).alias("categories"), "pos").orderBy("pos")
