"""Listings, paging strategies, enriched views on the hand-made ledger."""

import json

from conftest import D, make_ledger
from pyspark.sql import functions as F
from tillbook.functions.nested import to_json_text
from tillbook.operators import enrich as EN
from tillbook.operators import listings as LS
from tillbook.params import DateRange, Page, TagFilter


def ids(df):
    return [r.id for r in df.collect()]


def test_index_range_and_page(small_ledger):
    got = LS.expense_index(small_ledger, DateRange(D("2024-01-01"), D("2024-01-31")), Page(100, 0))
    assert sorted(ids(got)) == [1, 2]
    assert [r.date for r in got.orderBy("id").collect()] == ["2024-01-05", "2024-01-10"]
    assert sorted(ids(LS.expense_index(small_ledger, DateRange(), Page(2, 3)))) == [4, 5]
    assert ids(LS.expense_index(small_ledger, DateRange(), Page(0, 0))) == []


def test_deep_and_keyset_pages_agree_with_topk(fixture_ledger):
    for off in (0, 7, 500, 1450, 1499, 1600):
        top = sorted(ids(LS.expense_index(fixture_ledger, DateRange(), Page(100, off), strategy="topk")))
        deep = sorted(ids(LS.expense_index(fixture_ledger, DateRange(), Page(100, off), strategy="positions")))
        assert top == deep, off
    after = sorted(ids(LS.expense_index(fixture_ledger, DateRange(), Page(5, 0), after_id=700)))
    assert after == [701, 702, 703, 704, 705]


def test_name_ordered_lists(small_ledger):
    cats = LS.category_list(small_ledger, Page(100, 0)).orderBy("pos").collect()
    assert [c.name for c in cats] == ["fees", "Power", "rent", "snacks", "snacks", "void"]
    assert [c.pos for c in cats] == list(range(6))
    tags = LS.tag_list(small_ledger, TagFilter(), Page(100, 0)).orderBy("pos").collect()
    assert [(t.id, t.is_important) for t in tags] == [(4, True), (1, True), (3, True), (2, False)]
    only = LS.tag_list(small_ledger, TagFilter(False), Page(100, 0)).collect()
    assert [t.id for t in only] == [2]
    wallets = LS.wallet_list(small_ledger, Page(2, 1)).orderBy("pos").collect()
    assert [(w.id, w.pos) for w in wallets] == [(3, 1), (1, 2)]


def test_parent_tree(small_ledger):
    rows = LS.parent_tree(small_ledger, Page(100, 0)).orderBy("pos").collect()
    assert [r.name for r in rows] == ["Empty", "Food", "Home", "Zero"]
    by = {r.name: [(c.id, c.name) for c in r.categories] for r in rows}
    assert by["Empty"] == []
    assert by["Home"] == [(2, "Power"), (1, "rent")]
    assert by["Food"] == [(25, "fees"), (3, "snacks"), (4, "snacks")]


def test_expense_detail_and_latest(small_ledger):
    d = {r.id: r for r in EN.expense_detail(small_ledger).select(
        "id", to_json_text(F.col("tags")).alias("tags"), to_json_text(F.col("category")).alias("category")).collect()}
    # important first, then name (case-sensitive), then id
    assert json.loads(d[1].tags) == [{"id": 4, "name": "a", "isImportant": True},
                                     {"id": 1, "name": "b", "isImportant": True},
                                     {"id": 2, "name": "a", "isImportant": False}]
    assert json.loads(d[2].tags) == []
    assert json.loads(d[2].category) == {"id": 2, "name": "Power"}
    latest = EN.latest_expense(small_ledger).collect()
    assert [r.id for r in latest] == [6]
    sub = EN.expense_detail(small_ledger, small_ledger.spark.createDataFrame([(3,), (4,)], "id int"))
    assert sorted(ids(sub)) == [3, 4]
    assert [r.id for r in EN.latest_income(small_ledger).collect()] == [5]
    assert EN.latest_expense(make_ledger(small_ledger.spark)).count() == 0


def test_lists_under_a_collation(spark):
    names = ["zebra", "Éclair", "eclair", "apple", "Ängström", "ECLAIR", "Zoo", "äpfel"]
    led = make_ledger(spark, category=[(i, 1, n) for i, n in enumerate(names, 1)], wallet=list(enumerate(names, 1)),
                      tag=[(i, n, i % 2 == 0) for i, n in enumerate(names, 1)])
    want = ["Ängström", "äpfel", "apple", "ECLAIR", "eclair", "Éclair", "zebra", "Zoo"]
    got = LS.category_list(led, Page(100, 0), "UNICODE_CI_AI").orderBy("pos").collect()
    assert [r.name for r in got] == want and [r.pos for r in got] == list(range(8))
    assert [r.name for r in LS.wallet_list(led, Page(3, 2), "UNICODE_CI_AI").orderBy("pos").collect()] == want[2:5]
    tags = [r.name for r in LS.tag_list(led, TagFilter(), Page(100, 0), "UNICODE_CI_AI").orderBy("pos").collect()]
    assert tags == [n for n in want if names.index(n) % 2 == 1] + [n for n in want if names.index(n) % 2 == 0]
    # the ledger's own order puts letters with accents last
    assert [r.name for r in LS.category_list(led, Page(100, 0)).orderBy("pos").collect()][-2:] == ["äpfel", "Éclair"]
