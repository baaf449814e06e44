"""Summary: hand-made edge cases and invariants."""

import json

from conftest import D
from pyspark.sql import functions as F
from tillbook.functions.nested import to_json_text
from tillbook.operators import summary as S
from tillbook.params import SummaryParams


def doc(ledger, p):
    row = S.summary_document(ledger, p).select(
        to_json_text(F.col("expense")).alias("e"), to_json_text(F.col("income")).alias("i")).collect()
    assert len(row) == 1
    return json.loads(row[0].e), json.loads(row[0].i)


def test_document_shape_and_values(small_ledger):
    e, i = doc(small_ledger, SummaryParams(D("2024-01-01"), D("2024-12-31")))
    assert e["amount"] == 1000 + 200 + 50 + 70 + 0
    parents = e["groupSummary"]["parentCategories"]
    # same-named 'snacks' under Food merge; Zero (only a zero sum) and Empty vanish
    assert parents == [
        {"name": "Home", "amount": 1200, "categories": [{"name": "rent", "amount": 1000}, {"name": "Power", "amount": 200}]},
        {"name": "Food", "amount": 120, "categories": [{"name": "snacks", "amount": 120}]},
    ]
    # zero sums are kept for priorities
    assert e["groupSummary"]["priorities"] == [
        {"level": 0, "amount": 1000}, {"level": 1, "amount": 200}, {"level": 2, "amount": 120}]
    assert i["amount"] == 1600
    # wallets 2 and 3 share the name 'Bank' but stay apart (documented grouping)
    assert i["groupSummary"]["wallets"] == [
        {"name": "Cash", "amount": 1000}, {"name": "Bank", "amount": 300}, {"name": "Bank", "amount": 300}]


def test_compat_wallets(small_ledger):
    p = SummaryParams(D("2024-01-01"), D("2024-12-31"))
    rows = sorted((r.name, r.amount) for r in S.wallet_summary_compat(small_ledger, p).collect())
    # (name, distinct amount) groups: Cash 500 x2 -> 1000; Bank 300 from wallets 2 and 3 -> 600
    assert rows == [("Bank", 600), ("Cash", 1000)]


def test_start_after_end_and_exclude_all(small_ledger):
    e, i = doc(small_ledger, SummaryParams(D("2024-12-31"), D("2024-01-01")))
    assert e == {"amount": 0, "groupSummary": {"parentCategories": [], "priorities": []}}
    assert i == {"amount": 0, "groupSummary": {"wallets": []}}
    e, i = doc(small_ledger, SummaryParams(D("2024-01-01"), D("2024-12-31"), (1, 2, 3, 4, 5, 25)))
    assert e == {"amount": 0, "groupSummary": {"parentCategories": [], "priorities": []}}
    assert i["amount"] == 1600  # exclusions do not touch incomes


def test_long_exclusion_list_uses_anti_join(small_ledger):
    ids = tuple(range(2, 3000))
    e, _ = doc(small_ledger, SummaryParams(D("2024-01-01"), D("2024-12-31"), ids))
    assert e["amount"] == 1000


def test_invariants_on_fixture(fixture_ledger):
    p = SummaryParams(D("1992-01-01"), D("1998-12-31"), (5, 10))
    e, i = doc(fixture_ledger, p)
    total = e["amount"]
    assert sum(x["amount"] for x in e["groupSummary"]["parentCategories"]) == total
    assert sum(x["amount"] for x in e["groupSummary"]["priorities"]) == total
    for parent in e["groupSummary"]["parentCategories"]:
        assert sum(c["amount"] for c in parent["categories"]) == parent["amount"]
    assert sum(w["amount"] for w in i["groupSummary"]["wallets"]) == i["amount"]
    compat = S.wallet_summary_compat(fixture_ledger, p).agg(F.sum("amount")).collect()[0][0]
    assert compat == i["amount"]
    # sums are 64-bit (the ledger's int amounts overflow 2^31 quickly)
    assert S.summary_totals(fixture_ledger, p).schema["expense_amount"].dataType.typeName() == "long"


def test_empty_ledger(spark):
    from conftest import make_ledger

    e, i = doc(make_ledger(spark), SummaryParams(D("2024-01-01"), D("2024-12-31")))
    assert e["amount"] == 0 and i["amount"] == 0
