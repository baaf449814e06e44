"""Field rules as one table-driven DataFrame test (input JSON -> status, reasons)."""

import json

import pytest

from conftest import make_ledger
from tillbook.operators import validate as V


def _doc(*elements):
    return json.dumps({"expenses": list(elements)})


GOOD = {"amount": 10, "date": "2025-04-01", "description": "x", "priority": 1,
        "categoryId": 1, "walletId": 1, "tagIds": [1]}


def _with(**kw):
    e = dict(GOOD)
    for k, v in kw.items():
        if v is ...:
            e.pop(k)
        else:
            e[k] = v
    return e


EXPENSE_CASES = [
    (_with(), "ok", []),
    (_with(amount=0), "ok", []),
    (_with(amount=-100), "invalid", ["amount:negative"]),
    (_with(date="2025-04-31"), "invalid", ["date:invalid"]),
    (_with(date="2025-13-01"), "invalid", ["date:invalid"]),
    (_with(date=None), "invalid", ["date:invalid"]),
    (_with(priority=3), "invalid", ["priority:range"]),
    (_with(priority=-1), "invalid", ["priority:range"]),
    (_with(categoryId=0), "invalid", ["categoryId:not_positive"]),
    (_with(walletId=-5), "invalid", ["walletId:not_positive"]),
    (_with(tagIds=[1, 2, 0, 4]), "invalid", ["tagIds:not_positive"]),
    (_with(tagIds=[1, -3, 4]), "invalid", ["tagIds:not_positive"]),
    (_with(tagIds=[]), "ok", []),
    (_with(tagIds=...), "invalid", ["tagIds:missing"]),
    (_with(description=...), "ok", []),
    (_with(description=None), "ok", []),
    (_with(description=5), "invalid", ["json:type"]),
    (_with(amount=1.5), "invalid", ["json:type"]),
    (_with(amount="5"), "invalid", ["json:type"]),
    (_with(amount=3_000_000_000), "invalid", ["json:type"]),
    (_with(amount=...), "invalid", ["amount:missing"]),
    (_with(tagIds=[1, 1]), "conflict", ["tagIds:duplicate"]),
    (_with(categoryId=99), "conflict", ["categoryId:unknown"]),
    (_with(walletId=99), "conflict", ["walletId:unknown"]),
    (_with(tagIds=[1, 77]), "conflict", ["tagIds:unknown"]),
    (_with(amount=-1, walletId=99), "invalid", ["amount:negative", "walletId:unknown"]),
]


@pytest.fixture(scope="module")
def tiny(spark):
    return make_ledger(spark, category=[(1, 1, "c")], parent_category=[(1, "p")], wallet=[(1, "w"), (2, "v")],
                       tag=[(1, "t", True), (2, "u", False), (3, "v", False), (4, "w", True)])


def test_expense_field_rules(spark, tiny):
    docs = spark.createDataFrame([(i, _doc(case[0])) for i, case in enumerate(EXPENSE_CASES)], "batch_id long, value string")
    got = {r.batch_id: r for r in V.validate_expense_batches(tiny, docs, mode="quarantine").collect()}
    for i, (_, status, reasons) in enumerate(EXPENSE_CASES):
        assert (got[i].status, list(got[i].reasons)) == (status, reasons), EXPENSE_CASES[i][0]


def test_repeated_keys_are_mistyped(spark, tiny):
    twice = json.dumps(_with(amount=-5))[:-1] + ', "amount": 7}'
    docs = spark.createDataFrame([(1, '{"expenses": [' + twice + "]}")], "batch_id long, value string")
    row = V.validate_expense_batches(tiny, docs).first()
    assert (row.status, list(row.reasons), row.batch_ok) == ("invalid", ["json:type"], False)


def test_malformed_documents(spark, tiny):
    good = _doc(_with())
    bad = [good + " more", good + "}", good + "]", good + "],[", good + "," + good, json.dumps({"expenses": [json.dumps(_with())]}),
           json.dumps({"expenses": [_with(), 5]}), '{"expenses":[],' + good[1:], "[]", "", None]
    docs = spark.createDataFrame(list(enumerate([*bad, good, f" {good}\n", '{"expenses":[]}'])), "batch_id long, value string")
    got = {r.batch_id: r for r in V.validate_expense_batches(tiny, docs).collect()}
    for i, text in enumerate(bad):
        assert (got[i].pos, got[i].status, list(got[i].reasons), got[i].batch_ok) == (None, "invalid", ["document:invalid"], False), text
    assert [got[len(bad) + k].batch_ok for k in (0, 1)] == [True, True] and len(got) == len(bad) + 2


def test_text_after_a_transfer_request(spark, tiny):
    good = json.dumps({"sourceWalletId": 1, "targetWalletId": 2, "amount": 5, "fee": 0, "date": "2025-04-01", "description": None})
    docs = spark.createDataFrame([(1, good), (2, good + " {}"), (3, good + "}"), (4, good + "]"), (5, json.dumps(good))], "request_id long, value string")
    got = {r.request_id: (r.status, list(r.reasons)[:1]) for r in V.validate_transfers(tiny, docs).collect()}
    assert got == {1: ("ok", []), **{k: ("invalid", ["json:type"]) for k in (2, 3, 4, 5)}}


def test_batch_is_atomic(spark, tiny):
    docs = spark.createDataFrame([(1, _doc(_with(), _with(priority=5))), (2, _doc(_with(), _with())),
                                  (3, '{"expenses": "nope"}'), (4, "not json"), (5, '{"expenses": []}')],
                                 "batch_id long, value string")
    rows = V.validate_expense_batches(tiny, docs).collect()
    by_batch = {}
    for r in rows:
        by_batch.setdefault(r.batch_id, []).append(r)
    assert [r.batch_ok for r in by_batch[1]] == [False, False]
    assert sorted(r.status for r in by_batch[1]) == ["invalid", "ok"]
    assert all(r.batch_ok for r in by_batch[2]) and len(by_batch[2]) == 2
    assert [(r.pos, r.status, list(r.reasons), r.batch_ok) for r in by_batch[3]] == [(None, "invalid", ["document:invalid"], False)]
    assert by_batch[4][0].status == "invalid"
    assert 5 not in by_batch  # empty batch: nothing to insert, nothing to reject
    # quarantine keeps the good row of batch 1
    q = V.validate_expense_batches(tiny, docs, mode="quarantine").filter("batch_id = 1 and status = 'ok'").collect()
    assert q[0].batch_ok


INCOME_CASES = [
    ({"amount": 5, "date": "2025-04-01", "walletId": 1}, "ok", []),
    ({"amount": 0, "date": "2025-04-01", "walletId": 1}, "invalid", ["amount:not_positive"]),
    ({"amount": -500, "date": "2025-04-01", "walletId": 1}, "invalid", ["amount:not_positive"]),
    ({"amount": 5, "date": "2025-04-01", "walletId": 0}, "invalid", ["walletId:not_positive"]),
    ({"amount": 5, "date": "2025-04-01", "walletId": 9}, "conflict", ["walletId:unknown"]),
    ({"amount": 5, "date": "2025-04-01", "description": None, "walletId": 2}, "ok", []),
]


def test_income_field_rules(spark, tiny):
    docs = spark.createDataFrame([(i, json.dumps({"incomes": [c[0]]})) for i, c in enumerate(INCOME_CASES)],
                                 "batch_id long, value string")
    got = {r.batch_id: r for r in V.validate_income_batches(tiny, docs).collect()}
    for i, (_, status, reasons) in enumerate(INCOME_CASES):
        assert (got[i].status, list(got[i].reasons)) == (status, reasons), INCOME_CASES[i][0]


TRANSFER = {"sourceWalletId": 1, "targetWalletId": 2, "amount": 5, "fee": 1, "date": "2025-04-01", "description": "d"}
TRANSFER_CASES = [
    ({}, "ok", []),
    ({"amount": -1}, "invalid", ["amount:negative"]),
    ({"fee": -1}, "invalid", ["fee:negative"]),
    ({"sourceWalletId": 0}, "invalid", ["sourceWalletId:not_positive"]),
    ({"targetWalletId": -2}, "invalid", ["targetWalletId:not_positive"]),
    ({"date": "2025-13-01"}, "invalid", ["date:invalid"]),
    ({"description": ...}, "ok", []),
    ({"targetWalletId": 1}, "conflict", ["wallet:same_wallet"]),
    ({"targetWalletId": 7}, "conflict", ["targetWalletId:unknown"]),
    ({"amount": 0, "fee": 0}, "ok", []),
]


def test_transfer_rules(spark, tiny):
    rows = []
    for i, (change, _, _) in enumerate(TRANSFER_CASES):
        doc = dict(TRANSFER)
        for k, v in change.items():
            if v is ...:
                doc.pop(k)
            else:
                doc[k] = v
        rows.append((i, json.dumps(doc)))
    docs = spark.createDataFrame(rows, "request_id int, value string")
    got = {r.request_id: r for r in V.validate_transfers(tiny, docs, fee_category_id=1).collect()}
    for i, (_, status, reasons) in enumerate(TRANSFER_CASES):
        assert (got[i].status, list(got[i].reasons)) == (status, reasons), TRANSFER_CASES[i][0]
    # fee category must exist when a fee is charged
    got = {r.request_id: r for r in V.validate_transfers(tiny, docs, fee_category_id=99).collect()}
    assert got[0].status == "conflict" and "feeCategory:unknown" in got[0].reasons
    assert got[9].status == "ok"


def test_json_lines_file_source(spark, tiny, tmp_path):
    from tillbook.sources.batches import read_documents

    path = tmp_path / "batches.jsonl"
    path.write_text("\n".join([_doc(_with(), _with(amount=3)), _doc(_with(priority=9)), "{oops"]) + "\n")
    docs = read_documents(spark, str(path))
    first = sorted(r.batch_id for r in docs.collect())
    assert first == sorted(r.batch_id for r in read_documents(spark, str(path)).collect())  # stable ids
    rows = V.validate_expense_batches(tiny, docs).collect()
    assert len(rows) == 4
    assert sorted((r.status, r.batch_ok) for r in rows) == [
        ("invalid", False), ("invalid", False), ("ok", True), ("ok", True)]
    # transfer requests: one request per line, keyed by request_id
    tpath = tmp_path / "transfers.jsonl"
    tpath.write_text(json.dumps(TRANSFER) + "\n" + json.dumps(dict(TRANSFER, targetWalletId=1)) + "\n")
    checked = V.validate_transfers(tiny, read_documents(spark, str(tpath), key="request_id"), fee_category_id=1)
    assert sorted(r.status for r in checked.collect()) == ["conflict", "ok"]
