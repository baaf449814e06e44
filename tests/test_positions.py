"""Numbering of elements by document, and requests read in one parse."""

import contextlib
import io
import json
import re

import pytest
from pyspark.sql import functions as F
from tillbook.operators import changes as CH
from tillbook.operators import validate as V
from tillbook.plans import positions as P
from tillbook.sources.batches import expense_elements


def elements(spark, sizes, gap):
    rows = [(doc, i, (doc * 7 + i) % gap != 0) for doc, n in sizes.items() for i in range(n)] + [(10**12, None, True)]
    return spark.createDataFrame(rows, "batch_id long, pos int, ok boolean").repartition(7), sorted((d, i) for d, i, ok in rows if ok and i is not None)


def test_ranks_across_documents_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 16)  # a long document has many pieces
    for gap in (3, 10**9):
        rows, want = elements(spark, {5: 40, -3: 1, 900: 200, 7: 16, 8: 17, 2**40: 3}, gap)
        got = P.number_elements(rows, "batch_id", "pos", F.col("ok"), "n").select("n", "batch_id", "pos").orderBy("n").collect()
        assert [tuple(r) for r in got] == [(k, *x) for k, x in enumerate(want)]


def test_null_verdicts_and_nothing_kept(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, True), (2, 0, False)], "batch_id long, pos int, ok boolean")
    assert [tuple(r) for r in P.number_elements(rows, "batch_id", "pos", F.col("ok"), "n").select("n", "pos").collect()] == [(0, 1)]
    assert P.number_elements(rows.limit(0), "batch_id", "pos", F.col("ok"), "n").collect() == []


def test_a_document_under_two_ids_is_refused(spark):
    rows = spark.createDataFrame([(1, 0, True), (1, 0, True)], "batch_id long, pos int, ok boolean")
    with pytest.raises(Exception, match="must stand once"):
        P.number_elements(rows, "batch_id", "pos", F.col("ok"), "n").collect()


def test_ids_in_quarantine_mode_close_the_gaps(spark, small_ledger):
    def el(amount):
        return {"amount": amount, "date": "2024-03-01", "priority": 0, "categoryId": 1, "walletId": 1, "tagIds": []}
    docs = spark.createDataFrame([(2, json.dumps({"expenses": [el(1), el(-1), el(2)]})), (1, json.dumps({"expenses": [el(-1), el(3)]})),
                                  (3, "no json")], "batch_id long, value string")
    rows, _ = CH.insert_expenses(small_ledger, V.validate_expense_batches(small_ledger, docs, mode="quarantine"))
    assert sorted((r.id, r.amount) for r in rows.collect()) == [(7, 3), (8, 1), (9, 2)]


def explained(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_elements_are_not_range_sorted(spark, small_ledger):
    docs = spark.createDataFrame([(1, json.dumps({"expenses": []}))], "batch_id long, value string")
    rows, _ = CH.insert_expenses(small_ledger, V.validate_expense_batches(small_ledger, docs))
    assert "rangepartitioning" not in explained(rows)


def test_one_parse_per_document(spark):
    """Apart from the branch for refused documents there is one parse, before the rows are made."""
    docs = spark.createDataFrame([(1, "{}")], "batch_id long, value string").repartition(1)
    plan = explained(expense_elements(docs))
    after = plan[:plan.index("Generate")]  # the plan is printed from its end
    assert "from_json" not in after and "parse_json" not in after.lower()
    assert len(re.findall(r"parse_json\(concat", plan, re.I)) <= 1, plan


def test_text_after_a_batch_that_names_its_own_end(spark, small_ledger):
    good = json.dumps({"expenses": [{"amount": 1, "date": "2024-03-01", "priority": 0, "categoryId": 1, "walletId": 1, "tagIds": []}]})
    bad = [good + ",5", good + ",5]", good + "]", good + ", null", good + " " + good, "[" + good + "]", good + "],[1", "null", '{"expenses":[null]}',
           '{"expenses":{}}', '{"Expenses":[]}']
    docs = spark.createDataFrame(list(enumerate([*bad, good + " \n "])), "batch_id long, value string")
    got = {r.batch_id: (r.batch_ok, list(r.reasons)) for r in V.validate_expense_batches(small_ledger, docs).collect()}
    assert got == {**{i: (False, ["document:invalid"]) for i in range(len(bad))}, len(bad): (True, [])}
