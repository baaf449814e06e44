"""Day cubes: many requests at once against the single summary, and signed cells against recomputed cubes."""

import json
from types import SimpleNamespace

import pytest
from conftest import D
from pyspark.sql import functions as F
from tillbook.functions.nested import to_json_text
from tillbook.operators import changes as CH
from tillbook.operators import cube as CU
from tillbook.operators import summary as S
from tillbook.operators import validate as V
from tillbook.params import SummaryParams

RANGES = [
    (1, "2024-01-01", "2024-12-31", []),
    (2, "2024-12-31", "2024-01-01", []),  # ends before it starts
    (3, "2024-01-05", "2024-01-05", [1]),  # one day, its only category left out
    (4, "1900-01-01", "2100-12-31", [2, 2, 99]),  # beyond the ledger on both sides
    (5, "2000-01-01", "2001-01-01", []),  # before every row
    (6, "2030-01-01", "2031-01-01", []),  # after every row
    (7, "2024-01-10", "2024-02-02", [1, 2, 3, 4, 5, 25]),
    (8, "2024-02-03", "2024-02-03", []),  # a zero amount still counts as a row
]


def requests(spark, rows=RANGES):
    return spark.createDataFrame([(i, D(a), D(b), x) for i, a, b, x in rows], "request_id int, start date, end date, exclude array<int>")


def texts(df):
    return {r[0]: (json.loads(r[1]), json.loads(r[2])) for r in df.select(
        df.columns[0], to_json_text(F.col("expense")), to_json_text(F.col("income"))).collect()}


def test_every_request_as_its_own_summary(spark, small_ledger):
    got = texts(CU.request_documents(small_ledger, requests(spark), CU.expense_cube(small_ledger), CU.income_cube(small_ledger)))
    for i, a, b, x in RANGES:
        one = S.summary_document(small_ledger, SummaryParams(D(a), D(b), tuple(x))).select(F.lit(i), "expense", "income")
        assert got[i] == texts(one)[i], i


def test_totals(spark, small_ledger):
    rows = CU.request_totals(small_ledger, requests(spark), CU.expense_cube(small_ledger), CU.income_cube(small_ledger)).collect()
    assert {r.request_id: (r.expense_amount, r.income_amount) for r in rows} == {
        1: (1320, 1600), 2: (0, 0), 3: (0, 0), 4: (2119, 1610), 5: (0, 0), 6: (0, 0), 7: (0, 800), 8: (0, 0)}


def test_empty_ledger(spark, small_ledger):
    empty = small_ledger.replace(expense=small_ledger.expense.limit(0), income=small_ledger.income.limit(0))
    got = texts(CU.request_documents(empty, requests(spark), CU.expense_cube(empty), CU.income_cube(empty)))
    assert len(got) == len(RANGES) and all(e["amount"] == 0 and i == {"amount": 0, "groupSummary": {"wallets": []}} for e, i in got.values())


def test_running_totals_fill_every_day(small_ledger):
    rows = CU.running_totals(CU.income_cube(small_ledger), CU.INCOME_KEY).filter("wallet_id = 1").orderBy("day").collect()
    assert rows[0].day == D("2024-01-01") and rows[-1].day == D("2025-01-01") and len(rows) == 367
    assert [r.amount_to for r in rows[13:15]] == [500, 1000] and rows[-1].n_to == 2


def cells(df):
    return sorted((r.date, *(r[k] for k in CU.EXPENSE_KEY), r.amount, r.n) for r in df.collect())


@pytest.fixture
def stored(spark, small_ledger, tmp_path):
    path = str(tmp_path / "cube")
    CU.write_cube(CU.expense_cube(small_ledger), path)
    return path


def test_signed_cells_keep_the_cube_right(spark, small_ledger, stored):
    changes = spark.createDataFrame([
        (1, '{"amount":1,"date":"2023-12-05","description":null,"priority":1,"categoryId":2,"walletId":1,"tagIds":[]}'),  # into another month
        (3, '{"amount":60,"date":"2024-02-01","description":null,"priority":2,"categoryId":3,"walletId":1,"tagIds":[]}'),  # same cell
        (4, '{"amount":-1,"date":"2024-02-01","description":null,"priority":2,"categoryId":3,"walletId":1,"tagIds":[]}'),  # refused
        (99, '{"amount":60,"date":"2024-02-01","description":null,"priority":2,"categoryId":3,"walletId":1,"tagIds":[]}'),  # unknown
    ], "id int, value string")
    changed, _, outcome = CH.update_expenses(small_ledger, changes)
    CU.merge_cells(spark, stored, CU.EXPENSE_KEY, CU.update_cells(small_ledger.expense, outcome, CU.EXPENSE_KEY))
    after = SimpleNamespace(expense=changed)
    assert cells(CU.read_cube(spark, stored, CU.EXPENSE_KEY)) == cells(CU.expense_cube(after))

    ids = spark.createDataFrame([(2,), (6,), (77,)], "id int")
    left = CH.delete_expenses(small_ledger.replace(expense=changed), ids)[0]
    CU.merge_cells(spark, stored, CU.EXPENSE_KEY, CU.delete_cells(changed, ids, CU.EXPENSE_KEY))
    assert cells(CU.read_cube(spark, stored, CU.EXPENSE_KEY)) == cells(CU.expense_cube(SimpleNamespace(expense=left)))

    # all rows of January go: the month is overwritten, not forgotten
    gone = left.filter("date between '2024-01-01' and '2024-01-31'").select("id")
    CU.merge_cells(spark, stored, CU.EXPENSE_KEY, CU.delete_cells(left, gone, CU.EXPENSE_KEY))
    assert cells(CU.read_cube(spark, stored, CU.EXPENSE_KEY)) == cells(CU.expense_cube(SimpleNamespace(
        expense=left.join(gone, "id", "left_anti"))))


def test_untouched_months_stay(spark, small_ledger, stored):
    import os
    before = {m: sorted(os.listdir(f"{stored}/{m}")) for m in os.listdir(stored) if m.startswith("month=")}
    ids = spark.createDataFrame([(6,)], "id int")
    CU.merge_cells(spark, stored, CU.EXPENSE_KEY, CU.delete_cells(small_ledger.expense, ids, CU.EXPENSE_KEY))
    after = {m: sorted(os.listdir(f"{stored}/{m}")) for m in before}
    assert {m for m in before if before[m] != after[m]} == {"month=2023-12-01"}


def test_months_are_pruned_at_run_time(spark, small_ledger, stored):
    signed = CU.delete_cells(small_ledger.expense, spark.createDataFrame([(6,)], "id int"), CU.EXPENSE_KEY)
    signed = signed.withColumn("month", F.trunc("date", "month"))
    months = signed.filter((F.col("amount") != 0) | (F.col("n") != 0)).select("month").distinct()
    plan = spark.read.parquet(stored).join(months, "month", "left_semi")._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()


def test_request_rules(spark):
    docs = [(1, '{"startDate":"2024-01-01","endDate":"2024-02-01","excludeCategoryIds":[]}'),
            (2, '{"startDate":"2024-02-30","endDate":"2024-02-01","excludeCategoryIds":[1]}'),
            (3, '{"startDate":"2024-01-01","endDate":"2024-02-01","excludeCategoryIds":[0]}'),
            (4, '{"startDate":"2024-01-01","endDate":"2024-02-01"}'),
            (5, '{"startDate":"2024-01-01","endDate":"2024-02-01","excludeCategoryIds":["1"]}'),
            (6, '{"startDate":20240101,"endDate":"2024-02-01","excludeCategoryIds":[1]}'),
            (7, '[]'), (8, ""), (9, '{"startDate":"2024-03-01","endDate":"2024-02-01","excludeCategoryIds":[1]} x')]
    got = {r.request_id: (r.status, r.reasons) for r in V.validate_summary_requests(spark.createDataFrame(docs, "request_id int, value string")).collect()}
    assert got[1] == ("ok", []) and got[2] == ("invalid", ["startDate:invalid"]) and got[3][1] == ["excludeCategoryIds:not_positive"]
    assert got[4][1] == ["excludeCategoryIds:missing"] and {got[i][0] for i in (5, 6, 7, 8, 9)} == {"invalid"}


def test_points_are_dealt_before_they_meet_the_cells(spark, small_ledger):
    """A join that broadcasts the totals must not leave every cell to the few tasks that read the requests."""
    from tillbook.plans.materialize import fix

    cells = fix(CU.income_cube(small_ledger))
    requests = spark.sql("SELECT id AS request_id, DATE'2024-01-01' AS start, DATE'2024-12-31' AS end, CAST(array() AS array<bigint>) AS exclude FROM range(0, 50, 1, 1)")
    plan = CU._range_cells(requests, cells, CU.INCOME_KEY)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(request_id" in plan.split("BroadcastHashJoin")[1], plan
