"""Stored ledger: save, read back, append, snapshot; only touched partitions
are written anew, repeated loads replace themselves, date filters prune."""

import contextlib
import io
import json
import os
from pathlib import Path

import pytest
from conftest import D
from pyspark.sql import functions as F
from tillbook import jobs
from tillbook.operators import changes as CH
from tillbook.operators import listings as LS
from tillbook.operators import summary as S
from tillbook.params import DateRange, Page, SummaryParams
from tillbook.sources.store import LedgerStore, touched_of, write_document


def files(root, table):
    """Data files by partition folder."""
    found = {}
    for folder, _, names in os.walk(f"{root}/{table}"):
        if own := sorted(n for n in names if n.endswith(".parquet")):
            found[os.path.relpath(folder, f"{root}/{table}")] = own
    return found


def changed(before, after):
    return {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)}


def expense_doc(batch, *amounts, tags=(), date="2024-05-01"):
    return (batch, json.dumps({"expenses": [{"amount": a, "date": date, "priority": 0, "categoryId": 1, "walletId": 1, "tagIds": list(tags)}
                                            for a in amounts]}))


def test_round_trip_append_and_snapshot(spark, small_ledger, store, tmp_path):
    none = LedgerStore(spark, str(tmp_path / "none"))
    assert none.read().expense.count() == 0 and none.max_ids() == {}
    back = store.read()
    assert back.expense.count() == 6 and back.expense_tag.count() == 5
    p = SummaryParams(D("2024-01-01"), D("2024-12-31"))
    assert S.summary_totals(small_ledger, p).collect() == S.summary_totals(back, p).collect()
    store.append(expense=small_ledger.expense.filter("id = 1").withColumn("id", F.lit(100)),
                 expense_tag=small_ledger.expense_tag.filter("expense_id = 1").withColumn("expense_id", F.lit(100)))
    assert store.read().expense.count() == 7 and store.read().expense_tag.count() == 8
    # a snapshot may read the table that it replaces
    store.snapshot(expense=store.read().expense.filter("id <> 100"))
    assert sorted(r.id for r in store.read().expense.collect()) == [1, 2, 3, 4, 5, 6]
    assert store.max_ids()["expense"] == 100
    out = str(tmp_path / "doc")
    write_document(S.summary_document(store.read(), p), out)
    assert spark.read.text(out).collect()[0].value.startswith('{"expense":{"amount":1320,"groupSummary":{"parentCategories":[')


def test_a_snapshot_clears_months_without_rows(spark, small_ledger, store):
    jobs.ingest(store, spark.createDataFrame([expense_doc(1, 9)], "batch_id long, value string"), tag="x")
    store.snapshot(expense=small_ledger.expense.filter("id = 3"), tag=small_ledger.tag.limit(0))
    assert [r.id for r in store.read().expense.collect()] == [3] and store.read().tag.count() == 0
    store.snapshot(expense=small_ledger.expense)
    assert store.read().expense.drop("month", "load").exceptAll(small_ledger.expense).count() == 0 and store.read().expense.count() == 6


def test_month_partition_pruning(spark, small_ledger, store):
    rows = LS.expense_index(store.read(), DateRange(D("2024-02-01"), D("2024-02-29")), Page(100, 0))
    assert sorted(r.id for r in rows.collect()) == [3, 4, 5]
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        rows.explain()
    assert "PartitionFilters: [isnotnull(month" in buf.getvalue()


def test_update_writes_only_touched_partitions(spark, small_ledger, store):
    root = store.root
    before = files(root, "expense"), files(root, "expense_tag"), files(root, "income")
    changes = spark.createDataFrame([(3, json.dumps({
        "amount": 51, "date": "2024-03-15", "description": "moved", "priority": 2,
        "categoryId": 3, "walletId": 1, "tagIds": [3]}))], "id int, value string")
    want = {r.id: (r.amount, str(r.date)) for r in CH.update_expenses(store.read(), changes)[0].collect()}
    jobs.update(store, changes)
    got = {r.id: (r.amount, str(r.date)) for r in store.read().expense.collect()}
    assert got == want and got[3] == (51, "2024-03-15")
    assert changed(before[0], files(root, "expense")) == {"load=base/month=2024-02-01", "load=base/month=2024-03-01"}
    assert changed(before[1], files(root, "expense_tag")) == {"load=base/id_block=0"} and files(root, "income") == before[2]


def test_touched_partitions_are_pruned_at_run_time(spark, small_ledger, store):
    applied = spark.createDataFrame([(3, D("2024-03-15"))], "id int, date date")
    led = store.read()
    for base, parts in ((led.expense, CH.touched_months(led.expense, applied)), (led.expense_tag, CH.touched_blocks(applied))):
        assert "dynamicpruning" in touched_of(base, parts)._jdf.queryExecution().toString().lower()


def test_store_jobs(spark, small_ledger, store):
    jobs.ingest(store, spark.createDataFrame([expense_doc(1, 9, tags=[2])], "batch_id long, value string"))
    assert store.read().expense.filter("id = 7").count() == 1
    reqs = spark.createDataFrame([(1, json.dumps({"sourceWalletId": 1, "targetWalletId": 2, "amount": 5, "fee": 2,
                                                   "date": "2024-05-02", "description": "x"}))], "request_id int, value string")
    jobs.transfer(store, reqs)
    led = store.read()
    assert led.wallet_transfer.count() == 1 and led.expense.filter("id = 8 AND amount = 2").count() == 1
    changes = spark.createDataFrame([(1, json.dumps({"amount": 1, "date": "2024-05-03", "priority": 1,
                                                     "categoryId": 2, "walletId": 2, "tagIds": []}))], "id int, value string")
    expected = {r.id: (r.amount, str(r.date)) for r in CH.update_expenses(store.read(), changes)[0].collect()}
    assert [r.status for r in jobs.update(store, changes).collect()] == ["ok"]
    led = store.read()
    assert {r.id: (r.amount, str(r.date)) for r in led.expense.collect()} == expected
    assert led.expense_tag.filter("expense_id = 1").count() == 0
    gone = jobs.delete(store, spark.createDataFrame([(7,), (2,), (77,)], "id int"))
    assert {r.id: r.status for r in gone.collect()} == {7: "ok", 2: "ok", 77: "not_found"}
    led = store.read()
    assert sorted(r.id for r in led.expense.collect()) == [1, 3, 4, 5, 6, 8]
    assert led.expense_tag.filter("expense_id = 7").count() == 0
    jobs.update(store, spark.createDataFrame([(5, json.dumps({"amount": 11, "date": "2026-01-01", "walletId": 1}))], "id int, value string"), "incomes")
    jobs.delete(store, spark.createDataFrame([(1,)], "id int"), "incomes")
    assert sorted((r.id, r.amount) for r in store.read().income.collect()) == [(2, 500), (3, 300), (4, 300), (5, 11)]
    # a change set without any known id writes nothing
    before = files(store.root, "expense")
    jobs.delete(store, spark.createDataFrame([(99,)], "id int"))
    assert files(store.root, "expense") == before
    with pytest.raises(ValueError):
        jobs.delete(store, reqs, "wallets")


def test_a_repeated_load_replaces_itself(spark, small_ledger, store):
    """A named append that broke off, or ran twice, leaves each row once, under the same id."""
    docs = spark.createDataFrame([expense_doc(1, 9, 10, tags=[2]), expense_doc(2, 11, date="2024-06-01")], "batch_id long, value string")
    jobs.ingest(store, docs, tag="a")
    once = store.read().expense.drop("created_at", "updated_at").collect()
    jobs.ingest(store, docs, tag="a")
    assert sorted(store.read().expense.drop("created_at", "updated_at").collect()) == sorted(once) and store.read().expense_tag.count() == 7
    jobs.ingest(store, docs, tag="b")
    assert sorted(r.id for r in store.read().expense.filter("id > 6").collect()) == [7, 8, 9, 10, 11, 12]
    # rows of every load are reached by changes
    jobs.delete(store, spark.createDataFrame([(7,), (12,), (1,)], "id int"))
    assert sorted(r.id for r in store.read().expense.collect()) == [2, 3, 4, 5, 6, 8, 9, 10, 11]


def test_ids_of_deleted_rows_are_not_reused(spark, small_ledger, store):
    jobs.delete(store, spark.createDataFrame([(6,)], "id int"))
    docs = spark.createDataFrame([(1, json.dumps({"expenses": [
        {"amount": 9, "date": "2024-05-01", "priority": 0, "categoryId": 1, "walletId": 1, "tagIds": []}]}))],
        "batch_id long, value string")
    jobs.ingest(store, docs)
    assert sorted(r.id for r in store.read().expense.collect()) == [1, 2, 3, 4, 5, 7]


def test_unreadable_files_are_no_empty_ledger(spark, small_ledger, store):
    torn = Path(store.root) / "_ids" / "load=torn"
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"torn")
    with pytest.raises(Exception):
        store.read()


def test_appends_read_in_one_scan(spark, small_ledger, store):
    for i in range(3):
        store.append(expense=small_ledger.expense.filter("id = 1").withColumn("id", F.lit(20 + i)))
    df = store.read().expense
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    assert buf.getvalue().count("FileScan parquet") == 1 and df.count() == 9


def test_a_large_dimension_is_written_by_several_tasks(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "store"))
    tags = spark.range(1, 20_001).selectExpr("CAST(id AS INT) AS id", "CONCAT('t', id) AS name", "id % 2 = 0 AS is_important")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.snapshot(tag=tags)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = store.read().table("tag")
    assert len(back.inputFiles()) > 1 and back.drop("load").exceptAll(tags).count() == 0 and back.count() == 20_000
