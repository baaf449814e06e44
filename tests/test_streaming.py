"""Streaming ingest: files -> validated micro-batches -> stored ledger."""

import json

from tillbook.streaming import start_ingest
from tillbook.streaming.ingest import micro_batch


def _el(amount, tags=(), wallet=1):
    return {"amount": amount, "date": "2024-03-01", "priority": 0, "categoryId": 1, "walletId": wallet,
            "tagIds": list(tags)}


def test_stream_ingest_appends_and_rejects(spark, tmp_path, store):
    src = tmp_path / "incoming"
    src.mkdir()
    (src / "a.json").write_text("\n".join([
        json.dumps({"expenses": [_el(11, [1]), _el(12)]}),
        json.dumps({"expenses": [_el(13), _el(-1)]}),           # whole batch rejected
    ]) + "\n")
    ckpt, rejects = str(tmp_path / "ckpt"), str(tmp_path / "rejects")
    q = start_ingest(spark, str(src), store, ckpt, reject_dir=rejects)
    q.awaitTermination(300)
    led = store.read()
    assert sorted(r.amount for r in led.expense.filter("id > 6").collect()) == [11, 12]
    # a recreated checkpoint has another id, so its loads never replace these
    assert {r.load for r in led.expense.filter("id > 6").collect()} == {f"expenses-{q.id}-0"}
    assert led.expense_tag.filter("expense_id > 6").count() == 1
    assert spark.read.parquet(rejects).count() == 2
    # a second file continues the id sequence; an unknown wallet is a conflict
    (src / "b.json").write_text(json.dumps({"expenses": [_el(14), _el(15, wallet=9)]}) + "\n" +
                                json.dumps({"expenses": [_el(16, [2, 3])]}) + "\n")
    q = start_ingest(spark, str(src), store, ckpt, reject_dir=rejects)
    q.awaitTermination(300)
    led = store.read()
    got = sorted((r.id, r.amount) for r in led.expense.filter("id > 6").collect())
    assert got == [(7, 11), (8, 12), (9, 16)]
    assert spark.read.parquet(rejects).count() == 4


def test_stream_ingest_incomes(spark, tmp_path, store):
    src = tmp_path / "incoming"
    src.mkdir()
    (src / "a.json").write_text(
        json.dumps({"incomes": [{"amount": 40, "date": "2024-04-01", "walletId": 2},
                                {"amount": 41, "date": "2024-04-02", "description": "tip", "walletId": 1}]}) + "\n" +
        json.dumps({"incomes": [{"amount": 0, "date": "2024-04-03", "walletId": 1}]}) + "\n")
    q = start_ingest(spark, str(src), store, str(tmp_path / "ckpt"), kind="incomes")
    q.awaitTermination(300)
    got = sorted((r.id, r.amount) for r in store.read().income.filter("id > 5").collect())
    assert got == [(6, 40), (7, 41)]


def test_a_replayed_epoch_changes_nothing(spark, tmp_path, store):
    """The epoch's function runs again, as after a failure before the streaming checkpoint."""
    handle = micro_batch(store, "expenses", "fail_batch", str(tmp_path / "rejects"))
    batch = spark.createDataFrame([(json.dumps({"expenses": [_el(11, [1]), _el(12)]}),), (json.dumps({"expenses": [_el(-1)]}),)], "value string").coalesce(1)
    handle(batch, 4)
    first = store.read().expense.select("id", "amount", "load").collect()
    handle(batch, 4)
    assert sorted(store.read().expense.select("id", "amount", "load").collect()) == sorted(first) and len(first) == 8
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 1
    handle(batch, 5)
    assert sorted(r.id for r in store.read().expense.filter("id > 6").collect()) == [7, 8, 9, 10]
