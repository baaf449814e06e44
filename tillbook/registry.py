"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each one builds the ledger from the driver's tables (FIXTURES.md §4) and runs
one operator over the whole ledger with the standard parameters. Nested
values are rendered as JSON text so they compare as plain strings.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook import jobs
from tillbook.functions import rules as RU
from tillbook.functions.nested import to_json_text
from tillbook.ledger import Ledger
from tillbook.operators import changes as CH
from tillbook.operators import charts as CT
from tillbook.operators import cube as CU
from tillbook.operators import enrich as EN
from tillbook.operators import listings as LS
from tillbook.operators import summary as S
from tillbook.operators import validate as V
from tillbook.params import DateRange, Page, SummaryParams, TagFilter
from tillbook.plans.materialize import fix
from tillbook.session import ensure_checkpoint_dir
from tillbook.sources import requests as RQ
from tillbook.sources.buckets import bucketed
from tillbook.sources.store import LedgerStore, write_document

# The standard summary request of FIXTURES.md.
STANDARD_SUMMARY = SummaryParams(dt.date(1996, 1, 1), dt.date(1996, 12, 31), (5, 10))


def _ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    return Ledger.from_fixture(spark, sf_dir)


def sum_total(spark, sf_dir) -> DataFrame:
    return S.summary_totals(_ledger(spark, sf_dir), STANDARD_SUMMARY)


def sum_category(spark, sf_dir) -> DataFrame:
    L = _ledger(spark, sf_dir)
    return S.category_summary(L, S.expense_groups(L, STANDARD_SUMMARY)).select("parent_id", "name", "amount")


def sum_parent(spark, sf_dir) -> DataFrame:
    L = _ledger(spark, sf_dir)
    parents = S.parent_summary(S.category_summary(L, S.expense_groups(L, STANDARD_SUMMARY)))
    return parents.withColumn("categories", to_json_text(F.col("categories")))


def sum_priority(spark, sf_dir) -> DataFrame:
    L = _ledger(spark, sf_dir)
    return S.priority_summary(S.expense_groups(L, STANDARD_SUMMARY))


def sum_wallet(spark, sf_dir) -> DataFrame:
    L = _ledger(spark, sf_dir)
    return S.wallet_summary(L, S.income_groups(L, STANDARD_SUMMARY))


def sum_wallet_compat(spark, sf_dir) -> DataFrame:
    return S.wallet_summary_compat(_ledger(spark, sf_dir), STANDARD_SUMMARY)


def sum_doc(spark, sf_dir) -> DataFrame:
    doc = S.summary_document(_ledger(spark, sf_dir), STANDARD_SUMMARY)
    return doc.select(to_json_text(F.col("expense")).alias("expense"), to_json_text(F.col("income")).alias("income"))


QUERIES = {
    "sum_total": sum_total,
    "sum_category": sum_category,
    "sum_parent": sum_parent,
    "sum_priority": sum_priority,
    "sum_wallet": sum_wallet,
    "sum_wallet_compat": sum_wallet_compat,
    "sum_doc": sum_doc,
}


# ---- listings -------------------------------------------------------------

# The request parameters the registered listings use. Pages are
# chosen so that which rows land on the page depends on the order.
INDEX_RANGE = DateRange(dt.date(1995, 1, 1), dt.date(1996, 12, 31))
INDEX_PAGE = Page(100, 20)
INCOME_RANGE = DateRange(dt.date(1996, 1, 1), None)
INCOME_PAGE = Page(100, 50)
DEEP_PAGE = Page(100, 10_000)
KEYSET_AFTER_ID = 7_000
CAT_PAGE = Page(10, 5)
WALLET_PAGE = Page(5, 3)
TAG_PAGE = Page(20, 10)
PARENT_PAGE = Page(4, 1)


def exp_index(spark, sf_dir):
    return LS.expense_index(_ledger(spark, sf_dir), INDEX_RANGE, INDEX_PAGE)


def exp_index_deep(spark, sf_dir):
    return LS.expense_index(_ledger(spark, sf_dir), DateRange(), DEEP_PAGE, strategy="positions")


def exp_index_keyset(spark, sf_dir):
    return LS.expense_index(_ledger(spark, sf_dir), DateRange(), Page(), after_id=KEYSET_AFTER_ID)


def inc_index(spark, sf_dir):
    return LS.income_index(_ledger(spark, sf_dir), INCOME_RANGE, INCOME_PAGE)


def cat_list(spark, sf_dir):
    return LS.category_list(_ledger(spark, sf_dir), CAT_PAGE)


def wallet_list(spark, sf_dir):
    return LS.wallet_list(_ledger(spark, sf_dir), WALLET_PAGE)


def tag_list(spark, sf_dir):
    return LS.tag_list(_ledger(spark, sf_dir), TagFilter(), TAG_PAGE)


def tag_list_important(spark, sf_dir):
    return LS.tag_list(_ledger(spark, sf_dir), TagFilter(True), Page())


def parent_tree(spark, sf_dir):
    t = LS.parent_tree(_ledger(spark, sf_dir), PARENT_PAGE)
    return t.withColumn("categories", to_json_text(F.col("categories")))


def _expense_json(df):
    return df.select("id", "amount", "date", "description", "priority",
                     to_json_text(F.col("category")).alias("category"),
                     to_json_text(F.col("wallet")).alias("wallet"),
                     to_json_text(F.col("tags")).alias("tags"))


def _income_json(df):
    return df.select("id", "amount", "date", "description", to_json_text(F.col("wallet")).alias("wallet"))


def exp_detail(spark, sf_dir):
    return _expense_json(EN.expense_detail(_ledger(spark, sf_dir)))


def exp_latest(spark, sf_dir):
    return _expense_json(EN.latest_expense(_ledger(spark, sf_dir)))


def inc_detail(spark, sf_dir):
    return _income_json(EN.income_detail(_ledger(spark, sf_dir)))


def inc_latest(spark, sf_dir):
    return _income_json(EN.latest_income(_ledger(spark, sf_dir)))


QUERIES.update({
    "exp_index": exp_index,
    "exp_index_deep": exp_index_deep,
    "exp_index_keyset": exp_index_keyset,
    "inc_index": inc_index,
    "cat_list": cat_list,
    "wallet_list": wallet_list,
    "tag_list": tag_list,
    "tag_list_important": tag_list_important,
    "parent_tree": parent_tree,
    "exp_detail": exp_detail,
    "exp_latest": exp_latest,
    "inc_detail": inc_detail,
    "inc_latest": inc_latest,
})


# ---- validation, ingest, transfers, updates, deletes ----------------------


def _reasons_text(df):
    return df.withColumn("reasons", F.array_join(F.col("reasons"), ";"))


def _validated_expenses(L, spark, sf_dir):
    return V.validate_expense_batches(L, RQ.expense_request_documents(spark, sf_dir))


def validate_expenses(spark, sf_dir):
    v = _validated_expenses(_ledger(spark, sf_dir), spark, sf_dir)
    return _reasons_text(v.select("batch_id", "pos", "status", "reasons", "batch_ok"))


def validate_incomes(spark, sf_dir):
    v = V.validate_income_batches(_ledger(spark, sf_dir), RQ.income_request_documents(spark, sf_dir))
    return _reasons_text(v.select("batch_id", "pos", "status", "reasons", "batch_ok"))


def validate_transfers(spark, sf_dir):
    v = V.validate_transfers(_ledger(spark, sf_dir), RQ.transfer_request_documents(spark, sf_dir))
    return _reasons_text(v.select("request_id", "status", "reasons"))


def fk_check(spark, sf_dir):
    """Elements of the expense requests that reference a missing category,
    wallet or tag: one row per (element, violated reference)."""
    v = _validated_expenses(_ledger(spark, sf_dir), spark, sf_dir)
    return (v.select("batch_id", "pos", F.explode("reasons").alias("reason"))
            .filter(F.col("reason").endswith(":unknown")))


def exp_insert(spark, sf_dir):
    L = _ledger(spark, sf_dir)
    rows, _ = CH.insert_expenses(L, _validated_expenses(L, spark, sf_dir))
    return rows.select("id", "category_id", "wallet_id", "amount", "date", "priority", "description")


def exp_insert_tags(spark, sf_dir):
    L = _ledger(spark, sf_dir)
    _, tags = CH.insert_expenses(L, _validated_expenses(L, spark, sf_dir))
    return tags.select("expense_id", "tag_id")


def inc_insert(spark, sf_dir):
    L = _ledger(spark, sf_dir)
    rows = CH.insert_incomes(L, V.validate_income_batches(L, RQ.income_request_documents(spark, sf_dir)))
    return rows.select("id", "amount", "wallet_id", "date", "description")


def _validated_transfers(L, spark, sf_dir):
    return V.validate_transfers(L, RQ.transfer_request_documents(spark, sf_dir))


def transfer_rows(spark, sf_dir):
    L = _ledger(spark, sf_dir)
    t = CH.transfer_rows(L, _validated_transfers(L, spark, sf_dir))
    return t.select("id", "amount", "source_wallet_id", "target_wallet_id", "date", "description", "request_id")


def transfer_fees(spark, sf_dir):
    L = _ledger(spark, sf_dir)
    f = CH.fee_expenses(L, _validated_transfers(L, spark, sf_dir))
    return f.select("id", "category_id", "wallet_id", "amount", "date", "priority", "description", "request_id")


EXPENSE_COLS = ["id", "category_id", "wallet_id", "amount", "date", "priority", "description"]
INCOME_COLS = ["id", "amount", "wallet_id", "date", "description"]


def _exp_update(spark, sf_dir):
    return CH.update_expenses(_ledger(spark, sf_dir), RQ.expense_updates(spark, sf_dir))


def exp_update(spark, sf_dir):
    return _exp_update(spark, sf_dir)[0].select(*EXPENSE_COLS)


def exp_update_tags(spark, sf_dir):
    return _exp_update(spark, sf_dir)[1].select("expense_id", "tag_id")


def exp_update_outcome(spark, sf_dir):
    return _exp_update(spark, sf_dir)[2].select("id", "status")


def _inc_update(spark, sf_dir):
    return CH.update_incomes(_ledger(spark, sf_dir), RQ.income_updates(spark, sf_dir))


def inc_update(spark, sf_dir):
    return _inc_update(spark, sf_dir)[0].select(*INCOME_COLS)


def inc_update_outcome(spark, sf_dir):
    return _inc_update(spark, sf_dir)[1].select("id", "status")


def _exp_delete(spark, sf_dir):
    return CH.delete_expenses(_ledger(spark, sf_dir), RQ.expense_deletes(spark, sf_dir))


def exp_delete(spark, sf_dir):
    return _exp_delete(spark, sf_dir)[0].select(*EXPENSE_COLS)


def exp_delete_tags(spark, sf_dir):
    return _exp_delete(spark, sf_dir)[1].select("expense_id", "tag_id")


def exp_delete_outcome(spark, sf_dir):
    return _exp_delete(spark, sf_dir)[2]


def inc_delete(spark, sf_dir):
    new_income, _ = CH.delete_incomes(_ledger(spark, sf_dir), RQ.income_deletes(spark, sf_dir))
    return new_income.select(*INCOME_COLS)


def inc_delete_outcome(spark, sf_dir):
    return CH.delete_incomes(_ledger(spark, sf_dir), RQ.income_deletes(spark, sf_dir))[1]


QUERIES.update({
    "validate_expenses": validate_expenses,
    "validate_incomes": validate_incomes,
    "validate_transfers": validate_transfers,
    "fk_check": fk_check,
    "exp_insert": exp_insert,
    "exp_insert_tags": exp_insert_tags,
    "inc_insert": inc_insert,
    "transfer_rows": transfer_rows,
    "transfer_fees": transfer_fees,
    "exp_update": exp_update,
    "exp_update_tags": exp_update_tags,
    "exp_update_outcome": exp_update_outcome,
    "inc_update": inc_update,
    "inc_update_outcome": inc_update_outcome,
    "exp_delete": exp_delete,
    "exp_delete_tags": exp_delete_tags,
    "exp_delete_outcome": exp_delete_outcome,
    "inc_delete": inc_delete,
    "inc_delete_outcome": inc_delete_outcome,
})


# ---- chart feeds ----------------------------------------------------------


def chart_bar(spark, sf_dir):
    return CT.bar(_ledger(spark, sf_dir), STANDARD_SUMMARY)


def chart_sunburst(spark, sf_dir):
    return CT.sunburst(_ledger(spark, sf_dir), STANDARD_SUMMARY)


def chart_sankey(spark, sf_dir):
    return CT.sankey(_ledger(spark, sf_dir), STANDARD_SUMMARY)


QUERIES.update({"chart_bar": chart_bar, "chart_sunburst": chart_sunburst, "chart_sankey": chart_sankey})


# ---- full-range summary (every expense and income, no exclusions) ---------
FULL_RANGE_SUMMARY = SummaryParams(dt.date(1900, 1, 1), dt.date(2100, 12, 31), ())


def sum_doc_all(spark, sf_dir):
    doc = S.summary_document(_ledger(spark, sf_dir), FULL_RANGE_SUMMARY)
    return doc.select(to_json_text(F.col("expense")).alias("expense"), to_json_text(F.col("income")).alias("income"))


QUERIES["sum_doc_all"] = sum_doc_all


# ---- detail for given ids, quarantine, stamps, sinks ----------------------


def exp_detail_ids(spark, sf_dir):
    """Expense detail for the ids that the delete requests name."""
    return _expense_json(EN.expense_detail(_ledger(spark, sf_dir), RQ.expense_deletes(spark, sf_dir)))


def inc_detail_ids(spark, sf_dir):
    return _income_json(EN.income_detail(_ledger(spark, sf_dir), RQ.income_deletes(spark, sf_dir)))


def validate_expenses_quarantine(spark, sf_dir):
    v = V.validate_expense_batches(_ledger(spark, sf_dir), RQ.expense_request_documents(spark, sf_dir), mode="quarantine")
    return _reasons_text(v.select("batch_id", "pos", "status", "reasons", "batch_ok"))


def transfer_rows_again(spark, sf_dir):
    """The same transfers once more, onto the table that the first ones made."""
    L = _ledger(spark, sf_dir)
    v = _validated_transfers(L, spark, sf_dir)
    again = CH.transfer_rows(L.replace(wallet_transfer=CH.transfer_rows(L, v)), v)
    return again.select("id", "amount", "source_wallet_id", "target_wallet_id", "date", "description", "request_id")


def exp_update_stamps(spark, sf_dir):
    """Whether an update kept ``created_at`` and set ``updated_at`` (both null before)."""
    new = _exp_update(spark, sf_dir)[0]
    return new.select("id", F.col("created_at").isNull().alias("created_kept"), F.col("updated_at").isNotNull().alias("stamped"))


def _scratch(spark) -> str:
    """A folder of its own under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sink-{uuid.uuid4().hex}"


def sink_append(spark, sf_dir):
    """Incomes of the ledger, then those of the accepted batches, appended to a store and read back."""
    L, store = _ledger(spark, sf_dir), LedgerStore(spark, _scratch(spark))
    store.append(income=L.income, wallet=L.wallet)
    jobs.ingest(store, RQ.income_request_documents(spark, sf_dir), "incomes", tag="batch-1")
    return store.read().income.select(*INCOME_COLS)


def _changed_store(spark, sf_dir):
    """The whole ledger as a snapshot, then an update and a delete that each write only what they touch."""
    store = LedgerStore(spark, _scratch(spark))
    store.save(_ledger(spark, sf_dir))
    jobs.update(store, RQ.expense_updates(spark, sf_dir))
    jobs.delete(store, RQ.expense_deletes(spark, sf_dir))
    return store.read()


def sink_snapshot(spark, sf_dir):
    """The changed expenses, written over the whole table once more and read back."""
    L = _changed_store(spark, sf_dir)
    store = LedgerStore(spark, _scratch(spark))
    store.save(L)
    store.snapshot(expense=store.read().expense)
    return store.read().expense.select(*EXPENSE_COLS)


def sink_snapshot_tags(spark, sf_dir):
    return _changed_store(spark, sf_dir).expense_tag.select("expense_id", "tag_id")


def sink_doc(spark, sf_dir):
    """The summary document, written as JSON text and read back."""
    path = _scratch(spark)
    write_document(S.summary_document(_ledger(spark, sf_dir), STANDARD_SUMMARY), path)
    return spark.read.text(path)


QUERIES.update({
    "exp_detail_ids": exp_detail_ids,
    "inc_detail_ids": inc_detail_ids,
    "validate_expenses_quarantine": validate_expenses_quarantine,
    "transfer_rows_again": transfer_rows_again,
    "exp_update_stamps": exp_update_stamps,
    "sink_append": sink_append,
    "sink_snapshot": sink_snapshot,
    "sink_snapshot_tags": sink_snapshot_tags,
    "sink_doc": sink_doc,
})


# ---- summaries of many requests, cubes kept up to date ----------------------


def _documents_text(df, *columns):
    return df.select(*columns, to_json_text(F.col("expense")).alias("expense"), to_json_text(F.col("income")).alias("income"))


def _summary_requests(spark, sf_dir):
    """All checked requests, and those that are answered."""
    checked = V.validate_summary_requests(RQ.summary_request_documents(spark, sf_dir))
    return checked, checked.filter(F.col("status") == "ok")


def validate_summaries(spark, sf_dir):
    return _reasons_text(_summary_requests(spark, sf_dir)[0].select("request_id", "status", "reasons"))


def sum_requests(spark, sf_dir):
    """The summary document of every customer's request."""
    L, (_, ok) = _ledger(spark, sf_dir), _summary_requests(spark, sf_dir)
    return _documents_text(CU.request_documents(L, ok, CU.expense_cube(L), CU.income_cube(L)), "request_id")


def sum_total_requests(spark, sf_dir):
    L, (_, ok) = _ledger(spark, sf_dir), _summary_requests(spark, sf_dir)
    return CU.request_totals(L, ok, CU.expense_cube(L), CU.income_cube(L))


def _moved_expense_cube(L, spark, sf_dir):
    """The stored cube after an insert, an update and a delete, each merged as signed cells."""
    path = _scratch(spark)
    CU.write_cube(CU.expense_cube(L), path)
    new = fix(CH.insert_expenses(L, _validated_expenses(L, spark, sf_dir))[0])  # read by every change after
    CU.merge_cells(spark, path, CU.EXPENSE_KEY, CU.signed_cells(CU.EXPENSE_KEY, after=new))
    L = L.replace(expense=L.expense.unionByName(new))
    changed, _, outcome = CH.update_expenses(L, RQ.expense_updates(spark, sf_dir))
    CU.merge_cells(spark, path, CU.EXPENSE_KEY, CU.update_cells(L.expense, outcome, CU.EXPENSE_KEY))
    CU.merge_cells(spark, path, CU.EXPENSE_KEY, CU.delete_cells(changed, RQ.expense_deletes(spark, sf_dir), CU.EXPENSE_KEY))
    return CU.read_cube(spark, path, CU.EXPENSE_KEY)


def _moved_income_cube(L, spark, sf_dir):
    path = _scratch(spark)
    CU.write_cube(CU.income_cube(L), path)
    new = fix(CH.insert_incomes(L, V.validate_income_batches(L, RQ.income_request_documents(spark, sf_dir))))
    CU.merge_cells(spark, path, CU.INCOME_KEY, CU.signed_cells(CU.INCOME_KEY, after=new))
    L = L.replace(income=L.income.unionByName(new))
    changed, outcome = CH.update_incomes(L, RQ.income_updates(spark, sf_dir))
    CU.merge_cells(spark, path, CU.INCOME_KEY, CU.update_cells(L.income, outcome, CU.INCOME_KEY))
    CU.merge_cells(spark, path, CU.INCOME_KEY, CU.delete_cells(changed, RQ.income_deletes(spark, sf_dir), CU.INCOME_KEY))
    return CU.read_cube(spark, path, CU.INCOME_KEY)


def cube_expense_moved(spark, sf_dir):
    return _moved_expense_cube(_ledger(spark, sf_dir), spark, sf_dir).drop("month")


def cube_income_moved(spark, sf_dir):
    return _moved_income_cube(_ledger(spark, sf_dir), spark, sf_dir).drop("month")


def sum_requests_moved(spark, sf_dir):
    """Every request's document from the cubes after the change sets."""
    L, (_, ok) = _ledger(spark, sf_dir), _summary_requests(spark, sf_dir)
    cubes = _moved_expense_cube(L, spark, sf_dir), _moved_income_cube(L, spark, sf_dir)
    return _documents_text(CU.request_documents(L, ok, *cubes), "request_id")


QUERIES.update({
    "validate_summaries": validate_summaries,
    "sum_requests": sum_requests,
    "sum_total_requests": sum_total_requests,
    "cube_expense_moved": cube_expense_moved,
    "cube_income_moved": cube_income_moved,
    "sum_requests_moved": sum_requests_moved,
})


# ---- collated lists, co-located detail, lenient parameters, far pages --------

COLLATION = "UNICODE_CI_AI"
FAR_PAGE = Page(100, 100_000)


def cat_list_collated(spark, sf_dir):
    return LS.category_list(_ledger(spark, sf_dir), CAT_PAGE, COLLATION)


def wallet_list_collated(spark, sf_dir):
    return LS.wallet_list(_ledger(spark, sf_dir), WALLET_PAGE, COLLATION)


def tag_list_collated(spark, sf_dir):
    return LS.tag_list(_ledger(spark, sf_dir), TagFilter(), TAG_PAGE, COLLATION)


def exp_detail_bucketed(spark, sf_dir):
    """Every expense's detail from tables that are bucketed by expense id."""
    L = bucketed(_ledger(spark, sf_dir), f"detail_{uuid.uuid4().hex}", _scratch(spark))
    return _expense_json(EN.expense_detail(L))


def params_lenient(spark, sf_dir):
    """V-INT-STR, V-OPT-DATE and V-BOOL over a table of raw parameter texts."""
    raw = RQ.parameter_texts(spark, sf_dir)
    return raw.select("request_id", RU.page_limit(F.col("limit")).alias("page_limit"), RU.page_offset(F.col("offset")).alias("page_offset"),
                      RU.strict_date(F.col("from")).alias("first_day"), RU.bool_text(F.col("important")).alias("important"))


def exp_index_far(spark, sf_dir):
    """The page from offset 100,000 (empty where the ledger is smaller)."""
    return LS.expense_index(_ledger(spark, sf_dir), DateRange(), FAR_PAGE, strategy="positions")


QUERIES.update({
    "cat_list_collated": cat_list_collated,
    "wallet_list_collated": wallet_list_collated,
    "tag_list_collated": tag_list_collated,
    "exp_detail_bucketed": exp_detail_bucketed,
    "params_lenient": params_lenient,
    "exp_index_far": exp_index_far,
})
