"""Plan checks: broadcast dimensions, one scan per fact table in the summary,
date predicates pushed to the parquet reader."""

import contextlib
import io
import re

from conftest import D, SF_SMALL
from tillbook.ledger import Ledger
from tillbook.operators import enrich as EN
from tillbook.operators import listings as LS
from tillbook.operators import summary as S
from tillbook.params import DateRange, Page, SummaryParams


def plan(df, executed=True):
    if executed:
        df.collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    text = buf.getvalue()
    return text.split("== Initial Plan ==")[0]


def test_summary_document_scans_each_fact_once(spark):
    L = Ledger.from_fixture(spark, SF_SMALL)
    text = plan(S.summary_document(L, SummaryParams(D("1996-01-01"), D("1996-12-31"), (5, 10))))
    scans = re.findall(r"FileScan parquet \[(\w+)", text)
    assert scans.count("o_custkey") + scans.count("o_orderkey") == 1, scans
    assert scans.count("event_id") == 1, scans
    assert text.count("Expand") == 1  # categories, priorities and the total in one aggregate
    assert len(re.findall(r"Exchange (?:hash|range)partitioning", text)) <= 4 and text.count("Exchange SinglePartition") <= 2
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_date_filter_reaches_parquet(spark):
    L = Ledger.from_fixture(spark, SF_SMALL)
    text = plan(LS.expense_index(L, DateRange(D("1995-01-01"), D("1995-12-31")), Page(10, 0)), executed=False)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", text)
    assert "TakeOrderedAndProject" in text


def test_expense_detail_shuffles_fact_sides_only(spark):
    L = Ledger.from_fixture(spark, SF_SMALL)
    text = plan(EN.expense_detail(L), executed=False)
    # every exchange counts: expense_tag (distinct pairs, aggregate by expense_id) and expense (join by id)
    assert len(re.findall(r"Exchange hashpartitioning", text)) <= 3, text
    assert text.count("BroadcastExchange") >= 3  # the planner's own choice, by size


def test_results_hold_without_broadcast(spark):
    """Gate, update and delete through shuffle joins give the same rows."""
    from oracle_check import compare, duck
    import __spark_entry__ as E

    con = duck(SF_SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("validate_expenses", "exp_update_outcome", "exp_update", "exp_delete_tags"):
            res = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
            assert res["values_match"], res
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_bucketed_detail_shuffles_no_fact_table(spark, small_ledger, tmp_path):
    from tillbook.sources.buckets import bucketed, read_bucketed

    L = bucketed(small_ledger, "plan_test", str(tmp_path), buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so that the tags are not broadcast either
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        tags = EN.tag_arrays(L.replace(tag=L.tag.hint("broadcast")))
        joined = L.expense.join(tags.withColumnRenamed("expense_id", "id"), "id", "left")
        text = plan(joined, executed=False)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "Exchange hashpartitioning" not in text, text
    again = read_bucketed(spark, small_ledger, "plan_test")
    rows = lambda l: sorted(tuple(map(str, r)) for r in EN.expense_detail(l).collect())
    assert rows(again) == rows(small_ledger)


def test_latest_is_one_plan(spark, store):
    """No job runs before the plan is executed, and the id reaches the reader."""
    led = store.read()
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("latest", "latest")
    try:
        top = EN.latest_expense(led)
        assert not jobs.getJobIdsForGroup("latest")
        text = plan(top, executed=False)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "subquery" in text.lower()
    assert re.search(r"ReadSchema: struct<id:int>", text), text


def test_a_far_page_numbers_ids_only(spark, store, monkeypatch):
    seen = []
    plain = LS.with_positions
    monkeypatch.setattr(LS, "with_positions", lambda df, *a: (seen.append(df.columns), plain(df, *a))[1])
    rows = LS.expense_index(store.read(), DateRange(), Page(2, 3), strategy="positions").collect()
    assert [r.id for r in rows] == [4, 5] and seen == [["id"]]


def test_expense_elements_are_dealt_once(spark):
    """Lines and orders are dealt by batch; the JSON texts of the elements are not shuffled."""
    from tillbook.sources import requests as RQ

    plan = RQ.expense_request_documents(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_flags_of_elements_do_not_shuffle_them(spark, fixture_ledger):
    """Offending keys and rejected batches are small tables of known size: the elements stay where they are."""
    from tillbook.operators import validate as V
    from tillbook.sources import requests as RQ

    v = V.validate_expense_batches(fixture_ledger, RQ.expense_request_documents(spark, SF_SMALL))
    assert "Exchange hashpartitioning" not in v._jdf.queryExecution().executedPlan().toString()
    assert v.filter("NOT batch_ok").count() > 0


def test_expense_documents_of_repeated_and_null_keys(spark, tmp_path):
    """Orders that come twice give two elements, each with all the tags; a null key has none."""
    from tillbook.sources import requests as RQ

    spark.sql("SELECT * FROM VALUES (1L, 3L, 10.5D, '1-URGENT', 'F', DATE'1996-01-02'), (1L, 3L, 10.5D, '1-URGENT', 'F', DATE'1996-01-02'), "
              "(2L, 4L, 7.0D, '2-HIGH', 'O', DATE'1996-01-03'), (22L, 4L, 7.0D, '2-HIGH', 'O', DATE'1996-01-03'), (CAST(NULL AS LONG), 4L, 7.0D, '2-HIGH', 'O', DATE'1996-01-03') "
              "t(o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus, o_orderdate)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT * FROM VALUES (1L, 9L), (1L, 4L), (1L, 9L), (22L, 5L), (CAST(NULL AS LONG), 6L), (400L, 6L) t(l_orderkey, l_partkey)").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = RQ.expense_request_elements(spark, str(tmp_path)).selectExpr("batch_id", "pos", "get_json_object(element, '$.tagIds') AS tags").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(0, 1, "[5,10]"), (0, 1, "[5,10]"), (0, 2, "[]"), (1, 2, "[6]"), (None, None, "[]")], key=str)


def test_expense_tags_are_made_distinct_by_a_sort(spark, tmp_path):
    """Pairs are dealt once, by expense, and no hash map holds them all; null and repeated ones stand once."""
    from tillbook.sources import fixtures as FX

    spark.sql("SELECT * FROM VALUES (1L, 9L), (1L, 4L), (1L, 9L), (CAST(NULL AS LONG), 6L), (CAST(NULL AS LONG), 6L), (2L, CAST(NULL AS LONG)), "
              "(2L, CAST(NULL AS LONG)) t(l_orderkey, l_partkey)").write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = FX.expense_tag(spark, str(tmp_path))
    assert sorted(((r.expense_id, r.tag_id) for r in pairs.collect()), key=str) == sorted([(2, 10), (2, 5), (None, 7), (3, None)], key=str)
    text = plan(pairs, executed=False)
    assert "HashAggregate" not in text and text.count("Exchange hashpartitioning") == 1
