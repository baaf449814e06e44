"""Enriched views and latest record (Q-EXP-DETAIL, Q-EXP-LATEST, Q-INC-*).

Expense detail = expense + category{id,name} + wallet{id,name} +
tags[{id,name,isImportant}] (important first, then name; [] when none).
Tags are aggregated per expense *before* the join: expense_tag joined to the
broadcast tag dimension, grouped by expense_id (each group holds at most
|tag| rows because (expense_id, tag_id) is a key), then left-joined to
expenses. The aggregate is already hash-partitioned by expense_id, so only
the expense side is shuffled for the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.nested import date_text, ordered_collect
from tillbook.ledger import Ledger


def _entity(id_col: str, name_col: str):
    return F.struct(F.col(id_col).alias("id"), F.col(name_col).alias("name"))


def tag_arrays(ledger: Ledger, expense_tag: DataFrame | None = None) -> DataFrame:
    """(expense_id, tags array) for every expense that has at least one tag."""
    et = ledger.expense_tag if expense_tag is None else expense_tag
    tag = ledger.tag.select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name"),
                                   F.col("is_important").alias("tag_important"))
    item = F.struct(F.col("tag_id").alias("id"), F.col("tag_name").alias("name"),
                    F.col("tag_important").alias("isImportant"))
    return (et.select("expense_id", "tag_id").join(tag, "tag_id")
            .groupBy("expense_id")
            .agg(ordered_collect(item, F.when(F.col("tag_important"), 0).otherwise(1),
                                 F.col("tag_name"), F.col("tag_id")).alias("tags")))


def _expense_shape(ledger: Ledger, expenses: DataFrame, tags: DataFrame, small_tags: bool = False) -> DataFrame:
    cat = ledger.category.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    wal = ledger.wallet.select(F.col("id").alias("wallet_id"), F.col("name").alias("wallet_name"))
    e = (expenses.select("id", "amount", "date", "description", "priority", "category_id", "wallet_id")
         .join(cat, "category_id").join(wal, "wallet_id"))
    tags = tags.withColumnRenamed("expense_id", "id")
    e = e.join(F.broadcast(tags) if small_tags else tags, "id", "left")
    return e.select(
        "id", "amount", date_text("date").alias("date"), "description", "priority",
        _entity("category_id", "category_name").alias("category"),
        _entity("wallet_id", "wallet_name").alias("wallet"),
        F.coalesce(F.col("tags"), F.array()).alias("tags"),
    )


def expense_detail(ledger: Ledger, ids: DataFrame | None = None) -> DataFrame:
    """Q-EXP-DETAIL over the whole ledger, or over the expense ids in ``ids``
    (a one-column ``id`` frame, applied as a semi join on both fact tables)."""
    expenses, et = ledger.expense, ledger.expense_tag
    if ids is not None:
        expenses = expenses.join(ids.select("id"), "id", "left_semi")
        et = et.join(ids.select(F.col("id").alias("expense_id")), "expense_id", "left_semi")
    return _expense_shape(ledger, expenses, tag_arrays(ledger, et))


def _top_id(df: DataFrame) -> Column:
    """The highest id as a scalar subquery over the id column: it runs in the
    plan that uses it, and its value reaches the parquet reader as a filter."""
    return df.agg(F.max("id")).scalar()


def latest_expense(ledger: Ledger) -> DataFrame:
    """Q-EXP-LATEST: the expense with the highest id (no row when empty).
    The expense and its tags are read with filters on that id, which skip row
    groups of the id-clustered store."""
    top = ledger.expense.filter(F.col("id") == _top_id(ledger.expense))
    et = ledger.expense_tag.filter(F.col("expense_id") == _top_id(ledger.expense))
    # one expense: its tag array is a single row, so broadcasting it is bounded
    return _expense_shape(ledger, top, tag_arrays(ledger, et), small_tags=True)


def _income_shape(ledger: Ledger, incomes: DataFrame) -> DataFrame:
    wal = ledger.wallet.select(F.col("id").alias("wallet_id"), F.col("name").alias("wallet_name"))
    i = incomes.select("id", "amount", "date", "description", "wallet_id").join(wal, "wallet_id")
    return i.select("id", "amount", date_text("date").alias("date"), "description",
                    _entity("wallet_id", "wallet_name").alias("wallet"))


def income_detail(ledger: Ledger, ids: DataFrame | None = None) -> DataFrame:
    """Q-INC-DETAIL: income + wallet{id,name}."""
    incomes = ledger.income
    if ids is not None:
        incomes = incomes.join(ids.select("id"), "id", "left_semi")
    return _income_shape(ledger, incomes)


def latest_income(ledger: Ledger) -> DataFrame:
    """Q-INC-LATEST: the income with the highest id, with its wallet."""
    return _income_shape(ledger, ledger.income.filter(F.col("id") == _top_id(ledger.income)))
