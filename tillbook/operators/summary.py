"""Income / expense summary (the flagship report).

Plan shape: each fact table is scanned once with the date range pushed into
the parquet reader and partially aggregated map-side to at most
(#categories x 3) expense groups and #wallets income groups. Every later step
(category, parent, priority and wallet rollups, the nested document) works on
those tiny aggregates, joined to the dimensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.nested import date_between, ordered_collect
from tillbook.ledger import Ledger
from tillbook.params import SummaryParams
from tillbook.plans.onerow import merge_one_row_frames


def filtered_expense(ledger: Ledger, p: SummaryParams) -> DataFrame:
    """SUM-FILT-EXP: expenses in range whose category is not excluded."""
    e = date_between(ledger.expense, p.start, p.end).select("category_id", "priority", "amount", "date")
    return e.filter(~F.col("category_id").isin(list(p.exclude_category_ids)))


def filtered_income(ledger: Ledger, p: SummaryParams) -> DataFrame:
    """SUM-FILT-INC: incomes in range (exclusions do not apply)."""
    return date_between(ledger.income, p.start, p.end).select("wallet_id", "amount", "date")


def expense_groups(ledger: Ledger, p: SummaryParams) -> DataFrame:
    """Pre-aggregate: (category_id, priority) -> amount, restricted to known
    categories, with the category's parent and name attached.

    This is the only shuffle over expense rows; its output is bounded by the
    category dimension, so every rollup below is a tiny-frame operation.
    """
    g = (filtered_expense(ledger, p).groupBy("category_id", "priority")
         .agg(F.sum("amount").alias("amount")))
    cat = ledger.category.select(
        F.col("id").alias("category_id"), "parent_category_id", F.col("name").alias("category_name"))
    return g.join(cat, "category_id")


def total_expense(groups: DataFrame) -> DataFrame:
    """SUM-TOTAL-EXP: one row, 0 when nothing matches."""
    return groups.agg(F.coalesce(F.sum("amount"), F.lit(0).cast("long")).alias("amount"))


def category_summary(ledger: Ledger, groups: DataFrame) -> DataFrame:
    """SUM-CATEGORY: amount per (parent id, category name); same-named
    categories under one parent merge. Zero sums are kept here. The parent's
    name rides along as a dependent grouping column."""
    parent = ledger.parent_category.select(
        F.col("id").alias("parent_category_id"), F.col("name").alias("parent_name"))
    return (groups.join(parent, "parent_category_id")
            .groupBy(F.col("parent_category_id").alias("parent_id"), "parent_name",
                     F.col("category_name").alias("name"))
            .agg(F.sum("amount").alias("amount")))


def parent_summary(categories: DataFrame) -> DataFrame:
    """SUM-PARENT: drop category sums <= 0, total per parent, categories as an
    array ordered by amount desc (name breaks ties). Parents left empty vanish."""
    return categories.filter(F.col("amount") > 0).groupBy("parent_id", "parent_name").agg(
        F.sum("amount").alias("amount"),
        ordered_collect(F.struct("name", "amount"), -F.col("amount"), F.col("name")).alias("categories"),
    ).select(F.col("parent_id").alias("id"), F.col("parent_name").alias("name"), "amount", "categories")


def priority_summary(groups: DataFrame) -> DataFrame:
    """SUM-PRIORITY: amount per priority level; zero sums kept."""
    return groups.groupBy(F.col("priority").alias("level")).agg(F.sum("amount").alias("amount"))


def income_groups(ledger: Ledger, p: SummaryParams) -> DataFrame:
    """Pre-aggregate of incomes per wallet id (single shuffle over incomes)."""
    return filtered_income(ledger, p).groupBy("wallet_id").agg(F.sum("amount").alias("amount"))


def total_income(inc_groups: DataFrame) -> DataFrame:
    """SUM-TOTAL-INC: one row, 0 when nothing matches."""
    return inc_groups.agg(F.coalesce(F.sum("amount"), F.lit(0).cast("long")).alias("amount"))


def wallet_summary(ledger: Ledger, inc_groups: DataFrame) -> DataFrame:
    """SUM-WALLET (documented intent): income per wallet."""
    w = ledger.wallet.select(F.col("id").alias("wallet_id"), "name")
    return inc_groups.join(w, "wallet_id").select("wallet_id", "name", "amount")


def wallet_summary_compat(ledger: Ledger, p: SummaryParams) -> DataFrame:
    """SUM-WALLET-COMPAT: the deployed grouping, one row per (wallet name,
    distinct income amount) with value amount x occurrences.

    Partial aggregation on (wallet_id, amount) runs map-side; the second
    regroup by name only merges wallets that share a name.
    """
    per_wallet_amount = (filtered_income(ledger, p).groupBy("wallet_id", F.col("amount").alias("unit"))
                         .agg(F.sum("amount").alias("amount")))
    w = ledger.wallet.select(F.col("id").alias("wallet_id"), "name")
    return (per_wallet_amount.join(w, "wallet_id").groupBy("name", "unit")
            .agg(F.sum("amount").alias("amount")).select("name", "amount"))


def summary_totals(ledger: Ledger, p: SummaryParams) -> DataFrame:
    """One row: expense_amount, income_amount."""
    exp = total_expense(expense_groups(ledger, p)).select(F.col("amount").alias("expense_amount"))
    inc = total_income(income_groups(ledger, p)).select(F.col("amount").alias("income_amount"))
    return merge_one_row_frames(exp, inc)


def expense_rollups(ledger: Ledger, groups: DataFrame) -> DataFrame:
    """SUM-CATEGORY, SUM-PRIORITY and SUM-TOTAL-EXP in one aggregate: ``kind``
    says which of them a row belongs to. Grouping sets expand the small
    pre-aggregate, never fact rows."""
    parent = ledger.parent_category.select(F.col("id").alias("parent_category_id"), F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    keys = ["parent_id", "parent_name", "category_name", "priority"]
    rows = groups.join(parent, "parent_category_id", "left").groupingSets([keys[:3], keys[3:], []], *keys).agg(
        F.grouping("category_name").alias("no_category"), F.grouping("priority").alias("no_priority"), F.sum("amount").alias("amount"))
    kind = F.when(F.col("no_category") == 0, "category").when(F.col("no_priority") == 0, "priority").otherwise("total")
    # a category without a known parent counts in priorities and total only
    return rows.select(kind.alias("kind"), *keys, "amount").filter((F.col("kind") != "category") | F.col("parent_id").isNotNull())


def expense_document(rollups: DataFrame) -> DataFrame:
    """One row of ``expense_rollups``: expense_amount, parentCategories and priorities."""
    positive = (F.col("kind") != "category") | (F.col("amount") > 0)  # SUM-PARENT drops category sums <= 0
    by_parent = rollups.filter(positive).groupBy("kind", "parent_id", "parent_name").agg(
        F.sum("amount").alias("amount"),
        ordered_collect(F.struct(F.col("category_name").alias("name"), "amount"), -F.col("amount"), F.col("category_name"),
                        skip_null=F.col("kind") == "category").alias("categories"),
        ordered_collect(F.struct(F.col("priority").alias("level"), "amount"), -F.col("amount"), F.col("priority"),
                        skip_null=F.col("kind") == "priority").alias("levels"))
    return by_parent.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "total", F.col("amount"))), F.lit(0).cast("long")).alias("expense_amount"),
        F.flatten(F.collect_list(F.when(F.col("kind") == "priority", F.col("levels")))).alias("priorities"),  # at most one row
        ordered_collect(F.struct(F.col("parent_name").alias("name"), "amount", "categories"), -F.col("amount"), F.col("parent_name"), F.col("parent_id"),
                        skip_null=F.col("kind") == "category").alias("parentCategories"))


def summary_document(ledger: Ledger, p: SummaryParams) -> DataFrame:
    """SUM-DOC: one row with ``expense`` and ``income`` structs shaped like the
    published summary (camelCase keys). Arrays are bounded by the dimension
    sizes (parents x categories, 3 priorities, wallets).

    One plan: the expense pre-aggregate goes through one chain of aggregates,
    with categories, priorities and the total as grouping sets; income is
    scanned once and its total and wallet array come out of a single aggregate.
    """
    expense_row = expense_document(expense_rollups(ledger, expense_groups(ledger, p)))

    # left join: incomes of an unknown wallet still count in the total
    w = ledger.wallet.select(F.col("id").alias("wallet_id"), "name")
    inc = income_groups(ledger, p).join(w, "wallet_id", "left")
    income_row = inc.agg(
        F.coalesce(F.sum("amount"), F.lit(0).cast("long")).alias("income_amount"),
        ordered_collect(F.struct("name", "amount"), -F.col("amount"), F.col("name"), F.col("wallet_id"),
                        skip_null=F.col("name").isNotNull()).alias("wallets"))

    row = merge_one_row_frames(expense_row, income_row)
    return row.select(
        F.struct(F.col("expense_amount").alias("amount"),
                 F.struct("parentCategories", "priorities").alias("groupSummary")).alias("expense"),
        F.struct(F.col("income_amount").alias("amount"),
                 F.struct("wallets").alias("groupSummary")).alias("income"),
    )
