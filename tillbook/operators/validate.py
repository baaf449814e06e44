"""Ingest validation: request rows -> rows with reason codes and a status.

Field rules (V-DATE, V-NONNEG, V-POS, V-POS-VEC, V-PRIORITY, V-TYPE,
V-REQUIRED) are per-row expressions; table rules (V-FK, V-UNIQ) are joins
against the dimensions; the batch gate (V-ATOMIC) rejects
every element of a batch that holds any rejected element.

Scale notes: rows are parsed and checked field by field once, then fixed
in a written table; everything after reads that table. Unknown tags are
found with an explode + anti join against the tag dimension; they, the
offending element keys and the ids of rejected batches are small tables
written first and joined back, so the planner broadcasts them by their bytes
and the elements stay where they are. Beyond that size both sides are
shuffled; the batch gate never groups a batch's rows together, and AQE splits
a shuffle partition if one batch is huge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions import rules as R
from tillbook.ledger import Ledger
from tillbook.plans.materialize import fix


def _known(ledger: Ledger, table: str, key: str, flag: str) -> DataFrame:
    return ledger.table(table).select(F.col("id").alias(key), F.lit(True).alias(flag))


def _flag_keys(x: DataFrame, offending: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """x + boolean ``flag`` for rows whose key is in ``offending`` (keys only).
    The keys are fixed first, so that the planner knows their bytes before it
    would shuffle x to meet them."""
    return x.join(fix(offending.select(*keys).distinct()).withColumn(flag, F.lit(True)), keys, "left")


def _passthrough(parsed: DataFrame) -> list[str]:
    return [c for c in ("doc_ok",) if c in parsed.columns]


def expense_rules(ledger: Ledger, parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Columns ``keys``, e [, doc_ok] -> keys + typed fields + reasons + status."""
    extra = _passthrough(parsed)
    x = parsed.select(*keys, *extra, "e.*")
    x = (x.join(_known(ledger, "category", "categoryId", "_cat_ok"), "categoryId", "left")
         .join(_known(ledger, "wallet", "walletId", "_wal_ok"), "walletId", "left"))
    x = fix(x)
    tag_ids = ledger.tag.select(F.col("id").alias("_tag"))
    # the distinct ids meet the tag table, and only the few unknown ones meet the elements again
    named = x.select(*keys, F.explode("tagIds").alias("_tag")).filter(F.col("_tag") >= 1)
    unknown = fix(named.select("_tag").distinct().join(tag_ids, "_tag", "left_anti"))
    x = _flag_keys(x, named.join(unknown, "_tag", "left_semi"), keys, "_tag_unknown")
    corrupt = F.col("_corrupt")
    doc = F.col("doc_ok") if extra else F.lit(True)
    reasons = R.reasons(
        F.col("_readable"), F.col("_mistyped"),
        R.missing("amount", F.col("amount"), corrupt), R.non_negative("amount", F.col("amount")),
        R.date_rule("date", F.col("date")),
        R.missing("priority", F.col("priority"), corrupt), R.priority_range("priority", F.col("priority")),
        R.missing("categoryId", F.col("categoryId"), corrupt), R.positive("categoryId", F.col("categoryId")),
        R.missing("walletId", F.col("walletId"), corrupt), R.positive("walletId", F.col("walletId")),
        R.missing("tagIds", F.col("tagIds"), corrupt), R.positive_vector("tagIds", F.col("tagIds")),
        R.distinct_vector("tagIds", F.col("tagIds")),
        F.when((F.col("categoryId") >= 1) & F.col("_cat_ok").isNull(), F.lit("categoryId:unknown")),
        F.when((F.col("walletId") >= 1) & F.col("_wal_ok").isNull(), F.lit("walletId:unknown")),
        F.when(F.col("_tag_unknown"), F.lit("tagIds:unknown")),
    )
    # a malformed document carries only its document reason
    reasons = F.when(F.coalesce(doc, F.lit(True)), reasons).otherwise(F.array(F.lit("document:invalid")))
    return x.select(
        *keys, *extra,
        F.col("amount"), R.strict_date(F.col("date")).alias("date"), F.col("description"),
        F.col("priority"), F.col("categoryId").alias("category_id"), F.col("walletId").alias("wallet_id"),
        F.col("tagIds").alias("tag_ids"), reasons.alias("reasons"),
    ).withColumn("status", R.status(F.col("reasons")))


def income_rules(ledger: Ledger, parsed: DataFrame, keys: list[str]) -> DataFrame:
    extra = _passthrough(parsed)
    x = parsed.select(*keys, *extra, "e.*")
    x = fix(x.join(_known(ledger, "wallet", "walletId", "_wal_ok"), "walletId", "left"))
    corrupt = F.col("_corrupt")
    reasons = R.reasons(
        F.col("_readable"), F.col("_mistyped"),
        R.missing("amount", F.col("amount"), corrupt), R.positive("amount", F.col("amount")),
        R.date_rule("date", F.col("date")),
        R.missing("walletId", F.col("walletId"), corrupt), R.positive("walletId", F.col("walletId")),
        F.when((F.col("walletId") >= 1) & F.col("_wal_ok").isNull(), F.lit("walletId:unknown")),
    )
    if extra:
        reasons = F.when(F.coalesce(F.col("doc_ok"), F.lit(True)), reasons).otherwise(
            F.array(F.lit("document:invalid")))
    return x.select(
        *keys, *extra, F.col("amount"), R.strict_date(F.col("date")).alias("date"), F.col("description"),
        F.col("walletId").alias("wallet_id"), reasons.alias("reasons"),
    ).withColumn("status", R.status(F.col("reasons")))


def gate_batches(checked: DataFrame, mode: str = "fail_batch") -> DataFrame:
    """Adds ``batch_ok``.

    fail_batch: a batch is accepted only if its document parsed and every
    element is ok (one bad row rejects the whole batch, as a request does).
    quarantine: ``batch_ok`` only reflects a malformed document; good rows of
    a batch with bad rows are kept.
    """
    if mode not in ("fail_batch", "quarantine"):
        raise ValueError(f"unknown mode {mode!r}")
    bad = ~F.col("doc_ok")
    if mode == "fail_batch":
        bad = bad | (F.col("status") != "ok")
    rejected = checked.filter(bad).select("batch_id")
    return _flag_keys(checked, rejected, ["batch_id"], "_rejected").withColumn(
        "batch_ok", F.col("_rejected").isNull()).drop("_rejected", "doc_ok")


def validate_expense_batches(ledger: Ledger, docs: DataFrame, mode: str = "fail_batch") -> DataFrame:
    """(batch_id, value) documents -> one row per element (+ one per bad document)."""
    from tillbook.sources.batches import expense_elements

    return gate_batches(expense_rules(ledger, expense_elements(docs), ["batch_id", "pos"]), mode)


def validate_income_batches(ledger: Ledger, docs: DataFrame, mode: str = "fail_batch") -> DataFrame:
    from tillbook.sources.batches import income_elements

    return gate_batches(income_rules(ledger, income_elements(docs), ["batch_id", "pos"]), mode)


def validate_transfers(ledger: Ledger, docs: DataFrame, fee_category_id: int = 25) -> DataFrame:
    """(request_id, value) transfer requests -> typed fields + reasons + status.

    Same source and target wallet is a conflict, as are unknown wallets and,
    for a non-zero fee, an unknown fee category."""
    from tillbook.sources.batches import transfer_requests

    x = transfer_requests(docs).select("request_id", "e.*")
    x = (x.join(_known(ledger, "wallet", "sourceWalletId", "_src_ok"), "sourceWalletId", "left")
         .join(_known(ledger, "wallet", "targetWalletId", "_dst_ok"), "targetWalletId", "left"))
    # a non-zero fee becomes an expense in the fee category, which must exist
    fee_cat = ledger.category.filter(F.col("id") == F.lit(fee_category_id)).select(
        F.col("id").alias("_fee_cat"), F.lit(True).alias("_fee_cat_ok"))
    x = x.withColumn("_fee_cat", F.when(F.col("fee") != 0, F.lit(fee_category_id))).join(fee_cat, "_fee_cat", "left")
    corrupt = F.col("_corrupt")
    reasons = R.reasons(
        F.col("_readable"), F.col("_mistyped"),
        R.missing("sourceWalletId", F.col("sourceWalletId"), corrupt), R.positive("sourceWalletId", F.col("sourceWalletId")),
        R.missing("targetWalletId", F.col("targetWalletId"), corrupt), R.positive("targetWalletId", F.col("targetWalletId")),
        R.missing("amount", F.col("amount"), corrupt), R.non_negative("amount", F.col("amount")),
        R.missing("fee", F.col("fee"), corrupt), R.non_negative("fee", F.col("fee")),
        R.date_rule("date", F.col("date")),
        F.when(F.col("sourceWalletId") == F.col("targetWalletId"), F.lit("wallet:same_wallet")),
        F.when((F.col("sourceWalletId") >= 1) & F.col("_src_ok").isNull(), F.lit("sourceWalletId:unknown")),
        F.when((F.col("targetWalletId") >= 1) & F.col("_dst_ok").isNull(), F.lit("targetWalletId:unknown")),
        F.when((F.col("fee") > 0) & F.col("_fee_cat_ok").isNull(), F.lit("feeCategory:unknown")),
    )
    # fixed once: transfer rows and fee expenses both number these rows
    return fix(x.select(
        "request_id", F.col("sourceWalletId").alias("source_wallet_id"),
        F.col("targetWalletId").alias("target_wallet_id"), "amount", "fee",
        R.strict_date(F.col("date")).alias("date"), "description", reasons.alias("reasons"),
    ).withColumn("status", R.status(F.col("reasons"))))


def validate_summary_requests(docs: DataFrame) -> DataFrame:
    """(request_id, value) summary requests -> request_id, start, end, exclude, reasons, status.

    Both dates are required calendar dates and the id list is required, with
    positive ids; a start after the end is accepted and selects nothing."""
    from tillbook.sources.batches import summary_requests

    x = summary_requests(docs).select("request_id", "e.*")
    corrupt, ids = F.col("_corrupt"), F.col("excludeCategoryIds")
    reasons = R.reasons(
        F.col("_readable"), F.col("_mistyped"),
        R.date_rule("startDate", F.col("startDate")), R.date_rule("endDate", F.col("endDate")),
        R.missing("excludeCategoryIds", ids, corrupt), R.positive_vector("excludeCategoryIds", ids),
    )
    return fix(x.select("request_id", R.strict_date(F.col("startDate")).alias("start"), R.strict_date(F.col("endDate")).alias("end"),
                        ids.alias("exclude"), reasons.alias("reasons")).withColumn("status", R.status(F.col("reasons"))))
