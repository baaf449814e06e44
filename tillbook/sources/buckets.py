"""Bucketed copies of the expense tables, co-located by expense id.

``expense`` (by ``id``) and ``expense_tag`` (by ``expense_id``) are written as
tables of the session's catalog with the same number of hash buckets, each
sorted inside. An aggregation or join by expense id reads matching buckets
together, so neither table is shuffled for it, however often it runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillbook.ledger import Ledger

#: Buckets at least; a bucket should hold what one task can sort in memory.
BUCKETS = 64


def _write(df: DataFrame, key: str, name: str, path: str, buckets: int) -> DataFrame:
    # dealt by the bucket hash first, so that each bucket is one file
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("errorifexists")
     .format("parquet").saveAsTable(name))
    return df.sparkSession.table(name)


def bucketed(ledger: Ledger, prefix: str, folder: str, buckets: int = BUCKETS) -> Ledger:
    """``ledger`` with its expense tables written to ``folder`` as tables ``<prefix>_expense`` and ``<prefix>_expense_tag``."""
    return ledger.replace(
        expense=_write(ledger.expense, "id", f"{prefix}_expense", f"{folder}/expense", buckets),
        expense_tag=_write(ledger.expense_tag, "expense_id", f"{prefix}_expense_tag", f"{folder}/expense_tag", buckets))


def read_bucketed(spark: SparkSession, ledger: Ledger, prefix: str) -> Ledger:
    """``ledger`` with its expense tables read from bucketed tables written before."""
    return ledger.replace(expense=spark.table(f"{prefix}_expense"), expense_tag=spark.table(f"{prefix}_expense_tag"))
