"""The ledger: eight typed DataFrames and the highest ids ever handed out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Ledger:
    spark: SparkSession
    wallet: DataFrame
    parent_category: DataFrame
    category: DataFrame
    tag: DataFrame
    expense: DataFrame
    expense_tag: DataFrame
    income: DataFrame
    wallet_transfer: DataFrame
    # highest id ever handed out by table, where a store keeps it
    max_ids: dict = field(default_factory=dict, compare=False, repr=False)

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def replace(self, **tables: DataFrame) -> "Ledger":
        """A new ledger version with some tables swapped (change-set output)."""
        current = {name: getattr(self, name) for name in (
            "wallet", "parent_category", "category", "tag",
            "expense", "expense_tag", "income", "wallet_transfer")}
        current.update(tables)
        return Ledger(self.spark, max_ids=self.max_ids, **current)

    @classmethod
    def from_fixture(cls, spark: SparkSession, sf_dir: str) -> "Ledger":
        from tillbook.sources.fixtures import fixture_ledger

        return fixture_ledger(spark, sf_dir)

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> "Ledger":
        from tillbook.sources.store import read_ledger

        return read_ledger(spark, root)
