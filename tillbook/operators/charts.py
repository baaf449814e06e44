"""Chart feeds (CH-BAR, CH-SUNBURST, CH-SANKEY) as flat tables.

The published contract names three chart types over the summary's
parameters but defines no data layout; these tables are ours, built from
the same tiny summary aggregates (one pass over each fact table). Every
node key carries a type prefix and an id, so same-named wallets or
categories never collide. Drawing is not done here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.ledger import Ledger
from tillbook.operators import summary as S
from tillbook.params import SummaryParams


def _key(prefix: str, *parts) -> F.Column:
    return F.concat_ws(":", F.lit(prefix), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])


def _pieces(ledger: Ledger, p: SummaryParams):
    groups = S.expense_groups(ledger, p)
    cats = S.category_summary(ledger, groups)
    parents = S.parent_summary(cats)
    prios = S.priority_summary(groups)
    wallets = S.wallet_summary(ledger, S.income_groups(ledger, p))
    return cats, parents, prios, wallets


def bar(ledger: Ledger, p: SummaryParams) -> DataFrame:
    """series, key, label, amount — parent categories (kept ones), priority
    levels and wallets, each a bar series."""
    _, parents, prios, wallets = _pieces(ledger, p)
    return (parents.select(F.lit("parent_category").alias("series"), _key("parent", "id").alias("key"),
                           F.col("name").alias("label"), "amount")
            .unionByName(prios.select(F.lit("priority").alias("series"), _key("priority", "level").alias("key"),
                                      F.col("level").cast("string").alias("label"), "amount"))
            .unionByName(wallets.select(F.lit("wallet").alias("series"), _key("wallet", "wallet_id").alias("key"),
                                        F.col("name").alias("label"), "amount")))


def sunburst(ledger: Ledger, p: SummaryParams) -> DataFrame:
    """level, key, parent_key, name, amount — ring 1: parents, ring 2: their
    categories with a positive sum (the summary's own filter)."""
    cats, parents, _, _ = _pieces(ledger, p)
    ring1 = parents.select(F.lit(1).alias("level"), _key("parent", "id").alias("key"),
                           F.lit(None).cast("string").alias("parent_key"), "name", "amount")
    ring2 = cats.filter(F.col("amount") > 0).select(
        F.lit(2).alias("level"), _key("category", "parent_id", "name").alias("key"),
        _key("parent", "parent_id").alias("parent_key"), "name", "amount")
    return ring1.unionByName(ring2)


def sankey(ledger: Ledger, p: SummaryParams) -> DataFrame:
    """source, target, source_label, target_label, amount — wallet -> income,
    income -> parent category, parent category -> category."""
    cats, parents, _, wallets = _pieces(ledger, p)
    w = wallets.select(_key("wallet", "wallet_id").alias("source"), F.lit("income").alias("target"),
                       F.col("name").alias("source_label"), F.lit("Income").alias("target_label"), "amount")
    ip = parents.select(F.lit("income").alias("source"), _key("parent", "id").alias("target"),
                        F.lit("Income").alias("source_label"), F.col("name").alias("target_label"), "amount")
    pc = cats.filter(F.col("amount") > 0).select(
        _key("parent", "parent_id").alias("source"), _key("category", "parent_id", "name").alias("target"),
        F.col("parent_name").alias("source_label"), F.col("name").alias("target_label"), "amount")
    return w.unionByName(ip).unionByName(pc)
