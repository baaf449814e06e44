"""Ledger tables derived from the driver's TPC-H-like parquet tables.

The mapping (which driver column feeds which ledger column) is fixed by
FIXTURES.md §4; it is expressed here with the DataFrame API so that scans
prune columns and push filters like any other plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillbook import schemas

def null_ts():
    return F.lit(None).cast("timestamp")


# Table handles are opened once per session and directory: a DataFrame is an
# immutable plan, and the driver's inputs are read-only.
_HANDLES: dict[tuple[str, str], DataFrame] = {}
_LEDGERS: dict[tuple[str, str], object] = {}


def _session_key(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:  # sessions without a local SparkContext (Spark Connect)
        return f"session-{id(spark)}"


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; column pruning and filters reach the parquet reader."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (_session_key(spark), path)
    if key not in _HANDLES:
        _HANDLES[key] = spark.read.parquet(path)
    return _HANDLES[key]


def _int(c):
    return c.cast("int")


def parent_category(spark, sf_dir):
    region = read_driver_table(spark, sf_dir, "region")
    base = region.select(_int(F.col("r_regionkey") + 1).alias("id"), F.col("r_name").alias("name"))
    # one parent without children
    empty = spark.range(1).select(F.lit(6).cast("int").alias("id"), F.lit("EMPTY").alias("name"))
    return base.unionByName(empty)


def category(spark, sf_dir):
    n = read_driver_table(spark, sf_dir, "nation")
    suffix = (F.col("n_nationkey") % 20).cast("string")
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("nation_"), suffix)).otherwise(
        F.concat(F.lit("NATION_"), suffix))
    return n.select(_int(F.col("n_nationkey") + 1).alias("id"),
                    _int(F.col("n_regionkey") + 1).alias("parent_category_id"), name.alias("name"))


def wallet(spark, sf_dir):
    # every nation is a wallet: a small dimension at every scale; the last two share a name
    n = read_driver_table(spark, sf_dir, "nation")
    name = F.when(F.col("n_nationkey") >= 23, F.lit("Shared")).otherwise(F.col("n_name"))
    return n.select(_int(F.col("n_nationkey") + 1).alias("id"), name.alias("name"))


def tag(spark, sf_dir):
    p = read_driver_table(spark, sf_dir, "part")
    return p.select(_int(F.col("p_partkey") + 1).alias("id"), F.col("p_name").alias("name"),
                    (F.col("p_size") > 25).alias("is_important"))


def expense(spark, sf_dir):
    o = read_driver_table(spark, sf_dir, "orders")
    cust = F.col("o_custkey")
    priority = (F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 0)
                .when(F.col("o_orderpriority") == "3-MEDIUM", 1).otherwise(2))
    return o.select(
        _int(F.col("o_orderkey") + 1).alias("id"),
        _int(cust % 24 + 1).alias("category_id"),
        _int(cust % 25 + 1).alias("wallet_id"),
        F.when(cust % 24 == 14, F.lit(0)).otherwise(_int(F.floor("o_totalprice"))).alias("amount"),
        F.col("o_orderdate").cast("date").alias("date"),
        _int(priority).alias("priority"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("order "), F.col("o_orderstatus"))).alias("description"),
        null_ts().alias("created_at"), null_ts().alias("updated_at"),
    )


def expense_tag(spark, sf_dir):
    li = read_driver_table(spark, sf_dir, "lineitem")
    pairs = li.select(_int(F.col("l_orderkey") + 1).alias("expense_id"), _int(F.col("l_partkey") + 1).alias("tag_id"))
    # dealt by expense, as every join and grouping after is, and made distinct by a sort that can spill:
    # pairs hardly repeat, so a hash map would hold them all, before the shuffle and after
    same = Window.partitionBy("expense_id", "tag_id").orderBy("expense_id", "tag_id")
    pairs = pairs.repartition("expense_id").withColumn("_nth", F.row_number().over(same)).filter(F.col("_nth") == 1)
    return pairs.select("expense_id", "tag_id", null_ts().alias("created_at"), null_ts().alias("updated_at"))


def income(spark, sf_dir):
    ev = read_driver_table(spark, sf_dir, "events")
    return ev.select(
        _int(F.col("event_id") + 1).alias("id"),
        _int(F.greatest(F.ceil("value"), F.lit(1))).alias("amount"),
        _int(F.col("user_id") % 25 + 1).alias("wallet_id"),
        F.date_add(F.lit("1995-01-01").cast("date"), _int(F.col("event_id") % 2400)).alias("date"),
        F.col("event_type").alias("description"),
        null_ts().alias("created_at"), null_ts().alias("updated_at"),
    )


def wallet_transfer_empty(spark):
    return spark.createDataFrame([], schemas.WALLET_TRANSFER)


def transfer_request(spark, sf_dir):
    """Transfer requests (flat, typed) incl. invalid and same-wallet ones."""
    c = read_driver_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        _int(k + 1).alias("request_id"),
        _int(k % 25 + 1).alias("source_wallet_id"),
        _int((k * 3 + 4) % 25 + 1).alias("target_wallet_id"),
        _int(F.floor("c_acctbal")).alias("amount"),
        _int(k % 4).alias("fee"),
        F.date_add(F.lit("1995-01-01").cast("date"), _int(k % 2400)).alias("date"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("description"),
    )


def fixture_ledger(spark: SparkSession, sf_dir: str):
    """The ledger mapped from one driver directory (one instance per session
    and directory)."""
    key = (_session_key(spark), sf_dir.rstrip("/"))
    if key not in _LEDGERS:
        _LEDGERS[key] = _build_ledger(spark, sf_dir)
    return _LEDGERS[key]


def _build_ledger(spark: SparkSession, sf_dir: str):
    from tillbook.ledger import Ledger

    return Ledger(
        spark,
        wallet=wallet(spark, sf_dir),
        parent_category=parent_category(spark, sf_dir),
        category=category(spark, sf_dir),
        tag=tag(spark, sf_dir),
        expense=expense(spark, sf_dir),
        expense_tag=expense_tag(spark, sf_dir),
        income=income(spark, sf_dir),
        wallet_transfer=wallet_transfer_empty(spark),
    )
