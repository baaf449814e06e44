"""Summaries for a table of requests, from day cubes that change sets keep up to date.

* A day cube holds one cell for each day and key: the sum and the number of
  its rows (expenses by category and priority, incomes by wallet). It is the
  only thing made from a fact table, in one aggregation, however many requests
  are answered from it.
* ``running_totals`` turns it into prefix sums: for every key and calendar day
  the totals up to that day, so a sum over a date range is the difference of
  two look-ups by day. A request is two rows in that join (end of the range,
  day before its start), whatever its length. Windows are by key, with one row
  for each day, so they are bounded by the calendar, not by the data.
* ``request_documents`` joins each request's cells to the dimensions. The
  cells are dealt by request once; every later grouping and join is by
  request first and needs no further shuffle.
* A change set moves a cube by signed cells: minus what its rows were, plus
  what they are now. Only months with such cells are read and written again
  (``merge_cells``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillbook.functions.nested import ordered_collect
from tillbook.ledger import Ledger
from tillbook.plans.materialize import fix

EXPENSE_KEY = ("category_id", "priority")
INCOME_KEY = ("wallet_id",)


# ---- cubes ------------------------------------------------------------------


def day_cells(rows: DataFrame, key: tuple[str, ...], sign: int = 1) -> DataFrame:
    """(date, *key, amount, n): sum and number of the rows of each day and key, negated for sign -1."""
    return rows.groupBy("date", *key).agg((F.sum("amount") * sign).alias("amount"), (F.count(F.lit(1)) * sign).alias("n"))


def expense_cube(ledger: Ledger) -> DataFrame:
    return day_cells(ledger.expense, EXPENSE_KEY)


def income_cube(ledger: Ledger) -> DataFrame:
    return day_cells(ledger.income, INCOME_KEY)


def signed_cells(key: tuple[str, ...], before: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """What replacing the rows ``before`` by the rows ``after`` adds to a cube;
    cells that cancel out are left out."""
    parts = [day_cells(rows.select("date", *key, "amount"), key, sign) for rows, sign in ((before, -1), (after, 1)) if rows is not None]
    cells = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return (cells.groupBy("date", *key).agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))
            .filter((F.col("amount") != 0) | (F.col("n") != 0)))


def update_cells(base: DataFrame, outcome: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Signed cells of an update: ``outcome`` as the update operators return it."""
    applied = outcome.filter(F.col("status") == "ok")
    return signed_cells(key, base.join(applied.select("id"), "id", "left_semi"), applied)


def delete_cells(base: DataFrame, ids: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return signed_cells(key, base.join(ids.select("id"), "id", "left_semi"))


def write_cube(cells: DataFrame, path: str) -> None:
    """A stored cube: Parquet, one folder for each month."""
    _by_month(cells).write.mode("errorifexists").partitionBy("month").parquet(path)


def read_cube(spark: SparkSession, path: str, key: tuple[str, ...]) -> DataFrame:
    """(month, date, *key, amount, n); cells whose rows have all gone are left out."""
    schema = "date date, " + ", ".join(f"{k} int" for k in key) + ", amount bigint, n bigint, month date"
    return spark.read.schema(schema).parquet(path).filter(F.col("n") > 0)


def _by_month(cells: DataFrame) -> DataFrame:
    return cells.withColumn("month", F.trunc("date", "month")).repartition("month")


def merge_cells(spark: SparkSession, path: str, key: tuple[str, ...], signed: DataFrame) -> None:
    """Adds signed cells to a stored cube. Months without any stay untouched.

    The merged months are written as a table first and then put in place by a
    dynamic partition overwrite, so a repeated overwrite gives the same cube.
    Cells stay, with n = 0, when their last row has gone, so that a month that
    empties is overwritten too. One writer at a time is assumed.
    """
    signed = fix(signed.withColumn("month", F.trunc("date", "month")))
    # the comparison tells the optimizer that the months are selective: partitions are pruned at run time
    months = signed.filter((F.col("amount") != 0) | (F.col("n") != 0)).select("month").distinct()
    stored = spark.read.parquet(path).join(months, "month", "left_semi")
    merged = stored.unionByName(signed).groupBy("month", "date", *key).agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))
    out = fix(merged)
    out.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


# ---- requests ---------------------------------------------------------------


def running_totals(cells: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(day, *key, amount_to, n_to): for each key the totals of all days up to
    ``day``, for every calendar day from the key's first to the cube's last."""
    by_key = Window.partitionBy(*key).orderBy("date")
    to_date = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = cells.agg(F.max("date")).scalar()
    steps = cells.select("date", *key, F.sum("amount").over(to_date).alias("amount_to"), F.sum("n").over(to_date).alias("n_to"),
                         F.date_sub(F.lead("date").over(by_key), 1).alias("until"))
    days = F.sequence("date", F.coalesce("until", last))
    return steps.select(*key, "amount_to", "n_to", F.explode(days).alias("day"))


def _range_cells(requests: DataFrame, cells: DataFrame, key: tuple[str, ...], keep: Column | None = None) -> DataFrame:
    """(request_id, *key, amount): the cube's sum in each request's range, for keys with rows in it."""
    totals = running_totals(cells, key)
    last = cells.agg(F.max("date")).scalar()
    ends = F.array(F.struct(F.lit(1).alias("sign"), F.least(F.col("end"), last).alias("day")),
                   F.struct(F.lit(-1).alias("sign"), F.least(F.date_sub("start", 1), last).alias("day")))
    points = requests.filter(F.col("start") <= F.col("end")).select("request_id", "exclude", F.explode(ends).alias("p"))
    points = points.select("request_id", "exclude", "p.sign", "p.day")
    # requests lie in few files, and each point meets every key: dealt first, or few tasks would make all the cells
    found = points.repartition("request_id", "sign").join(totals, "day")
    if keep is not None:
        found = found.filter(keep)
    signed = found.select("request_id", *key, (F.col("sign") * F.col("amount_to")).alias("amount"), (F.col("sign") * F.col("n_to")).alias("n"))
    # dealt by request once, for all that follows
    sums = signed.repartition("request_id").groupBy("request_id", *key).agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))
    return sums.filter(F.col("n") > 0).drop("n")


def expense_answers(ledger: Ledger, requests: DataFrame, cube: DataFrame) -> DataFrame:
    """(request_id, category_id, priority, amount, parent_category_id, category_name)."""
    allowed = ~F.array_contains("exclude", F.col("category_id"))
    cat = ledger.category.select(F.col("id").alias("category_id"), "parent_category_id", F.col("name").alias("category_name"))
    return _range_cells(requests, cube, EXPENSE_KEY, allowed).join(cat, "category_id")


def income_answers(ledger: Ledger, requests: DataFrame, cube: DataFrame) -> DataFrame:
    """(request_id, wallet_id, amount, name); the name of an unknown wallet is null."""
    w = ledger.wallet.select(F.col("id").alias("wallet_id"), "name")
    return _range_cells(requests, cube, INCOME_KEY).join(w, "wallet_id", "left")


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast("long"))


def request_totals(ledger: Ledger, requests: DataFrame, expense_cells: DataFrame, income_cells: DataFrame) -> DataFrame:
    """SUM-TOTAL-EXP / -INC for each request: (request_id, expense_amount, income_amount)."""
    spent = expense_answers(ledger, requests, expense_cells).groupBy("request_id").agg(F.sum("amount").alias("_spent"))
    earned = income_answers(ledger, requests, income_cells).groupBy("request_id").agg(F.sum("amount").alias("_earned"))
    out = requests.select("request_id").join(spent, "request_id", "left").join(earned, "request_id", "left")
    return out.select("request_id", _zero("_spent").alias("expense_amount"), _zero("_earned").alias("income_amount"))


def request_documents(ledger: Ledger, requests: DataFrame, expense_cells: DataFrame, income_cells: DataFrame) -> DataFrame:
    """SUM-DOC for each request: (request_id, expense, income), shaped like ``summary.summary_document``.

    ``requests``: request_id (unique), start, end, exclude (category ids), as
    ``validate.validate_summary_requests`` gives them; a range that ends
    before it starts selects nothing. The arrays of a document are bounded by
    the dimensions.
    """
    cells = expense_answers(ledger, requests, expense_cells)
    levels = cells.groupBy("request_id", F.col("priority").alias("level")).agg(F.sum("amount").alias("amount"))
    spent = levels.groupBy("request_id").agg(
        F.sum("amount").alias("_spent"),
        ordered_collect(F.struct("level", "amount"), -F.col("amount"), F.col("level")).alias("priorities"))
    parent = ledger.parent_category.select(F.col("id").alias("parent_category_id"), F.col("name").alias("parent_name"))
    named = (cells.join(parent, "parent_category_id")
             .groupBy("request_id", "parent_category_id", "parent_name", F.col("category_name").alias("name"))
             .agg(F.sum("amount").alias("amount")).filter(F.col("amount") > 0))
    parents = named.groupBy("request_id", "parent_category_id", F.col("parent_name").alias("name")).agg(
        ordered_collect(F.struct("name", "amount"), -F.col("amount"), F.col("name")).alias("categories"), F.sum("amount").alias("total"))
    parents = parents.withColumnRenamed("total", "amount").groupBy("request_id").agg(ordered_collect(
        F.struct("name", "amount", "categories"), -F.col("amount"), F.col("name"), F.col("parent_category_id")).alias("parentCategories"))
    earned = income_answers(ledger, requests, income_cells).groupBy("request_id").agg(
        F.sum("amount").alias("_earned"),
        ordered_collect(F.struct("name", "amount"), -F.col("amount"), F.col("name"), F.col("wallet_id"),
                        skip_null=F.col("name").isNotNull()).alias("wallets"))
    out = requests.select("request_id")
    for part in (spent, parents, earned):
        out = out.join(part, "request_id", "left")
    listed = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    pair = "array<struct<name:string,amount:bigint>>"
    return out.select(
        "request_id",
        F.struct(_zero("_spent").alias("amount"), F.struct(
            listed("parentCategories", f"array<struct<name:string,amount:bigint,categories:{pair}>>"),
            listed("priorities", "array<struct<level:int,amount:bigint>>")).alias("groupSummary")).alias("expense"),
        F.struct(_zero("_earned").alias("amount"), F.struct(listed("wallets", pair)).alias("groupSummary")).alias("income"))
