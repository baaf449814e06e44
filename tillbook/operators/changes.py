"""Change sets as batch operators: (ledger, change frame) -> new rows / new tables.

* Inserts hand out ids after the highest one ever used, in input order
  (batch_id, pos): documents are counted and prefix-summed, elements are
  numbered inside their document and never sorted as a whole. Tags are
  exploded from the frame that already holds the ids, so there is no
  positional zip.
* Updates and deletes are joins on ``id`` without hints: the planner and AQE
  broadcast a change set by its bytes or shuffle both sides.
* Stamps: one ``current_timestamp`` value per job, taken on the driver, so
  every row and every task retry writes the same instant.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.ledger import Ledger
from tillbook.plans.positions import number_elements, with_positions

INT_MAX = 2**31 - 1
# The transfer fee expense (category is a parameter; the
# ledger's default is 25, priority level 2, description prefix below).
FEE_CATEGORY_ID = 25
FEE_PRIORITY = 2
FEE_DESCRIPTION_PREFIX = "Wallet transfer fee: "


def job_stamp() -> Column:
    # an aware value: a naive one would be read in the driver's own time zone
    return F.lit(dt.datetime.now(dt.timezone.utc)).cast("timestamp")


def _next_ids(ledger: Ledger, name: str, pos_col: str = "_pos") -> Column:
    """Highest id ever handed out + 1 + position, as INT; fails the job rather
    than wrap. A stored ledger knows that id, also of rows deleted since; for
    other ledgers it is the table's maximum."""
    high = ledger.max_ids.get(name)
    max_id = F.lit(high).cast("long") if high is not None else \
        ledger.table(name).agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    new_id = max_id + F.lit(1) + F.col(pos_col)
    return F.when(new_id > INT_MAX, F.raise_error(F.lit("id space exhausted: ids are 32-bit"))) \
        .otherwise(new_id).cast("int")


def accepted() -> Column:
    return (F.col("status") == "ok") & F.col("batch_ok")


def insert_expenses(ledger: Ledger, validated: DataFrame, stamp: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """M-EXP-INSERT: accepted elements -> (expense rows, expense_tag rows)."""
    stamp = job_stamp() if stamp is None else stamp
    rows = number_elements(validated, "batch_id", "pos", accepted(), "_pos")
    new = rows.select(
        _next_ids(ledger, "expense").alias("id"), "category_id", "wallet_id", "amount", "date",
        "priority", "description", stamp.alias("created_at"), stamp.alias("updated_at"), "tag_ids")
    expenses = new.drop("tag_ids")
    tags = new.select(F.col("id").alias("expense_id"), F.explode("tag_ids").alias("tag_id"),
                      stamp.alias("created_at"), stamp.alias("updated_at"))
    return expenses, tags


def insert_incomes(ledger: Ledger, validated: DataFrame, stamp: Column | None = None) -> DataFrame:
    """M-INC-INSERT: accepted elements -> income rows."""
    stamp = job_stamp() if stamp is None else stamp
    rows = number_elements(validated, "batch_id", "pos", accepted(), "_pos")
    return rows.select(_next_ids(ledger, "income").alias("id"), "amount", "wallet_id", "date", "description",
                       stamp.alias("created_at"), stamp.alias("updated_at"))


def transfer_rows(ledger: Ledger, validated: DataFrame, stamp: Column | None = None) -> DataFrame:
    """M-TRANSFER, part 1: every ok request becomes a wallet_transfer row."""
    stamp = job_stamp() if stamp is None else stamp
    t = with_positions(validated.filter(F.col("status") == "ok"), [F.col("request_id")], "_pos")
    return t.select(
        _next_ids(ledger, "wallet_transfer").alias("id"), "amount", "source_wallet_id", "target_wallet_id",
        "date", "description", stamp.alias("created_at"), stamp.alias("updated_at"), "request_id")


def fee_expenses(ledger: Ledger, validated: DataFrame, fee_category_id: int = FEE_CATEGORY_ID,
                 stamp: Column | None = None) -> DataFrame:
    """M-TRANSFER, part 2: an ok request with a non-zero fee also becomes an
    expense on the source wallet in the fee category, priority 2, same date,
    description 'Wallet transfer fee: <description>' (NULL stays NULL)."""
    stamp = job_stamp() if stamp is None else stamp
    f = with_positions(validated.filter((F.col("status") == "ok") & (F.col("fee") != 0)),
                       [F.col("request_id")], "_pos")
    return f.select(
        _next_ids(ledger, "expense").alias("id"), F.lit(fee_category_id).cast("int").alias("category_id"),
        F.col("source_wallet_id").alias("wallet_id"), F.col("fee").alias("amount"), "date",
        F.lit(FEE_PRIORITY).cast("int").alias("priority"),
        F.concat(F.lit(FEE_DESCRIPTION_PREFIX), F.col("description")).alias("description"),
        stamp.alias("created_at"), stamp.alias("updated_at"), "request_id")


def apply_transfers(ledger: Ledger, validated: DataFrame, fee_category_id: int = FEE_CATEGORY_ID,
                    stamp: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """M-TRANSFER: ok requests -> (wallet_transfer rows, fee expense rows),
    both stamped with the same instant."""
    stamp = job_stamp() if stamp is None else stamp
    return (transfer_rows(ledger, validated, stamp),
            fee_expenses(ledger, validated, fee_category_id, stamp))


# ---- updates and deletes --------------------------------------------------

def _dedupe_ids(checked: DataFrame) -> DataFrame:
    """Two changes for one id have no meaning: both become conflicts. Counting
    per id is a partially aggregated groupBy, so a hot id cannot pile up."""
    from tillbook.functions.rules import status

    dup = checked.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(
        "id", F.lit(True).alias("_dup"))
    out = checked.join(dup, "id", "left")
    reasons = F.when(F.col("_dup"), F.concat(F.col("reasons"), F.array(F.lit("id:duplicate")))).otherwise(F.col("reasons"))
    return out.withColumn("reasons", reasons).drop("_dup").withColumn("status", status(F.col("reasons")))


def _outcome(base: DataFrame, checked: DataFrame) -> DataFrame:
    """Per change: status ok / invalid / conflict / not_found (ok but no such id).
    The planner broadcasts the change ids where their bytes allow."""
    ok = checked.filter(F.col("status") == "ok").select("id")
    found = base.select("id").join(ok, "id", "left_semi").withColumn("_found", F.lit(True))
    out = checked.join(found, "id", "left")
    status = F.when((F.col("status") == "ok") & F.col("_found").isNull(), F.lit("not_found")).otherwise(F.col("status"))
    return out.withColumn("status", status).drop("_found")


def _replace_rows(base: DataFrame, changes: DataFrame, columns: list[str], stamp: Column) -> DataFrame:
    """Base rows with the changed columns swapped in where a change exists.
    Presence is a flag, never ``coalesce(new, old)``: a change may set NULL."""
    c = changes.select("id", *[F.col(x).alias(f"_new_{x}") for x in columns], F.lit(True).alias("_hit"))
    j = base.join(c, "id", "left")
    out = [F.col("id")]
    for name in base.columns:
        if name == "id":
            continue
        if name in columns:
            out.append(F.when(F.col("_hit"), F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name))
        elif name == "updated_at":
            out.append(F.when(F.col("_hit"), stamp).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return j.select(*out)


def _checked_changes(ledger: Ledger, changes: DataFrame, schema, rules, base: DataFrame):
    """Parse + rules (fixed in a table inside the rules), duplicate ids,
    existence; the outcome is fixed once more so the tables built from it do
    not re-run the checks."""
    from tillbook.plans.materialize import fix
    from tillbook.sources.batches import parse_requests

    checked = rules(ledger, parse_requests(changes, "id", schema), ["id"])
    return fix(_outcome(base, _dedupe_ids(checked)))


def expense_outcome(ledger: Ledger, changes: DataFrame) -> DataFrame:
    """(id, value JSON) changes -> typed fields + status of each, fixed."""
    from tillbook import schemas
    from tillbook.operators.validate import expense_rules

    return _checked_changes(ledger, changes, schemas.EXPENSE_ELEMENT, expense_rules, ledger.expense)


def income_outcome(ledger: Ledger, changes: DataFrame) -> DataFrame:
    from tillbook import schemas
    from tillbook.operators.validate import income_rules

    return _checked_changes(ledger, changes, schemas.INCOME_ELEMENT, income_rules, ledger.income)


def apply_expense_outcome(ledger: Ledger, outcome: DataFrame, stamp: Column) -> tuple[DataFrame, DataFrame]:
    applied = outcome.filter(F.col("status") == "ok")
    cols = ["category_id", "wallet_id", "amount", "date", "priority", "description"]
    new_expense = _replace_rows(ledger.expense, applied, cols, stamp)
    kept_tags = ledger.expense_tag.join(applied.select(F.col("id").alias("expense_id")), "expense_id", "left_anti")
    new_tags = applied.select(F.col("id").alias("expense_id"), F.explode("tag_ids").alias("tag_id"),
                              stamp.alias("created_at"), stamp.alias("updated_at"))
    return new_expense, kept_tags.unionByName(new_tags, allowMissingColumns=True)


def apply_income_outcome(ledger: Ledger, outcome: DataFrame, stamp: Column) -> DataFrame:
    applied = outcome.filter(F.col("status") == "ok")
    return _replace_rows(ledger.income, applied, ["amount", "wallet_id", "date", "description"], stamp)


def update_expenses(ledger: Ledger, changes: DataFrame, stamp: Column | None = None):
    """M-EXP-UPDATE: (id, value JSON) -> (new expense table, new expense_tag
    table, outcome per change). A change replaces every mutable column and
    the whole tag set of its expense; unknown ids change nothing."""
    outcome = expense_outcome(ledger, changes)
    return *apply_expense_outcome(ledger, outcome, job_stamp() if stamp is None else stamp), outcome


def update_incomes(ledger: Ledger, changes: DataFrame, stamp: Column | None = None):
    """M-INC-UPDATE: (id, value JSON) -> (new income table, outcome)."""
    outcome = income_outcome(ledger, changes)
    return apply_income_outcome(ledger, outcome, job_stamp() if stamp is None else stamp), outcome


def _delete_outcome(base: DataFrame, ids: DataFrame) -> DataFrame:
    found = base.select("id").join(ids, "id", "left_semi").withColumn("_found", F.lit(True))
    return ids.join(found, "id", "left").select(
        "id", F.when(F.col("_found"), F.lit("ok")).otherwise(F.lit("not_found")).alias("status"))


def _delete_ids(ids: DataFrame) -> DataFrame:
    return ids.select("id").distinct()


def delete_expenses(ledger: Ledger, ids: DataFrame):
    """M-EXP-DELETE: remove expenses by id and cascade to their tags."""
    ids = _delete_ids(ids)
    new_expense = ledger.expense.join(ids, "id", "left_anti")
    new_tags = ledger.expense_tag.join(ids.withColumnRenamed("id", "expense_id"), "expense_id", "left_anti")
    return new_expense, new_tags, _delete_outcome(ledger.expense, ids)


def delete_incomes(ledger: Ledger, ids: DataFrame):
    """M-INC-DELETE: remove incomes by id."""
    ids = _delete_ids(ids)
    return ledger.income.join(ids, "id", "left_anti"), _delete_outcome(ledger.income, ids)


def touched_months(base: DataFrame, changed: DataFrame) -> DataFrame:
    """(month) where the changed rows (id, date) live now and where they will live."""
    old = base.join(changed.select("id"), "id", "left_semi").select(F.trunc("date", "month").alias("month"))
    new = changed.select(F.trunc("date", "month").alias("month"))
    return old.unionByName(new).distinct()


def touched_blocks(changed: DataFrame) -> DataFrame:
    """(id_block) of expense_tag that hold the tags of the changed expenses."""
    from tillbook.sources.store import id_block

    return changed.select(id_block(F.col("id")).alias("id_block")).distinct()
