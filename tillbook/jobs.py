"""Store-level jobs: validate or change, then write what changed.

These tie the batch operators to the stored ledger the way a ledger
application runs them. Inserts append; a named one (``tag``) can be repeated
without doubling its rows. Updates and deletes write anew only the months (and,
for expenses, the id blocks of their tags) that hold changed rows: these are a
table of their own, joined to the stored ones, so that all other partitions are
pruned at run time and no list of them passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillbook.operators import changes as CH
from tillbook.operators import validate as V
from tillbook.plans.materialize import fix
from tillbook.sources.store import LedgerStore, touched_of

KINDS = {"expenses": "expense", "incomes": "income"}


def _table(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(kind)
    return KINDS[kind]


def ingest(store: LedgerStore, docs: DataFrame, kind: str = "expenses", mode: str = "fail_batch", tag: str | None = None) -> DataFrame:
    """(batch_id, value) request documents -> validated rows; the accepted ones are appended."""
    ledger = store.read(before=tag)
    if _table(kind) == "expense":
        validated = V.validate_expense_batches(ledger, docs, mode)
        rows, tags = CH.insert_expenses(ledger, validated)
        store.append(tag=tag, expense=rows, expense_tag=tags)
    else:
        validated = V.validate_income_batches(ledger, docs, mode)
        store.append(tag=tag, income=CH.insert_incomes(ledger, validated))
    return validated


def transfer(store: LedgerStore, docs: DataFrame, fee_category_id: int = CH.FEE_CATEGORY_ID, tag: str | None = None) -> DataFrame:
    """(request_id, value) transfer requests -> checked requests; transfers and fees are appended."""
    ledger = store.read(before=tag)
    checked = V.validate_transfers(ledger, docs, fee_category_id)
    transfers, fees = CH.apply_transfers(ledger, checked, fee_category_id)
    store.append(tag=tag, wallet_transfer=transfers.drop("request_id"), expense=fees.drop("request_id"))
    return checked


def update(store: LedgerStore, changes: DataFrame, kind: str = "expenses") -> DataFrame:
    """(id, value) changes -> outcome."""
    ledger, stamp = store.read(), CH.job_stamp()
    if _table(kind) == "expense":
        outcome = CH.expense_outcome(ledger, changes)
        part, touched = _touched(ledger, "expense", outcome.filter("status = 'ok'"))
        rows, tags = CH.apply_expense_outcome(part, outcome, stamp)
        store.overwrite(touched, expense=rows, expense_tag=tags)
    else:
        outcome = CH.income_outcome(ledger, changes)
        part, touched = _touched(ledger, "income", outcome.filter("status = 'ok'"))
        store.overwrite(touched, income=CH.apply_income_outcome(part, outcome, stamp))
    return outcome


def delete(store: LedgerStore, ids: DataFrame, kind: str = "expenses") -> DataFrame:
    """ids -> outcome; expense deletes cascade to tags. Tags go first, so a
    delete that broke off finds its expenses again."""
    ledger, name = store.read(), _table(kind)
    base = ledger.table(name)
    part, touched = _touched(ledger, name, base.join(ids.select("id"), "id", "left_semi").select("id", "date"))
    if name == "expense":
        outcome = fix(CH.delete_expenses(ledger, ids)[2])
        rows, tags, _ = CH.delete_expenses(part, ids)
        store.overwrite(touched, expense=rows, expense_tag=tags)
    else:
        outcome = fix(CH.delete_incomes(ledger, ids)[1])
        store.overwrite(touched, income=CH.delete_incomes(part, ids)[0])
    return outcome


def _touched(ledger, name: str, changed: DataFrame):
    """The ledger cut to the partitions that the changed rows (id, date) touch, and those partitions."""
    touched = {name: fix(CH.touched_months(ledger.table(name), changed))}
    if name == "expense":
        touched["expense_tag"] = fix(CH.touched_blocks(changed))
    return ledger.replace(**{t: touched_of(ledger.table(t), parts) for t, parts in touched.items()}), touched
