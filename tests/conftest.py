import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillbook import schemas  # noqa: E402
from tillbook.ledger import Ledger  # noqa: E402
from tillbook.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    return local_session(cores="*", shuffle_partitions=8, app="tillbook-tests")


@pytest.fixture(scope="session")
def fixture_ledger(spark):
    return Ledger.from_fixture(spark, SF_SMALL)


def D(text):
    return dt.date.fromisoformat(text)


def make_ledger(spark, **rows) -> Ledger:
    """A ledger from literal rows (tests only). Missing tables are empty."""
    frames = {}
    for name, schema in schemas.TABLES.items():
        data = rows.get(name, [])
        width = len(schema.fields)
        data = [tuple(r) + (None,) * (width - len(r)) for r in data]
        frames[name] = spark.createDataFrame(data, schema)
    return Ledger(spark, **frames)


@pytest.fixture(scope="session")
def small_ledger(spark):
    """Hand-made ledger: same-named categories under one parent, a parent
    without children, a parent whose only category sums to zero, wallets
    sharing a name, tags with and without importance."""
    return make_ledger(
        spark,
        parent_category=[(1, "Home"), (2, "Food"), (3, "Zero"), (4, "Empty")],
        category=[(1, 1, "rent"), (2, 1, "Power"), (3, 2, "snacks"), (4, 2, "snacks"), (5, 3, "void"),
                  (25, 2, "fees")],
        wallet=[(1, "Cash"), (2, "Bank"), (3, "Bank")],
        tag=[(1, "b", True), (2, "a", False), (3, "c", True), (4, "a", True)],
        expense=[
            (1, 1, 1, 1000, D("2024-01-05"), 0, "jan rent"),
            (2, 2, 2, 200, D("2024-01-10"), 1, None),
            (3, 3, 1, 50, D("2024-02-01"), 2, "chips"),
            (4, 4, 3, 70, D("2024-02-02"), 2, "nuts"),
            (5, 5, 1, 0, D("2024-02-03"), 1, "nothing"),
            (6, 1, 2, 999, D("2023-12-31"), 0, "old"),
        ],
        expense_tag=[(1, 1), (1, 2), (1, 4), (3, 3), (4, 2)],
        income=[
            (1, 500, 1, D("2024-01-01"), "salary"),
            (2, 500, 1, D("2024-01-15"), "salary"),
            (3, 300, 2, D("2024-01-20"), None),
            (4, 300, 3, D("2024-02-20"), "bonus"),
            (5, 10, 2, D("2025-01-01"), "late"),
        ],
    )


@pytest.fixture(scope="session")
def saved_ledger(spark, small_ledger, tmp_path_factory):
    """A folder with the stored small ledger, to be copied."""
    from tillbook.sources.store import LedgerStore

    root = str(tmp_path_factory.mktemp("saved") / "ledger")
    LedgerStore(spark, root).save(small_ledger)
    return root


@pytest.fixture
def store(spark, saved_ledger, tmp_path):
    """A store of its own for each test, holding the small ledger."""
    import shutil

    from tillbook.sources.store import LedgerStore

    return LedgerStore(spark, shutil.copytree(saved_ledger, str(tmp_path / "ledger")))
