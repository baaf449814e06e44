import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) rows, with columns whose names clash with those that operators add."""

    def make(rows, clash=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA)
        if clash:
            for c in ("size", "shard", "slot", "fp", "root", "n_words", "kept", "target", "_index", "_pid", "_fp", "_key", "words", "start",
                      "item_id", "a", "b", "rid", "_text", "taken"):
                df = df.selectExpr("*", f"'x' AS `{c}`")
        return df

    return make


@pytest.fixture(scope="session")
def write_tables(spark, tmp_path_factory):
    """A folder with the given frames as the driver's tables."""

    def write(**frames):
        d = tmp_path_factory.mktemp("tables")
        for name, df in frames.items():
            df.write.parquet(f"{d}/{name}.parquet")
        return str(d)

    return write
