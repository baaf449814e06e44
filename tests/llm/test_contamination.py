"""Containment search against its SQL, on the given tables and on hard cases."""

from oracle_check import compare, duck

import duckdb

from tillbook.llm import contamination
from tillbook.llm.oracle import OP7
from tillbook.llm.queries import QUERIES

ITEM = "what is the name of the river that runs past the old mill and under seven bridges"


def run_both(spark, d):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    return compare(spark, con, "op7", QUERIES["op7_benchmark_decontamination"], OP7, d)


def tables(spark, make_docs, write_tables, docs, items):
    return write_tables(documents=make_docs(docs), benchmark=spark.createDataFrame(items, "item_id long, text string"))


def test_given_tables(spark):
    res = compare(spark, duck("/root/testdata/sf0.01"), "op7", QUERIES["op7_benchmark_decontamination"], OP7, "/root/testdata/sf0.01")
    assert res["values_match"] and res["spark_rows"] > 20, res


def test_hard_cases(spark, make_docs, write_tables):
    w = ITEM.split()
    filler = " ".join(f"w{i}" for i in range(5000))
    docs = [(1, f"{filler} {ITEM.upper()}! {filler}"), (2, None), (3, ""), (4, filler), (5, "What, is the name; of the river - that runs past the old mill"),
            (6, " ".join(w[:-2])), (7, " ".join(w[:-4])), (8, ITEM), (8, ITEM), (8, ITEM + " again"), (None, ITEM), (9, " ".join(w[:8] + ["x"] + w[8:])),
            (10, ("a " * 40 + "b ") * 200), (11, "a " * 10)] + [(100 + i, ITEM) for i in range(60)]
    items = [(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "four words are few"), (5, "a " * 30), (None, ITEM + " and on"), (6, " ".join(f"w{i}" for i in range(700)))]
    res = run_both(spark, tables(spark, make_docs, write_tables, docs, items))
    assert res["values_match"] and res["spark_rows"] > 60, res


def test_empty_tables(spark, make_docs, write_tables):
    for docs, items in (([], [(1, ITEM)]), ([(1, ITEM)], []), ([], [])):
        assert run_both(spark, tables(spark, make_docs, write_tables, docs, items))["spark_rows"] == 0


def test_without_broadcast(spark, make_docs, write_tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        res = run_both(spark, tables(spark, make_docs, write_tables, [(i, ITEM if i % 3 else "no") for i in range(90)], [(1, ITEM)]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert res["values_match"] and res["spark_rows"] == 60


def test_a_prompt_that_all_items_share(spark, make_docs, write_tables, monkeypatch):
    """Texts with the prompt don't meet every item that has it: the candidates grow with the texts, not with texts times items."""
    prompt = "please read the question below and answer it with one word"
    own = lambda i: " ".join(f"k{i}x{j}" for j in range(24))
    n = 150
    docs = [(i, f"{prompt} {' '.join(f'd{i}y{j}' for j in range(30))}") for i in range(n)] + [(1000 + i, f"lead in {prompt} {own(i)} and on") for i in range(5)]
    items = [(i, f"{prompt} {own(i)}") for i in range(n)] + [(5000, prompt)]
    written = []
    plain = contamination.Stage.write
    monkeypatch.setattr(contamination.Stage, "write", lambda self, df, **k: (written.append(plain(self, df, **k)), written[-1])[1])
    res = run_both(spark, tables(spark, make_docs, write_tables, docs, items))
    assert res["values_match"] and res["spark_rows"] == n + 10, res
    assert written[-1].columns == ["doc_id", "item"] and written[-1].count() <= 2 * n + 10


def test_decontaminate_keeps_clean_documents(spark, make_docs):
    docs = make_docs([(1, ITEM), (2, "clean text here"), (None, None), (3, "intro " + ITEM), (2, "clean text here")])
    kept = contamination.decontaminate(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 2, None]


def test_sketch_admits_every_containment(spark):
    """Every item keeps enough of its sketch whatever shingles are missing."""
    import math

    for n in range(1, 300):
        u = 2 ** (int(math.log2(n)) + 1) - 1
        k = min(n, u - math.ceil(0.8 * u - 1e-9) + 1)
        need = max(1, k - (n - math.ceil(0.8 * n - 1e-9)))
        assert k - (n - math.ceil(0.8 * n - 1e-9)) >= 1 and need <= k
