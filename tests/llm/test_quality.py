"""Quality rules: the cascade, its order and hard rows (the query has SQL)."""

import random
import time

import duckdb
from oracle_check import compare, duck
from pyspark.sql import functions as F

from tillbook.llm import quality as q
from tillbook.llm.oracle import OP1
from tillbook.llm.queries import QUERIES

CLEAN = " ".join(f"word{i}" for i in range(60))


def test_given_tables(spark):
    res = compare(spark, duck("/root/testdata/sf0.01"), "op1", QUERIES["op1_quality_rules"], OP1, "/root/testdata/sf0.01")
    assert res["values_match"], res


def test_hard_rows(spark, make_docs, write_tables):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, CLEAN), (4, CLEAN), (None, CLEAN + "\n" + CLEAN), (5, "a b c " * 30_000), (6, "x y z"), (7, "a b c a b c"),
            (8, "é ü " * 40), (9, CLEAN.upper()), (10, "# $ | " + CLEAN), (11, "\n".join(["same line"] * 40)), (12, "a\x0bb\x0cc d " * 20), (13, "q" * 100_000)]
    d = write_tables(documents=make_docs(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    res = compare(spark, con, "op1", QUERIES["op1_quality_rules"], OP1, d)
    assert res["values_match"], res
    docs = make_docs(rows)
    kept = q.cascade(docs)
    assert kept.columns == docs.columns
    report = {r.doc_id: r.kept for r in q.quality_report(docs).collect()}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in rows if report[r[0]]), key=str)
    assert q.quality_report(docs.limit(0)).collect() == [] and q.cascade(docs.limit(0)).collect() == []


def test_hash_collisions_are_verified(spark, monkeypatch):
    """With one hash value for all windows, the words themselves decide."""
    monkeypatch.setattr(q.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    df = spark.createDataFrame([("a b c d a b c e f g",), ("a b c d e f g",)], "t string").select(q.n_repeat_words(F.col("t"), q.words(F.col("t"))).alias("n"))
    assert [r.n for r in df.collect()] == [6, 0]


def test_order_is_by_rejection_per_cost(spark, make_docs):
    a, b, c = (q.Rule(n, lambda f: f("n_words") < 0) for n in "abc")
    alone = {(True, False, False): 10, (False, True, False): 10, (False, False, False): 80}
    assert [r.name for r in q.order_rules(q.Measured((a, b, c), (1.0, 0.1, 0.01), alone))] == ["b", "a", "c"]
    # b rejects nothing that a lets through, so c comes before it
    nested = {(True, True, False): 40, (True, False, False): 20, (False, False, True): 1, (False, False, False): 39}
    assert [r.name for r in q.order_rules(q.Measured((a, b, c), (0.1, 0.1, 0.1), nested))] == ["a", "c", "b"]
    found = q.measure(make_docs([(1, CLEAN), (2, "few")]))
    assert found.rules == q.RULES and found.rejected(0) == 0.5 and found.rejected(1, [0]) == 0.0 and min(found.seconds) > 0


def test_order_bears_noise():
    """Costs that differ by a quarter from run to run, rules that reject nothing."""
    rng = random.Random(1)
    hits = {(True, False, False, False): 15, (False, True, False, False): 4, (False, False, True, False): 3, (False,) * 4: 78}
    rules = [q.Rule(n, lambda f: f("n_words") < 0) for n in "abcd"]
    orders = set()
    for _ in range(200):
        cost = tuple(c * rng.uniform(0.8, 1.25) for c in (0.016, 1.0, 0.064, 0.25))
        orders.add("".join(r.name for r in q.order_rules(q.Measured(tuple(rules), cost, hits))))
    assert orders == {"acbd"}


def test_cascade_is_cheaper_than_all_features(spark):
    """Long texts that a cheap rule rejects never reach the costly one."""
    docs = spark.range(3000).select(F.concat(F.repeat(F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("id") % (i + 2)) for i in range(40)]), 12),
                                             F.when(F.col("id") % 10 < 8, F.repeat(F.lit(" #"), 200)).otherwise("")).alias("text"))
    docs = docs.repartition(8).cache()
    ordered = q.order_rules(q.measure(docs))
    assert [r.name for r in ordered].index("symbols") < [r.name for r in ordered].index("repeated_words")
    t = F.col("text")

    def best(c):
        times = []
        for _ in range(4):
            began = time.perf_counter()
            docs.agg(F.count(c)).first()
            times.append(time.perf_counter() - began)
        return min(times[1:])

    every = q.shared(t, lambda f: F.struct(*[f(n).alias(n) for n in q.FEATURES]))
    assert best(q.shared(t, lambda f: q.verdict(ordered, f))) < best(F.to_json(every))
    docs.unpersist()


def test_words_are_split_once(spark):
    """One split of words in the cascade's plan, whatever the number of rules."""
    plan = spark.createDataFrame([("a b",)], "text string").select(q.shared(F.col("text"), lambda f: q.verdict(q.RULES, f)).alias("v"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2  # of words, and of lines


def test_later_rules_do_not_run_on_rejected_rows(spark):
    rules = [q.Rule("first", lambda f: f("n_words") < 5), q.Rule("boom", lambda f: F.raise_error(F.lit("reached")).cast("boolean"))]
    df = spark.createDataFrame([("too few",)], "text string")
    assert df.select(q.verdict(rules, q.inline(F.col("text"))).alias("v")).first().v == "first"
