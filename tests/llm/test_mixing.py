"""Mixing: budgets, order and the mixed rows (the query has SQL)."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tillbook.llm import mixing
from tillbook.llm.common import word_count
from tillbook.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, share=1.5, cap=2):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = cap * sizes[s]
            free.discard(s)
        left = share * sum(sizes.values()) - sum(target.values())
    return target


def check(rows, docs):
    sizes = defaultdict(int)
    for r in docs:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    target, taken = brute_targets(sizes), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * (1 + target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in target:
        assert 0 <= target[s] - taken[s] < 1 + 1e-6


def test_budgets_are_exact_and_reruns_agree(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        plan = mixing.mix_plan(docs, word_count(F.col("text")))
        assert plan.count() == docs.count()
        check(plan.collect(), docs.collect())
    q = [sorted(map(tuple, QUERIES["op9_source_mixing"](spark, "/root/testdata/sf0.001").collect())) for _ in range(2)]
    assert q[0] == q[1]


def test_nulls_repeats_ties_empty(make_docs):
    docs = make_docs([(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", None), (2, None, "x"), (3, "", "empty"), (4, "f " * 500, "y"),
                      (5, "g h i j", "z"), (6, "ä ö", "é")])
    rows = mixing.mix_plan(docs, word_count(F.col("text"))).collect()
    assert len(rows) == 8
    check(rows, docs.collect())
    empty = docs.limit(0)
    assert mixing.mix_plan(empty, word_count(F.col("text"))).collect() == [] and mixing.mix(empty).collect() == []
    blank = make_docs([(1, None, "x"), (2, " ", "y")])
    assert [r.taken for r in mixing.mix_plan(blank, word_count(F.col("text"))).collect()] == [0, 0]


def test_mixed_rows_carry_the_taken_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    want = {r.doc_id: r.taken for r in mixing.mix_plan(docs, word_count(F.col("text"))).collect() if r.taken}
    got, cut = Counter(), 0
    for r in mixed.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) and text[r.doc_id].startswith(r.text)
        cut += r.text != text[r.doc_id]
    assert got == want and cut <= 20


def test_first_words(spark):
    df = spark.createDataFrame([("  a  b\tc ",), ("a b c",)], "t string").select(mixing.first_words(F.col("t"), F.lit(2)).alias("x"))
    assert [r.x for r in df.collect()] == ["  a  b", "a b"]
