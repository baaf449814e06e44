"""Ranked lexical search against a brute-force version and its SQL."""

import math
import re

import duckdb
import numpy as np
from oracle_check import compare, duck

from tillbook.llm import lexical
from tillbook.llm.oracle import OP11
from tillbook.llm.queries import QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    words = [(i, split(t)) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w in words)
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(split(t))
    out = []
    for item, own in terms.items():
        scored = []
        for doc, w in words:
            m, score = 50 + 50 * len(w) * n_docs // n_terms, 0
            for t in own:
                df, tf = sum(t in v for _, v in words), w.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


DOCS = [(1, "alpha beta beta gamma"), (2, "Alpha"), (3, None), (4, ""), (5, "alpha beta"), (5, "alpha beta"), (6, "ÄÖ äö ALPHA é\x7fé x_y"),
        (None, "alpha beta"), (7, "...!"), (8, "delta " * 3000 + "alpha"), (9, "beta-gamma/beta 12a"), (-4, "alpha beta")]
DOCS += [(100 + i, "the same copy of a text with beta") for i in range(70)] + [(300 + i, f"word{i % 7} word{i % 5} filler" * (i % 4 + 1)) for i in range(60)]
ITEMS = [(1, "Alpha beta"), (2, "gamma, delta? 12A äö É"), (3, None), (4, ""), (5, "beta beta"), (None, "alpha word1"), (6, "nowhere"), (7, "word1 word2"), (7, "word3 filler")]


def test_brute_force(spark, make_docs):
    docs = make_docs(DOCS)
    items = spark.createDataFrame([(*x, "z") for x in ITEMS], "item_id long, text string, rank string").repartition(3)
    want = brute(DOCS, ITEMS)
    assert rows(lexical.rank_documents(docs.repartition(5), items)) == want
    assert rows(lexical.rank_documents(docs.coalesce(1), items)) == want
    # several blocks of items, with one item over the limit
    assert rows(lexical.rank_documents(docs, items, terms_per_block=3)) == want
    assert rows(lexical.rank_documents(docs, items, k=3)) == brute(DOCS, ITEMS, 3)


def test_small_blocks_of_documents(spark, make_docs, monkeypatch):
    """Thresholds carry over blocks; masks of more than 64 terms."""
    wide = [(1, " ".join(f"t{i}" for i in range(150)))]
    docs = [(i, " ".join(f"t{j}" for j in range(150) if (i * j) % 7 < 3)) for i in range(200)]
    monkeypatch.setattr(lexical, "CELLS", 64)
    assert rows(lexical.rank_documents(make_docs(docs).coalesce(1), spark.createDataFrame(wide, "item_id long, text string"))) == brute(docs, wide)


def test_mask_groups():
    held = np.array([[1, 0, 1, 0, 1], [0, 0, 1, 0, 0], [1, 0, 1, 0, 1]], np.uint8)
    present, groups = lexical.mask_groups(np.packbits(held, axis=1), 5)
    assert {tuple(p): tuple(g) for p, g in zip(present, groups)} == {(1, 0, 1): (0, 4), (1, 1, 1): (2,)}


def test_masks_are_abandoned(spark):
    """Documents under the bound are never scored."""
    best = [lexical._Best(2)]
    score = np.zeros((2, 1000), np.int64)
    score[0], score[1, :5] = 1, 1000
    seen = []
    plain = lexical._Best.add
    lexical._Best.add = lambda self, s, *a: (seen.append(len(s)), plain(self, s, *a))[1]
    try:
        lexical._search_block(best, [np.array([0, 1])], np.arange(1000), np.zeros(1000, bool), score)
    finally:
        lexical._Best.add = plain
    assert best[0].score.tolist() == [1001, 1001] and sum(seen) == 5


def test_empty(spark, make_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make_docs(DOCS)
    out = lexical.rank_documents(docs, items.limit(0))
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.collect() == []
    assert lexical.rank_documents(docs.limit(0), items).collect() == []


def test_sql(spark, make_docs, write_tables):
    d = write_tables(documents=make_docs([x for x in DOCS if x[0] is not None]), benchmark=spark.createDataFrame(ITEMS, "item_id long, text string"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    res = compare(spark, con, "op11", QUERIES["op11_lexical_search"], OP11, d)
    assert res["values_match"], res
    res = compare(spark, duck("/root/testdata/sf0.001"), "op11", QUERIES["op11_lexical_search"], OP11, "/root/testdata/sf0.001")
    assert res["values_match"], res
