"""Vantage-point trees against brute force and their SQL."""

import numpy as np
from oracle_check import compare, duck

from tillbook.llm import vantage
from tillbook.llm.oracle import OP13
from tillbook.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, rid string, score string, shard string, v string"


def brute(rows, k=10, every=100):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if v and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)]
    out = []
    for a, (qi, q) in enumerate(good):
        if qi is None or qi % every:
            continue
        found = sorted((float(vantage.exact(q[None], x[None])[0]), i is None, i or 0) for b, (i, x) in enumerate(good) if a != b and len(x) == len(q))
        out += [(qi, r, None if null else i, s) for r, (s, null, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def data(n=700, dims=6):
    rng = np.random.default_rng(5)
    out = [(i, [float(c) for c in np.float32(rng.normal(size=dims))]) for i in range(n)]
    out += [(5000 + i, out[300][1]) for i in range(250)]  # a large group of equal vectors, three of them queries
    out += [(100, out[7][1]), (100, out[7][1]), (None, out[200][1])]  # repeated rows, a null id
    out += [(9000, None), (9100, []), (9200, [0.0] * dims), (9300, [None] + [1.0] * (dims - 1)), (9400, [float("nan")] * dims), (9500, [float("inf")] * dims)]
    return out + [(9600, [1.0, 2.0]), (9700, [1.0, 3.0]), (9701, [2.0, 2.0]), (9800, [4.0])]  # other lengths


def frame(spark, rows_):
    return spark.createDataFrame([(*x, *"abcd") for x in rows_], SCHEMA)


def test_exact_at_factor_one(spark):
    d = data()
    want = brute(d)
    for shard_rows, leaf_rows in ((128, 8), (64, 200), (100_000, 16)):
        assert rows(vantage.nearest(frame(spark, d).repartition(4), shard_rows=shard_rows, leaf_rows=leaf_rows)) == want, shard_rows


def test_recall_and_work():
    """Larger factors compute fewer distances; recall against brute force."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 16))
    x = np.concatenate([c + 0.15 * rng.normal(size=(50, 16)) for c in centers])
    q, n = x[::20], len(x)
    args = (np.arange(0, n, 20), np.full(len(q), np.inf), np.arange(n), np.zeros(n, bool), np.arange(n), 10)
    tree = vantage.Tree(x, 32)
    true = [set(np.lexsort((np.arange(n), np.where(np.arange(n) == i, np.inf, vantage.exact(np.broadcast_to(x[i], x.shape), x))))[:10]) for i in range(0, n, 20)]
    spent = {}
    for factor in (1.0, 1.5, 3.0):
        _, row, spent[factor] = tree.search(q, *args, factor)
        recall = sum(len(t & set(r)) for t, r in zip(true, row)) / (10 * len(q))
        assert recall == 1.0 if factor == 1.0 else recall >= 0.9, (factor, recall)
    assert spent[1.0] < 0.8 * len(q) * n and spent[3.0] < spent[1.5] < spent[1.0], spent


def test_known_radius_saves_work():
    """What the own shard found keeps queries out of most leaves of a far one."""
    rng = np.random.default_rng(4)
    near, far = rng.normal(size=(2000, 3)), rng.normal(size=(2000, 3)) + 2
    q, rest = near[:50], (np.arange(2000), np.zeros(2000, bool), np.arange(2000), 5, 1.0)
    best, _, _ = vantage.Tree(near, 16).search(q, np.arange(50), np.full(50, np.inf), *rest)
    tree, nobody = vantage.Tree(far, 16), np.full(50, -1)
    alone, _, spent = tree.search(q, nobody, np.full(50, np.inf), *rest)
    known, _, less = tree.search(q, nobody, best[:, -1], *rest)
    assert less < 0.8 * spent
    inside = alone <= best[:, -1:]
    assert (known[inside] == alone[inside]).all()


def test_empty_and_none(spark):
    df = frame(spark, data(400))
    assert vantage.nearest(df.limit(0)).collect() == []
    assert vantage.nearest(df.filter("vec_id % 100 <> 0")).collect() == []
    one = frame(spark, [(0, [1.0, 2.0])])
    assert vantage.nearest(one).collect() == [] and vantage.nearest(one).columns == ["query_id", "rank", "vec_id", "score"]


def test_sql(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        res = compare(spark, duck(d), "op13", QUERIES["op13_nearest_neighbours"], OP13, d)
        assert res["values_match"], res
