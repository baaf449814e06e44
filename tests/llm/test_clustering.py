"""Heap-ordered clustering against plain rounds and its SQL."""

import hashlib

import numpy as np
import pytest
from oracle_check import compare, duck

from tillbook.llm import clustering as cl
from tillbook.llm.oracle import OP12
from tillbook.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, cluster string, v string"


def brute(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    if not kept:
        return []
    x = np.array([v for _, v in kept], dtype=object)
    digest = [hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest() for i, _ in kept]
    cen = [x[j] for j in sorted(range(len(kept)), key=lambda j: (digest[j], kept[j][1]))[:k]]
    for turn in range(rounds + 1):
        d = [[int(((v - c) ** 2).sum()) for c in cen] for v in x]
        own = [min(range(len(cen)), key=lambda c: (r[c], c)) for r in d]
        if turn < rounds:
            for c in range(len(cen)):
                mine = [v for v, o in zip(x, own) if o == c]
                if mine:
                    cen[c] = np.array([sum(col) // len(mine) for col in zip(*mine)], dtype=object)
    inertia = {c: sum(r[o] for r, o in zip(d, own) if o == c) for c in set(own)}
    return sorted(((i, o, r[o], inertia[o], sum(inertia.values()), hashlib.sha256(",".join(map(str, cen[o])).encode()).hexdigest())
                   for (i, _), r, o in zip(kept, d, own)), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def grouped(n, dims, seed=1, spread=0.1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dims))
    return [(i, [float(c) for c in np.float32(centers[i % 6] + spread * rng.normal(size=dims))]) for i in range(n)]


def test_brute_force(spark):
    data = grouped(300, 8)
    data += [(1000, None), (1001, []), (1002, [1.0] * 7), (1003, [None] + [1.0] * 7), (1004, [float("nan")] * 8), (1005, [float("inf")] * 8), (1006, [0.0] * 8)]
    data += [(2000, [0.5] * 8)] * 120 + [(2001, [-0.5] * 8)] * 3 + [(None, [0.25] * 8)] * 2  # repeated rows, ties between centroids, null ids
    df = spark.createDataFrame([(*x, "a", "b") for x in data], SCHEMA)
    for k, rounds in ((12, 5), (40, 3), (1, 2), (7, 0)):
        want = brute(data, k, rounds, 8)
        assert rows(cl.cluster_vectors(df.repartition(5), k=k, rounds=rounds, dims=8)) == want, (k, rounds)
        assert rows(cl.cluster_vectors(df.coalesce(1), k=k, rounds=rounds, dims=8)) == want, (k, rounds)


def test_few_and_none(spark):
    data = grouped(5, 4)
    df = spark.createDataFrame([(*x, "a", "b") for x in data], SCHEMA)
    assert rows(cl.cluster_vectors(df, dims=4)) == brute(data, 40, 5, 4)
    assert cl.cluster_vectors(df, dims=64).collect() == []
    assert cl.cluster_vectors(df.limit(0), dims=4).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(OverflowError):
        cl.cluster_vectors(spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<double>"), dims=4)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(np.float32(c)) for c in rng.integers(-400_000, 400_000, 4)]) for i in range(60)]
    df = spark.createDataFrame([(*x, "a", "b") for x in data], SCHEMA)
    assert rows(cl.cluster_vectors(df, k=5, dims=4)) == brute(data, 5, 5, 4)


def test_only_expired_are_scanned(spark):
    """On grouped vectors most gaps outlast the drift."""
    data = grouped(2000, 16, spread=0.02)
    work = []
    df = spark.createDataFrame([(*x, "a", "b") for x in data], SCHEMA)
    assert rows(cl.cluster_vectors(df, k=6, dims=16, work=work)) == brute(data, 6, 5, 16)
    assert work[0] == 2000 and work[-1] < 200, work


def test_heaps():
    x = np.array([[0], [1], [9], [10], [5]])
    centroids = np.array([[0], [10]])
    cluster, gap = cl.scan(x, centroids)
    key = gap.copy()
    assert cluster.tolist() == [0, 0, 1, 1, 0] and gap[4] <= 0
    new = np.array([[0], [8]])
    assert cl.rescan_expired(x, cluster, key, new, np.array([2.0, 2.0])) == 1  # the middle one alone
    assert cluster.tolist() == [0, 0, 1, 1, 1] and key[4] == pytest.approx(2 + 2)


def test_sql(spark):
    res = compare(spark, duck("/root/testdata/sf0.001"), "op12", QUERIES["op12_centroid_clusters"], OP12, "/root/testdata/sf0.001")
    assert res["values_match"], res
