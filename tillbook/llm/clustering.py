"""Centroid clustering with heap-ordered bounds.

Every vector carries the gap between its distances to the second nearest and
the nearest centroid at its last exact scan. When centroids move, the gap of a
vector in cluster c can shrink by no more than the drift of c plus the largest
drift of the others; that sum, accumulated over the rounds, is the offset of c.
A vector enters the heap of its cluster under the key gap + offset, so the keys
of a heap stay comparable while the offset grows, and a round pops only those
whose key the offset has reached. They are scanned against all centroids and
pushed into the heap of their nearest one; all others keep their cluster
without any distance being computed.

The state (vector, cluster, key) is a table written once for each round; every
Arrow batch of it is one set of heaps, so that a task's memory is bounded and
a lost executor only repeats its batches. Components are whole numbers, sums
are exact, and only the k centroids pass through the driver.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import Stage

CLUSTERS = 40
ROUNDS = 5
SCALE = 256
#: Largest component for which any squared distance of 64 components stays under 2 ** 63.
MOST = 2 ** 27
#: Vectors are scanned against all centroids so many at a time.
SCAN = 4096
#: What rounding can take from a gap: a share of it and an absolute part.
SLACK = 1e-9


def whole_components(vectors: DataFrame, id_col: str, vector: str, dims: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors with ``dims`` components, none null or non-finite: floor(scale * x)."""
    x = F.col(f"`{vector}`").cast("array<double>")
    good = (F.size(x) == dims) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    # a condition of its own, as a filter may be evaluated after the projection
    return vectors.filter(F.coalesce(good, F.lit(False))).select(
        F.col(f"`{id_col}`").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of ``x`` x centroids), whole numbers."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if 4 * x.shape[1] * float(most) ** 2 < 2 ** 53:  # every sum is exact in doubles
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (a @ c.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number) and gap of each row."""
    near, gap = np.empty(len(x), np.int64), np.full(len(x), np.inf)
    for lo in range(0, len(x), SCAN):
        d = squared(x[lo:lo + SCAN], centroids)
        near[lo:lo + SCAN] = d.argmin(axis=1)
        if d.shape[1] > 1:
            two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
            gap[lo:lo + SCAN] = (two[:, 1] - two[:, 0]) - SLACK * (1 + two[:, 1])
    return near, gap


def rescan_expired(x: np.ndarray, cluster: np.ndarray, key: np.ndarray, centroids: np.ndarray, offset: np.ndarray) -> int:
    """Pops the expired vectors from the heaps of their clusters, scans them and
    pushes them anew; ``cluster`` and ``key`` are changed in place. Returns
    the number of scanned vectors."""
    order = np.lexsort((key, cluster))
    cuts = np.searchsorted(cluster[order], np.arange(len(centroids) + 1))
    heaps = [list(zip(key[own].tolist(), own.tolist())) for own in (order[lo:hi] for lo, hi in zip(cuts, cuts[1:]))]  # sorted lists are heaps
    expired = []
    for heap, limit in zip(heaps, offset.tolist()):
        while heap and heap[0][0] <= limit:
            expired.append(heapq.heappop(heap)[1])
    if expired:
        rows = np.array(expired)
        near, gap = scan(x[rows], centroids)
        cluster[rows], key[rows] = near, gap + offset[near]
        for c, entry in zip(near.tolist(), zip(key[rows].tolist(), expired)):
            heapq.heappush(heaps[c], entry)
    out = np.array([i for heap in heaps for _, i in heap], np.int64)  # the batch's heaps hold every vector once
    assert len(out) == len(x)
    return len(expired)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def assign(state: DataFrame, centroids: np.ndarray, offset: np.ndarray, dims: int, first: bool) -> DataFrame:
    """The state after one assignment; ``was`` is the cluster before it (-1 at first)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), dims)
            if first:
                was = np.full(len(x), -1)
                cluster, gap = scan(x, centroids)
                key, scanned = gap + offset[cluster], np.ones(len(x), bool)
            else:
                was = b.column(2).to_numpy().astype(np.int64)
                cluster, key = was.copy(), b.column(3).to_numpy().copy()
                scanned = key <= offset[cluster]
                rescan_expired(x, cluster, key, centroids, offset)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster.astype(np.int32)), pa.array(key),
                                              pa.array(was.astype(np.int32)), pa.array(scanned)],
                                             names=["vec_id", "v", "cluster", "key", "was", "scanned"])

    schema = T.StructType([state.schema["vec_id"], state.schema["v"], *[T.StructField(n, t) for n, t in (
        ("cluster", T.IntegerType()), ("key", T.DoubleType()), ("was", T.IntegerType()), ("scanned", T.BooleanType()))]])
    columns = ["vec_id", "v"] if first else ["vec_id", "v", "cluster", "key"]
    return state.select(*columns).mapInArrow(run, schema)


def moved_sums(state: DataFrame, k: int, dims: int) -> list:
    """(cluster, at, total) of the vectors that changed their cluster, taken
    into the new one and out of the old one; at = -1 holds their number. Each
    partition sends at most k rows of sums, the result has k * (dims + 1)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), np.int64)
        for b in batches:
            x = np.hstack([_matrix(b.column(0), dims), np.ones((b.num_rows, 1), np.int64)])
            for sign, i in ((1, 1), (-1, 2)):
                c = b.column(i).to_numpy()
                order = np.argsort(c, kind="stable")
                found, starts = np.unique(c[order], return_index=True)
                if len(found):
                    part = sign * np.add.reduceat(x[order], starts, axis=0)
                    sums[found[found >= 0]] += part[found >= 0]
        rows = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(sums[rows].tolist(), pa.list_(pa.int64()))], names=["cluster", "sums"])

    moved = state.filter("cluster <> was").select("v", "cluster", "was")
    parts = moved.mapInArrow(run, "cluster int, sums array<bigint>").select("cluster", F.posexplode("sums").alias("at", "s"))
    return parts.groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("total")).collect()


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
                    dims: int = 64, seed: str = "2:", work: list | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Vectors of another length, or with a null or non-finite component, are
    left out. The first centroids are the ``k`` vectors with the smallest
    hashes of seed and id (fewer vectors: as many clusters; equal ids: by
    their components; a null id hashes as an empty one). Every round assigns
    all vectors to the nearest centroid (ties: smaller number) and replaces
    the centroids of non-empty clusters by the floor of their exact means;
    one more assignment follows. Repeated rows and equal vectors are vectors
    of their own. No vectors: no rows. Components beyond ``MOST`` after
    scaling raise OverflowError, as their squared distances don't fit a long.
    ``work``, if given, gets the number of scanned vectors of each assignment.
    """
    spark, stage = vectors.sparkSession, Stage(vectors.sparkSession)
    state = stage.write(whole_components(vectors, id_col, vector, dims))
    n, most = state.agg(F.count("*"), F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()
    schema = T.StructType([state.schema["vec_id"], *[T.StructField(c, t) for c, t in (
        ("cluster", T.IntegerType()), ("distance", T.LongType()), ("cluster_inertia", T.LongType()), ("inertia", T.LongType()),
        ("centroid_sha256", T.StringType()))]])
    if not n:
        return spark.createDataFrame([], schema)
    if most is not None and most > MOST:
        raise OverflowError(f"component {most} is beyond {MOST}: squared distances would not fit a long")
    chosen = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    centroids = np.array([r.v for r in state.orderBy(chosen, "v").select("v").limit(k).collect()], np.int64)  # k rows
    k = len(centroids)
    sums, counts, offset = [[0] * dims for _ in range(k)], [0] * k, np.zeros(k)
    for turn in range(rounds + 1):
        new = stage.write(assign(state, centroids, offset, dims, first=turn == 0))
        stage.drop(state)
        state = new
        if work is not None:
            work.append(state.filter("scanned").count())
        if turn == rounds:
            break
        for r in moved_sums(state, k, dims):
            if r["at"] == dims:
                counts[r["cluster"]] += int(r["total"])
            else:
                sums[r["cluster"]][r["at"]] += int(r["total"])
        new = np.array([[s // c for s in own] if c else old for own, c, old in zip(sums, counts, centroids.tolist())], np.int64)
        drift = np.sqrt(((new - centroids).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
        others = [max(np.delete(drift, c), default=0.0) for c in range(k)]
        offset = offset + drift + np.array(others)
        centroids = new
    # the k centroids: a table of k rows, bounded by the parameter
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    means = spark.createDataFrame([(c, v, h) for c, (v, h) in enumerate(zip(centroids.tolist(), digests))],
                                  "cluster int, centroid array<bigint>, centroid_sha256 string")
    d = F.aggregate(F.zip_with("v", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    placed = stage.write(state.select("vec_id", "v", "cluster").join(F.broadcast(means), "cluster")
                         .select("vec_id", "cluster", d.alias("distance"), "centroid_sha256"), rows=n)
    stage.drop(state)
    per = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = per.agg(F.sum("cluster_inertia").alias("inertia")).first()["inertia"]
    return placed.join(F.broadcast(per), "cluster").withColumn("inertia", F.lit(total).cast("long")).select(*schema.names)  # per: k rows
