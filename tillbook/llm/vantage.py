"""Nearest neighbours by vantage-point trees.

The vectors are numbered and dealt by number into shards of ``shard_rows``;
each shard has a tree of its own. A node takes one of its vectors as vantage
point and parts the others at the median of their distances to it; leaves
hold up to ``leaf_rows``. A node keeps the least and largest distance of each
side, so by the triangle inequality no vector of a side lies nearer to a
query at distance d than max(least - d, d - largest, 0), and a leaf no nearer
than the largest of these along its path.

A query visits the leaves of a tree by rising bound and stops at the first
whose bound times ``factor`` exceeds its k-th best distance so far: factor one
is exact, larger factors leave more leaves out. Queries first search the
shard that they lie in; the distance found there is where they start from in
all other shards.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.llm.common import Stage, running_totals

NEIGHBOURS = 10
#: Every vector whose id is divisible by it is a query.
EVERY = 100
SHARD_ROWS = 2048
LEAF_ROWS = 64
#: Relaxation of the pruning; 1 is exact.
FACTOR = 1.0
#: Queries that descend a tree together.
QUERY_ROWS = 512
#: Columns of a row sent to a shard: its own vectors (is_query 0), or queries with the distance known to hold k vectors.
ROW = ["dims", "shard", "is_query", "rid", "vec_id", "radius", "v"]
#: Share by which rounding may change a bound or a quick distance.
SLACK = 1e-9


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a and b in double precision, summed from the first component on."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        diff = a[:, i] - b[:, i]
        total += diff * diff
    return np.sqrt(total)


class Tree:
    """A vantage-point tree over the rows of ``x``, flat: vantage rows, leaf
    rows, and for every leaf the sides taken on its path."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.x, self.sq = x, (x * x).sum(axis=1)
        self.vantage: list[int] = []
        self.sides: list[tuple[int, float, float]] = []  # vantage, least and largest distance of the side
        self.leaves: list[np.ndarray] = []
        self.paths: list[list[int]] = []  # sides above each leaf
        todo = [(np.arange(len(x)), [])]
        while todo:
            rows, path = todo.pop()
            if len(rows) <= leaf_rows:
                self.leaves.append(rows)
                self.paths.append(path)
                continue
            # of a few spread candidates, the vector whose distances to the others vary most
            tried = rows[:: max(1, len(rows) // 5)][:5]
            spread = [exact(np.broadcast_to(x[t], (len(rows), x.shape[1])), x[rows]) for t in tried]
            best = int(np.argmax([d.std() for d in spread]))
            d = spread[best]
            order = np.argsort(d, kind="stable")  # a split by rank, so equal vectors are parted too
            v, half = len(self.vantage), len(rows) // 2
            self.vantage.append(int(tried[best]))
            for part in (order[:half], order[half:]):
                self.sides.append((v, float(d[part[0]]), float(d[part[-1]])))
                todo.append((rows[part], [*path, len(self.sides) - 1]))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries x leaves) least possible distance."""
        if not self.sides:
            return np.zeros((len(q), len(self.leaves)))
        point = self.x[self.vantage]
        d = np.stack([exact(q, np.broadcast_to(p, q.shape)) for p in point], axis=1)
        v, least, most = (np.array(c) for c in zip(*self.sides))
        at = d[:, v.astype(np.int64)]
        side = np.maximum(np.maximum(least - at, at - most), 0) - SLACK * (1 + at)
        return np.stack([side[:, path].max(axis=1) for path in self.paths], axis=1)

    def search(self, q: np.ndarray, own: np.ndarray, start: np.ndarray, ids: np.ndarray, null: np.ndarray, rids: np.ndarray, k: int,
               factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(queries x k) distances and rows of the nearest vectors, and the
        number of distances computed (for tests and tuning). ``own``: the number of the query's own
        row; ``start``: a distance that is known to hold the k nearest.
        Missing ones have the distance inf."""
        bound = self.bounds(q)
        order = np.argsort(bound, axis=1, kind="stable")
        best, row = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
        radius, qq, spent = start.copy(), (q * q).sum(axis=1), len(q) * len(self.vantage)
        active = np.arange(len(q))
        for turn in range(len(self.leaves)):
            leaf = order[active, turn]
            near = bound[active, leaf] * factor <= radius[active]
            active, leaf = active[near], leaf[near]  # bounds only rise from here: the rest of the query's leaves is pruned
            if not len(active):
                break
            for at in np.unique(leaf):
                who, rows = active[leaf == at], self.leaves[at]
                spent += len(who) * len(rows)
                scale = qq[who][:, None] + self.sq[rows][None, :]
                quick = scale - 2 * (q[who] @ self.x[rows].T)
                limit = radius[who]
                open_ = ~(quick > (limit * limit)[:, None] + SLACK * scale) & (rids[rows][None, :] != own[who][:, None])
                any_open = open_.any(axis=1)
                who, open_ = who[any_open], open_[any_open]
                i, j = np.nonzero(open_)
                found = np.full(open_.shape, np.inf)
                found[i, j] = exact(q[who[i]], self.x[rows[j]])
                both = np.hstack([best[who], found])
                which = np.hstack([row[who], np.broadcast_to(rows, found.shape)])
                keep = np.lexsort((rids[which], ids[which], null[which], both), axis=1)[:, :k]
                best[who], row[who] = np.take_along_axis(both, keep, 1), np.take_along_axis(which, keep, 1)
                radius[who] = np.minimum(radius[who], best[who, -1])
        return best, row, spent


def usable(vector: Column) -> Column:
    """No null or non-finite component, not empty and not zero."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def _search_shards(rows: DataFrame, k: int, factor: float, leaf_rows: int) -> DataFrame:
    """(rid, query_id, found, vec_id, score) of every query in the shards that
    it was sent to.

    ``rows``: those of ``ROW``; sorted, the vectors of a shard come before the
    queries sent to it, so a task holds one shard and a block of queries at a
    time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(parts: list[pa.RecordBatch]) -> np.ndarray:
            flat = np.concatenate([p.column("v").flatten().to_numpy(zero_copy_only=False) for p in parts])
            return flat.reshape(sum(p.num_rows for p in parts), -1)

        def column(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
            return np.concatenate([p.column(name).fill_null(0).to_numpy(zero_copy_only=False) for p in parts])

        shard, held, tree, ids, null, rids = None, [], None, None, None, None
        for b in batches:
            key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ROW[:3]])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                if hi == lo:
                    continue
                piece = b.slice(lo, hi - lo)
                if tuple(key[:2, lo]) != shard:
                    shard, held, tree = tuple(key[:2, lo]), [], None
                if not key[2, lo]:
                    held.append(piece)
                    continue
                if tree is None:
                    tree, ids, rids = Tree(matrix(held), leaf_rows), column(held, "vec_id"), column(held, "rid")
                    null = np.concatenate([p.column("vec_id").is_null().to_numpy(zero_copy_only=False) for p in held])
                for at in range(0, piece.num_rows, QUERY_ROWS):
                    q = piece.slice(at, QUERY_ROWS)
                    best, row, _ = tree.search(matrix([q]), column([q], "rid"), column([q], "radius"), ids, null, rids, k, factor)
                    i, j = np.nonzero(np.isfinite(best))
                    found = row[i, j]
                    yield pa.RecordBatch.from_arrays(
                        [q.column("rid").take(pa.array(i)), q.column("vec_id").take(pa.array(i)), pa.array(rids[found]),
                         pa.array(ids[found], mask=null[found]), pa.array(best[i, j])], names=["rid", "query_id", "found", "vec_id", "score"])

    sent = rows.select(*ROW).repartition("dims", "shard").sortWithinPartitions(*ROW[:3])
    return sent.mapInArrow(run, "rid long, query_id long, found long, vec_id long, score double")


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, factor: float = FACTOR, id_col: str = "vec_id",
            vector: str = "embedding", shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of every row whose id is divisible by ``every``.

    Vectors that are null, empty or zero, or hold a null or non-finite
    component, take no part; only vectors with as many components are
    compared. A row is never its own neighbour; rows that repeat an id are
    rows of their own, as queries too. Equal distances go by the smaller id,
    null ids last. Fewer candidates than ``k`` are all returned. An empty
    table, and one without queries, gives no rows.
    """
    stage = Stage(vectors.sparkSession)
    x = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("v")).filter(usable(F.col("v")))
    # numbered by length first: the shards of a length are a range of numbers
    ranked = running_totals(stage, rows.withColumn("dims", F.size("v")),
                            [F.col("dims"), F.col("vec_id").asc_nulls_last(), F.xxhash64("v")], {}, index="rid")
    own = ranked.select("dims", F.floor(F.col("rid") / shard_rows).alias("shard"), F.lit(0).alias("is_query"), "rid", "vec_id",
                        F.lit(float("inf")).alias("radius"), "v")
    queries = own.filter(F.col("vec_id") % every == 0).withColumn("is_query", F.lit(1))
    first = stage.write(_search_shards(own.unionByName(queries), k, factor, leaf_rows))
    # a full list of the own shard bounds the k-th distance in the whole table
    reach = first.groupBy("rid").agg(F.when(F.count("*") == k, F.max("score")).alias("reach"))
    shards = stage.write(own.groupBy("dims").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi")))  # one row for each length
    known = queries.join(reach, "rid", "left").withColumn("radius", F.coalesce("reach", "radius")).join(shards, "dims")
    others = F.filter(F.sequence("lo", "hi"), lambda s: s != F.col("shard"))
    second = stage.write(_search_shards(own.unionByName(known.withColumn("shard", F.explode(others)).select(*own.columns)), k, factor, leaf_rows))
    near = Window.partitionBy("rid").orderBy("score", F.col("vec_id").asc_nulls_last(), "found")
    found = first.unionByName(second).withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
