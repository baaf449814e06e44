"""Shared pieces: stage tables in the cluster's shared folder, text
expressions, distributed ranks and prefix sums, connected components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.session import ensure_checkpoint_dir

#: White space of the word rule: space, tab, line feed, vertical tab, form feed, return.
WS_CHARS = " \t\n\x0b\x0c\r"
WS = r"[\x20\x09-\x0D]"
#: Narrow rows for each file of a stage table whose size is known.
ROWS_PER_FILE = 250_000


class Stage:
    """Tables written once to the shared folder of ``spark.checkpoint.dir``.

    A stage table cuts the lineage: later readers and recomputed tasks of lost
    executors read its files instead of running the upstream plan again, and
    the planner knows its real size. Tables live until ``drop`` or the end of
    the Python process, because lazily returned frames still read them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        atexit.register(self.close)

    def write(self, df: DataFrame, rows: int | None = None, codec: str | None = None) -> DataFrame:
        """Write ``df`` and return the written table. ``rows``, a bound on its
        number of narrow rows where that is known, keeps small tables from
        being spread over many files: one file for each ``ROWS_PER_FILE``.
        ``codec`` is the compression of a wide table, else the session's."""
        path = f"{self.base}/{len(self.paths)}"
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
        df.write.parquet(path, compression=codec)
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a stage table that no returned frame reads any more."""
        self._delete(df._stage_path)

    def close(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # the session has ended before the process
            pass

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row. An expression
    that is used inside a lambda would else run for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the runs of non-white-space of ``text`` (null or blank: empty)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS + "+"))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def running_totals(stage: Stage, df: DataFrame, order: Sequence[Column], values: dict[str, str],
                   index: str | None = None) -> DataFrame:
    """``df`` plus, for each ``{name: column}`` of ``values``, the sum of that
    long column over all rows before this one in the order of ``order``
    (nulls count 0), and the row's global position in ``index``.

    Rows are range-partitioned and sorted, every partition sums its own rows
    as a stream of Arrow batches, and the totals of the partitions (one row
    each) give the offsets. No key is gathered in one task: a hot key spans as
    many partitions as it needs. The result reads a stage table, so positions
    stay fixed whatever is recomputed.
    """
    index = index or fresh(df, "_index")
    pid = fresh(df, "_pid")
    extra = [pid, index, *values]
    schema = T.StructType([*df.schema.fields, T.StructField(pid, T.IntegerType()),
                           *[T.StructField(c, T.LongType()) for c in extra[1:]]])
    names, columns = list(df.columns), list(values.values())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, sums = TaskContext.get().partitionId(), 0, [0] * len(columns)
        for b in batches:
            n = b.num_rows
            out = [b.column(i) for i in range(len(names))]
            out += [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n, dtype=np.int64))]
            for k, c in enumerate(columns):
                v = b.column(names.index(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                cum = np.cumsum(v) + sums[k]
                out.append(pa.array(cum - v))
                sums[k] = int(cum[-1]) if n else sums[k]
            seen += n
            yield pa.RecordBatch.from_arrays(out, names=names + extra)

    local = stage.write(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    sums = local.groupBy(pid).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(columns)])
    offsets = sums.select(pid, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
                          *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_s{i}") for i in range(len(columns))])
    shift = dict(zip([index, *values], ["_n", *[f"_s{i}" for i in range(len(columns))]]))
    # one row for each partition of the sort: bounded by the partition count
    joined = local.join(F.broadcast(offsets.withColumnRenamed(pid, "_off_pid")), F.col(pid) == F.col("_off_pid"))
    return joined.select(*[F.col(f"`{c}`") for c in names], *[(F.col(c) + F.col(s)).alias(c) for c, s in shift.items()])


def components(stage: Stage, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: (node, root), root the
    smallest node; nodes are those of ``edges`` (loops and nulls are ignored).

    Alternating large-star and small-star rounds on DataFrames: each round is
    two aggregations by node (combined on the map side) and two joins, written
    as a stage table. Ends when a round changes nothing.
    """
    x, y = F.col(a), F.col(b)
    cur = stage.write(edges.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    state, rows = None, cur.count()
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = stage.write(small.select("e.u", "e.v").filter("u != v").distinct(), rows=rows)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stage.drop(cur)
        cur = new
        if state is not None and tuple(now) == state or now[0] == 0:
            break
        state, rows = tuple(now), now[0]
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
