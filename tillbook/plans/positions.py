"""Global row positions over a sorted DataFrame, without a single-task sort.

* ``with_positions``: dense 0-based position of every row in key order.
  Range-partition + sort inside each partition, tag rows with
  ``monotonically_increasing_id`` (partition index in the upper bits), write
  them to the shared checkpoint folder so that partition contents are fixed
  even if executors are lost, count rows per partition, prefix-sum those
  counts (one row per partition) and add.
* ``prefix_sums``: the sum of a column over all rows before each row.
* ``number_elements``: positions of the kept elements of documents, in
  (document, element) order. Only one narrow row per document (per ``PIECE``
  elements of a long one) is sorted; an element's place inside it is its index
  less the rejected ones before it.

No number of partitions is given anywhere: adaptive execution sets it by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.plans.materialize import fix
from tillbook.session import ensure_checkpoint_dir

_LOW_BITS = 33  # monotonically_increasing_id: partition index << 33 | row number
_LOW_MASK = (1 << _LOW_BITS) - 1
#: Elements of a document that are counted as one piece.
PIECE = 4096


def with_positions(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """``df`` plus a LONG column ``name`` = 0-based rank in ``order``
    (order columns should form a unique key)."""
    ensure_checkpoint_dir(df.sparkSession)
    # The tagged rows are written once: counts and rows must see the very same
    # partition ids (AQE may coalesce a re-read shuffle differently), and a
    # lost executor re-reads the shared files instead of re-sorting.
    tagged = fix(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("_rid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_rid"), _LOW_BITS)
    starts = _starts(tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")))
    return (tagged.join(F.broadcast(starts), part == F.col("_part"))
            .withColumn(name, F.col("_start") + F.col("_rid").bitwiseAND(F.lit(_LOW_MASK)))
            .drop("_rid", "_part", "_start"))


def _starts(totals: DataFrame) -> DataFrame:
    """(_part, _n) -> (_part, _start): sums of the partitions before; one row per partition."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))


def prefix_sums(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` plus the sum of ``value`` over all rows before each one in ``order`` (a unique key)."""
    tagged = fix(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    starts = _starts(tagged.groupBy("_part").agg(F.sum(value).alias("_n")))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return (tagged.withColumn("_own", own).join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_start") + F.col("_own")).drop("_part", "_start", "_own"))


def number_elements(rows: DataFrame, doc: str, index: str, keep: Column, name: str) -> DataFrame:
    """The rows that ``keep`` holds for, plus a LONG column ``name`` = their
    0-based rank in (doc, index) order.

    ``rows`` holds every element of a document, by its index from 0 on; rows
    with a null index are markers and are left out. A document whose elements
    don't stand once each raises an error.
    """
    kept = F.coalesce(keep, F.lit(False)) & F.col(index).isNotNull()
    pieces = rows.withColumn("_piece", F.floor(F.col(index) / PIECE))
    counted = pieces.groupBy(doc, "_piece").agg(
        F.count_if(kept).alias("_kept"), F.count(index).alias("_all"), F.min(index).alias("_low"), F.max(index).alias("_high"),
        F.sort_array(F.collect_list(F.when(~kept, F.col(index)))).alias("_gaps")).filter(F.col("_kept") > 0)
    once = (F.col("_low") == F.col("_piece") * PIECE) & (F.col("_high") - F.col("_low") + 1 == F.col("_all"))
    counted = counted.select(doc, "_piece", F.when(once, F.col("_kept")).otherwise(F.raise_error(
        F.lit("elements of a document must stand once each"))).cast("long").alias("_kept"), "_gaps")
    # fixed first: the range sort samples its input, which would count everything once more
    starts = prefix_sums(fix(counted), [doc, "_piece"], "_kept", "_first")
    before = F.size(F.filter("_gaps", lambda g: g < F.col(index)))
    numbered = pieces.filter(kept).join(starts.select(doc, "_piece", "_first", "_gaps"), [doc, "_piece"])
    return numbered.withColumn(name, F.col("_first") + (F.col(index) - F.col("_piece") * PIECE - before).cast("long")).drop(
        "_piece", "_first", "_gaps")
