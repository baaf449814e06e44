"""Parquet ledger store (SRC-LEDGER, SINK-APPEND, SINK-SNAPSHOT, SINK-DOC): plain partitioned tables.

Layout under ``root``: one folder per table, partitioned by ``load`` (the
name of the append that brought the rows, ``base`` for all others) and

* expense, income, wallet_transfer: by ``month`` of ``date``, so that a date
  range prunes whole folders;
* expense_tag: by blocks of expense ids, so that a cascade touches only the
  blocks of the expenses it changes;
* dimensions: by ``load`` alone.

Files are range-clustered by key, so that statistics skip row groups. Every
write is a Spark write: an append adds files to ``base``; a named append, a
change of some partitions and a snapshot are dynamic partition overwrites of
a table written before (``fix``), so a repeated one leaves the same rows.
Partitions whose last row has gone keep one row without a key, which readers
leave out. Tables are written one after the other, those that only hang on
others (expense_tag) first: a reader that comes in between sees no expense
without its tags, and a job that broke off is run again. Frames read before a
partition is overwritten must be read anew. One writer at a time is assumed.

``_ids`` holds the highest id that each load has brought by table, written
before the rows; the id of a deleted row is not handed out again.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook import schemas
from tillbook.ledger import Ledger
from tillbook.plans.materialize import fix

MONTH_PARTITIONED = ("expense", "income", "wallet_transfer")
ID_BLOCK = 1_000_000
# Target rows per output file for fact tables.
ROWS_PER_FILE = 5_000_000
BASE = "base"


def id_block(col: Column) -> Column:
    return F.floor(col / F.lit(ID_BLOCK)).cast("int")


#: table -> (partition column, its type, its value)
PARTITIONING = {
    **{name: ("month", T.DateType(), lambda: F.trunc("date", "month")) for name in MONTH_PARTITIONED},
    "expense_tag": ("id_block", T.IntegerType(), lambda: id_block(F.col("expense_id"))),
}
#: Tables in the order in which they are written.
WRITTEN = ("expense_tag", *[name for name in schemas.TABLES if name != "expense_tag"])


def key_of(name: str) -> str:
    return "expense_id" if name == "expense_tag" else "id"


def part_of(name: str) -> list[str]:
    return [PARTITIONING[name][0]] if name in PARTITIONING else []


class LedgerStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # ---- reading ----------------------------------------------------------
    def _stored(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _table(self, name: str) -> DataFrame:
        parts = [T.StructField(PARTITIONING[name][0], PARTITIONING[name][1])] if name in PARTITIONING else []
        return self._stored(name, T.StructType([*schemas.TABLES[name].fields, *parts, T.StructField("load", T.StringType())]))

    def max_ids(self, before: str | None = None) -> dict[str, int]:
        """Highest id ever handed out, by table, without the load ``before``."""
        ids = self._stored("_ids", T.StructType.fromDDL("table string, high int, load string"))
        if before is not None:
            ids = ids.filter(F.col("load") != before)
        return dict(ids.groupBy("table").agg(F.max("high")).filter("`max(high)` IS NOT NULL").collect())  # one row for each table

    def read(self, before: str | None = None) -> Ledger:
        """The ledger; partition columns stay, so that filters on them prune.
        ``before``: ids go on as if that load had not been written yet."""
        frames = {name: self._table(name).filter(F.col(key_of(name)).isNotNull()) for name in schemas.TABLES}
        return Ledger(self.spark, max_ids=self.max_ids(before), **frames)

    # ---- writing ----------------------------------------------------------
    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        load = F.coalesce("load", F.lit(BASE)) if "load" in rows.columns else F.lit(BASE)
        parts = [PARTITIONING[name][2]().alias(c) for c in part_of(name)]
        return rows.select(*[f.name for f in schemas.TABLES[name].fields], *parts, load.alias("load"))

    def _write(self, name: str, rows: DataFrame, overwrite: bool) -> None:
        # ranges over partition and key: a month that holds a third of the rows is written by many tasks
        order = ["load", *part_of(name), key_of(name)]
        out = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", ROWS_PER_FILE)
        out = out.mode("overwrite").option("partitionOverwriteMode", "dynamic") if overwrite else out.mode("append")
        out.partitionBy("load", *part_of(name)).parquet(f"{self.root}/{name}")

    def _mark_ids(self, tables: dict[str, DataFrame], load: str) -> None:
        tops = [df.agg(F.max("id").cast("int").alias("high")).select(F.lit(name).alias("table"), "high")
                for name, df in tables.items() if name in MONTH_PARTITIONED]
        if tops:
            old = self._stored("_ids", T.StructType.fromDDL("table string, high int, load string")).filter(F.col("load") == load)
            high = reduce(DataFrame.unionByName, [old.select("table", "high"), *tops]).groupBy("table").agg(F.max("high").alias("high"))
            out = high.withColumn("load", F.lit(load)).coalesce(1)  # one row for each table; only ever higher
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(f"{self.root}/_ids")

    def append(self, tag: str | None = None, **rows: DataFrame) -> None:
        """SINK-APPEND: adds rows to some tables. With a ``tag`` they are a load
        of that name: an append that is repeated replaces its own rows."""
        rows = {name: fix(self._shaped(name, df.drop("load"))) for name, df in rows.items()}
        self._mark_ids(rows, tag or BASE)
        for name in _ordered(rows):
            self._write(name, rows[name].withColumn("load", F.lit(tag or BASE)), overwrite=tag is not None)

    def overwrite(self, touched: dict[str, DataFrame], **rows: DataFrame) -> None:
        """New contents of some partitions: ``rows[name]`` holds all rows of
        the months (or id blocks) in the one-column frame ``touched[name]``
        and no others. Rows may read the store."""
        self._replace({name: (rows[name], touched_of(self._partitions(name), touched[name])) for name in rows})

    def snapshot(self, **tables: DataFrame) -> None:
        """SINK-SNAPSHOT: new contents for whole tables; rows may read the store."""
        self._replace({name: (df, self._partitions(name)) for name, df in tables.items()})

    def save(self, ledger: Ledger) -> None:
        """Every table of ``ledger`` as the new contents."""
        self.snapshot(**{name: ledger.table(name) for name in schemas.TABLES})

    def _partitions(self, name: str) -> DataFrame:
        return self._table(name).select(*part_of(name), "load")

    def _replace(self, tables: dict[str, tuple[DataFrame, DataFrame]]) -> None:
        """table -> (its new rows, the partitions that they stand for)."""
        # a row without a key for every partition there is, so that one that empties is overwritten too
        out = {name: fix(self._shaped(name, rows).unionByName(parts.distinct(), allowMissingColumns=True)) for name, (rows, parts) in tables.items()}
        self._mark_ids(out, BASE)
        for name in _ordered(out):
            self._write(name, out[name], overwrite=True)


def _ordered(names: Iterable[str]) -> list[str]:
    return [name for name in WRITTEN if name in names]


def touched_of(table: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of a stored table in the months or id blocks of ``touched`` (one
    column of that name); other partitions are pruned at run time."""
    part = touched.columns[0]
    # the comparison tells the optimizer that the values are selective
    kind = F.lit("0001-01-01").cast("date") if part == "month" else F.lit(-(2**31))
    return table.join(touched.filter(F.col(part) >= kind), part, "left_semi")


def read_ledger(spark: SparkSession, root: str) -> Ledger:
    return LedgerStore(spark, root).read()


def write_document(doc: DataFrame, path: str) -> None:
    """SINK-DOC: the summary document as JSON text (camelCase keys)."""
    doc.select(F.to_json(F.struct(*doc.columns), {"ignoreNullFields": "false"}).alias("value")) \
        .coalesce(1).write.mode("errorifexists").text(path)


def read_jdbc_table(spark: SparkSession, url: str, table: str, properties: dict,
                    num_partitions: int = 64) -> DataFrame:
    """SRC-LEDGER from an existing relational ledger: a partitioned JDBC read
    split on ``id`` (bounds from one MIN/MAX query). Needs the database's
    JDBC driver on the classpath; not exercised by the tests here."""
    bounds = spark.read.jdbc(url, f"(SELECT MIN(id) AS lo, MAX(id) AS hi FROM {table}) b",
                             properties=properties).collect()[0]
    if bounds.lo is None:
        return spark.createDataFrame([], schemas.TABLES[table])
    return spark.read.jdbc(url, table, column="id", lowerBound=bounds.lo, upperBound=bounds.hi + 1,
                           numPartitions=num_partitions, properties=properties)
