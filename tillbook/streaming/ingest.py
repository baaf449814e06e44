"""Streaming ingest: JSON request documents arriving as files -> validated
rows in the stored ledger, one micro-batch at a time.

``readStream.text`` picks up new files; ``foreachBatch`` runs the ingest job
(field rules, reference checks, batch gate, id assignment) on each micro-batch.
Rejected rows go to a reject folder partitioned by query and epoch.

Exactly once: a micro-batch is a load named by the id that Spark gives the
query (kept in its checkpoint, new if that is recreated) and the epoch. A
replayed epoch (after a failure before the streaming checkpoint) hands out the
same ids, as its own load doesn't count, and overwrites its own partitions, as
it does with its rejects. Batch ids are ``epoch << 40 |
monotonically_increasing_id`` of the micro-batch rows; the file source
replays an epoch with the same files, so ids are stable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.jobs import ingest
from tillbook.plans.materialize import scratch
from tillbook.sources.store import LedgerStore

EPOCH_SHIFT = 40


def micro_batch(store: LedgerStore, kind: str, mode: str, reject_dir: str | None):
    """The function that ``foreachBatch`` calls."""
    def handle(batch: DataFrame, epoch_id: int) -> None:
        query = f"{kind}-{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}"
        with scratch():
            docs = batch.select(
                (F.lit(epoch_id).cast("long") * F.lit(1 << EPOCH_SHIFT) + F.monotonically_increasing_id()).alias("batch_id"),
                "value")
            validated = ingest(store, docs, kind, mode, tag=f"{query}-{epoch_id}")
            if reject_dir:
                rejected = validated.filter((F.col("status") != "ok") | ~F.col("batch_ok"))
                (rejected.withColumn("query", F.lit(query)).withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite")
                 .option("partitionOverwriteMode", "dynamic").partitionBy("query", "epoch").parquet(reject_dir))

    return handle


def start_ingest(spark: SparkSession, source_dir: str, store: LedgerStore, checkpoint_location: str,
                 kind: str = "expenses", mode: str = "fail_batch", reject_dir: str | None = None,
                 available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the ingest query; returns the StreamingQuery. ``kind`` is
    ``expenses`` or ``incomes``; one JSON document per line in each file."""
    if kind not in ("expenses", "incomes"):
        raise ValueError(kind)
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = reader.load(source_dir)
    writer = (docs.writeStream.foreachBatch(micro_batch(store, kind, mode, reject_dir))
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
