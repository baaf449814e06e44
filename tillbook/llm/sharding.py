"""Sharding by rendezvous hashing of stable record keys over weighted shards.

A record goes to the shard with the highest score ``-weight / ln(u)``, where
``u`` is a uniform hash of (record key, shard id). A further shard only takes
the records on which it scores highest, and no other record moves; a shard of
twice the weight gets twice the records.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import Stage, fresh, running_totals

#: Bytes counted for each record beside its text.
RECORD_BYTES = 16


def equal_weights(n: int) -> dict[int, float]:
    return {s: 1.0 for s in range(n)}


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """Shard of ``key``: the highest score, the smaller shard on a tie.

    A null key hashes like any other value, so all null keys share one shard.
    """
    if not weights or not all(w > 0 and math.isfinite(w) for w in weights.values()):
        raise ValueError("shards need positive, finite weights")
    table = F.array(*[F.struct(F.lit(-s).alias("s"), F.lit(float(w)).alias("w")) for s, w in sorted(weights.items())])

    def score(x: Column) -> Column:
        # the upper 53 bits of the hash as a double strictly between 0 and 1
        bits = F.shiftrightunsigned(F.xxhash64(key, -x["s"]), 11)
        u = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0 ** -53)
        return F.struct((-x["w"] / F.log(u)).alias("score"), x["s"].alias("s"))

    return -F.array_max(F.transform(table, score))["s"]


def assign(docs: DataFrame, weights: Mapping[int, float], key: str = "doc_id", text: str = "text",
           grown: Mapping[int, float] | None = None) -> DataFrame:
    """Narrow table: key (as ``doc_id``), size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers the records of a shard from 0 without gaps, by key, then
    text checksum, then size (nulls last); equal rows take neighbouring slots.
    The order is a distributed range sort over (shard, key, ...), so a hot key
    spans partitions; only the shards' first positions (one row for each
    shard) are broadcast. Null texts have no bytes and checksum 0. An empty
    table gives no rows. Texts never enter a shuffle.
    """
    k = F.col(f"`{key}`")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    narrow = docs.select(
        k.alias("doc_id"), (F.octet_length(body) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(k, weights).cast("int").alias("shard"),
        (rendezvous(k, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"))
    order = [F.col("shard"), *[F.col(c).asc_nulls_last() for c in ("doc_id", "text_crc32", "size")]]
    at = fresh(narrow, "_index")
    ranked = running_totals(Stage(docs.sparkSession), narrow, order, {}, index=at)
    first = ranked.groupBy("shard").agg(F.min(at).alias("_first"))
    ranked = ranked.join(F.broadcast(first), "shard")  # one row for each shard
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", (F.col(at) - F.col("_first")).alias("slot"), "grown_shard")


def shard(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``assign`` over ``n`` equal shards, and the shard that each record would have with one more."""
    return assign(docs, equal_weights(n), key, text, grown=equal_weights(n + 1))
