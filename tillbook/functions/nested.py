"""Nested-result helpers: ordered arrays of structs and JSON text at the sink."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_text(c) -> Column:
    """DATE -> 'YYYY-MM-DD' text."""
    return F.date_format(c, "yyyy-MM-dd")


def ordered_collect(payload: Column, *keys: Column, skip_null: Column | None = None) -> Column:
    """Aggregate: array of ``payload`` ordered by ``keys`` (ascending; negate a
    numeric key for descending). Empty group -> ``[]``, never NULL.

    Sorting happens on a struct whose leading fields are the keys, so one
    ``sort_array`` orders the list; ``transform`` then drops the keys.
    ``skip_null`` (a boolean column) excludes rows, like SQL ``FILTER (WHERE ..)``.
    """
    fields = [k.alias(f"k{i}") for i, k in enumerate(keys)] + [payload.alias("v")]
    item = F.struct(*fields)
    if skip_null is not None:
        item = F.when(skip_null, item)
    # collect_list skips NULL items and yields [] for a group with none
    return F.transform(F.sort_array(F.collect_list(item)), lambda x: x["v"])


def to_json_text(c: Column) -> Column:
    """Struct/array -> compact JSON text, keeping null fields (``"x":null``)."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def date_between(df, start, end):
    """Inclusive optional date bounds. On a month-partitioned table (a
    ``month`` column, as the store reads it) the same bounds are also put on
    ``month`` so whole partitions are pruned before any file is opened."""
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start))
        if "month" in df.columns:
            df = df.filter(F.col("month") >= F.trunc(F.lit(start), "month"))
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(end))
        if "month" in df.columns:
            df = df.filter(F.col("month") <= F.trunc(F.lit(end), "month"))
    return df
