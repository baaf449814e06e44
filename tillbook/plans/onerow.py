"""Combining one-row results without a cross join or a driver round trip."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_one_row_frames(*frames: DataFrame) -> DataFrame:
    """Frames of exactly one row each, with disjoint column names, become one
    row. They are stacked with ``unionByName`` (missing columns NULL) and
    folded by a global aggregate that keeps the single non-NULL value per
    column. Everything stays in one plan, so shared sub-plans (e.g. a
    pre-aggregated fact table) are computed once via exchange reuse.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.any_value(c, True).alias(c) for c in stacked.columns])
