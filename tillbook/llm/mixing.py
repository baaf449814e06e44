"""Mixing sources to target weights.

Every source gets a share of the mix by weight, held under a cap; inside a
source the documents are put in a hash-random order by a range sort, prefix
sums of their sizes are computed across partitions, and the order is cut at
the source's exact budget. A budget above the source's size repeats whole
epochs first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import WS, WS_CHARS, Stage, fresh, running_totals, word_count

#: Production mix: weights that repeat over the ordered sources, share of all words, epochs at most.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2


def source_targets(stage: Stage, sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> also start (words of the sources before it) and target.

    Sources are ordered by code point, null last, and weigh ``weights`` in
    turn. Sharing by weight, capping and sharing the excess again ends at the
    level where target = min(cap, weight x level) and the targets sum to the
    whole: with sources sorted by cap / weight, the level is the first at
    which the rest of the words, spread by weight over the sources from there
    on, stays under their caps. Both orders are distributed prefix sums, so
    the number of sources is not bounded.
    """
    ranked = running_totals(stage, sizes, [F.col("source").asc_nulls_last()], {"start": "source_size"}, index="rank")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    table = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    # weights as whole millionths, for exact sums
    table = table.withColumn("_w", F.round(F.col("weight") * 1_000_000).cast("long"))
    by_level = running_totals(stage, table, [F.col("cap") / F.col("weight"), F.col("rank")],
                              {"caps_before": "cap", "weights_before": "_w"}, index="level_rank")
    total = by_level.agg((F.sum("source_size") * share).alias("_total"), F.sum("_w").alias("_weights"))
    joined = by_level.join(F.broadcast(total))  # one row
    level = (F.col("_total") - F.col("caps_before")) / ((F.col("_weights") - F.col("weights_before")) / 1_000_000)
    joined = joined.withColumn("_level", level)
    fits = F.col("_level") * F.col("weight") <= F.col("cap")
    # the first source, by cap / weight, that its share doesn't fill up
    chosen = joined.filter(fits).agg(F.min_by("_level", "level_rank").alias("level"))
    out = joined.join(F.broadcast(chosen))  # one row
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return out.select("source", "source_size", "start", target.alias("target"))


def mix_plan(docs: DataFrame, size: Column, id_col: str = "doc_id", source: str = "source", seed: str = "mix",
             weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``docs`` plus size, source_size, target and taken: the words of the
    document in the mix, repeats counted.

    The order inside a source is by the MD5 of seed and id, then id, then
    size; equal rows keep any order among themselves, with the same sums. All
    positions come from the data, so reruns agree. Null sizes count 0; a
    source without words gets target 0. Clashing columns of ``docs`` are
    replaced by those four. An empty table gives no rows.
    """
    stage = Stage(docs.sparkSession)
    keep = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    key = fresh(rows, "_key")
    rows = rows.withColumn(key, F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))))
    src = F.col(f"`{source}`")
    before = fresh(rows, "_before")
    order = [src.asc_nulls_last(), F.col(key), F.col(f"`{id_col}`").asc_nulls_last(), F.col("size")]
    ordered = running_totals(stage, rows, order, {before: "size"})
    sizes = ordered.groupBy(src.alias("source")).agg(F.sum("size").alias("source_size"))
    name, start = fresh(rows, "_source"), fresh(rows, "_start")
    targets = stage.write(source_targets(stage, sizes, weights, share, max_epochs)
                          .select(F.col("source").alias(name), "source_size", F.col("start").alias(start), "target"))
    # no hint: one row for each source, and the planner knows the size of the written table
    joined = ordered.join(targets, src.eqNullSafe(F.col(name)))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col(before) - F.col(start))))
    return joined.select(*[F.col(f"`{c}`") for c in keep], "size", "source_size", "target",
                         (epochs * F.col("size") + part).cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word."""
    pieces = F.split(text, f"(?<={WS})(?!{WS})")
    lead = F.when(text.rlike(f"^{WS}"), F.lit(1)).otherwise(F.lit(0))
    return F.rtrim(F.array_join(F.slice(pieces, F.lit(1), n.cast("int") + lead), ""), F.lit(WS_CHARS))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """The mixed documents, with the columns of ``docs``: one row for each
    whole epoch of a document, and one row with its first words where the
    budget of its source ends inside it (once for each source and mix;
    ``n_chars``, if present, follows). Documents that the mix doesn't reach,
    and those without words, are left out."""
    plan = mix_plan(docs, word_count(F.col(f"`{text}`")), id_col, source, seed, weights, share, max_epochs)
    cut = fresh(plan, "_words")
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    left = F.col("taken") - whole * F.col("size")
    copies = F.concat(F.when(whole > 0, F.array_repeat(F.col("size"), whole)).otherwise(F.array().cast("array<bigint>")),
                      F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<bigint>")))
    rows = plan.withColumn(cut, F.explode(copies))
    t = F.col(f"`{text}`")
    rows = rows.withColumn(text, F.when(F.col(cut) < F.col("size"), first_words(t, F.col(cut))).otherwise(t))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(cut) < F.col("size"), F.length(t).cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
