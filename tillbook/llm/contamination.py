"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is contained in a document if the document has at least
``threshold`` of the item's distinct word shingles. Items are partitioned by
the size of their shingle set. In a partition whose sets have at most ``u``
shingles, an item's sketch is a weighted bottom-k MinHash: the ``k`` shingles
that come first by the number of items that have them and then by hash, with
``k = u - ceil(threshold u) + 1``. A document that contains the item can lack
at most ``n - ceil(threshold n)`` of the item's ``n`` shingles, so it has at
least ``need = k - (n - ceil(threshold n)) >= 1`` of any ``k`` of them,
however long it is. Documents with fewer hits are ruled out without error; the
others are verified by exact shingle containment. The weight keeps a prompt
that many items share out of their sketches, so texts that hold the prompt
don't meet all those items.

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import Stage, fresh, let

SHINGLE_WORDS = 5
THRESHOLD = 0.8


def content_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits (null: none)."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(words: Column, make, n: int) -> Column:
    """``make`` applied to every window of ``n`` words; none for shorter texts."""
    return let(words, lambda all_words: F.when(F.size(all_words) >= n, F.transform(
        F.sequence(F.lit(0), F.size(all_words) - n), lambda i: make(*[F.get(all_words, i + k) for k in range(n)]))))


def shingle_hashes(words: Column, n: int = SHINGLE_WORDS) -> Column:
    return F.coalesce(_windows(words, F.xxhash64, n), F.array().cast("array<bigint>"))


def shingle_texts(words: Column, n: int = SHINGLE_WORDS) -> Column:
    return F.coalesce(_windows(words, lambda *w: F.concat_ws(" ", *w), n), F.array().cast("array<string>"))


def containments(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", n: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for every document
    that contains a test item at ``threshold`` or more.

    Items with fewer than ``n`` words have no shingle and are contained
    nowhere; null texts have no words. Rows with equal (id, text) count once;
    rows that share an id but differ in text are searched each on its own,
    and the best containment of an id pair is returned. Null ids are kept as
    a value of their own. Empty tables give no rows.
    """
    stage = Stage(docs.sparkSession)
    sets = (items.select(F.col(f"`{item_id}`").alias("item_id"), F.array_distinct(shingle_texts(content_words(F.col(f"`{item_text}`")), n)).alias("s"))
            .filter(F.size("s") > 0).distinct().withColumn("item", F.xxhash64("item_id", "s")).withColumn("n_item", F.size("s")))
    sets = stage.write(sets)
    # items whose sizes lie in [2^c, 2^(c+1)) share a partition
    upper = F.pow(F.lit(2.0), F.floor(F.log2("n_item")) + 1) - 1
    least = F.ceil(F.lit(threshold) * F.col("n_item") - 1e-9).cast("int")
    k = (upper - F.ceil(F.lit(threshold) * upper - 1e-9) + 1).cast("int")
    sized = sets.withColumn("k", F.least(k, F.col("n_item"))).withColumn("need", F.greatest(F.lit(1), F.col("k") - (F.col("n_item") - least)))
    hashed = F.transform("s", lambda x: let(F.split(x, " "), lambda w: F.xxhash64(*[F.get(w, i) for i in range(n)])))
    shingle = stage.write(sized.select("item", "need", "k", F.explode(F.array_distinct(hashed)).alias("h")))
    shared_by = shingle.groupBy("h").agg(F.count("*").alias("w"))
    first = F.slice(F.sort_array(F.collect_list(F.struct("w", "h"))), 1, F.first("k"))  # the shingles of one item
    sketches = shingle.join(shared_by, "h").groupBy("item").agg(F.first("need").alias("need"), first.alias("s"))
    sketches = stage.write(sketches.select("item", "need", F.explode("s.h").alias("h")))

    pages = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    hashes = pages.select("doc_id", F.explode(shingle_hashes(content_words(F.col("t")), n)).alias("h"))
    # no hints: sketches and candidates are written tables, so the planner knows their size
    hits = (hashes.join(sketches, "h").groupBy("doc_id", "item")
            .agg(F.size(F.collect_set("h")).alias("hits"), F.first("need").alias("need")).filter("hits >= need"))
    found = stage.write(hits.select("doc_id", "item"))

    # exact containment of the candidates: only their documents' shingles are made, and only they are compared
    wanted = found.select("doc_id").distinct()
    texts = pages.join(wanted, pages["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
    shingles = texts.select("doc_id", F.xxhash64("t").alias("copy"), F.explode(F.array_distinct(shingle_texts(content_words(F.col("t")), n))).alias("g"))
    pairs = found.join(sets, "item").select(F.col("doc_id").alias("d"), "item", "item_id", "n_item", F.explode("s").alias("g"))
    shared = (shingles.join(pairs, shingles["doc_id"].eqNullSafe(pairs["d"]) & (shingles["g"] == pairs["g"]))
              .groupBy("doc_id", "copy", "item", "item_id", "n_item").agg(F.count_distinct(shingles["g"]).alias("n_shared")))
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item"))
    return (shared.filter(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9).groupBy("doc_id", "item_id").agg(best.alias("x"))
            .select("doc_id", "item_id", F.col("x.n_shared").alias("n_shared"), F.col("x.n_item").cast("long").alias("n_item"), "x.containment"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", n: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that contain a test item; all columns kept."""
    name = fresh(docs, "_leak")
    leaks = Stage(docs.sparkSession).write(
        containments(docs, items, doc_id, text, item_id, item_text, n, threshold).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(leaks, F.col(f"`{doc_id}`").eqNullSafe(F.col(name)), "left_anti")
