"""Line dedup with a log-template tree.

A line walks a tree of fixed depth: its number of words, then its first
``depth`` words, with words that hold a digit as wildcards. Inside a leaf the
words of each position after those vote: a word that stands there in at least
``min_docs`` texts and in a share ``fixed_share`` of the leaf's texts is part
of the wording, any other one is a variable field. Both sides of the share
grow with the corpus, so a field stays a field at every size. A line
generalised so is its template.

A line is dropped wherever it stands if ``min_docs`` different texts hold its
template, and a share ``similarity`` of its words after the prefix is fixed;
or if they hold the line itself (but for words with digits), with that share
of them free of digits. Lines that only share their beginning stay.

Leaves are found from the raw line: counting its spaces and masking its first
words is all that is done to most lines; only lines of leaves that ``min_docs``
texts reach are split and masked as a whole. Votes and recurrences are counts
combined on the map side, so neither a hot leaf nor a hot line meets in one
task, and the templates don't depend on the order of the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.llm.common import WS, Stage, fresh

DEPTH = 3
MIN_DOCS = 5
FIXED_SHARE = 0.1
SIMILARITY = 0.6
WILDCARD = "<*>"
DIGIT_WORD = "[^ 0-9]*[0-9][^ ]*"


def key128(*values: Column) -> Column:
    """Two 64-bit hashes of a value with different seeds."""
    return F.struct(F.xxhash64(*values).alias("h"), F.xxhash64(F.lit(1), *values).alias("g"))


def single_spaced(text: Column) -> Column:
    """A text whose words in a line stand one space apart. Few texts hold other
    white space than single spaces and line feeds."""
    odd = text.contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | text.contains(c)
    return F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text)


def masked(words: Column) -> Column:
    """A single-spaced text with words that hold a digit as wildcards."""
    return F.when(words.rlike("[0-9]"), F.regexp_replace(words, DIGIT_WORD, WILDCARD)).otherwise(words)


def text_key(text: Column) -> Column:
    return key128(F.coalesce(text, F.lit("")))


def _lines(docs: DataFrame, text: str, depth: int) -> DataFrame:
    """(copy, line, leaf) of every line with a word, its words one space apart;
    ``copy`` identifies a text, so that copies of it count once."""
    t = F.col(f"`{text}`")
    rows = docs.select(text_key(t).alias("copy"), F.split(single_spaced(t), "\n").alias("lines"))  # the key once for each text
    # explode_outer: for explode, the optimizer would split every text again to filter it beforehand
    rows = rows.select("copy", F.explode_outer("lines").alias("line")).withColumn("line", F.trim("line")).filter("line <> ''")
    rows = rows.withColumn("start", F.substring_index("line", " ", depth))
    spaces = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    return rows.select("copy", "line", F.concat(spaces.cast("string"), F.lit(" "), masked(F.col("start"))).alias("leaf"))


def recurring_lines(stage: Stage, docs: DataFrame, text: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS,
                    fixed_share: float = FIXED_SHARE, similarity: float = SIMILARITY) -> DataFrame:
    """(copy, key): the lines of each text that recur across texts, as keys of the text and of the single-spaced line."""
    lines = _lines(docs, text, depth)
    leaves = lines.select("leaf", "copy").distinct().groupBy("leaf").agg(F.count("*").alias("texts")).filter(F.col("texts") >= min_docs)
    leaves = stage.write(leaves.withColumn("id", F.monotonically_increasing_id()))
    busy = lines.join(leaves.select("leaf"), "leaf", "left_semi")  # no hints: the planner knows the size of the written table
    busy = busy.select("copy", "leaf", "line").repartition("leaf", "copy").dropDuplicates(["leaf", "copy", "line"])
    busy = busy.withColumn("alone", F.count("*").over(Window.partitionBy("leaf", "copy")) == 1)
    busy = busy.select("copy", "leaf", "alone", key128(F.col("line")).alias("key"), F.split(masked(F.col("line")), " ").alias("tokens"))
    busy = busy.withColumn("line", key128(F.col("tokens"))).join(leaves.select("leaf", "id"), "leaf")
    busy = stage.write(busy.drop("leaf").withColumnRenamed("id", "leaf"))  # leaves are numbers from here on
    leaves = leaves.select(F.col("id").alias("leaf"), "texts")
    rest = lambda at: F.col(at) >= depth  # noqa: E731  positions from 0
    voting = busy.select("copy", "leaf", "alone", F.posexplode("tokens").alias("at", "word")).filter(rest("at") & (F.col("word") != WILDCARD))
    # a text votes once for a word; only one with several lines in the leaf has to be held against itself
    once = voting.filter("alone").groupBy("leaf", "at", "word").agg(F.count("*").alias("n"))
    several = voting.filter("not alone").groupBy("leaf", "at", "word").agg(F.count_distinct("copy").alias("n"))
    votes = once.unionByName(several).groupBy("leaf", "at", "word").agg(F.sum("n").alias("n"))
    fixed = votes.join(leaves, "leaf").filter(F.col("n") >= F.greatest(F.lit(min_docs), F.lit(fixed_share) * F.col("texts")))
    # one row for each different line from here on
    one = stage.write(busy.groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"), F.count_distinct("copy").alias("texts")))
    judged = F.when(F.size("tokens") > depth, F.slice("tokens", depth + 1, 2**30)).otherwise(F.col("tokens"))
    plain = F.size(F.filter(judged, lambda w: w != WILDCARD))
    same = one.filter((F.col("texts") >= min_docs) & (plain >= F.lit(similarity) * F.size(judged))).select("leaf", "line")
    kept = (one.filter(F.size("tokens") > depth).select("leaf", "line", "texts", F.size("tokens").alias("size"), F.posexplode("tokens").alias("at", "word"))
            .join(fixed.select("leaf", "at", "word"), ["leaf", "at", "word"])
            .groupBy("leaf", "line").agg(F.first("size").alias("size"), F.first("texts").alias("texts"),
                                         F.sort_array(F.collect_list(F.struct("at", "word"))).alias("kept")))
    kept = kept.filter(F.size("kept") >= F.lit(similarity) * (F.col("size") - depth))
    kept = stage.write(kept.select("leaf", "line", "texts", key128(F.col("leaf"), F.col("kept")).alias("template")))
    # a line that recurs by itself decides for its template; the others stand in few texts each, whose keys are counted
    sure = kept.filter(F.col("texts") >= min_docs).select("template")
    rare = busy.join(kept.filter(F.col("texts") < min_docs), ["leaf", "line"]).groupBy("template").agg(F.count_distinct("copy").alias("n"))
    often = sure.unionByName(rare.filter(F.col("n") >= min_docs).select("template")).distinct()
    gone = kept.join(often, "template", "left_semi").select("leaf", "line").unionByName(same).distinct()
    return busy.join(stage.write(gone), ["leaf", "line"], "left_semi").select("copy", "key")


def drop_recurring(docs: DataFrame, text: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS, fixed_share: float = FIXED_SHARE,
                   similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, plus ``n_lines``
    (lines with a word) and ``n_dropped``; columns of those names are replaced.

    Lines without a word stay. Null texts stay null and count no lines. All
    copies of a text get the same result and count once, so a text isn't
    dropped for being copied. An empty table gives no rows.
    """
    stage = Stage(docs.sparkSession)
    found = recurring_lines(stage, docs, text, depth, min_docs, fixed_share, similarity)
    drops = stage.write(found.groupBy("copy").agg(F.collect_set("key").alias("_drop")).withColumnRenamed("copy", "_copy"))
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    t = F.col(f"`{text}`")
    # one key for each different text; copies meet it through a join whose large partitions Spark can split
    rows = docs.join(drops, text_key(t) == F.col("_copy"), "left")
    # lines and what is left of them are columns of their own, so that each is made once for a row
    lines, left = fresh(rows, "_lines"), fresh(rows, "_left")
    rows = rows.withColumn(lines, F.split(t, "\n"))
    rows = rows.withColumn(left, F.when(F.col("_drop").isNull(), F.col(lines)).otherwise(
        F.filter(lines, lambda x: ~F.array_contains("_drop", key128(F.trim(single_spaced(x)))))))
    n_lines = F.size(F.filter(lines, lambda x: x.rlike(f"[^{WS[1:-1]}]")))
    count = lambda n: F.when(t.isNull(), F.lit(0)).otherwise(n).cast("long")
    return rows.select(*[F.when(F.col("_drop").isNull(), t).otherwise(F.array_join(left, "\n")).alias(c) if c == text else F.col(f"`{c}`") for c in keep],
                       count(n_lines).alias("n_lines"), count(F.size(lines) - F.size(left)).alias("n_dropped"))
