"""Ranked lexical search by presence masks.

One pass turns every document into narrow postings of the items' terms; the
second scores them in blocks of documents. In a block each term has a bitmap
of the documents that hold it. An item's bitmaps, transposed, give every
document the mask of the item's terms that it holds, and documents with the
same mask form a group. A mask's score is at most the sum of its terms'
largest contributions in the block, so the masks are taken by descending
bound, their documents scored exactly, and the block is left as soon as the
next bound lies under the item's k-th best score so far.

Items are taken in blocks of at most ``TERMS_PER_BLOCK`` (item, term) pairs
(a longer item is a block of its own); only a block is held on the driver and
in a task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import Stage, ascii_lower

TOP = 50
#: Pairs of an item and one of its terms that are searched for together.
TERMS_PER_BLOCK = 50_000
#: Numbers of the table of contributions (terms x documents) of a block of documents.
CELLS = 1 << 23
DOCS_PER_BLOCK = 8192
#: Documents that are scored together at first; doubled from there on.
FIRST_DOCS = 128

#: Term bytes of UTF-8: digits, letters (A-Z lower-cased) and everything beyond ASCII; others become spaces.
_TERM_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: Column) -> Column:
    """Array of the distinct terms of a text (null: none)."""
    found = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def postings(docs: DataFrame, id_col: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf) of every document with a term: all its terms with
    repeats in ``n``; ``term`` and ``tf`` list the ones of the vocabulary."""
    known = vocabulary.keys()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, sizes, found, counts, ends = [], [], [], [], [0]
            for i, t in enumerate(b.column(1).cast(pa.binary())):
                w = (t.as_py() or b"").translate(_TERM_BYTES).split()
                if not w:
                    continue
                c = Counter(w)
                hits = c.keys() & known
                keep.append(i)
                sizes.append(len(w))
                found += [vocabulary[x] for x in hits]
                counts += [c[x] for x in hits]
                ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (found, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), *lists],
                                             names=["doc_id", "n", "term", "tf"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n long, term array<int>, tf array<int>")


class _Best:
    """The k best (score, id) of an item so far; equal scores by id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """Scores under it can't enter; those equal to it can, by a smaller id."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score))[:self.k]
        self.score, self.id, self.null = score[order], ids[order], null[order]


def mask_groups(planes: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(groups x terms) presence of each distinct mask, and the documents of each group.

    Row t of ``planes`` is the bitmap of the documents (0 to n - 1) with the
    item's term t. Documents without a term belong to no group."""
    docs = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(planes, axis=0), count=n))
    if not len(docs):
        return np.empty((0, len(planes)), np.uint8), []
    masks = np.packbits(np.unpackbits(planes, axis=1, count=n)[:, docs], axis=0).T  # the bitmaps, transposed
    width = -(-masks.shape[1] // 8) * 8
    padded = np.zeros((len(docs), width), np.uint8)
    padded[:, :masks.shape[1]] = masks
    keys = padded.view(np.uint64)[:, 0] if width == 8 else padded.view(f"V{width}")[:, 0]
    order = np.argsort(keys, kind="stable") if width == 8 else np.lexsort(padded.view(np.uint64).T)
    ordered = keys[order]
    cuts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return np.unpackbits(padded[order[cuts]], axis=1, count=len(planes)), np.split(docs[order], cuts[1:])


def _search_block(best: list[_Best], items: list[np.ndarray], ids: np.ndarray, null: np.ndarray, score: np.ndarray) -> None:
    """Takes a block of documents into the best of every item; row t of
    ``score`` holds what term t adds to each document."""
    n = len(ids)
    planes, most = np.packbits(score > 0, axis=1), score.max(axis=1).astype(np.float64)
    for top, own in zip(best, items):
        if not len(own) or most[own].sum() < top.least:
            continue
        present, groups = mask_groups(planes[own], n)
        if not groups:
            continue
        bound = present @ most[own]
        order = np.argsort(-bound, kind="stable")
        at, take = 0, FIRST_DOCS
        while at < len(order) and bound[order[at]] >= top.least:  # all later masks lie under it too: safely finished
            chosen, count = [], 0
            # small masks are scored together, a large one alone
            while at < len(order) and bound[order[at]] >= top.least and (not chosen or count + len(groups[order[at]]) <= take):
                chosen.append(groups[order[at]])
                count += len(chosen[-1])
                at += 1
            rows = np.concatenate(chosen)
            found = score[np.ix_(own, rows)].sum(axis=0)
            good = found >= top.least
            top.add(found[good], ids[rows[good]], null[rows[good]])
            take *= 2


def _score_items(posted: DataFrame, items: list[list[int]], weights: list[int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item in every partition."""
    own = [np.array(sorted(x), np.int64) for x in items]
    weight = np.array(weights, np.int64)
    rows = int(min(DOCS_PER_BLOCK, max(64, CELLS // max(1, len(weights)))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in own]
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                b = batch.slice(lo, rows)
                ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                null = b.column(0).is_null().to_numpy(zero_copy_only=False)
                # whole numbers of Python, as 50 n N can pass 64 bits
                m = np.array([50 + 50 * n * n_docs // n_terms for n in b.column(1).to_pylist()], np.int64)
                term = b.column(2).flatten().to_numpy()
                tf = b.column(3).flatten().to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(ids)), np.diff(b.column(2).offsets.to_numpy()))
                score = np.zeros((len(weight), len(ids)), np.int64)
                score[term, doc] = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                _search_block(best, own, ids, null, score)
        for i, top in enumerate(best):
            if len(top.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.score), i, np.int32)), pa.array(top.id, mask=top.null), pa.array(top.score)],
                                                 names=["item", "doc_id", "score"])

    return posted.mapInArrow(run, "item int, doc_id long, score long")


def _blocks(pairs: Iterable, limit: int) -> Iterator[list[tuple]]:
    """Lists of (item_id, its terms) with at most ``limit`` terms together, or one item."""
    block, size, last, found = [], 0, object(), []
    for item, term in pairs:
        if item != last:
            if found and size + len(found) > limit and block:
                yield block
                block, size = [], 0
            if found:
                block.append((last, found))
                size += len(found)
            last, found = item, []
        found.append(term)
    if found:
        if block and size + len(found) > limit:
            yield block
            block = []
        block.append((last, found))
    if block:
        yield block


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", terms_per_block: int = TERMS_PER_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0.

    Terms, document counts and the score are those of the query contract:
    saturated term frequency with length normalisation, in whole numbers, so
    results don't depend on the order of summing. All documents with a term
    count in N, L and df. ``id_col`` is an integer; null ids come last among
    equal scores, rows that repeat an id are documents of their own. Item rows
    with the same id are one item, with the terms of all its rows; items
    without terms, documents without terms and empty tables give no rows.
    Other columns are not read.
    """
    spark, stage = docs.sparkSession, Stage(docs.sparkSession)
    kind = items.schema[item_id].dataType
    pairs = items.select(F.col(f"`{item_id}`").alias("item_id"), F.explode(terms(F.col(f"`{item_text}`").cast("string"))).alias("term")).distinct()
    pairs = stage.write(pairs.orderBy("item_id", "term"))
    out = []
    for block in _blocks(pairs.orderBy("item_id", "term").toLocalIterator(), terms_per_block):
        vocabulary: dict[bytes, int] = {}
        own = [[vocabulary.setdefault(t.encode(), len(vocabulary)) for t in found] for _, found in block]
        posted = stage.write(postings(docs, id_col, text, vocabulary))
        n_docs, n_terms = posted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # one row for each term of the block
        df = dict(posted.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*")).collect())
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))]
        found = _score_items(posted, own, weights, n_docs, max(1, n_terms), k)
        names = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)])
        best = found.withColumn("rank", F.row_number().over(
            Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))).filter(F.col("rank") <= k)
        out.append(best.join(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], names), "item"))
    if not out:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", kind)])).selectExpr(
            "item_id", "0 AS rank", "0L AS doc_id", "0L AS score")
    return reduce(DataFrame.unionByName, out).select("item_id", "rank", "doc_id", "score")
