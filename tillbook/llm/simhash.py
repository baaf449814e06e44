"""SimHash near-dedup with bit-sliced comparison.

Fingerprints within ``radius`` differing bits are found exactly: the 64 bits
are split into radius + 2 blocks, and two such fingerprints agree on at least
two whole blocks, so every pair meets in a bucket that is keyed by two blocks.
Inside a bucket the fingerprints are stored as vertical bit planes; the
distances of a query to 64 fingerprints at a time are kept in bit-sliced
counters that take two planes by a carry-save adder, and a block of
comparisons is abandoned once all its distances exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import Stage, components, fresh

SHINGLE_WORDS = 3
RADIUS = 2
HASH_SEED = 42
#: Distinct fingerprints of one bucket that are compared in one piece; larger buckets are dealt in pairs of pieces.
PIECE = 4096
#: Fingerprints of small buckets that are compared together.
TILE = 1024
#: Side of a block of comparisons, in fingerprints.
BLOCK = 256
ALL_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of one text (UTF-8): bit k is 1 if it is 1 in more than
    half of the shingles' hashes. No words: 0. Fewer words than a shingle:
    one shingle of all words."""
    w = text.lower().split()  # on bytes: A-Z only; space, tab, line feed, vertical tab, form feed, return
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return digest(b" ".join(w), HASH_SEED)
    h = np.array([digest(b" ".join(s), HASH_SEED) for s in zip(*[w[i:] for i in range(shingle)])], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 14):  # bounded memory for very long texts
        bits = np.unpackbits(h[lo:lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str, name: str, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` plus the signed 64-bit fingerprint of ``text`` (null: no words)."""
    at = docs.columns.index(text)
    names = [*docs.columns, name]
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).cast(pa.binary())
            found = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found.view(np.int64))], names=names)

    return docs.mapInArrow(run, schema)


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) bit planes: bit j of word w of plane p is bit p of fingerprint 64 w + j."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # (n, 64)
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def near_bits(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Bit j of word w of row q: fingerprint 64 w + j of the planes lies within
    ``radius`` of query q."""
    masks = ((queries[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)) * ALL_ONES
    counters = [np.zeros((len(queries), planes.shape[1]), np.uint64) for _ in range((radius + 1).bit_length())]
    over = np.zeros_like(counters[0])
    for p in range(0, 64, 2):
        x = planes[p][None, :] ^ masks[p][:, None]
        y = planes[p + 1][None, :] ^ masks[p + 1][:, None]
        low = counters[0] ^ x
        carry = (counters[0] & x) | (low & y)  # carry-save adder of the lowest counter and two planes
        counters[0] = low ^ y
        for k in range(1, len(counters)):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p % 8 == 6 and ((over | _above(counters, radius)) == ALL_ONES).all():
            return np.zeros_like(over)  # abandoned: no distance of this block can come back under the radius
    return ~(over | _above(counters, radius))


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bit-sliced ``counter > radius``."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above |= equal & counters[k]
            equal = equal & ~counters[k]
    return above


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint that it reaches) for those of
    ``fps`` (distinct) that link to another one."""
    n = len(fps)
    words = -(-n // 64)
    near = np.empty((n, words), np.uint64)
    planes = _planes(fps)
    for lo in range(0, n, BLOCK):
        for w in range(0, words, BLOCK // 64):
            near[lo:lo + BLOCK, w:w + BLOCK // 64] = near_bits(planes[:, w:w + BLOCK // 64], fps[lo:lo + BLOCK], radius)
    if n % 64:
        near[:, -1] &= np.uint64((1 << (n % 64)) - 1)
    linked = np.bitwise_count(near).sum(axis=1) > 1
    member, root = [], []
    todo = linked.copy()
    for start in np.flatnonzero(linked):
        if not todo[start]:
            continue
        group, front = np.zeros(n, bool), np.array([start])
        group[start] = True
        while len(front):
            reach = np.bitwise_or.reduce(near[front], axis=0)
            new = np.unpackbits(reach.view(np.uint8), bitorder="little")[:n].astype(bool) & ~group
            group |= new
            front = np.flatnonzero(new)
        todo &= ~group
        ids = fps[group].view(np.int64)
        member.append(ids)
        root.append(np.full(len(ids), ids.min()))
    if not member:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(member), np.concatenate(root)


def links(stage: Stage, fps: DataFrame, name: str, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints of ``fps`` linked
    within ``radius``: a spanning forest of every bucket, at most one row for
    each fingerprint and bucket."""
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    fp = F.col(name)

    def part(i: int):
        return F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))

    keys = [F.struct(F.lit(t).alias("t"), part(i).alias("x"), part(j).alias("y"))
            for t, (i, j) in enumerate(combinations(range(blocks), 2))]
    rows = fps.select(fp.alias("fp"), F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.x", "k.y")
    rows = stage.write(rows)
    hot = (rows.groupBy("t", "x", "y").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
           .withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int")))
    own = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    # every two pieces of a large bucket meet in one cell
    cells = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1),
                        lambda p: F.struct(F.least(p, own).alias("i"), F.greatest(p, own).alias("j")))
    dealt = rows.join(hot, ["t", "x", "y"]).withColumn("c", F.explode(cells)).select("t", "x", "y", "c.i", "c.j", "fp")
    cell = ["t", "x", "y", "i", "j"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(found: list[np.ndarray]) -> pa.RecordBatch:
            a, b = forest(np.unique(np.concatenate(found)).view(np.uint64), radius)
            apart = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[apart]), pa.array(b[apart])], names=["a", "b"])

        held, count, last = [], 0, None
        for batch in batches:
            ids = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            fp_values = batch.column(5).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                if hi == lo:
                    continue
                if count >= TILE and tuple(ids[:, lo]) != last:  # a tile ends where a cell ends
                    yield compared(held)
                    held, count = [], 0
                last = tuple(ids[:, lo])
                held.append(fp_values[lo:hi])
                count += hi - lo
        if held:
            yield compared(held)

    return dealt.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "a long, b long")


def near_groups(stage: Stage, rows: DataFrame, id_col: str, name: str, radius: int = RADIUS) -> DataFrame:
    """(fp, group_id): for each distinct fingerprint of ``rows`` the smallest
    id reachable over links, its own documents included (null ids only if
    there is no other)."""
    total = rows.count()
    reps = stage.write(rows.groupBy(F.col(name).alias("fp")).agg(F.min(f"`{id_col}`").alias("first_id")), rows=total)
    found = components(stage, links(stage, reps, "fp", radius))
    joined = stage.write(reps.join(found, reps["fp"] == found["node"], "left")
                         .select("fp", "first_id", F.coalesce("root", "fp").alias("root")), rows=total)
    least = joined.groupBy("root").agg(F.min("first_id").alias("group_id"))
    return joined.join(least, "root").select("fp", "root", "group_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS,
                    radius: int = RADIUS) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id.

    Equal fingerprints are one node whatever their number, so a large group
    of copies costs one comparison. Documents without words have fingerprint
    0 and link like any other. Repeated rows share their component. An empty
    table gives no rows.
    """
    stage = Stage(docs.sparkSession)
    one = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = stage.write(with_fingerprints(one, "text", "fp", shingle).select("doc_id", "fp"))
    groups = near_groups(stage, rows, "doc_id", "fp", radius)
    return rows.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("group_id").alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS,
               radius: int = RADIUS) -> DataFrame:
    """One document of each group, the one with the smallest id, all columns
    kept. Where that id stands on several rows, one of them stays; a group of
    null ids keeps one row."""
    stage = Stage(docs.sparkSession)
    row_h, row_g = fresh(docs, "_row_h"), fresh(docs, "_row_g")
    ident = [F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`"), F.col(f"`{text}`").isNull(), F.col(f"`{text}`")]
    keyed = docs.withColumn(row_h, F.xxhash64(*ident)).withColumn(row_g, F.xxhash64(F.lit(1), *ident))
    # all is decided on narrow rows: id, fingerprint and two hashes of id and text
    one = keyed.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(row_h).alias("h"), F.col(row_g).alias("g"))
    rows = stage.write(with_fingerprints(one, "text", "fp", shingle).select("doc_id", "fp", "h", "g"))
    total = rows.count()
    groups = near_groups(stage, rows, "doc_id", "fp", radius)
    # of each group the rows with its id, by fingerprint and hash the first of them
    first = (rows.join(groups, "fp").filter(F.col("doc_id").eqNullSafe(F.col("group_id")))
             .groupBy("root").agg(F.min(F.struct("fp", "h", "g")).alias("k")).select("k.h", "k.g"))
    again = rows.groupBy("h", "g").agg(F.count("*").alias("n")).filter("n > 1").select("h", "g")
    first = stage.write(first.join(again.withColumn("again", F.lit(True)), ["h", "g"], "left").withColumn("again", F.col("again").isNotNull()), rows=total)
    # the texts are shuffled once; only repeated rows of a kept one are also brought together
    kept = lambda which: keyed.join(first.filter(which).select(F.col("h").alias(row_h), F.col("g").alias(row_g)), [row_h, row_g], "left_semi")
    out = kept(~F.col("again")).unionByName(kept(F.col("again")).dropDuplicates([row_h, row_g]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
