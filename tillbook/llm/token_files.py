"""Token-id files: Parquet list columns with chosen encodings, row groups and page indexes.

Layout of a file set (one folder, files in ascending id order):

* ``doc_id`` long and ``n_tokens`` int, delta-encoded;
* ``tokens`` list of int, dictionary-encoded (a vocabulary of 50 thousand ids
  takes 16 bits each) or delta-encoded.

Rows are sorted by id, row groups are bounded in bytes, and pages in bytes and
rows; the column and offset indexes that the writer adds let a reader with a
filter on ``doc_id`` skip row groups by statistics and pages by index, and a
reader of the metadata columns never touches the tokens.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.llm.common import Stage, running_totals

END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
#: Word pieces whose ids a task remembers; on reaching it, the memory is emptied.
CACHE_PIECES = 400_000
#: Texts that are encoded together.
TEXTS = 2500
FILE_SCHEMA = "doc_id long, n_tokens int, tokens array<int>"


class Encoder:
    """Encodes texts with a byte-level BPE file of the tokenizers library.

    The library's pre-tokenizer starts a new piece at every single space that
    is followed by a character that isn't white space; BPE never merges across
    pieces. Texts can therefore be cut at those spaces. The cuts of a batch
    are dictionary-encoded, and each different cut is parted once more where a
    letter stands before punctuation and around a single line feed, which are
    piece boundaries too. The different parts are encoded and remembered, and
    the ids of the texts are gathered by cut. Texts for which a cut isn't safe
    are encoded whole.
    """

    #: Marks a part without a space before it, as the first one of a text.
    FIRST = "\x00"
    #: Stands where a cut is parted.
    SEAM = "\x01"
    LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
    WORD = re.compile(f"[{LETTERS}]+")
    #: A letter before punctuation other than an apostrophe, and a line feed between characters that aren't white space.
    WORD_END = f"([{LETTERS}])([!-&(-/:-@\\[-`{{-~])"
    LINE_END = f"([!-~{LETTERS}])\n([!-~{LETTERS}])"
    #: First characters that surely aren't white space, for the C++ regex engine.
    SAFE_START = r"^[!-~\pL]"
    #: Texts with a mark of this class or the special token are encoded whole.
    WHOLE = r"[\x00\x01]|<\|"
    #: Words that are encoded in one text, and parts that are encoded by one call.
    JOINED = 1000
    LEARNED = 20_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads also keep memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Tokens that begin with a space, by id; the byte-level alphabet shows it as U+0120.
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[k for token, k in vocabulary.items() if token[0] == "\u0120"]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, parts: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.sizes)
        self.known.update(zip(parts, range(at, at + len(parts))))
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids, self.starts, self.sizes = np.append(self.ids, ids), np.append(self.starts, starts), np.append(self.sizes, sizes)

    def _learn(self, parts: list[str]) -> None:
        """Remember parts that are not known yet.

        Words of letters are encoded together, each after a space: no token
        spans two of them, and just the first token of each begins with one.
        """
        is_word = self.WORD.fullmatch
        words = [p for p in parts if is_word(p)]
        others = [p for p in parts if not is_word(p)]
        for lo in range(0, len(words), self.LEARNED):  # a token takes some hundred bytes inside the library
            some = words[lo:lo + self.LEARNED]
            found = self._whole([" " + " ".join(some[k:k + self.JOINED]) for k in range(0, len(some), self.JOINED)])
            ids = np.fromiter(chain.from_iterable(found), np.int32, sum(map(len, found)))
            self._add(some, ids, np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids))))
        for lo in range(0, len(others), self.LEARNED):
            some = others[lo:lo + self.LEARNED]
            found = self._whole([p[1:] if p[:1] == self.FIRST else " " + p for p in some])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._add(some, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes)

    def _gather(self, parts: np.ndarray) -> np.ndarray:
        """Ids of a sequence of known parts."""
        sizes = self.sizes[parts]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[parts] - (ends - sizes), sizes) + np.arange(ends[-1])]

    def _cut_ids(self, cuts: pa.Array) -> pa.ListArray:
        """Ids of each of the different cuts."""
        seam = f"\\1{self.SEAM}{self.FIRST}"
        parted = pc.replace_substring_regex(cuts, self.LINE_END, f"{seam}\n{self.SEAM}{self.FIRST}\\2")
        lists = pc.split_pattern(pc.replace_substring_regex(parted, self.WORD_END, f"{seam}\\2"), self.SEAM)
        flat = lists.flatten().dictionary_encode()
        parts = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        get = self.known.get
        numbers = np.fromiter((get(p, -1) for p in parts), np.int64, len(parts))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            missing = [parts[k] for k in new.tolist()]
            self._learn(missing)
            numbers[new] = [self.known[p] for p in missing]
        sequence = numbers[flat.indices.to_numpy(zero_copy_only=False)]
        ends = np.concatenate([[0], np.cumsum(self.sizes[sequence])])
        return pa.ListArray.from_arrays(pa.array(ends[_offsets(lists)].astype(np.int32)), pa.array(self._gather(sequence)))

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        texts = pa.array(texts, pa.string()).fill_null("")
        if len(self.known) > CACHE_PIECES:
            self._forget()
        if not len(texts):
            return []
        lists = pc.split_pattern(pc.binary_join_element_wise(self.FIRST, texts, ""), " ")
        flat = lists.flatten().dictionary_encode()
        codes, bounds = flat.indices.to_numpy(zero_copy_only=False), _offsets(lists)
        # a cut is a piece boundary if what follows the space surely isn't white space; a text with other cuts stays whole
        risky = ~pc.match_substring_regex(flat.dictionary, self.SAFE_START).to_numpy(zero_copy_only=False)[codes]
        risky[bounds[:-1]] = False  # the first cut of a text carries the mark
        alone = np.add.reduceat(risky, bounds[:-1]) > 0
        alone |= pc.match_substring_regex(texts, self.WHOLE).to_numpy(zero_copy_only=False)
        taken = self._cut_ids(flat.dictionary).take(flat.indices)
        ids, ends = taken.values.to_numpy(), taken.offsets.to_numpy()[bounds]
        out = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
        for k in np.flatnonzero(alone):
            out[k] = np.array(self._whole([texts[k].as_py()])[0], np.int32)
        return out


def _offsets(lists: pa.ListArray) -> np.ndarray:
    """Bounds of the lists in their flattened values."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


#: Encoders of this worker process, kept from task to task by vocabulary file.
ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                 end_id: int | None = END_ID, delta_tokens: bool = False) -> None:
    """Encode every text and write the file set to ``folder`` in ascending id
    order (null ids last; rows of one id by a hash of their text). Null texts
    are empty and only have the end id. The order is a range sort, so a hot id spans
    files; each task streams Arrow batches through the encoder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = encoder(tokenizer)
        for b in batches:
            for lo in range(0, b.num_rows, TEXTS):
                part = b.slice(lo, TEXTS)
                ids = found.encode(part.column(1))
                if end_id is not None:
                    ids = [np.append(x, np.int32(end_id)) for x in ids]
                lengths = np.array([len(x) for x in ids], np.int32)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths), tokens], names=["doc_id", "n_tokens", "tokens"])
                pa.default_memory_pool().release_unused()

    # the hash of the text, not the text, as the range sort samples its keys to the driver
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, FILE_SCHEMA)
    (ranged.write.option("parquet.writer.version", "v2").option("parquet.block.size", ROW_GROUP_BYTES)
     .option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
     .option("parquet.enable.dictionary", "false")
     .option("parquet.enable.dictionary#tokens.list.element", "false" if delta_tokens else "true")
     .parquet(folder))


def read_tokens(spark: SparkSession, folder: str, where: Column | None = None) -> DataFrame:
    """The file set; a filter on ``doc_id`` is pushed to statistics and page indexes."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(folder)
    return rows if where is None else rows.filter(where)


def in_file_order(stored: DataFrame) -> DataFrame:
    """The rows of a file set with ``part`` and ``row``, their place in it: the number of the file, as its
    writing task was numbered in the range sort, and the row in the file."""
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"^part-(\d+)-.*-c(\d+)", 1).cast("long") * 1_000_000 + F.regexp_extract(name, r"^part-(\d+)-.*-c(\d+)", 2).cast("long")
    return stored.select("*", number.alias("part"), F.col("_metadata.row_index").alias("row"))


def token_digests(stored: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, part, row): the checksum of each list as little-endian 32-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            ids, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(at)
            sums = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends, at)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int64()), pa.array(sums, pa.int64()), b.column(3), b.column(4)],
                                             names=["doc_id", "n_tokens", "ids_crc32", "part", "row"])

    return in_file_order(stored).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, part long, row long")


def token_index(spark: SparkSession, folder: str, stage: Stage) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read from the file set; ``start``
    counts the ids of all rows before, in the order of the files, so that a
    reader finds the row's ids from ``start`` on in the concatenated lists."""
    digests = stage.write(token_digests(read_tokens(spark, folder)))
    return running_totals(stage, digests, [F.col("part"), F.col("row")], {"start": "n_tokens"}).select("doc_id", "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = END_ID,
               folder: str | None = None) -> DataFrame:
    """Write a file set, in the shared folder unless ``folder`` names another
    one, and return its index. An empty table gives no rows."""
    stage = Stage(docs.sparkSession)
    folder = folder or f"{stage.base}/tokens"
    write_tokens(docs, folder, tokenizer, doc_id, text, end_id)
    return token_index(docs.sparkSession, folder, stage)
