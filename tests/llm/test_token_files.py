"""Token files: exact round trip against whole-text encoding, and the layout of the files."""

import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillbook.llm import token_files as tf
from tillbook.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " ", "\n", "a", " a", "a ", "  a  b ", "a\n b", "x\n\n y", "tab\tx y", "don't 'tis it's ' s", "12 345 6a", "é è ñ", "ab \u00a0c", "a \u2003b",
        "<|endoftext|>", "a <|endoftext|> b", "a <|x", "\u200b z", "日本 語", "e\u0301 \u0301x", "a \x1cb", "\r\n x\r y", "| pipe | | x", "!!! ...", "a\x85 b", "😀 😀a", "\n x \n"]


def whole(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_pieces_give_the_same_ids():
    enc = tf.Encoder(PATH)
    for _ in range(2):
        assert [x.tolist() for x in enc.encode(HARD)] == whole(HARD)


def check(rows, docs):
    docs = sorted(docs, key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    want, at = [], 0
    for d, ids in zip(docs, whole([r["text"] or "" for r in docs])):
        want.append((d["doc_id"], at, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())))
        at += len(ids) + 1
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_query_is_an_exact_round_trip(spark):
    df = QUERIES["op3_token_files"](spark, SF)
    assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    check(df.collect(), spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def test_nulls_repeats_long_and_empty(make_docs):
    docs = make_docs([(i, t) for i, t in enumerate(HARD)] + [(500, None), (501, "word two " * 40_000), (502, "same"), (502, "same")])
    check(tf.round_trip(docs, PATH).collect(), docs.collect())
    assert tf.round_trip(docs.limit(0), PATH).collect() == []
    only = make_docs([(None, "x"), (1, "y")])
    assert [(r.doc_id, r.start) for r in sorted(tf.round_trip(only, PATH).collect(), key=lambda r: r.start)] == [(1, 0), (None, 2)]


def test_start_is_the_place_in_the_files(make_docs, tmp_path):
    """Several texts under one id, spread over files: the ids from ``start`` on are the row's own."""
    docs = make_docs([(1, "one two three " * n) for n in (4, 1, 9, 2, 7, 3)] + [(i, f"text {i} " * (i % 5)) for i in range(2, 60)] + [(None, "x"), (None, "y z")])
    index = tf.round_trip(docs.repartition(6), PATH, folder=f"{tmp_path}/t").collect()
    stream = []
    for name in sorted(glob.glob(f"{tmp_path}/t/part-*")):
        for ids in pq.read_table(name).column("tokens").to_pylist():
            stream += ids
    assert len(index) == 66 and sum(r.n_tokens for r in index) == len(stream)
    for r in index:
        assert zlib.crc32(np.array(stream[r.start:r.start + r.n_tokens], "<u4").tobytes()) == r.ids_crc32, r
    by_id = sorted(index, key=lambda r: r.start)
    assert [r.doc_id for r in by_id] == [1] * 6 + list(range(2, 60)) + [None, None]


@pytest.mark.parametrize("delta", [False, True])
def test_layout(spark, tmp_path, delta):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tf.write_tokens(docs, f"{tmp_path}/t", PATH, delta_tokens=delta)
    last = -1
    for name in sorted(glob.glob(f"{tmp_path}/t/part-*")):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(c).path_in_schema.split(".")[0]: meta.row_group(g).column(c) for c in range(3)}
            assert "DELTA_BINARY_PACKED" in cols["doc_id"].encodings
            assert ("RLE_DICTIONARY" in cols["tokens"].encodings) != delta
            assert cols["doc_id"].has_column_index and cols["doc_id"].has_offset_index
            assert cols["doc_id"].statistics.min > last
            last = cols["doc_id"].statistics.max
            assert meta.row_group(g).total_byte_size <= 2 * tf.ROW_GROUP_BYTES
    one = tf.read_tokens(spark, f"{tmp_path}/t", F.col("doc_id") == 17).collect()
    assert len(one) == 1 and one[0].tokens == [*whole([docs.filter("doc_id = 17").first().text])[0], 2]
    plan = tf.read_tokens(spark, f"{tmp_path}/t", F.col("doc_id") < 9).select("n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,9)]" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:int>" in plan
