import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from perilframe.llm import common, packing, queries, record_files

SMALL = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def plain(rows):
    """(doc_id, start, n_tokens, crc) in the order of doc_id, whole texts encoded one by one."""
    whole, out, at = Tokenizer.from_file(VOCABULARY), [], 0
    for doc_id, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


def fresh(spark):
    return f"{common.shared_dir(spark)}/test-{uuid.uuid4().hex}"


def test_round_trip_of_all_documents(spark):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op13_record_files(spark, SMALL).collect())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert got == plain(sorted((r.doc_id, r.text) for r in docs))


def test_small_files_odd_rows_and_shuffled_reads(spark, odd, none):
    path = fresh(spark)
    record_files.write(odd, path, VOCABULARY, file_bytes=100)
    index = record_files.write_index(spark, path)
    rows = index.orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 3, 4, 5, 6, 7, 7, 8, 9] and rows[0].start == 0
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == plain([(r.doc_id, texts[r.doc_id]) for r in rows])
    assert [(r.file, r.offset) for r in rows] == sorted((r.file, r.offset) for r in rows) and len({r.file for r in rows}) > 3
    order = [int(k) for k in np.random.default_rng(0).permutation(9)]
    wanted = spark.createDataFrame([(rows[k].file, rows[k].offset, place) for place, k in enumerate(order)], "file string, offset long, place long")
    read = record_files.read_at(spark, path, wanted).orderBy("place").collect()
    assert [(r.doc_id, len(r.ids)) for r in read] == [(rows[k].doc_id, rows[k].n_tokens) for k in order]
    assert [zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in read] == [rows[k].ids_crc32 for k in order]
    empty = fresh(spark)
    record_files.write(none, empty, VOCABULARY)
    assert record_files.write_index(spark, empty).count() == 0


def test_frames_hold_any_bytes_and_show_damage():
    ids = np.array([10, 0x0A0A, 49407, 0, 1], "<u4")
    for width in (2, 4):
        for doc_id in (None, 0, -(1 << 63), (1 << 63) - 1, 10):
            data = record_files.frame(doc_id, ids, width) * 2
            got, found, end = record_files.parse(data, 0)
            assert got == doc_id and found.tolist() == ids.tolist() and end * 2 == len(data)
            assert record_files.parse(data, end)[2] == len(data)
    for k in range(end):
        spoiled = bytearray(data[:end])
        spoiled[k] ^= 1
        with pytest.raises(ValueError):
            record_files.parse(bytes(spoiled), 0)
    with pytest.raises(ValueError):
        record_files.parse(data[:end - 1], 0)


def test_one_id_with_many_rows_is_dealt_out(spark):
    path = fresh(spark)
    same = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    record_files.write(same, path, VOCABULARY, file_bytes=1 << 20)
    index = record_files.write_index(spark, path)
    assert index.count() == 4000 and index.agg(F.max("start")).first()[0] == 3999 * 4
    tasks = index.groupBy(F.substring("file", 1, 7)).count().collect()
    assert len(tasks) >= 4 and max(r["count"] for r in tasks) < 2000


def test_words_learned_in_one_step_equal_whole_texts():
    words, whole = packing.WordTokens(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    texts = ["It's a we'll-known x2y3 ... I'd!! 42", "", " \n ", "naïve café é ΣΊΣΥΦΟΣ İ", "<|endoftext|> a", "日本語 テキスト", "a\x1cb c\x85d", "'s 't ''ll", "🙂🙂 x"] * 3
    for _ in range(2):
        assert [x.tolist() for x in words.ids(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_all_code_points_equal_the_tokenisers():
    words, whole = packing.WordTokens(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 17 == 0)]
    texts = [f"a{c}b1{c}. {c}" for c in points]
    want = whole.encode_batch_fast(texts, add_special_tokens=False)
    assert all(got.tolist() == w.ids for got, w in zip(words.ids(texts), want, strict=True))
