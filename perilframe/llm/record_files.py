"""Token ids as length-delimited binary records with masked checksums, and a separate index of offsets for shuffled reads.

A record, all numbers little-endian:

    length    u64   bytes of the payload
    check     u32   masked CRC-32 of the eight bytes of length
    payload         u8 kind, i64 doc_id, then the ids
    check     u32   masked CRC-32 of the payload
    end       u8    line feed

kind is the bytes of an id, 2 or 4, plus 128 for a null doc_id. A checksum c is masked as rotate_right(c, 15) + MASK, so that
checksums of data that hold checksums stay meaningful. Files are named by their folder, file=<partition>-<number>, in the
order of the documents; records of a file lie end to end.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perilframe.llm.packing import END_ID, TEXTS, WordTokens

MASK = 0xA282EAD8  # fixed value: the addend that published record formats use
FILE_BYTES = 32 << 20  # a file ends with the record that reaches this; a reading task holds some files
TEXT_BYTES = 64 << 20  # text of a writing task, about
FRAMED = 17  # bytes around a payload
HEAD = 9  # bytes before the ids in it
NULL_ID = 128


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    """One record."""
    payload = struct.pack("<Bq", width + NULL_ID * (doc_id is None), doc_id or 0) + ids.astype(f"<u{width}").tobytes()
    size = struct.pack("<Q", len(payload))
    return b"".join([size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload)), b"\n"])


def parse(data: bytes | memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """doc_id and ids of the record at a place, and where the next begins; ValueError if the record is damaged."""
    if at + 12 > len(data):
        raise ValueError(f"the record at {at} ends early")
    size, check = struct.unpack_from("<QI", data, at)
    if masked(data[at:at + 8]) != check:
        raise ValueError(f"the length at {at} is damaged")
    end = at + size + FRAMED
    if size < HEAD or end > len(data):
        raise ValueError(f"the record at {at} ends early")
    payload = data[at + 12:at + 12 + size]
    if masked(payload) != struct.unpack_from("<I", data, end - 5)[0] or data[end - 1] != 10:
        raise ValueError(f"the record at {at} is damaged")
    kind, doc_id = struct.unpack_from("<Bq", payload)
    return None if kind & NULL_ID else doc_id, np.frombuffer(payload, f"<u{kind & 127}", offset=HEAD).astype("<u4"), end


def write(docs: DataFrame, path: str, vocabulary: str, file_bytes: int = FILE_BYTES) -> None:
    """Write every document of docs (doc_id, text) as a record, ascending by doc_id, to files under path.

    Ids are those of the tokenizer at `vocabulary` (a parameter; present on every executor) without special tokens, then
    END_ID; null and empty text has END_ID alone. They take two bytes where the vocabulary allows, else four. A null
    doc_id comes first. Documents of one doc_id are ordered by a hash of their text; rows that repeat are written each,
    and a running number deals them out, so that they fill no single task. Extra columns are not read. An empty table
    writes no files.

    Spark's own writer puts the bytes down, so that any store it reaches will do and a lost task leaves no part of a file.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TEXT_BYTES))
    order = ["doc_id", "salt", "number"]
    dealt = rows.withColumn("salt", F.xxhash64("text")).withColumn("number", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(tasks, *[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens.shared(vocabulary)
        width, task, number, filled, place = (2 if words.size <= 1 << 16 else 4), TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                files, frames, places = [], [], []
                for doc_id, ids in zip(part.column(0).to_pylist(), words.ids(part.column(1).to_pylist()), strict=True):
                    frames.append(frame(doc_id, np.append(ids, np.uint32(END_ID)), width))
                    files.append(f"{task:07d}-{number:07d}")
                    places.append(place := place + 1)
                    filled += len(frames[-1])
                    if filled >= file_bytes:
                        number, filled = number + 1, 0
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(places, pa.int64()), pa.array(frames, pa.binary())], ["file", "place", "frame"])

    framed = dealt.select("doc_id", "text").mapInArrow(run, "file string, place long, frame binary").sortWithinPartitions("file", "place")  # the order that the writer asks for
    # The text writer ends each value with its separator, the record's last byte.
    value = F.substring(F.col("frame"), F.lit(1), F.length("frame") - 1).cast("string")
    framed.select(value.alias("value"), "file").write.partitionBy("file").option("lineSep", "\n").text(f"{path}/records")


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the files under path; a file is held whole, so their size at writing bounds a task."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(f"{path}/records")
    return found.select(F.regexp_extract("path", "file=([0-9-]+)", 1).alias("file"), "content")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, bytes, doc_id, ahead, n_tokens, ids_crc32) of every record, read back and checked; a damaged one fails the job.

    ahead counts the ids of the file before the record.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, at, ahead, rows = memoryview(content.as_buffer()), 0, 0, []
                while at < len(data):
                    doc_id, ids, end = parse(data, at)
                    rows.append((name, at, end - at, doc_id, ahead, len(ids), zlib.crc32(ids.tobytes())))
                    at, ahead = end, ahead + len(ids)
                names = ["file", "offset", "bytes", "doc_id", "ahead", "n_tokens", "ids_crc32"]
                kinds = [pa.string()] + [pa.int64()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds, strict=True)], names)

    return files_of(spark, path).mapInArrow(run, "file string, offset long, bytes long, doc_id long, ahead long, n_tokens long, ids_crc32 long")


def write_index(spark: SparkSession, path: str) -> DataFrame:
    """Write the offset index of the files under path beside them: scan() and start, the ids of all records before each.

    Only totals of files, one row each, are summed in order.
    """
    found = scan(spark, path)
    found.write.parquet(f"{path}/offsets")
    found = spark.read.parquet(f"{path}/offsets")
    each = found.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    before = each.select("file", (F.sum("ids").over(Window.orderBy("file")) - F.col("ids")).alias("before"))
    return found.join(before, "file").withColumn("start", F.col("before") + F.col("ahead")).drop("before", "ahead")


def read_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """wanted (file, offset, place), any part of the index -> (place, doc_id, ids): records by offset, for reads in shuffled order.

    Places are numbers of the caller, such as a draw's; only files that are wanted are parsed, at the wanted offsets alone.
    """
    by_file = wanted.groupBy("file").agg(F.collect_list(F.struct("offset", "place")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, some in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = memoryview(content.as_buffer())
                for at in range(0, len(some), 256):
                    got = [(x["place"], *parse(data, x["offset"])[:2]) for x in some[at:at + 256]]
                    yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
                                                      pa.array([g[2].astype(np.int32) for g in got], pa.list_(pa.int32()))], ["place", "doc_id", "ids"])

    return files_of(spark, path).join(by_file, "file").select("content", "at").mapInArrow(run, "place long, doc_id long, ids array<int>")
