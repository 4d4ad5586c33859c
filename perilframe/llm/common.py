"""Helpers shared by the training-data operators: lineage cuts, word hashing, connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilframe.operators.lineage import shared_dir

CHUNK = 500_000  # links that a task holds at once


def freed(spark: SparkSession) -> None:
    """Let go of the shuffle files of earlier steps: Spark drops them when the driver collects its garbage, else they add up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """df as it is now, read from the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    done = df.checkpoint()
    freed(df.sparkSession)
    return done


def table(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: smaller than checkpoint files for numeric columns."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.parquet(path)
    freed(df.sparkSession)
    return kept


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch, cut into small ones so that long texts don't pile up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield fn(batch.slice(at, 256))
    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the splitmix64 finaliser, a public-domain function)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(n: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_POWERS: dict[int, np.ndarray] = {}
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def powers(base: int, n: int) -> np.ndarray:
    """base^1 to base^n modulo 2^64, remembered per task."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = np.cumprod(np.full(max(n, 1 << 16), base, np.uint64))
    return _POWERS[base][:n]


def run_sums(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: int = BASE) -> np.ndarray:
    """Polynomial hashes of the runs values[first:last], from prefix sums: place i of a run has the weight base^i."""
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(base, len(values)))])
    back = powers(pow(base, -1, 1 << 64), len(values))
    return (prefix[last] - prefix[first]) * back[first] if len(first) else np.zeros(0, np.uint64)


def words_in(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\x20\x09-\x0D]+, and where in the bytes they begin and end."""
    raw = np.frombuffer(text, np.uint8)
    blank = np.concatenate([[True], _BLANK[raw], [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    first, last = edge[::2], edge[1::2]
    return mix(run_sums(_BYTES[raw], first, last) + (last - first).astype(np.uint64)), first, last


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the words after lower-casing A-Z (bytes methods touch ASCII only); none of null."""
    return words_in((text or b"").lower())[0]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word windows; fewer words make one window, none make none."""
    n = min(k, len(words))
    if not n:
        return words
    by = odd(k)
    total = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        total += words[j:len(words) - n + 1 + j] * by[j]
    return np.unique(mix(total))


def starred(links: DataFrame) -> DataFrame:
    """Links (u, v) as stars: each task replaces CHUNK links at a time by links of their nodes to the smallest reachable one."""
    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        nodes, at = np.unique(np.concatenate([rows.column(0).to_numpy(), rows.column(1).to_numpy()]), return_inverse=True)
        u, v = at.reshape(2, -1)
        label = np.arange(len(nodes))
        while (label[u] != label[v]).any():
            low = np.minimum(label[u], label[v])
            np.minimum.at(label, label[u], low)
            np.minimum.at(label, label[v], low)
            while ((up := label[label]) != label).any():
                label = up
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        kind = rows.schema.field(0).type
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved], kind), pa.array(nodes[label[moved]], kind)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= CHUNK:
                yield stars(held)
                held, size = [], 0
        if size:
            yield stars(held)

    return links.mapInArrow(run, links.schema)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the undirected links, for nodes that have one.

    Links become stars within each task first, which shortens paths. Minimum labels then travel along what is left and
    jump to the label of their label, so that rounds grow with the logarithm of a path. Hot nodes meet partial
    aggregation on one side and joins that Spark can split on the other.
    """
    ends = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()
    stars = table(starred(ends))
    both = cut(stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("component")))
    while True:
        near = (both.join(labels.withColumnRenamed("node", "u"), "u").groupBy("v").agg(F.min("component").alias("near")))
        step = (labels.join(near.withColumnRenamed("v", "node"), "node")
                .select("node", F.col("component").alias("was"), F.least("component", "near").alias("component")))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = cut(step.join(jump, "component", "left")
                  .select("node", "was", F.least("component", F.coalesce("root", "component")).alias("component")))
        moved = not new.where("component <> was").isEmpty()
        labels = new.select("node", "component")
        if not moved:
            return labels


def joined_by(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (node, component), as components() gives them, after further links (a, b): only components are traversed anew."""
    end = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    between = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = components(between)
    known = groups.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return cut(known.select("node", F.coalesce("to", "component").alias("component")).unionByName(moved.join(groups, "node", "left_anti")))


def narrowed(df: DataFrame, col: str, wanted: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """Rows of df whose `col` may be among the values of wanted (one column), to be joined with them afterwards.

    A bitmap of `bits` bits, 64 to a row and so at most bits / 64 rows however many values there are, goes to every
    task; rows that can't match then need no shuffle. Where it fills up, more rows pass, and the join decides.
    """
    value = wanted.columns[0]
    place = lambda c: F.expr(f"pmod(xxhash64({c}), {bits})")
    map_ = (wanted.select(place(value).alias("at")).select((F.col("at") / 64).cast("long").alias("row64"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
            .groupBy("row64").agg(F.bit_or("bit").alias("map64")))
    found = df.withColumn("at64", place(col)).withColumn("row64", (F.col("at64") / 64).cast("long")).join(F.broadcast(map_), "row64")
    return found.where(F.expr("(map64 & shiftleft(1L, cast(at64 % 64 as int))) <> 0")).drop("row64", "map64", "at64")
