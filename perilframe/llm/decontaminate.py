"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from perilframe.llm.common import mix, run_sums, words_in

MIN_MATCH = 5  # words of the shortest tile
COVERAGE = 0.5  # least share of an item's words under tiles
SEED_LIMIT = 2_000_000  # benchmark words that are sent to every task at once; a larger benchmark is joined by shuffle
PUNCTUATION = b".,;:!?\"'`()[]{}<>|#$%&*+-_=/\\~^@"
LOWER = bytes(range(256)).lower()


def tokens(text: bytes | None) -> np.ndarray:
    """Word hashes after lower-casing A-Z and leaving out punctuation; words of punctuation only are none."""
    return words_in((text or b"").translate(LOWER, PUNCTUATION))[0]


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `size` words, rolled as differences of prefix sums modulo 2^64."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    first = np.arange(n)
    return mix(run_sums(words, first, first + size))


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH, seeds: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, doc start, length), the longest unmarked match first, none overlapping.

    Equal Karp-Rabin windows give runs on diagonals; the longest is marked, and what marks cut off a run is tried again
    while it has min_match tokens. Ties go to the earliest item place, then document place.
    """
    a = windows(item, min_match)
    b = windows(doc, min_match) if seeds is None else seeds
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    many = hi - lo
    if not many.any():
        return []
    j = np.repeat(np.arange(len(b)), many)
    i = order[np.arange(len(j)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    first = np.flatnonzero(np.append(True, (np.diff(i) != 1) | (np.diff(j - i) != 0)))
    length = np.diff(np.append(first, len(i))) + min_match - 1
    heap = [(-int(n), int(x), int(y)) for n, x, y in zip(length, i[first], j[first], strict=True)]
    heapq.heapify(heap)
    used_a, used_b, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        n, x, y = heapq.heappop(heap)
        n = -n
        taken = used_a[x:x + n] | used_b[y:y + n]
        if not taken.any():
            used_a[x:x + n] = used_b[y:y + n] = True
            out.append((x, y, n))
            continue
        free = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for s, e in zip(free[::2], free[1::2], strict=True):
            if e - s >= min_match:
                heapq.heappush(heap, (-int(e - s), x + int(s), y + int(s)))
    return out


class Tiler:
    """Finds the items that a text covers, among a bounded list of items."""

    def __init__(self, items: list[tuple[int, bytes]], min_match: int, coverage: float):
        self.min_match, self.coverage = min_match, coverage
        self.items = [(i, tokens(t)) for i, t in sorted(items)]
        seeds = [np.unique(windows(t, min_match)) for _, t in self.items]
        every = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.seed, self.of_item = every[order], np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])[order]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[every & np.uint64((1 << 22) - 1)] = True

    def covered(self, text: bytes | None) -> list[tuple[float, int]]:
        """(coverage, item id) of items with any tile, best first."""
        doc = tokens(text)
        keys = windows(doc, self.min_match)
        maybe = np.flatnonzero(self.filter[keys & np.uint64((1 << 22) - 1)])
        lo, hi = np.searchsorted(self.seed, keys[maybe], "left"), np.searchsorted(self.seed, keys[maybe], "right")
        hit = maybe[hi > lo]
        if not len(hit):
            return []
        # Tiles consist of words in hit windows; the rest of the document is left out, with a break in each gap.
        inside = np.zeros(len(doc) + 1, np.int32)
        np.add.at(inside, hit, 1)
        np.add.at(inside, hit + self.min_match, -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        part = np.insert(doc[at], gaps := np.flatnonzero(np.diff(at) > 1) + 1, np.arange(1, len(gaps) + 1, dtype=np.uint64))
        seeds = windows(part, self.min_match)
        named = np.unique(np.concatenate([self.of_item[a:b] for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True)]))
        found = []
        for k in named:
            item, words = self.items[k]
            marked = sum(n for _, _, n in tiles(words, part, self.min_match, seeds))
            found.append((marked / len(words), item))
        return sorted(((c, i) for c, i in found if c > 0), key=lambda x: (-x[0], x[1]))


FIELDS = "coverage double, items array<long>"


def _report(found: list[tuple[float, int]], coverage: float) -> tuple[float, list[int]]:
    return (found[0][0] if found else 0.0), sorted(i for c, i in found if c >= coverage)


def annotate(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, limit: int = SEED_LIMIT) -> DataFrame:
    """docs with any columns -> (row, coverage, items): row is the whole row as a struct, items the leaked item ids.

    Words are compared in lower case (A-Z) without punctuation. Items and documents that share a run of
    min_match words are tiled; coverage is the largest share of an item's words under tiles, and an item leaks from
    `coverage` on, however its passages are ordered. Items of fewer than min_match words never match. Null and empty
    texts have coverage 0. Repeated items count by their id; null ids and texts of items are left out.

    A benchmark of up to `limit` words, counted first, goes to every task, and documents are read once without a
    shuffle. A larger one meets the documents by a shuffled join on seeds, and each candidate pair is tiled by itself.
    """
    bench = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").cast("binary").alias("words"))
    size = bench.agg(F.sum(F.size(F.split(F.col("words").cast("string"), "\\s+")))).first()[0] or 0
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").cast("binary").alias("text"))
    out = StructType(rows.schema.fields[:1] + StructType.fromDDL(FIELDS).fields)
    if size > limit:
        return _joined(rows, bench, min_match, coverage)
    shared = docs.sparkSession.sparkContext.broadcast([(r.item, bytes(r.words)) for r in bench.collect()])  # at most `limit` words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiler = Tiler(shared.value, min_match, coverage)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [_report(tiler.covered(t), coverage) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c for c, _ in made], pa.float64()), pa.array([i for _, i in made], pa.list_(pa.int64()))],
                                                 ["row", "coverage", "items"])

    return rows.mapInArrow(run, out)


def _joined(rows: DataFrame, bench: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """annotate for a benchmark of any size."""
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.unique(windows(tokens(t), min_match)) for t in batch.column(1).to_pylist()]
            ids = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64))], ["id", "seed"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = []
            for t, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                item = tokens(w)
                share.append(sum(n for _, _, n in tiles(item, tokens(t), min_match)) / max(1, len(item)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.float64())], ["rk", "item", "share"])

    keyed = rows.withColumn("rk", F.xxhash64("text"))
    texts = keyed.where("text is not null").select("rk", "text").dropDuplicates(["rk"])
    ours = texts.mapInArrow(seeds, "id long, seed long")
    theirs = bench.mapInArrow(seeds, "id long, seed long").select(F.col("id").alias("item"), "seed")
    pairs = ours.join(theirs, "seed").select(F.col("id").alias("rk"), "item").distinct()
    tiled = (pairs.join(texts, "rk").join(bench, "item").select("rk", "item", "text", "words").mapInArrow(pair, "rk long, item long, share double"))
    best = tiled.groupBy("rk").agg(F.max("share").alias("coverage"), F.array_compact(F.sort_array(F.collect_set(F.when(F.col("share") >= coverage, F.col("item"))))).alias("items"))
    return keyed.join(best, "rk", "left").select("row", F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
                                                 F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))
