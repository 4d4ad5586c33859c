"""Exact n-gram Jaccard join in the metric space of shingle sets.

Jaccard distance d = 1 - similarity is a metric, and tau = 1 - threshold is the radius of a link.

1. Shells. The empty set is the first pivot, and the size of a set is its distance to it under the symmetric
   difference. Sizes fall into shells; a set near a shell's edge is replicated into the next one, so that linked sets
   meet in the shell of the smaller one.
2. Regions. Most sets are at distance 1 from any document chosen as pivot, so that windows around documents alone would
   replicate everything. A shell therefore projects sets onto m hash classes of shingles, with m larger than the number r
   of shingles in which linked sets can differ: linked sets coincide in m - r classes or more. Sets that coincide in a
   class form a region, whose pivot is its smallest id. Empty classes make no region, unless a set has m - r of them:
   then a partner that coincides there only has as many, and both enter the regions of their empty classes.
3. Pivot distances. Each member is compared with its regions' pivots, once for a pair. Parity bitmaps of the sets come
   first: the bits in which two differ bound the symmetric difference from below, which settles most pairs that share a
   class by chance. Members within tau of a pivot are linked through it and need no comparison with each other.
4. Windows. Where a region's other members are still of more than one component, they are cut into those within 2 tau
   of the pivot and those beyond tau. By the triangle inequality linked members are both in one of these cells; members
   between tau and 2 tau, the boundary, are replicated into both. Cells are joined recursively, block by block: each
   task joins one pair of blocks exactly and returns a spanning forest of the links.

Copies of a set take part as one. No step holds a region in one task or sends ids to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perilframe.llm.common import components, cut, joined_by, map_batches, mix, narrowed, shingles, table, word_hashes

SHELL = 1.6  # ratio of the sizes at which shells end
SLACK = 4  # classes beyond the largest difference of linked sets
BLOCK, BLOCK_SHINGLES = 1024, 400_000  # members of a block of a cell, and their shingles


def shell_ends(largest: int) -> list[int]:
    ends = [1]
    while ends[-1] < largest:
        ends.append(max(ends[-1] + 1, int(ends[-1] * SHELL)))
    return ends


def region_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the regions of a sorted shingle set for links of similarity num / den or more."""
    n, out, below = len(s), [], 0
    for j, end in enumerate(shell_ends(n)):
        if end * den >= n * num and n > below:
            differ = end * (den - num) // num
            if differ:  # else only copies are linked
                m = differ + SLACK
                cls = (s % np.uint64(m)).astype(np.int64)
                order = np.argsort(cls, kind="stable")
                cls = cls[order]
                first = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
                content = np.add.reduceat(mix(s[order]), first)
                label = cls[first]
                if m - len(first) >= SLACK:
                    empty = np.setdiff1d(np.arange(m), label)
                    content, label = np.append(content, np.zeros(len(empty), np.uint64)), np.append(label, empty)
                out.append(mix(content + mix(label.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(j + 1))))
        below = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def profile(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, n, digest, keys) of each row of docs (id, text): set size, digest of the set, region keys."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(word_hashes(t), k) for t in batch.column(1).to_pylist()]
        keys = [region_keys(s, num, den).view(np.int64) for s in sets]
        at = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
             pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["id", "n", "digest", "keys"])

    return map_batches(docs, run, "id long, n long, digest binary, keys array<long>")


def parity(s: np.ndarray) -> bytes:
    """Bitmap of about two bits a shingle; each shingle flips one. Wider bitmaps fold to narrower ones by xor of halves."""
    bits = 64 << max(0, int(2 * len(s) - 1).bit_length() - 6)
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ at the width of the narrower: a lower bound of |A or B| - |A and B|."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, s, bitmap) of each row of docs (id, text): size, shingle hashes, parity bitmap."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(word_hashes(t), k) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                                           pa.array([parity(s) for s in sets], pa.binary())], ["id", "n", "s", "bitmap"])

    return map_batches(docs, run, "id long, n long, s array<long>, bitmap binary")


def compared(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, pivot, n, delta, union2, link) of pairs (id, pivot).

    delta is |A or B| - |A and B| where link could be true, else a lower bound of it; union2 is the size of both sets
    plus delta, twice the size of their union where delta is exact.
    """
    def apart(batch: pa.RecordBatch) -> pa.RecordBatch:
        delta = [bits_apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(delta, pa.int64())], ["id", "pivot", "n", "pn", "delta"])

    maps = sets.select("id", "n", "bitmap")
    both = (pairs.join(maps, "id").join(maps.select(F.col("id").alias("pivot"), F.col("n").alias("pn"), F.col("bitmap").alias("pmap")), "pivot")
            .select("id", "pivot", "n", "pn", "bitmap", "pmap"))
    bounded = cut(map_batches(both, apart, "id long, pivot long, n long, pn long, delta long").withColumn("union2", F.col("n") + F.col("pn") + F.col("delta")))
    could = F.col("delta") * (2 * den) <= F.col("union2") * (den - num)
    close = bounded.where(could)
    of = lambda c: narrowed(sets.select("id", "s"), "id", close.select(c))  # noqa: E731 - only sets of close pairs are shuffled
    exact = (close.join(of("id"), "id").join(of("pivot").select(F.col("id").alias("pivot"), F.col("s").alias("ps")), "pivot")
             .withColumn("delta", (F.col("n") + F.col("pn") - 2 * F.size(F.array_intersect("s", "ps"))).cast("long"))
             .withColumn("union2", F.col("n") + F.col("pn") + F.col("delta")))
    return bounded.where(~could).select("id", "pivot", "n", "delta", "union2", F.lit(False).alias("link")).unionByName(
        exact.select("id", "pivot", "n", "delta", "union2", could.alias("link")))


def widths(maps: list[bytes]) -> np.ndarray:
    """Bitmaps folded to the narrowest of them, one row each."""
    width = min(map(len, maps))
    return np.array([np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, width), axis=0) for m in maps])


def candidates(num: int, den: int):
    """Function of one pair of blocks (key, cell, p, q, id, n, bitmap, comp): members that may link with one of another component."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        n, comp, maps = block.n.to_numpy(), block.comp.to_numpy(), widths(block.bitmap.to_list())
        delta = np.zeros((len(n), len(n)), np.float32)
        for at in range(0, maps.shape[1], 256):
            bits = np.unpackbits(maps[:, at:at + 256], axis=1).astype(np.float32)
            ones = bits.sum(axis=1)
            delta += ones[:, None] + ones[None, :] - 2 * (bits @ bits.T)
        may = (delta * (2 * den) <= (n[:, None] + n[None, :] + delta) * (den - num)) & (comp[:, None] != comp[None, :])
        return block.loc[may.any(axis=1), ["key", "cell", "p", "q", "id", "comp"]]
    return run


def forest(num: int, den: int):
    """Function of one pair of blocks (id, s, comp): a spanning forest of its links between components."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id").drop_duplicates("id").reset_index(drop=True)
        size = np.array([len(s) for s in block.s])
        _, token, count = np.unique(np.concatenate(block.s.to_list()), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(block)), size)
        shared = np.flatnonzero(count > 1)
        place = np.full(len(count), -1)
        place[shared] = np.arange(len(shared))
        token = place[token]
        row, token = row[token >= 0], token[token >= 0]
        order = np.argsort(token, kind="stable")
        row, token = row[order], token[order]
        common = np.zeros((len(block), len(block)), np.float32)
        step = max(256, (1 << 22) // max(1, len(block)))  # shingles at a time, so that the table of them stays small
        for at in range(0, len(shared), step):
            lo, hi = np.searchsorted(token, [at, at + step])
            has = np.zeros((len(block), step), np.float32)
            has[row[lo:hi], token[lo:hi] - at] = 1
            common += has @ has.T
        linked = common * den >= num * (size[:, None] + size[None, :] - common)
        parent = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out, comp, ids = [], block.comp.to_numpy(), block.id.to_numpy()
        for i, j in np.argwhere(np.triu(linked, 1)):
            a, b = root(comp[i]), root(comp[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id, class_id), one row for each row of docs.

    A document's set holds its distinct k-word shingles after lower-casing A-Z, words being [^\\x20\\x09-\\x0D]+; fewer
    words make one shingle, none make the empty set. Documents are linked when den * |A and B| >= num * |A or B|;
    num / den is above 1/2. component_id is the smallest doc_id reachable by links, itself included; class_id the
    smallest doc_id with the same set. Empty sets, of null texts too, link with nothing.

    Rows with one doc_id are one node: their links join. Null doc_id is passed on with its set size, null ids, and no
    links. Extra columns are not read. Empty tables give no rows. Shingles are 64-bit hashes.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("text"))
    prof = table(profile(texts, k, num, den))
    reps = cut(prof.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep")))
    keyed = prof.where("id is not null and size(keys) > 0").join(reps.select(F.col("rep").alias("id"), F.col("digest").alias("d")), "id")
    rows = keyed.where("digest = d").select("id", F.explode("keys").alias("key"))
    by = Window.partitionBy("key")
    regions = table(rows.withColumn("pivot", F.min("id").over(by)).withColumn("last", F.max("id").over(by)).where("pivot <> last")
                    .select("key", "id", "pivot"))
    members = cut(regions.select("id").distinct())
    sets = table(sets_of(narrowed(texts, "id", members).join(members, "id", "left_semi").select("id", "text"), k))
    near = table(compared(regions.where("id <> pivot").select("id", "pivot").distinct(), sets, num, den))
    links = near.where("link").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    first = components(links)

    # Regions whose other members the pivot has not joined: cells 0, within 2 tau of it, and 1, beyond tau.
    placed = (regions.where("id <> pivot").join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
              .select("key", "id", "pivot", "comp"))
    inner = F.col("delta") * den <= F.col("union2") * (den - num)
    windows = near.select("id", "pivot", "n", F.array_compact(F.array(F.when(inner, F.lit(0)), F.when(~F.col("link"), F.lit(1)))).alias("cells"))
    # Regions of a pivot and one more member are done.
    more = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    cells = table(placed.join(more, "key").join(windows, ["id", "pivot"]).select("key", "id", "comp", "n", F.explode("cells").alias("cell")))
    many = (cells.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("who"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            .where("lo <> hi"))
    # Cells of the same members are joined once.
    once = many.groupBy("size", "who", "weight").agg(F.min(F.struct("key", "cell")).alias("c")).select("c.*", "size", "weight")
    blocks = cells.join(once, ["key", "cell"]).withColumn("nb", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")))
    tasks = blocks.select("key", "cell", "id", "comp", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("other"))
    tasks = tasks.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    # Bitmaps go first; sets follow for the members that bitmaps leave.
    left = table(tasks.drop("block", "other").join(sets.select("id", "n", "bitmap"), "id").groupBy("key", "cell", "p", "q")
                 .applyInPandas(candidates(num, den), "key long, cell int, p long, q long, id long, comp long"))
    found = (left.join(sets.select("id", "s"), "id").groupBy("key", "cell", "p", "q").applyInPandas(forest(num, den), "a long, b long"))
    further = cut(found.distinct())
    final = first if further.isEmpty() else joined_by(first, further)

    named = reps.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "rep", F.coalesce("component", "rep").alias("component"))
    out = prof.select("id", "n", "digest").join(named, "digest", "left").select(
        "id", "n", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
    return _one_id(out)


def _one_id(out: DataFrame) -> DataFrame:
    """Join the components that one id has a set in, where rows repeat an id with other texts."""
    result = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
                        F.coalesce("rep", "id").alias("class_id"))
    own = out.where("component is not null").groupBy("id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    if own.isEmpty():
        return result
    bridges = out.join(own.select("id", "a"), "id").where("component is not null").select("a", F.col("component").alias("b")).distinct()
    moved = components(bridges).select(F.col("node").alias("component_id"), F.col("component").alias("to"))
    return result.join(moved, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("to", "component_id").alias("component_id"), "class_id")
