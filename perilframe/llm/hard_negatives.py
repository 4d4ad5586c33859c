"""Hard-negative mining over rotated one-bit codes: popcount estimates, Cauchy-Schwarz intervals, integer scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilframe.llm.common import table
from perilframe.llm.whitening import matrix_of, usable

SCALE = 256  # a component c counts as the integer floor(SCALE * c)
LEVELS = 5  # codes of a vector: each is the signs of what the codes before it leave over, in a rotation of its own
PLANES = 6  # bits of a rotated anchor's components, for popcounts
POSITIVES, NEGATIVES = 5, 3
LOW, TOP, OF = 50, 95, 100  # a negative's score is between LOW / OF and TOP / OF of the positive's
ROWS, ANCHORS = 32768, 4096  # vectors and anchors of a cell at most; both sides are dealt into as many blocks as that takes
CHUNK = 1 << 17  # pairs of a cell that are estimated at once
SLACK = 1e-9  # of the product of the norms: what rounding may take from an interval
_TURNS: dict[int, list[np.ndarray]] = {}


def rotations(d: int) -> list[np.ndarray]:
    """LEVELS fixed random rotations of d dimensions, remembered per task."""
    if d not in _TURNS:
        rnd = np.random.default_rng(d)
        _TURNS[d] = [np.linalg.qr(rnd.normal(size=(d, d)))[0] for _ in range(LEVELS)]
    return _TURNS[d]


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    wide = np.zeros((bits.shape[0], -(-bits.shape[1] // 64) * 64), bool)
    wide[:, :bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (row, level, word), alignment of the rest before a level with its code vector of signs, norms of the rests after it.

    rest = align * signs + next rest, the two parts being at right angles.
    """
    rest, codes, aligns, norms = x.astype(np.float64), [], [], []
    for turn in rotations(x.shape[1]):
        seen = rest @ turn
        signs = np.where(seen >= 0, 1.0, -1.0)
        align = np.abs(seen).mean(1) if x.shape[1] else np.zeros(len(x))
        rest = (seen - align[:, None] * signs) @ turn.T
        codes.append(packed(seen >= 0))
        aligns.append(align)
        norms.append(np.linalg.norm(rest, axis=1))
    return np.stack(codes, axis=1), np.stack(aligns, axis=1), np.stack(norms, axis=1)


class Anchors:
    """Anchors rotated for each level and cut into bit planes: component = low + step * integer, up to a known error."""

    def __init__(self, x: np.ndarray):
        self.d, self.norm = x.shape[1], np.linalg.norm(x.astype(np.float64), axis=1)
        self.planes, self.low, self.step, self.total, self.left = [], [], [], [], []
        for turn in rotations(self.d):
            q = x.astype(np.float64) @ turn
            low = q.min(1, initial=0)
            step = np.maximum((q.max(1, initial=0) - low) / ((1 << PLANES) - 1), 1e-300)
            cut = np.rint((q - low[:, None]) / step[:, None])
            near = low[:, None] + step[:, None] * cut
            self.planes.append([packed(cut.astype(np.int64) >> b & 1 == 1) for b in range(PLANES)])
            self.low.append(low)
            self.step.append(step)
            self.total.append(near.sum(1))
            self.left.append(np.linalg.norm(q - near, axis=1))

    def intervals(self, some: slice, codes: np.ndarray, aligns: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates and half widths of the scores of some anchors with coded rows; scores lie within them for certain.

        A score is the sum over levels of align * <signs, anchor>, taken from popcounts, and <last rest, anchor>. The
        rounded part of the anchor adds at most align * sqrt(d) * its norm a level, by Cauchy-Schwarz, as the last rest
        adds at most its norm times that of the anchor without its part along the last signs, which it is at right angles to.
        """
        estimate = width = 0.0
        for k in range(LEVELS):
            code = codes[:, k]
            ones = np.bitwise_count(code).sum(1, dtype=np.int64)
            count = np.zeros((some.stop - some.start, len(code)), np.int64)
            for b, plane in enumerate(self.planes[k]):
                for w in range(code.shape[1]):
                    count += np.bitwise_count(plane[some, w][:, None] & code[:, w]).astype(np.int64) << b
            along = 2 * (self.low[k][some, None] * ones + self.step[k][some, None] * count) - self.total[k][some, None]
            estimate = estimate + aligns[:, k] * along
            width = width + np.outer(self.left[k][some], aligns[:, k] * np.sqrt(self.d))
        at_least = np.maximum(np.abs(along) - self.left[k][some, None] * np.sqrt(self.d), 0)  # of <last signs, anchor>
        across = np.sqrt(np.maximum(self.norm[some, None] ** 2 - at_least**2 / max(self.d, 1), 0))
        first = np.sqrt((norms[:, 0] ** 2 + self.d * aligns[:, 0] ** 2))
        return estimate, width + across * norms[:, -1] + SLACK * np.outer(self.norm[some], first) + SLACK


def exact(anchors: np.ndarray, rows: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer scores of the pairs (a, r)."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), CHUNK):
        out[at:at + CHUNK] = np.einsum("ij,ij->i", anchors[a[at:at + CHUNK]], rows[r[at:at + CHUNK]])
    return out


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group by falling score, ties by smaller id."""
    order = np.lexsort((ids, -score, group))
    sorted_ = group[order]
    first = np.searchsorted(sorted_, sorted_, "left")
    return order[np.arange(len(order)) - first < k]


def leaders(estimate: np.ndarray, may: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the 2 k entries of each row that look largest among those that may count."""
    seen = np.where(may, estimate, -np.inf)
    top = np.argpartition(seen, -min(2 * k, seen.shape[1]), axis=1)[:, -2 * k:]
    a = np.repeat(np.arange(len(seen)), top.shape[1])
    r = top.reshape(-1)
    real = may[a, r]
    return a[real], r[real]


def threshold(n: int, group: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each of n groups, -inf where there are fewer."""
    order = np.lexsort((-score, group))
    sorted_ = group[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_, sorted_, "left")
    out = np.full(n, -np.inf)
    out[sorted_[place == k - 1]] = score[order[place == k - 1]]
    return out


def positives_in(anchors: Anchors, ax: np.ndarray, aid: np.ndarray, coded: tuple, rx: np.ndarray, rid: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, row, score): the k best rows other than itself of each anchor in a cell of one label."""
    out = []
    step = max(1, CHUNK // max(1, len(rid)))
    for at in range(0, len(aid), step):
        some = slice(at, min(at + step, len(aid)))
        estimate, width = anchors.intervals(some, *coded)
        may = aid[some, None] != rid
        a, r = leaders(estimate, may, k)
        least = threshold(len(estimate), a, exact(ax, rx, a + at, r).astype(np.float64), k)  # that many rows score as much
        a, r = np.nonzero(may & (estimate + width >= least[:, None]))
        score = exact(ax, rx, a + at, r)
        keep = best(a, score, rid[r], k)
        out.append((a[keep] + at, r[keep], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def negatives_in(anchors: Anchors, ax: np.ndarray, alabel: np.ndarray, scores: np.ndarray, coded: tuple, rx: np.ndarray, rid: np.ndarray, rlabel: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, positive, row, score): the k best rows of other labels within each positive's bounds, in a cell.

    scores has a row of positives' scores for each anchor, NaN where it has fewer.
    """
    out = []
    step = max(1, CHUNK // max(1, len(rid)))
    for at in range(0, len(ax), step):
        some = slice(at, min(at + step, len(ax)))
        estimate, width = anchors.intervals(some, *coded)
        other = alabel[some, None] != rlabel
        for j in range(scores.shape[1]):
            p = scores[some, j]
            if np.isnan(p).all():
                continue
            may = other & (OF * (estimate + width) >= LOW * p[:, None]) & (OF * (estimate - width) <= TOP * p[:, None])

            def inside(a: np.ndarray, s: np.ndarray, p: np.ndarray = p) -> np.ndarray:
                whole = p[a].astype(np.int64)
                return (LOW * whole <= OF * s) & (OF * s <= TOP * whole)

            a, r = leaders(np.where(OF * estimate <= TOP * p[:, None], estimate, -np.inf), may, k)
            s = exact(ax, rx, a + at, r)
            real = inside(a, s)
            least = threshold(len(estimate), a[real], s[real].astype(np.float64), k)
            a, r = np.nonzero(may & (estimate + width >= least[:, None]))
            s = exact(ax, rx, a + at, r)
            real = inside(a, s)
            a, r, s = a[real], r[real], s[real]
            keep = best(a, s, rid[r], k)
            out.append((a[keep] + at, np.full(len(keep), j), r[keep], s[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


CODED = "vec_id long, label long, x array<int>, codes binary, aligns array<double>, norms array<double>"


def coded_rows(rows: DataFrame) -> DataFrame:
    """rows (vec_id, label, x) with their codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                for at in range(0, part.num_rows, ROWS):
                    some = part.slice(at, ROWS)
                    codes, aligns, norms = encode(matrix_of(some.column(2)))
                    ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * LEVELS)
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array([c.tobytes() for c in codes], pa.binary()),
                                                      pa.ListArray.from_arrays(ends, pa.array(aligns.reshape(-1))), pa.ListArray.from_arrays(ends, pa.array(norms.reshape(-1)))],
                                                     ["vec_id", "label", "x", "codes", "aligns", "norms"])
    return rows.mapInArrow(run, CODED)


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Ids, labels, integers and codes of a cell's rows, in the order of ids."""
    rows = rows.sort_by("vec_id").combine_chunks()
    x = matrix_of(rows.column("x").combine_chunks()).astype(np.int64)
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), "<u8").reshape(len(x), LEVELS, -1)
    aligns, norms = (matrix_of(rows.column(c).combine_chunks()) for c in ("aligns", "norms"))
    return rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), x, (codes, aligns, norms)


def block(n: Column | int, size: int) -> Column:
    """Blocks that n rows are dealt into."""
    return F.greatest(F.lit(1), F.ceil((F.lit(n) if isinstance(n, int) else n) / size)).cast("int")


def dealt(name: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64("vec_id", F.lit(name)), blocks).cast("int")


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """rows (vec_id, label, embedding) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows without a vec_id or label, or whose vector is null, empty or has a null or non-finite entry, take no part. vec_id names
    a row: of rows that share one, the smallest (label, vector) counts, so that repeated rows count once. Vectors of
    different lengths have no score and never meet. `anchor` tells on (vec_id, label) which rows are anchors. Scores are
    integer inner products of floor(SCALE * component), which must fit an int, as scores must fit a long. Ties go to the
    smaller vec_id. Anchors without positives, and positives without negatives, give no row. Extra columns are not read;
    an empty table gives no rows.

    Every anchor meets every row of its label, then every row of other labels, in cells of at most ROWS by ANCHORS: rows
    are dealt into blocks by hash, so that no label or copy fills a task, and each block of anchors is joined with each
    block of rows. Within a cell codes give each score an interval; rows whose interval ends below the scores of rows
    already found good enough are left out for certain, all others are scored in integers. The result is exact.
    """
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("int"))
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")) & (F.size("embedding") > 0))
    one = plain.select("vec_id", F.struct("label", whole.alias("x")).alias("r")).groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.*")
    coded = table(coded_rows(one).withColumn("d", F.size("x")))
    counts = table(coded.groupBy("d", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(anchor).alias("m")))
    sizes = counts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    size = max(1, min(ROWS, -(-total // least)))  # as many cells as the session has partitions, where the table is small

    def cells(keys: list[str], per: DataFrame, left: DataFrame):
        """Anchors left (vec_id, label, x, d, ...) and all rows, each with the cells that it belongs to, grouped by cell."""
        per = per.select(*keys, block(F.col("n"), size).alias("rows"), block(F.col("m"), ANCHORS).alias("anchors"))
        place = [*keys, "rb", "ab"]
        mine_ = left.join(per, keys).withColumn("ab", dealt("anchor", F.col("anchors"))).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
        theirs = coded.join(per, keys).withColumn("rb", dealt("row", F.col("rows"))).withColumn("ab", F.explode(F.sequence(F.lit(0), F.col("anchors") - 1)))
        return mine_.drop("rows", "anchors").groupBy(*place), theirs.drop("rows", "anchors").groupBy(*place)

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("anchor_id", "positive_id", "positive_score")})
        left = left.sort_by("vec_id").combine_chunks()
        aid, ax = left.column("vec_id").to_numpy(), matrix_of(left.column("x").combine_chunks()).astype(np.int64)
        rid, _, rx, code = unpacked(right)
        a, r, s = positives_in(Anchors(ax), ax, aid, code, rx, rid, positives)
        return pa.table({"anchor_id": aid[a], "positive_id": rid[r], "positive_score": s})

    wanted = table(coded.where(anchor).select("vec_id", "label", "x", "d"))
    some, all_ = cells(["d", "label"], counts.where("m > 0"), wanted)
    found = some.cogroup(all_).applyInArrow(near, "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    few = found.withColumn("place", place).where(F.col("place") <= positives)
    listed = F.sort_array(F.collect_list(F.struct("place", F.col("positive_score").alias("s"), F.col("positive_id").alias("id"))))
    chosen = table(few.groupBy("anchor_id").agg(listed.alias("ps")).join(wanted.withColumnRenamed("vec_id", "anchor_id"), "anchor_id")
                   .withColumnRenamed("anchor_id", "vec_id"))

    def far(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        left = left.sort_by("vec_id").combine_chunks()
        aid, alabel, ax = left.column("vec_id").to_numpy(), left.column("label").to_numpy(), matrix_of(left.column("x").combine_chunks()).astype(np.int64)
        ps = left.column("ps").to_pylist()
        scores = np.array([[p["s"] for p in some] + [np.nan] * (positives - len(some)) for some in ps], np.float64)
        rid, rlabel, rx, code = unpacked(right)
        a, j, r, s = negatives_in(Anchors(ax), ax, alabel, scores, code, rx, rid, rlabel, negatives)
        held = [ps[x][y] for x, y in zip(a, j, strict=True)]
        return pa.table({"anchor_id": pa.array(aid[a], pa.int64()), "positive_id": pa.array([h["id"] for h in held], pa.int64()), "positive_score": pa.array([h["s"] for h in held], pa.int64()),
                         "negative_id": pa.array(rid[r], pa.int64()), "negative_score": pa.array(s, pa.int64())})

    some, all_ = cells(["d"], sizes.where("m > 0"), chosen)
    pairs = some.cogroup(all_).applyInArrow(far, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    return (pairs.withColumn("rank", rank).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
