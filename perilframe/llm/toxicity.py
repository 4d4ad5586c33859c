"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learned from document labels."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18  # hashed features: 2^BITS weights
PREFIXES = (4, 5, 6)  # letters of a word's beginning that are features besides the whole word
SAMPLE = 6000  # at most so many labelled documents are learned from; those with the smallest id hashes
EPOCHS, RATE, L2 = 8, 2.0, 1e-4
LONG_BAGS, LONG_SIZE = 160, 13  # long bags laid together from labelled ones, for each epoch; up to 2^LONG_SIZE sentences
FEATURE_CACHE = 400_000
SENTENCE = re.compile(r"[.!?\n]+")


class Features:
    """Sentences of a text, and the hashed features of a sentence's distinct words."""

    def __init__(self) -> None:
        self.cache: dict[str, list[int]] = {}

    @staticmethod
    def sentences(text: str) -> list[list[str]]:
        found = [s.split() for s in SENTENCE.split(text.lower())]
        return [s for s in found if s] or [[]]

    def word(self, word: str) -> list[int]:
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) >= FEATURE_CACHE:
                self.cache.clear()
            core = word.strip(".,;:!?\"'()[]{}#$%&*-_|")
            names = {core, *("^" + core[:n] for n in PREFIXES if len(core) >= n)} if core else set()
            known = self.cache[word] = sorted({zlib.crc32(n.encode("utf-8", "surrogatepass")) & (1 << BITS) - 1 for n in names})
        return known

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter((i for w in set(words) for i in self.word(w)), np.int32)


@dataclass
class Model:
    """A logistic score of each sentence; a document is toxic unless all its sentences are clean.

    Each sentence of n loses slope * log(n), so that the least scores of many clean ones don't add up.
    """

    weights: np.ndarray
    bias: float
    slope: float = 0.0


def noisy_or(logits: np.ndarray) -> float:
    """1 - product of (1 - p) over sentences, from logits."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum()))


def fit(rows: list[tuple[list[np.ndarray], int]]) -> Model:
    """AdaGrad on the document likelihood of the noisy-or. rows: (features of each sentence, label).

    Among the documents come long bags, of clean documents laid end to end and of one toxic document within clean ones,
    whose label is known from theirs: labelled documents of thousands of sentences are few.
    """
    w, seen, bias, bias_seen, slope, slope_seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2), -4.0, 1e-2, 0.5, 1.0
    positive = sum(y for _, y in rows)
    weight = {1: min(10.0, max(1.0, (len(rows) - positive) / max(1, positive)) ** 0.5), 0: 1.0}
    ready = []  # of each document: the features of each occurrence and its sentence, the number of sentences, the label
    for sentences, y in rows:
        ready.append((np.concatenate(sentences), np.repeat(np.arange(len(sentences), dtype=np.int32), [len(s) for s in sentences]), len(sentences), y))
    clean_rows, toxic_rows = ([k for k, (*_, y) in enumerate(ready) if y == v] for v in (0, 1))
    order = np.random.default_rng(0)

    def long_bag(y: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        size, parts, n = 2 ** order.uniform(5, LONG_SIZE), [], 0
        if y:
            parts.append(ready[toxic_rows[order.integers(len(toxic_rows))]])
            n = parts[0][2]
        while n < size:
            parts.append(ready[clean_rows[order.integers(len(clean_rows))]])
            n += parts[-1][2]
        starts = np.cumsum([0, *[p[2] for p in parts]])
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + s for p, s in zip(parts, starts[:-1], strict=True)]), int(starts[-1]), y

    for _ in range(EPOCHS):
        bags = LONG_BAGS * bool(clean_rows)
        for k in order.permutation(len(ready) + bags):
            features, at, n, y = ready[k] if k < len(ready) else long_bag(int(k % 2 and bool(toxic_rows)))
            used, place = np.unique(features, return_inverse=True)
            z = np.clip(bias - slope * np.log(n) + np.bincount(at, w[used][place], n), -30, 30)
            p = 1 / (1 + np.exp(-z))
            clean = np.exp(-np.logaddexp(0, z).sum())
            g = weight[y] * (p if not y else -clean / max(1 - clean, 1e-6) * p)
            step = np.bincount(place, g[at], len(used)) + L2 * w[used]
            seen[used] += step ** 2
            w[used] -= RATE * step / np.sqrt(seen[used])
            total = g.sum()
            bias_seen += total ** 2
            bias -= 0.2 * RATE * total / bias_seen ** 0.5
            fall = -total * np.log(n)
            slope_seen += fall ** 2
            slope = max(0.0, slope - 0.05 * RATE * fall / slope_seen ** 0.5)
    return Model(w.astype(np.float32), bias, slope)


def sample_of(labelled: DataFrame, limit: int, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id hashes are the `limit` smallest, or all; ties with the last one stay too."""
    hashes = labelled.select(F.xxhash64(id_col).alias("h")).orderBy("h").limit(limit)
    edge = hashes.agg(F.max("h").alias("h")).first().h
    return labelled.where(F.xxhash64(id_col) <= F.lit(edge if edge is not None else 0))


def learn(labelled: DataFrame, limit: int = SAMPLE) -> Model:
    """Model of labelled (doc_id, text, label): learned from `limit` documents in one task, as a bounded sample.

    Rows without a text or a label of 0 or 1 are not used; without rows the model scores every text near 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, rows = Features(), []
        for batch in batches:
            texts, labels, ids = (batch.column(i).to_pylist() for i in (1, 2, 0))
            rows += [(i, [features.of(s) for s in Features.sentences(t)], y) for i, t, y in zip(ids, texts, labels, strict=True)]
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2], len(r[1])))
        model = fit([(s, y) for _, s, y in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.slope])], ["weights", "bias", "slope"])

    usable = labelled.where("text is not null and label in (0, 1)").select("doc_id", F.col("text").cast("string"), F.col("label").cast("int"))
    row = sample_of(usable, limit).repartition(1).mapInArrow(run, "weights binary, bias double, slope double").first()
    return Model(np.frombuffer(row.weights, np.float32), row.bias, row.slope) if row else fit([])  # no task ran: no labelled rows


def score(docs: DataFrame, model: Model, keep: list[Column]) -> DataFrame:
    """keep, then score (0 to 1), worst_start, worst_end and worst_score for each row of docs, from text alone.

    The worst sentence is the one with the highest score, the first of equals, by code points of the text; null where
    there is no word. Null and empty texts get the score of one empty sentence. Texts are scored whole; repeated rows
    and null ids alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast((np.asarray(model.weights), model.bias, model.slope))  # 2^BITS numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, (weights, bias, slope) = Features(), shared.value
        known: dict[str, float] = {}  # the sum of a word's weights

        def of(sentence: list[str]) -> float:
            total = bias
            for w in set(sentence):
                if (s := known.get(w)) is None:
                    if len(known) >= FEATURE_CACHE:
                        known.clear()
                    s = known[w] = float(weights[features.word(w)].sum())
                total += s
            return total

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for text in part.column("text").to_pylist():
                    z, best = [], (-np.inf, None, None)
                    low, start = (text or "").lower(), 0
                    for end in [*(m.start() for m in SENTENCE.finditer(low)), len(low)]:
                        if words := low[start:end].split():
                            z.append(of(words))
                            if z[-1] > best[0]:
                                best = (z[-1], start, end)
                        start = end
                    less = slope * np.log(max(1, len(z)))
                    rows.append((noisy_or(np.array(z or [bias]) - less), best[1], best[2], None if best[1] is None else 1 / (1 + np.exp(less - best[0]))))
                names = [c for c in part.schema.names if c != "text"]
                types = [pa.float64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True))],
                                                 names + ["score", "worst_start", "worst_end", "worst_score"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}score double, worst_start long, worst_end long, worst_score double")
