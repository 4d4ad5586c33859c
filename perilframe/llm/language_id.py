"""Language identification with hyperdimensional letter profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilframe.llm.common import mix

DIMS = 1024
N = 3  # letters of an n-gram
LETTERS = 512  # letter vectors; code points beyond share them by a hash
MAX_LANGS = 4096  # more language values than this are refused: prototypes are sent to every task


def letter_vectors(dims: int = DIMS) -> np.ndarray:
    """Fixed random +1/-1 vectors, one for each letter code; code 0 is the word gap."""
    bits = mix(np.arange(LETTERS * dims, dtype=np.uint64) + np.uint64(7)) >> np.uint64(63)
    return bits.astype(np.float32).reshape(LETTERS, dims) * 2 - 1


class Profiles:
    """Turns texts into n-gram counts, and n-grams into vectors."""

    def __init__(self, dims: int = DIMS):
        letters = letter_vectors(dims)
        self.rolled = [np.roll(letters, N - 1 - j, axis=1) for j in range(N)]  # permuted by place

    @staticmethod
    def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-gram codes of the lower-cased letters, other characters being gaps, and their counts."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = IS_LETTER[codes]
        code = np.where(letter, np.where(codes < 128, codes, 128 + codes % np.uint32(LETTERS - 128)), 0).astype(np.int64)
        if len(code) > 1:
            code = code[np.append(True, (code[1:] != 0) | (code[:-1] != 0))]  # one gap between words
        code = np.concatenate([[0], code, [0]])
        size = len(code) - N + 1
        if size < 1 or not code.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        gram = np.zeros(size, np.int64)
        for j in range(N):
            gram = gram * LETTERS + code[j:j + size]
        return np.unique(gram, return_counts=True)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Bind each n-gram's permuted letter vectors by multiplication."""
        out = np.ones((len(grams), self.rolled[0].shape[1]), np.float32)
        for j in range(N):
            out *= self.rolled[j][grams // LETTERS ** (N - 1 - j) % LETTERS]
        return out


IS_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def prototypes(docs: DataFrame, dims: int = DIMS) -> dict[str, np.ndarray]:
    """Bundle of all n-gram vectors of each language's texts, from every row of docs (text, lang) with both.

    Tasks bundle what they read; the partial bundles, `dims` numbers a language and task, are summed by language and
    place. The result has `dims` numbers a language. Bundles are whole numbers, so their sum has no rounding order.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dims), {}
        for batch in batches:
            by: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(Profiles.grams(text))
            for lang, found in by.items():
                grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([c for _, c in found]), len(grams)) if len(grams) else np.zeros(0)
                for k in range(0, len(grams), 4096):
                    part = counts[k:k + 4096] @ profiles.vectors(grams[k:k + 4096]).astype(np.float64)
                    sums[lang] = sums.get(lang, 0) + part
        rows = [(lang, i, int(v)) for lang, s in sums.items() for i, v in enumerate(s)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, [pa.string(), pa.int32(), pa.int64()], strict=True)],
                                         ["lang", "i", "v"])

    usable = docs.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    summed = usable.mapInArrow(run, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    rows = (summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v")))["v"].alias("v"))
            .orderBy("lang").limit(MAX_LANGS + 1).collect())
    if len(rows) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    return {r.lang: np.array(r.v, np.float64) for r in rows if any(r.v)}


def predict(docs: DataFrame, learned: dict[str, np.ndarray], keep: list[Column], dims: int = DIMS) -> DataFrame:
    """keep, then lang_pred and score, for each row of docs: the language whose prototype has the largest cosine.

    score is half of one plus that cosine. `und` with score 0 where text is null or has no letter, or nothing was
    learned. Equal cosines go to the first language by name. Only text is looked at.
    """
    names = sorted(learned)
    unit = np.array([learned[n] / np.linalg.norm(learned[n]) for n in names], np.float32).reshape(-1, dims).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dims)
        for batch in batches:
            for at in range(0, batch.num_rows, 48):
                part = batch.slice(at, 48)
                found = [Profiles.grams(t) if t else (np.zeros(0, np.int64),) * 2 for t in part.column("text").to_pylist()]
                lang, score = ["und"] * len(found), [0.0] * len(found)
                grams, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                if len(grams) and names:
                    row = np.repeat(np.arange(len(found)), [len(g) for g, _ in found])
                    counts = np.zeros((len(found), len(grams)), np.float32)
                    counts[row, place] = np.concatenate([c for _, c in found])
                    bundle = np.zeros((len(found), dims), np.float32)
                    for k in range(0, len(grams), 8192):
                        bundle += counts[:, k:k + 8192] @ profiles.vectors(grams[k:k + 8192])
                    norm = np.linalg.norm(bundle, axis=1)
                    cos = (bundle @ unit) / np.maximum(norm, 1e-9)[:, None]
                    for i in np.flatnonzero(norm):
                        best = int(np.argmax(cos[i]))
                        lang[i], score[i] = names[best], float(np.clip((1 + cos[i, best]) / 2, 0, 1))
                kept = [part.column(c) for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang), pa.array(score, pa.float64())],
                                                 [c for c in part.schema.names if c != "text"] + ["lang_pred", "score"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")
