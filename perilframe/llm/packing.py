"""Sum-of-squares packing of tokenised documents into fixed windows."""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
OPEN_LIMIT = 8192  # open windows a task holds before it pours their content together; a memory bound, no document is dropped
TOKEN_CACHE = 400_000  # distinct tokens a worker remembers, and as many from before
TEXTS = 256  # texts that are taken together
# Characters that str.split or str.lower treat otherwise than the tokeniser.
ODD = "\x1c\x1d\x1e\x1f\x85\u0130\u03a3"
# Fixed value: the word pattern of the vocabulary file's pre-tokeniser.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# A byte-level model names bytes by letters: printable ones of Latin-1 by themselves, the others in order by those from 256 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
LATIN_END = "\u0220"  # letters before it are Latin ones that have been in Unicode for long
MARKS = ".,;:!?"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokens:
    """Token ids of texts. The vocabulary's model sees one word at a time, so ids are remembered by word.

    A map holds little-endian 32-bit ids by blank-separated token, and by word that the pattern finds in one.
    """
    held: ClassVar[dict[str, WordTokens]] = {}

    @classmethod
    def shared(cls, path: str) -> WordTokens:
        """The one of this process: what a task has learned serves the worker's later tasks."""
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)  # without normaliser: for words that are ready
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        ends = [i for t, i in self.whole.get_vocab().items() if t.endswith("</w>")]
        self.last = np.isin(np.arange(self.whole.get_vocab_size()), ends)
        self.size = self.whole.get_vocab_size()
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.find = regex.compile(WORD).findall
        self.tokens: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # those of the time before, from where what is seen again comes back
        self.settled: dict[str, bool] = {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """As whole.encode(text, add_special_tokens=False).ids for each text."""
        if len(self.tokens) > TOKEN_CACHE:
            self.before, self.tokens = self.tokens, {}
        # Texts that normalisation changes beyond str.lower and blanks, or that name special ids, go to the tokeniser whole.
        split = [None if any(c in t for c in ODD) or any(s in t for s in self.specials) or not unicodedata.is_normalized("NFC", t) else t.lower().split()
                 for t in texts]
        found = [None if tokens is None else list(map(self.tokens.get, tokens)) for tokens in split]
        missing = [k for k, f in enumerate(found) if f is not None and None in f]
        if missing:
            new = {t for k in missing for t, f in zip(split[k], found[k], strict=True) if f is None}
            known = {t: self.before[t] for t in new if t in self.before}
            self.tokens.update(known)
            self.learn(new - known.keys())
            for k in missing:
                found[k] = [self.tokens[t] if f is None else f for t, f in zip(split[k], found[k], strict=True)]
        return [np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4") if f is None else np.frombuffer(b"".join(f), "<u4")
                for t, f in zip(texts, found, strict=True)]

    def old(self, c: str) -> bool:
        """The letter has been in Unicode for long, so that the pattern and the tokeniser agree on what it is."""
        if c not in self.settled:
            self.settled[c] = unicodedata.ucd_3_2_0.category(c) != "Cn"
        return self.settled[c]

    def learn(self, tokens: set[str]) -> None:
        """Remember the ids of new tokens. Words are tokens too, so that those found in one serve as such later."""
        need, parts = set(), {}
        for t in tokens:
            plain = t.isascii() or max(t) < LATIN_END
            if plain and t.isalpha():
                need.add(t)
            elif plain and t[-1] in MARKS and t[:-1].isalpha():
                parts[t] = (t[:-1], t[-1])
            elif plain or all(map(self.old, t)):
                words = self.find(t)
                if words == [t]:
                    need.add(t)
                else:
                    parts[t] = words
            else:  # the pattern may see letters otherwise than the tokeniser
                self.tokens[t] = array("I", self.whole.encode(t, add_special_tokens=False).ids).tobytes()
        known, before = self.tokens, self.before
        for words in parts.values():
            for w in words:
                if w not in known and w not in need:
                    if w in before:
                        known[w] = before[w]
                    else:
                        need.add(w)
        some = list(need)
        for at in range(0, len(some), 512):
            words = some[at:at + 512]
            ready = [w if w.isascii() and w.isprintable() else w.encode("utf-8").decode("latin-1").translate(BYTE_LETTERS) for w in words]
            ids = np.array(self.model.encode_batch_fast([" ".join(ready)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()  # each word ends with an id of word ends
            if len(ends) != len(words):
                raise ValueError("the vocabulary has words without an end")
            found, begin = ids.tobytes(), 0
            for w, end in zip(words, ends, strict=True):
                known[w] = found[begin:end]
                begin = end
        for t, words in parts.items():
            known[t] = b"".join([known[w] for w in words])


class Packer:
    """Windows of one task. level[h] counts the open windows filled to h; stack[h] holds them."""

    def __init__(self, window: int = WINDOW):
        self.window, self.level, self.stack = window, np.zeros(window + 1, np.int64), [[] for _ in range(window + 1)]
        self.made, self.open = 0, 0

    def place(self, size: int) -> int:
        """The fill level, 0 for a fresh window, where `size` more ids make the sum of squared counts smallest.

        From h to h + size the sum changes by 1 - 2 N(h) for leaving h (unless fresh) and 1 + 2 N(h + size) for arriving
        (unless full). Ties go to the fullest window.
        """
        top = self.window - size
        n = self.level
        gain = 1 - 2 * n[:top + 1]
        gain[0] = 0
        arrive = 1 + 2 * n[size:self.window + 1]
        arrive[-1] = 0
        cost = gain + arrive
        cost[1:][n[1:top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))

    def add(self, piece: tuple) -> list[tuple[int, list]]:
        """Put a piece (doc, start, ids, doc_tokens) in; the windows that it fills."""
        size = len(piece[2])
        h = self.place(size)
        if h:
            pieces = self.stack[h].pop()
            self.level[h] -= 1
            self.open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if h + size == self.window:
            return [self.number(pieces)]
        self.stack[h + size].append(pieces)
        self.level[h + size] += 1
        self.open += 1
        return self.pour(False) if self.open > OPEN_LIMIT else []

    def number(self, pieces: list) -> tuple[int, list]:
        self.made += 1
        return self.made - 1, pieces

    def pour(self, last: bool) -> list[tuple[int, list]]:
        """Join the open windows' content into full windows, cutting where they end.

        What is left stays open, or at the end is cut into windows of powers of two, which take no padding.
        """
        pieces = [p for h in range(self.window, 0, -1) for w in self.stack[h] for p in w]
        self.level[:], self.stack, self.open = 0, [[] for _ in range(self.window + 1)], 0
        total, out = sum(len(p[2]) for p in pieces), []
        room = [self.window] * (total // self.window)
        left = total % self.window
        room += [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1] if last else [left] * bool(left)
        at = 0
        for size in room:
            mine, need = [], size
            while need:
                doc, start, ids, n = pieces[at]
                mine.append((doc, start, ids[:need], n))
                if len(ids) <= need:
                    at += 1
                else:
                    pieces[at] = (doc, start + need, ids[need:], n)
                need -= len(mine[-1][2])
            if size == self.window or last:
                out.append(self.number(mine))
            else:
                self.stack[size].append(mine)
                self.level[size] += 1
                self.open += 1
        return out


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """Pack every document of docs (doc_id, text) into sequences of at most `window` ids, one row per piece.

    Each task packs what it reads, online: a document's full windows are cut off first, and its rest goes to the fill
    level that minimises the sum of squared counts of partially filled windows. At the end of a task, open windows are
    poured together. Sequences are full or have a power of two of ids, so nothing is padded. No shuffle; a task holds
    a batch of texts and its open windows. sequence_id is the task's number times 2^33 plus the window's in the task.

    `vocabulary` is the path of a word-level tokenizers file, present on every executor; it is a parameter. Ids are
    those of the tokenizer without special tokens, then END_ID. Null and empty text is one piece of END_ID alone. Rows
    that repeat are packed each; null doc_id is passed on. Extra columns are not read. Empty tables give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = WordTokens.shared(vocabulary), Packer(window)
        base = TaskContext.get().partitionId() << 33

        def rows(full: list[tuple[int, list]]) -> list[tuple]:
            out = []
            for k, pieces in full:
                at = 0
                for doc, start, ids, n in pieces:
                    out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, base + k, at))
                    at += len(ids)
            return out

        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*made) if made else [[]] * 7)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part, made = batch.slice(at, TEXTS), []
                found = words.ids([t or "" for t in part.column(1).to_pylist()])
                for doc, text_ids in zip(part.column(0).to_pylist(), found, strict=True):
                    ids = np.append(text_ids, np.uint32(END_ID))
                    n, cut = len(ids), len(ids) // window * window
                    made += rows([packer.number([(doc, s, ids[s:s + window], n)]) for s in range(0, cut, window)])
                    if cut < n:
                        made += rows(packer.add((doc, cut, ids[cut:].copy(), n)))
                yield batch_of(made)
        yield batch_of(rows(packer.pour(True)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
