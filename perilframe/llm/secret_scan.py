"""Secret scan: fixed patterns, and strings that a primed compressor can't shorten in sensitive places."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base kinds in their order, with the least length of what has to be long (a group, or 0 for all).
BASE = [("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]{32,}", 0, 32)]
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
# What makes a place sensitive, and identifiers that are common in code.
SENSITIVE = r"(?ai)(secret|token|passw|api.?key|private.?key|access.?key|credential|bearer|authorization|signature|client.?id|session.?key)"
IDENTIFIERS = ("authorization bearer access_key access_token refresh_token api_key apikey client_id client_secret connection_string "
               "private_key public_key secret_key password passwd username session_id signature certificate encryption config "
               "settings environment variable default example placeholder changeme your_token_here function return import export "
               "const static public private class string integer boolean true false null none self this request response header "
               "content-type application/json https:// http:// localhost .com .org .net www. /usr/local/bin /etc/ .py .js .json "
               "getElementById addEventListener abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789")
CANDIDATE = r"(?a)(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
CONTEXT = 400  # characters on each side that prime the compressor besides the dictionary
NEAR = 60  # characters before a candidate in which a sensitive word counts
NOVEL_BITS = 6.5  # marginal compressed bits per character that are enough for any alphabet
# Long or few-lettered random strings need no more than their alphabet's bits, so that these and a share above are enough too:
# for hexadecimal and base32 at any length, for others from ANY_ALPHABET characters on. The share, what the format adds,
# falls beyond LONG characters. Words joined to identifiers have less.
OVER, LONG, ANY_ALPHABET = 0.14, 256, 64
ALPHABETS = [frozenset("0123456789abcdef"), frozenset("0123456789ABCDEF"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567=")]
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base string, spans string"


class Novelty:
    """Marginal compressed bytes of a string among its surroundings, with a dictionary of identifiers."""

    def __init__(self) -> None:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.size = lambda x: len(zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False).compress(x))

    def bits(self, before: str, candidate: str, after: str) -> float:
        """Bits per character that the candidate adds to its surroundings' compressed size.

        The surroundings give the compressor its letter statistics, and they and the dictionary the strings to refer to.
        """
        around, body = (before + "\n" + after).encode(), (before + candidate + "\n" + after).encode()
        return 8 * (self.size(body) - self.size(around)) / len(candidate)


def enough_bits(word: str, novel_bits: float = NOVEL_BITS) -> float:
    """Marginal bits per character from which a string is novel, by its length and what its alphabet allows."""
    used = set(word)
    fixed = next((16 if len(a) == 16 else 32 for a in ALPHABETS if used <= a), None)
    if fixed is None and len(word) < ANY_ALPHABET:
        return novel_bits
    size = fixed or (26 * any("a" <= c <= "z" for c in used) + 26 * any("A" <= c <= "Z" for c in used)
                     + 10 * any("0" <= c <= "9" for c in used) + len(used & set("+/_=-")))
    return min(novel_bits, math.log2(size) * (1 + OVER * min(1.0, LONG / len(word)) ** 1.5))


class Scanner:
    def __init__(self, novel_bits: float = NOVEL_BITS):
        self.base = [(kind, re.compile(p), group, least) for kind, p, group, least in BASE]
        self.candidate, self.sensitive = re.compile(CANDIDATE), re.compile(SENSITIVE)
        self.novelty, self.novel_bits = Novelty(), novel_bits

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, order of kind, end) in code points, base kinds first to last, then novel ones that touch none of them."""
        low = text.lower()
        may = (any(w in low for w in ASSIGN_WORDS), "AKIA" in text, True)
        found = [(m.start(), k, m.end()) for k, (_, p, group, least) in enumerate(self.base) if may[k]
                 for m in p.finditer(text) if len(m[group]) >= least]
        if self.sensitive.search(low):
            for m in self.candidate.finditer(text):
                start, end = m.span()
                if any(s < end and start < e for s, _, e in found):
                    continue
                word = m[0]
                if not (any(c.isdigit() for c in word) and any(c.isalpha() for c in word)):
                    continue
                if self.sensitive.search(text, max(0, start - NEAR), start) and self.novelty.bits(
                        text[max(0, start - CONTEXT):start], word, text[end:end + CONTEXT]) >= enough_bits(word, self.novel_bits):
                    found.append((start, len(self.base), end))
        return sorted(found)


def scan(docs: DataFrame, novel_bits: float = NOVEL_BITS) -> DataFrame:
    """docs (doc_id, text) -> counts of each kind and their places.

    base and spans list kind:start:end by start, then kind, joined by commas; offsets are code points, end exclusive,
    of the whole match. base has the fixed patterns, leftmost and non-overlapping per kind; spans also has `novel`
    ones: strings after a sensitive word whose marginal compressed size, primed by an identifier dictionary and the
    surrounding text, is at least novel_bits per character or what their alphabet and length allow (see enough_bits),
    and which no base span touches.

    Null and empty text has no spans. doc_id is passed on, null or repeated. Extra columns are not read. Each text is
    scanned whole in one task, with memory for a small batch of texts.
    """
    kinds = [b[0] for b in BASE] + ["novel"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(novel_bits)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = scanner.spans(text) if text else []
                    write = [f"{kinds[k]}:{s}:{e}" for s, k, e in found]
                    base = [w for w, (_, k, _) in zip(write, found, strict=True) if k < len(BASE)]
                    rows.append((doc, *(sum(k == j for _, k, _ in found) for j in range(4)), ",".join(base), ",".join(write)))
                types = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)],
                                                 ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
