"""Problem 6: repetition inside a single document.

Compression bands: each text, without blanks, numbering, punctuation and case, is compressed with zstandard, whole and in fixed
chunks (the last may be shorter, and has the limit of its own length). Text whose ratio, whole or of a chunk, is within the limit of
its length is ``repetitive`` and may be rejected; text that hardly compresses at all is ``incompressible``; the rest is ``fresh``.
The limits are what text of that length reaches at most when half of it repeats in the way hardest to compress (shuffled pieces of
``GRAM`` letters that each stand twice), and a little more; beyond ``LONGEST`` bytes, where the compressor forgets what it saw, every
text keeps the band ``repetitive``.

The share of repeated content is then measured exactly, for every text whatever its band: a character is repeated if it lies in a run of
``gram`` characters that also begins somewhere earlier (overlaps count, as in a loop of one short word), or in a word that came
earlier. Texts under twice ``gram`` characters have runs of half their length. The measure is linear but for sorting: runs are
ranked, so no pairs of places are built.

Edge cases: null has no row values but null; text with no letters or digits gives share 0 over 0 characters; numbers are content
unless they number a list; very long texts are measured whole; repeated rows give repeated results; extra columns stay.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 5
#: (from how many bytes, highest ratio of text of which half repeats, ratio above which text is incompressible)
BANDS = ((0, 2.5, 2.5), (10, 2.0, 2.0), (20, 1.6, 1.6), (30, 1.4, 1.4), (50, 1.18, 1.18), (80, 1.05, 1.12), (120, 0.92, 1.06), (200, 0.80, 1.02), (400, 0.70, 1.0), (1000, 0.63, 0.98))
CHUNK, LONGEST = 1024, 60_000
#: A list's number, at its place.
NUMBERING = r"(^|\s)[(\[]?[0-9]{1,3}[.)\]:](\s|$)"
MEASURES = T.StructType(
    [
        T.StructField("n_chars", T.IntegerType()),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("least_chunk_ratio", T.DoubleType()),
        T.StructField("band", T.StringType()),
        T.StructField("repeated_share", T.DoubleType()),
    ]
)
_numbering, _words = re.compile(NUMBERING), re.compile(r"[^\W_]+")


def bare_words(text: str) -> list[str]:
    """Words in lower case: blanks, numbering and marks do not matter."""
    return _words.findall(_numbering.sub(" ", text.lower()))


def repeated_share(words: list[str], gram: int = GRAM) -> float:
    """Share of the characters in words, or in runs of ``gram`` characters, that began earlier; linear up to sorting."""
    a = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(a)
    if not n:
        return 0.0
    gram = min(gram, max(1, n // 2))
    rank, width = np.unique(a, return_inverse=True)[1].astype(np.uint64), 1
    while width < gram:  # ranks of runs, doubled up to the wanted width; exact, no hashing
        step = min(width, gram - width)
        rank = np.unique((rank[:-step] << np.uint64(32)) | rank[step:], return_inverse=True)[1].astype(np.uint64)
        width += step
    _, first, inv = np.unique(rank, return_index=True, return_inverse=True)
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(first[inv] < np.arange(len(rank)))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + gram, -1)
    seen: set[str] = set()
    k = 0
    for w in words:
        if w in seen:
            edge[k] += 1
            edge[k + len(w)] -= 1
        seen.add(w)
        k += len(w)
    return float((np.cumsum(edge)[:n] > 0).sum() / n)


def _limits(size: int, bands) -> tuple[float, float]:
    return (float("inf"), float("inf")) if size >= LONGEST else next(b for b in reversed(bands) if size >= b[0])[1:]


def _measure(text: str | None, gram: int, bands, chunk: int, z):
    if text is None:
        return (None, None, None, None, None)
    words = bare_words(text)
    raw = "".join(words).encode()
    if not raw:
        return (0, None, None, "empty", 0.0)
    ratio = len(z.compress(raw)) / len(raw)
    parts = [(ratio, len(raw))] if len(raw) <= chunk else [(len(z.compress(p)) / len(p), len(p)) for p in (raw[i : i + chunk] for i in range(0, len(raw), chunk))]
    high, noise = _limits(len(raw), bands)
    repetitive = ratio <= high or any(r <= _limits(n, bands)[0] for r, n in parts)
    band = "repetitive" if repetitive else "incompressible" if ratio > noise else "fresh"
    return (sum(map(len, words)), ratio, min(r for r, _ in parts), band, repeated_share(words, gram))


def repetition(text: Column, gram: int = GRAM, bands=BANDS, chunk: int = CHUNK) -> Column:
    """A struct of measures of each text; see the module."""

    @F.pandas_udf(MEASURES)
    def measure(s: pd.Series) -> pd.DataFrame:
        import zstandard

        z = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        return pd.DataFrame([_measure(None if not isinstance(x, str) else x, gram, bands, chunk, z) for x in s], columns=MEASURES.names)

    return measure(text)


def rejected(m: str = "m", share: float = 0.5) -> Column:
    """Whether a text is repetitive by its compression band, and so much of it is repeated."""
    return (F.col(f"{m}.band") == "repetitive") & (F.col(f"{m}.repeated_share") >= share)
