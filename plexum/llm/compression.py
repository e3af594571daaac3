"""Quality rules by compression bands.

A text's zstandard ratio (compressed bytes over bytes) falls with length, so each length class has its own band. Below the band a
text is repetitive, above it it is incompressible. The whole text and each fixed chunk of it are held against bands. The bands are
parameters; the defaults are wide enough for prose in any of the alphabets with one to three bytes a letter.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from plexum.llm.common import as_bytes, map_arrow

#: (least bytes, lowest ratio, highest ratio) of a whole text, by length class; below the first class there is no verdict.
BANDS = ((128, 0.20, 1.10), (256, 0.30, 0.95), (512, 0.34, 0.85), (1024, 0.30, 0.75), (2048, 0.27, 0.70), (4096, 0.24, 0.68), (16384, 0.20, 0.66), (65536, 0.16, 0.66))
#: Bytes of a chunk; a last chunk under half of that is judged with the whole text only.
CHUNK = 2048
CHUNK_BAND = (0.15, 0.80)
#: A text goes if more than this share of its chunks is outside the band.
CHUNK_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, chunk_min double, chunk_max double, n_chunks long, n_chunks_out long, verdict string, kept boolean"

_SYMBOL_CODES = list(SYMBOLS)
_SPACE_CODES = [32, *range(9, 14)]


def text_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text."""
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    chars = len(data) - int(seen[128:192].sum()) - int(seen[_SPACE_CODES].sum())
    lines = [x for x in data.split(b"\n") if x.strip()] if seen[10] else []
    return len(words), chars, int(seen[_SYMBOL_CODES].sum()), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of `width` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number = dict(zip(dict.fromkeys(words), itertools.count()))
    if len(number) == len(words):
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    key = ids[:n]
    for i in range(1, width):
        if i > 1 and len(number) >= 2_000_000:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(number) + ids[i : n + i]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : n + i] |= hit
    return int(covered.sum())


def ratios(data: bytes, packer: zstandard.ZstdCompressor, chunk: int = CHUNK) -> tuple[float | None, list[float]]:
    """The whole text's ratio and those of its chunks; None and none for an empty text."""
    if not data:
        return None, []
    parts = [data[i : i + chunk] for i in range(0, len(data), chunk)]
    whole = len(packer.compress(data)) / len(data)
    if len(parts) == 1:
        return whole, [whole] if 2 * len(data) >= chunk else []
    return whole, [len(packer.compress(x)) / len(x) for x in parts if 2 * len(x) >= chunk]


def verdict(size: int, whole: float | None, chunks: list[float], bands=BANDS, chunk_band=CHUNK_BAND, share: float = CHUNK_SHARE) -> str:
    """'kept', 'repetitive', 'incompressible', 'repetitive chunks' or 'incompressible chunks'."""
    band = next((x for x in reversed(bands) if size >= x[0]), None)
    if band is not None and whole is not None:
        if whole < band[1]:
            return "repetitive"
        if whole > band[2]:
            return "incompressible"
    if chunks:
        if sum(x < chunk_band[0] for x in chunks) > share * len(chunks):
            return "repetitive chunks"
        if sum(x > chunk_band[1] for x in chunks) > share * len(chunks):
            return "incompressible chunks"
    return "kept"


def compression_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 3, bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, share: float = CHUNK_SHARE, least_words: int = 50) -> DataFrame:
    """One row per document with its counts, ratios and verdict.

    A null or empty text counts as no words and fails the base rule; its ratio is null. Repeated rows give repeated rows; a null id
    stays null. Other columns are not read. One map over the rows, without a shuffle; memory is that of one Arrow batch.
    """

    def run(batch: pa.RecordBatch) -> dict:
        packer = zstandard.ZstdCompressor(level=level)
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = as_bytes(text)
            n, chars, symbols, dup, repeat = text_counts(data)
            failed = n < least_words or 100 * repeat > 50 * n
            whole, parts = ratios(data, packer, chunk)
            said = verdict(len(data), whole, parts, bands, chunk_band, share)
            out = sum(not chunk_band[0] <= x <= chunk_band[1] for x in parts)
            rows.append((key, n, chars, symbols, dup, repeat, failed, whole, min(parts, default=None), max(parts, default=None), len(parts), out, said, not failed and said == "kept"))
        return dict(zip((x.split()[0] for x in SCHEMA.split(", ")), zip(*rows)))

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), run, SCHEMA)
