"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds of `least` tokens (rolling Karp-Rabin hashes). For each pair, the longest match of
unmarked tokens is marked on both sides, again and again, until none of `least` tokens is left. An item leaks into a document if the tiles
cover enough of the item, in whatever order they stand. An item of under `least` tokens is its own seed and leaks where it stands whole.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexum.llm.common import as_bytes, map_arrow, sliced

#: Tokens of the shortest tile, and the share of an item's tokens that tiles must cover.
LEAST = 5
COVERAGE = 0.6
#: Benchmark bytes that are sent to every task at once; a larger benchmark is searched in blocks of that size.
BLOCK_BYTES = 16_000_000

_LOWER = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))
_BASE = 0x9E3779B97F4A7C15
#: Letters of scripts that are written without spaces: Thai, Lao, Burmese, Khmer, kana, Chinese characters.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
_UNSPACED_LEAD = re.compile(b"[\xe0\xe1\xe3-\xe9\xef]")


def tokens(data: bytes) -> list[bytes]:
    """Words with A-Z in lower case; ASCII punctuation separates like space, and letters of unspaced scripts are a word each."""
    if _UNSPACED_LEAD.search(data):
        data = _UNSPACED.sub(r" \g<0> ", data.decode("utf-8", "replace")).encode("utf-8", "replace")
    return data.translate(_LOWER).split()


_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=64)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, base, np.uint64))), out=out)
    return out


def _size(n: int) -> int:
    """The power of two from n on, so that few tables of powers are made."""
    return 1 << max(4, n.bit_length())


def prefixes(ids: np.ndarray) -> np.ndarray:
    """Sums over the first i tokens of token times base**place (mod 2**64); differences are Karp-Rabin hashes of windows of any width."""
    n = len(ids)
    x = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return np.concatenate(([np.uint64(0)], np.cumsum(x * _powers(_BASE, _size(n))[:n], dtype=np.uint64)))


def rolling(ids: np.ndarray, width: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Karp-Rabin hashes of all windows, the same for the same tokens wherever they stand: each is shifted to one place."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefixes(ids) if sums is None else sums
    return (sums[width:] - sums[:n]) * _powers(_INVERSE, _size(n))[:n]


class Items:
    """A block of benchmark items: their words' numbers, token numbers, and an index of seeds: `least` tokens, or a shorter item whole."""

    def __init__(self, rows: list[tuple[int, bytes]], least: int = LEAST):
        self.least, self.number, self.items = least, {}, []
        found: dict[int, list] = {}
        for key, data in rows:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in tokens(data)], np.int64)
            if len(ids):
                width = min(least, len(ids))
                h = np.unique(rolling(ids, width))
                found.setdefault(width, []).append((h, np.full(len(h), len(self.items))))
            self.items.append((key, ids))
        #: By seed width: hashes in order, and the item of each.
        self.seeds = {}
        for width, parts in found.items():
            h, owner = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            self.seeds[width] = h[order], owner[order]

    def candidates(self, data: bytes) -> tuple[np.ndarray, list[int]]:
        """The document's token numbers (0: not in the benchmark), and the items that share a seed with it."""
        words = tokens(data)
        ids = np.fromiter(map(self.number.get, words, itertools.repeat(0)), np.int64, len(words))
        out: set[int] = set()
        if len(ids) and ids.max():
            sums = prefixes(ids)
            gaps = np.concatenate(([0], np.cumsum(ids == 0)))
            for width, (hashes, owners) in self.seeds.items():
                if len(ids) < width:
                    continue
                known = gaps[width:] == gaps[:-width]
                if known.any():
                    own = rolling(ids, width, sums)[known]
                    near = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    own = np.unique(own[hashes[near] == own])
                    low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
                    hit = np.flatnonzero(high > low)
                    if len(hit):
                        # Each run of the index that a seed of the document has.
                        n = high[hit] - low[hit]
                        at = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                        out.update(np.unique(owners[at]).tolist())
        return ids, sorted(out)


def tile(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (place in a, place in b, length), longest first; of equals the first in a, then in b. Tokens 0 of a match nothing.

    Running Karp-Rabin: the longest width at which unmarked windows of both sides agree is found by halving, since a common window holds
    common windows of every lesser width. All tiles of that width are marked, and the width falls. A round takes time in
    proportion to both sides, however often a text repeats itself.
    """
    least = max(1, min(least, len(b)))
    shared = np.flatnonzero(np.isin(a, b) & (a > 0))
    if not len(shared):
        return []
    # Only tokens that b has, with a gap of one token between runs.
    jump = np.concatenate(([False], np.diff(shared) > 1))
    place = shared + 0
    at = np.arange(len(shared)) + np.cumsum(jump)
    ids = np.zeros(at[-1] + 1, np.int64)
    ids[at] = a[place]
    back = np.full(len(ids), -1)
    back[at] = place
    free_a, free_b = ids > 0, np.ones(len(b), bool)
    sums_a, sums_b, out = prefixes(ids), prefixes(b), []

    def common(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Unmarked windows of both sides that agree: their places and hashes."""
        found = []
        for x, sums, free in ((ids, sums_a, free_a), (b, sums_b, free_b)):
            taken = np.concatenate(([0], np.cumsum(~free)))
            places = np.flatnonzero(taken[width:] == taken[:-width]) if len(x) >= width else np.zeros(0, np.int64)
            found.append((places, rolling(x, width, sums)[places] if len(places) else np.zeros(0, np.uint64)))
        (pa_, ha), (pb, hb) = found
        ka, kb = np.isin(ha, hb), np.isin(hb, ha)
        return pa_[ka], ha[ka], pb[kb], hb[kb]

    top = min(len(ids), len(b))
    while top >= least:
        low, high = least - 1, top
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(common(mid)[0]) else (low, mid - 1)
        if low < least:
            break
        pa_, ha, pb, hb = common(low)
        where: dict[int, deque] = {}
        for j, h in zip(pb.tolist(), hb.tolist()):
            where.setdefault(h, deque()).append(j)
        for i, h in zip(pa_.tolist(), ha.tolist()):
            if not free_a[i : i + low].all():
                continue
            places = where[h]
            while places and not free_b[places[0] : places[0] + low].all():
                places.popleft()
            if places and np.array_equal(ids[i : i + low], b[places[0] : places[0] + low]):
                j = places.popleft()
                free_a[i : i + low] = False
                free_b[j : j + low] = False
                out.append((int(back[i]), j, low))
        top = low - 1
    return out


def covered_by(ids: np.ndarray, own: np.ndarray, least: int) -> tuple[int, int]:
    """Item tokens under tiles, and the number of tiles; an item of under `least` tokens counts whole or not at all."""
    tiles = tile(ids, own, least)
    return sum(x[2] for x in tiles), len(tiles)


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded size; one partition at a time comes to the driver."""
    block, size = [], 0
    rows = benchmark.select(benchmark[id_col].cast("long").alias("i"), benchmark[text_col].cast("string").alias("t"))
    for row in rows.toLocalIterator():
        data = as_bytes(row.t)
        block.append((row.i, data))
        size += len(data) + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item whose coverage reaches the threshold: doc_id, item_id, coverage, tile_tokens, item_tokens, n_tiles.

    Null and empty texts match nothing; an item of under `least` tokens matches whole or not at all. Repeated rows on either side give repeated rows;
    null ids stay null. Other columns are not read.
    """
    schema = "doc_id long, item_id long, coverage double, tile_tokens long, item_tokens long, n_tiles long"
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = None
    for block in blocks_of(benchmark, item_col, item_text_col, block_bytes):
        part = map_arrow(texts, _searcher(block, least, coverage), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _searcher(block: list[tuple[int, bytes]], least: int, coverage: float):
    held: list[Items] = []

    def run(batch: pa.RecordBatch) -> dict | None:
        if not held:
            held.append(Items(block, least))
        items, rows = held[0], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids, found = items.candidates(as_bytes(text))
            for owner in found:
                item, own = items.items[owner]
                covered, n = covered_by(ids, own, least)
                if covered >= coverage * len(own):
                    rows.append((key, item, covered / len(own), covered, len(own), n))
        return dict(zip(("doc_id", "item_id", "coverage", "tile_tokens", "item_tokens", "n_tiles"), zip(*rows))) if rows else None

    return run


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, that no item leaks into."""
    at = docs.columns.index(text_col)

    def filtered(block):
        def run(batches):
            items = Items(block, least)
            for batch in sliced(batches):
                yield batch.filter(pa.array([clean(items, x) for x in batch.column(at).to_pylist()], pa.bool_()))

        def clean(items, text):
            ids, found = items.candidates(as_bytes(text))
            return not any(covered_by(ids, items.items[o][1], least)[0] >= coverage * len(items.items[o][1]) for o in found)

        return run

    items = benchmark.select(F.lit(0).alias("_item"), benchmark[item_text_col].alias("_text"))
    for block in blocks_of(items, "_item", "_text", block_bytes):
        docs = docs.mapInArrow(filtered(block), docs.schema)
    return docs
