"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits into one sequence. Multiplicative weights solve the covering program: each round prices
lengths by how far they are from being covered, a knapsack dynamic program finds the dearest configurations, and their shares are added, until
every length is covered. Shares are rounded to whole sequences and the program is solved again for what is left; what no nearly full
sequence takes goes best-fit decreasing, on the histogram too. Documents then take the places of their length by rank.
"""

from __future__ import annotations

import bisect
import functools
import json
import math
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexum.llm.common import Scratch, map_arrow, partitions, remembered

CAPACITY = 2048
#: Parts that the pieces of one length are ranked in, or as many as there are shuffle partitions, if more.
SALTS = 256
#: Rounds of multiplicative weights at most; far more than it takes to cover all lengths.
ROUNDS = 20_000
#: Share of its scarcest length that a configuration covers at once, how fast prices fall with coverage, and how far from the best value of
#: the knapsack a configuration may be.
STEP, RATE, SLACK = 0.25, 0.3, 0.02
#: Share of the capacity from which on a sequence counts as full.
FULL = 0.998
#: The id 0 that ends a document, packed.
END = bytes(4)
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


@functools.lru_cache(maxsize=2)
def tokenizer_of(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: A space that begins a token: the byte-level pattern takes the last space of a run together with the word, number or sign after it.
_BEGINS = re.compile(r"(?= \S)")
_INNER = re.compile(r" (?:\s|\Z)")
#: A word of Latin, Greek or Cyrillic letters, with a few signs after it.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ʯΑ-ΡΣ-ωА-џ]+)([.,;:!?()%*#&$]{0,3})")


class Ids:
    """Token ids of texts by the tokenizers library, asked once for each part of a text that begins with a space. Ids are kept and joined as
    little-endian unsigned 32-bit numbers.

    No token of the byte-level pattern reaches over the begin of such a part, so the ids of the parts, in a row, are those of the text.
    Parts of over `longest` characters are not remembered; of the others, about the `most` last asked and those used since then are. A
    tokenizer of another kind, or one whose added tokens take in spaces, gets whole texts.
    """

    def __init__(self, path: str, longest: int = 40, most: int = 400_000):
        self.model, self.longest, self.most, self.known, self.older = tokenizer_of(path), longest, most, {}, {}
        spec = json.load(open(path, encoding="utf-8"))
        # Bytes as the vocabulary writes them: letters and signs for themselves, the others from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in shown]
        self.letters = {x: chr(256 + k) for k, x in enumerate(hidden)}
        self.merges, self.signs = self.model.model, {}
        plain = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer")
        self.split = plain and not any(" " in x["content"] or x.get("lstrip") or x.get("rstrip") for x in spec.get("added_tokens", ()))

    def ask(self, part: str) -> bytes:
        return array("I", self.model.encode(part, add_special_tokens=False).ids).tobytes()

    def learn(self, part: str) -> bytes:
        """The ids of a part not met before, given without the space it begins with. A word is one token of the pattern and the signs after it are
        one, and the library's model merges a word by itself at half the cost of a whole call; all else is asked as it stands."""
        m = _PLAIN.fullmatch(part)
        if not m:
            return self.ask(" " + part)
        word, signs = m.groups()
        ids = (self.known.get(word) or self.older.get(word)) if signs else None
        if ids is None:
            ids = array("I", [x.id for x in self.merges.tokenize("\u0120" + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)))]).tobytes()
            if signs:
                self.known[word] = ids
        if signs:
            if signs not in self.signs:
                self.signs[signs] = self.ask(signs)
            return ids + self.signs[signs]
        return ids

    def of(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def packed(self, text: str) -> bytes:
        if not self.split:
            return self.ask(text)
        if _INNER.search(text):
            first, *parts = _BEGINS.split(text)
            parts = [x[1:] for x in parts]
        else:
            first, *parts = text.split(" ")
        known = self.known
        got = list(map(known.get, parts))
        if None in got:
            for k, ids in enumerate(got):
                if ids is None:
                    part = parts[k]
                    ids = got[k] = known.get(part) or self.older.get(part) or self.learn(part)
                    if len(part) <= self.longest:
                        known[part] = ids
            if len(known) >= self.most:
                self.older, self.known = known, {}
        return (self.ask(first) if first else b"") + b"".join(got)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, salt (the part it is ranked in). Only documents of over `capacity` ids (id 0 at the end included) are cut."""
    path = tokenizer or default_tokenizer()

    turn = [0]

    def run(batch: pa.RecordBatch) -> dict:
        tokens = remembered(path, lambda: Ids(path))
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = tokens.packed(text or "") + END
            n = len(ids) // 4
            first = n % capacity or capacity
            cuts = [0, *range(first, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                # Pieces are dealt in turn, so that neither one length nor one repeated row gathers in a part.
                rows.append((key, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), (turn[0] + len(rows)) % salts))
        turn[0] += len(rows)
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "salt"), zip(*rows)))

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), run, _PIECE, keeps=path)


def _table(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the highest value of each room, and the size taken there (-1: none)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    count = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        n = count[c]
        best[c] = best[c - 1]
        if n:
            got = value[:n] + best[c - sizes[:n]]
            k = int(got.argmax())
            if got[k] > best[c] + 1e-15:
                best[c], pick[c] = got[k], k
    return best, pick


def _taken(pick: list[int], sizes: list[int], room: int, got: dict[int, int]) -> dict[int, int]:
    """got, with the sizes that the table takes for the room."""
    while room > 0:
        k = pick[room]
        if k < 0:
            room -= 1
        else:
            got[k] = got.get(k, 0) + 1
            room -= sizes[k]
    return got


def price(sizes: np.ndarray, most: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size stands in the configuration of highest value."""
    _, pick = _table(sizes, value, capacity)
    out = np.zeros(len(sizes), np.int64)
    for k, n in _taken(pick.tolist(), sizes.tolist(), capacity, {}).items():
        out[k] = n
    return np.minimum(out, most)


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, step: float = STEP, slack: float = SLACK) -> tuple[list[tuple[tuple[int, ...], float]], float, float]:
    """Configurations (lengths in falling order) with fractional shares, the least coverage of a length, and a lower bound of the program.

    A piece is priced by its length, less the more of its length is covered, and not at all once that is whole. A table of the knapsack serves all
    configurations within `slack` of its best, one for each length that has to be in it: prices only fall, so its best stays a bound. A
    share covers its scarcest length by `step`, and is a whole sequence at least, so that a rare length takes one configuration.
    Rounds, of a table each, go on until all lengths are covered.
    """
    sizes = np.array(sorted(x for x in histogram if 0 < x < capacity), np.int64)
    need = np.array([histogram[x] for x in sizes], float)
    if not len(sizes):
        return [], 1.0, 0.0
    covered, share, bound = np.zeros(len(sizes)), {}, 0.0
    for _ in range(rounds):
        open_ = np.flatnonzero(covered < 1 - 1e-9)
        if not len(open_):
            break
        own = sizes[open_]
        start = own / capacity
        value = start * np.exp(-RATE * covered[open_])
        best, pick = _table(own, value, capacity)
        # Scaled prices of all lengths are a solution of the dual program.
        bound = max(bound, float(value @ need[open_]) / best[capacity])
        forced = value + best[capacity - own]
        order = np.argsort(-forced, kind="stable")
        order = order[forced[order] >= (1 - slack) * best[capacity] - 1e-12]
        picks, lens = pick.tolist(), own.tolist()
        now, wants, have = value.tolist(), need[open_].tolist(), covered[open_].tolist()
        for first, k in enumerate(order.tolist()):
            got = {j: min(n, int(wants[j])) for j, n in _taken(picks, lens, capacity - lens[k], {k: 1}).items()}
            if first and sum(now[j] * n for j, n in got.items()) < (1 - slack) * best[capacity]:
                continue
            amount = max(1.0, step * min(wants[j] / n for j, n in got.items()))
            for j, n in got.items():
                have[j] += amount * n / wants[j]
                now[j] = lens[j] / capacity * math.exp(-RATE * have[j]) if have[j] < 1 - 1e-9 else 0.0
            key = tuple(lens[j] for j in sorted(got, reverse=True) for _ in range(got[j]))
            share[key] = share.get(key, 0.0) + amount
        covered[open_] = have
    return list(share.items()), float(covered.min()), bound


def best_fit(left: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (lengths, number of equal sequences)."""
    rooms: dict[int, list[list]] = {}
    order: list[int] = []

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append([lengths, n])

    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            k = bisect.bisect_left(order, length)
            if k == len(order):
                per = capacity // length
                if n >= per:
                    put(capacity - per * length, (length,) * per, n // per)
                    n %= per
                if n:
                    put(capacity - n * length, (length,) * n, 1)
                break
            room = order[k]
            lengths, have = rooms[room][-1]
            took = min(have, n)
            if took == have:
                rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(k)
            else:
                rooms[room][-1][1] = have - took
            put(room - length, (*lengths, length), took)
            n -= took
    return [(lengths, n) for groups in rooms.values() for lengths, n in groups]


def place(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Whole sequences from the program, (lengths, number of equal sequences), and the pieces it leaves.

    Shares are rounded by their running sum and cut to the pieces there are. The program is solved again for what is left until no
    configuration is placed.
    """
    left, out = dict(histogram), []
    while left:
        shares, _, _ = solve(left, capacity, rounds)
        carry, placed = 0.5, 0
        for lengths, share in sorted(shares, key=lambda x: -sum(x[0])):
            carry += share
            n, need = int(carry + 1e-9), Counter(lengths)
            carry -= n
            n = min(n, *(left.get(x, 0) // k for x, k in need.items()))
            # A sequence that is not nearly full would spend room that other pieces can use.
            if n > 0 and (sum(lengths) >= FULL * capacity or sum(lengths) + min(left) > capacity):
                out.append((lengths, n))
                placed += n
                for x, k in need.items():
                    left[x] -= n * k
                    if not left[x]:
                        del left[x]
        if not placed:
            break
    return out, left


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Whole sequences for every piece of the histogram: (lengths, number of equal sequences)."""
    left = {k: v for k, v in histogram.items() if v > 0}
    out = [((capacity,), left.pop(capacity))] if capacity in left else []
    placed, rest = place(left, capacity, rounds)
    return out + repaired(placed, rest, capacity)


def repaired(placed: list[tuple[tuple[int, ...], int]], rest: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The placed sequences and best-fit of the rest; where rounding left more sequences than the pieces' sum asks for, with as many of the
    least full placed sequences taken apart again as makes the whole fewest."""
    best = placed + best_fit(rest, capacity)
    least = -(-sum(sum(x) * n for x, n in best) // capacity)
    placed = sorted(placed, key=lambda x: sum(x[0]))
    k = 1
    while sum(n for _, n in best) > least and k < 2 * len(placed):
        back = Counter(rest)
        for lengths, n in placed[:k]:
            for x in lengths:
                back[x] += n
        tried = placed[k:] + best_fit(back, capacity)
        if sum(n for _, n in tried) < sum(n for _, n in best):
            best = tried
        k *= 2
    return best


class Places:
    """For each length, which rank takes which place. Its size follows the number of configurations, not of documents."""

    def __init__(self, planned: list[tuple[tuple[int, ...], int]]):
        rows: dict[int, list[tuple[int, int, int, list[int]]]] = {}
        first = 0
        for lengths, n in planned:
            at, offsets = 0, {}
            for x in lengths:
                offsets.setdefault(x, []).append(at)
                at += x
            for x, own in offsets.items():
                rows.setdefault(x, []).append((first, n, len(own), own))
            first += n
        self.sequences = first
        self.by_length = {x: (np.cumsum([0, *(n * per for _, n, per, _ in got)]), got) for x, got in rows.items()}

    def of(self, length: int, rank: int) -> tuple[int, int]:
        ends, got = self.by_length[length]
        k = int(np.searchsorted(ends, rank, "right")) - 1
        first, _, per, offsets = got[k]
        copy, slot = divmod(rank - int(ends[k]), per)
        return first + copy, offsets[slot]


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """A row per piece with its sequence and its place there: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is id 0 alone. Repeated rows are packed each; null ids stay null; other columns are not read. Texts never leave
    their task: pieces of a few numbers are written, counted by length, ranked within (length, salt) and placed. The driver gets one
    number for each of at most 2048 lengths times the salts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.save(pieces(docs, tokenizer, id_col, text_col, capacity, max(SALTS, partitions(spark))), "pieces")
    counts = sorted((r.length, r.salt, r.n) for r in cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect())
    histogram, base = {}, {}
    for length, salt, n in counts:
        base[length, salt] = histogram.get(length, 0)
        histogram[length] = base[length, salt] + n
    places = Places(plan(histogram, capacity, rounds))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("ids_crc32", "doc_id", "piece")) - 1

    def run(batch: pa.RecordBatch) -> dict:
        got = [places.of(n, base[n, s] + r) for n, s, r in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist())]
        return {f: batch.column(k) for k, f in enumerate(("doc_id", "piece", "start", "length", "ids_crc32"))} | {"sequence_id": [x[0] for x in got], "offset": [x[1] for x in got]}

    return map_arrow(cut.withColumn("rank", rank), run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
