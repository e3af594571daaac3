"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees grow leaf by leaf on the driver over a bounded sample of labelled rows (`max_rows`), each split found in histograms of at most 255
bins. The forest is flattened to arrays (feature, threshold, left, right, value) that all documents are sent through level by
level with numpy.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexum.llm.common import as_bytes, crc_mod, map_arrow, sliced
from plexum.llm.compression import text_counts

#: Labelled rows that a model is fitted on at most.
MAX_ROWS = 20_000
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "zstd_ratio", "digit_share", "upper_share", "punct_share",
    "space_share", "line_words", "pipe_share", "end_punct_share", "letter_entropy", "top_word_share", "long_word_share", "short_word_share", "multibyte_share",
    "lower_after_stop_share", "stop_word_share", "sentence_words", "word_len_sd",
)


def features(data: bytes, packer: zstandard.ZstdCompressor) -> list[float]:
    """The statistics named in FEATURES, of a whole UTF-8 text; zeros for an empty one."""
    n_bytes = len(data)
    if not n_bytes:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, chars, symbols, dup, repeat = text_counts(data)
    words = data.split()
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = _top(words)
    lines = max(1, int(seen[10]) + 1)
    share = seen / n_bytes
    used = share[share > 0]
    w = max(1, n)
    tails = sum(x in b".!?" for x in (word[-1] for word in words))
    return [
        np.log1p(n_bytes), np.log1p(n), chars / w, symbols / w, dup / lines, repeat / w, counts[1] / w, len(packer.compress(data)) / n_bytes,
        float(share[48:58].sum()), float(share[65:91].sum()), float(share[33:48].sum() + share[58:65].sum()), float(share[9:14].sum() + share[32]), n / lines, float(share[124]),
        tails / w, float(-(used * np.log2(used)).sum()), counts[0] / w, float((lengths > 12).sum()) / w, float((lengths <= 3).sum()) / w, float(share[128:].sum()),
        len(re.findall(rb"[.!?]\s+[a-z]", data)) / w, float((lengths == 2).sum()) / w, n / (1 + tails), float(lengths.std()) if n else 0.0,
    ]


def _top(words: list[bytes]) -> tuple[int, int]:
    """The most frequent word's count, and the number of distinct words."""
    count: dict[bytes, int] = {}
    get = count.get
    for x in words:
        count[x] = get(x, 0) + 1
    return max(count.values(), default=0), len(count)


@dataclass(frozen=True)
class Forest:
    """Trees laid end to end. A leaf is its own child, so `depth` steps bring every row to a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x))[:, None], np.full(len(x), self.base)
        if not len(x) or not len(self.roots):
            return total
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return total + self.value[at].sum(axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, rate: float = 0.1, leaves: int = 15, bins: int = 64, least: int = 10, l2: float = 1.0) -> Forest:
    """Boost logistic loss. No rows or one class: a constant forest."""
    mean = np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4)
    base = float(np.log(mean / (1 - mean)))
    empty = Forest(*(np.zeros(0, t) for t in (int, float, int, int, float, int)), 0, base)
    if len(y) < 2 * least or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    n_features, width = x.shape[1], bins
    flat = binned + np.arange(n_features) * width
    raw, nodes, roots, deepest = np.full(len(y), base), [], [], 1

    def histogram(rows, grad, hess):
        at = flat[rows].ravel()
        return [np.bincount(at, np.repeat(v[rows], n_features), n_features * width).reshape(n_features, width).cumsum(axis=1) for v in (grad, hess, np.ones_like(grad))]

    def best(rows, grad, hess):
        g, h, c = histogram(rows, grad, hess)
        tg, th, tc = g[:, -1:], h[:, -1:], c[:, -1:]
        gain = g**2 / (h + l2) + (tg - g) ** 2 / (th - h + l2) - tg**2 / (th + l2)
        gain[(c < least) | (tc - c < least)] = -np.inf
        j, k = np.unravel_index(np.argmax(gain), gain.shape)
        return float(gain[j, k]), int(j), int(k)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        root = len(nodes)
        roots.append(root)
        nodes.append([0, 0.0, root, root, 0.0])
        open_ = {root: (np.arange(len(y)), *best(np.arange(len(y)), grad, hess), 0)}
        for _ in range(leaves - 1):
            node = max(open_, key=lambda k: (open_[k][1], -k))
            rows, gain, j, k, level = open_[node]
            if gain <= 1e-9 or k >= len(edges[j]):
                break
            del open_[node]
            go = binned[rows, j] <= k
            kids = [len(nodes), len(nodes) + 1]
            nodes[node][:4] = [j, float(edges[j][k]), *kids]
            for kid, part in zip(kids, (rows[go], rows[~go])):
                nodes.append([0, 0.0, kid, kid, 0.0])
                open_[kid] = (part, *best(part, grad, hess), level + 1)
            deepest = max(deepest, level + 1)
        for node, (rows, *_rest) in open_.items():
            nodes[node][4] = float(-rate * grad[rows].sum() / (hess[rows].sum() + l2))
            raw[rows] += nodes[node][4]
    cols = list(zip(*nodes))
    return Forest(np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), np.array(cols[3]), np.array(cols[4]), np.array(roots), deepest, base)


def _featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        packer = zstandard.ZstdCompressor(level=3)
        return {"doc_id": batch.column(0), "f": [features(as_bytes(x), packer) for x in batch.column(1).to_pylist()]}

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), run, "doc_id long, f array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held: int = 0, max_rows: int = MAX_ROWS) -> Forest:
    """Fit on labelled rows outside the held-out fold, at most `max_rows` of them, taken in the order of a hash of the id.

    Rows without an id, a label or a match are left out; of several labels for an id the lowest counts.
    """
    marked = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("double").alias("y")).dropna().groupBy("doc_id").agg(F.min("y").alias("y"))
    marked = marked.filter(crc_mod(F.col("doc_id"), folds) != held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = _featured(texts.join(F.broadcast(marked), "doc_id", "left_semi"), "doc_id", "text").join(F.broadcast(marked), "doc_id").select("doc_id", "f", "y").collect()
    rows.sort(key=lambda r: (r.doc_id, r.f))
    return fit(np.array([r.f for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows]))


def score_documents(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, folds: int = 5, held: int = 0) -> DataFrame:
    """Score every whole text; null texts score as empty ones, repeated rows score alike, other columns are not read."""

    def run(batch: pa.RecordBatch) -> dict:
        packer = zstandard.ZstdCompressor(level=3)
        p = forest.predict(np.array([features(as_bytes(x), packer) for x in batch.column(2).to_pylist()]))
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": p, "predicted": (p >= threshold).astype(np.int32)}

    held_out = F.coalesce(crc_mod(docs[id_col], folds) == held, F.lit(False))
    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), held_out.alias("held_out"), docs[text_col].cast("string").alias("text")), run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, forest: Forest, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches):
            p = forest.predict(np.array([features(as_bytes(x), packer) for x in batch.column(at).to_pylist()]))
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
