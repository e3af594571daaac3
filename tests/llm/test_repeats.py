import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from plexum.llm import repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        kept = bytes(x for x, g in zip(b, gone[1:-1]) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def made(rng, words):
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(rng.randint(8, 70)) for _ in range(5)]
    texts = []
    for k in range(60):
        parts = [prose(rng.randint(1, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [p[a : a + rng.randint(150, 400)], prose(rng.randint(1, 30))]
        texts.append(" é".join(parts))
    return texts + ["spam " * 200, "ab" * 500, "x" * 700, passages[0] * 3, texts[0], None, "", "short", texts[1][:230]]


@pytest.mark.parametrize("length,gram,step,chunk", [(200, 32, 21, 1 << 20), (200, 32, 21, 300), (50, 8, 5, 1 << 20)])
def test_against_brute_force(spark, words, monkeypatch, length, gram, step, chunk):
    """Shared passages cut anywhere, periodic texts, copies; chunks under the texts' length too."""
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    texts = made(random.Random(length + chunk), words)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    source = docs if chunk > 1000 else spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    if chunk < 1000:  # the tasks' own processes read the module afresh
        parts = [x for _, b, p in repeats._chunks(list(range(len(texts))), texts, length) for x in p]
        assert len(parts) > len(texts)
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(source, length, gram, step).collect()}
    assert [out[k] for k in range(len(texts))] == brute(texts, length)


def test_odd_rows(docs, no_docs, rows):
    out = repeats.remove_repeats(docs).collect()
    want = brute([r[1] for r in rows], 200)
    key = lambda x: str(x)
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out], key=key) == sorted([(r[0], *w) for r, w in zip(rows, want)], key=key)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)
    assert repeats.remove_repeats(no_docs).count() == 0


def test_chunked_spans_cover_all_windows(monkeypatch):
    text = "".join(random.Random(4).choice("abc ") for _ in range(5000))
    for chunk in (1 << 20, 700):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        starts = []
        for _, begin, parts in repeats._chunks([1], [text], 200):
            _, p, lo, hi, _ = repeats.spans(parts, 200, 32, 128)
            ends = np.cumsum([len(x) for x in parts])
            row = np.searchsorted(ends, lo, "right")
            shift = np.array(begin)[row] - (ends - [len(x) for x in parts])[row]
            starts += [s for a, b in zip(lo + shift, hi + shift) for s in range(a, b + 1)]
        assert sorted(starts) == list(range(4801))


def test_ranks_by_doubling():
    """Equal strings have equal ranks and others not, at every length, alone and as pairs."""
    rng = random.Random(2)
    data = bytes(rng.choice(b"ab") for _ in range(600))
    named = repeats.ranks(np.frombuffer(data, np.uint8), 64)
    assert sorted(named) == [1, 2, 4, 8, 16, 32, 64]
    for m, r in named.items():
        assert len(r) == len(data) - m + 1 and len(set(r.tolist())) == len({data[i : i + m] for i in range(len(r))})
    assert repeats.top_of(200, 21) == 128 and repeats._levels(32, 200) == [64, 128]
    with pytest.raises(ValueError):
        repeats.top_of(200, 120)


def test_many_equal_rows(spark):
    """Rows that are equal in id and text cost time in proportion to their number."""
    text = " ".join(f"word{k}" for k in range(110))
    docs = spark.createDataFrame([(1, text)] * 10_000 + [(2, "only " + text[:400])], "doc_id long, text string")
    start = time.time()
    got = repeats.remove_repeats(docs).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert {tuple(r) for r in got} == {(1, len(text), len(text), 1, 10_000), (2, 405, 400, 1, 1)}
    assert time.time() - start < 90
