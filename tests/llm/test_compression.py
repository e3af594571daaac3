import os
import re
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from plexum.llm import compression


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(hit)


@given(st.text(alphabet="ab \n\t#|é  𝄞\x0b\x1c", max_size=60))
def test_counts(text):
    assert compression.text_counts(text.encode()) == plain(text)


def test_verdicts(words):
    import random

    rng = random.Random(3)
    packer = compression.zstandard.ZstdCompressor(level=3)
    prose = " ".join(rng.choice(words) + rng.choice(words) for _ in range(4000)).encode()
    say = lambda data: compression.verdict(len(data), *compression.ratios(data, packer))
    for n in (0, 40, 200, 600, 1500, 3000, 20_000):
        assert say(prose[:n]) == "kept", n
    assert say(b"spam and eggs " * 300) == "repetitive"
    assert say(os.urandom(4000)) == "incompressible"


def test_operator(docs, no_docs, rows):
    out = compression.compression_rules(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for k, text, *_ in rows:
        r = by[k]
        if k is not None:
            counts = plain(text or "")
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
            assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
            assert not (r.base_failed and r.kept)
    assert compression.compression_rules(no_docs).count() == 0
