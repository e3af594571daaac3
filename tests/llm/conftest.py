import random
import sys

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars int, h1 long, line_count string, rk string, n long, kept string"


@pytest.fixture(scope="session")
def words():
    return [a + b + c for a in ("ta", "mo", "re", "li", "su", "ka") for b in ("n", "lo", "ver", "s", "") for c in ("a", "ing", "o", "ed", "ul")]


@pytest.fixture(scope="session")
def rows(words):
    """Small documents: prose, copies, near copies, shared lines, nulls, empty texts, repeated rows, null ids."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = []
    for k in range(40):
        lines = [prose(rng.randint(5, 60)).capitalize() + "." for _ in range(rng.randint(1, 6))]
        if k % 3 == 0:
            lines.insert(0, "This line stands on every site.")
        texts.append("\n".join(lines))
    base = prose(300)
    texts += [base, base, base + " extra", " ".join(base.split()[:-20]), "x " + base, None, "", "   \n\t ", "one", "one", "Two words", "a b   c", "spam " * 500, "\n\n\n"]
    texts.append(" ".join(base.split()[40:140]) + " " + prose(50))
    out = [(k, t, "en", f"site{k % 12}", len(t or ""), k, "x", "y", 1, "z") for k, t in enumerate(texts)]
    out.append(out[3])
    out.append(out[40])
    out.append((None, base, None, None, 3, 0, "x", "y", 1, "z"))
    out.append((None, None, None, "site1", None, None, None, None, None, None))
    out.append((500, "This line stands on every site.", "en", None, 31, 0, "", "", 0, ""))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def pytest_configure(config):
    sys.setrecursionlimit(10_000)
