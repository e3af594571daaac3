import re

from plexum.llm import lines


def brute(rows, least):
    sites = {}
    for _, text, _, site, *_ in rows:
        for x in (text or "").split("\n"):
            if site is not None:
                sites.setdefault(x, set()).add(site)
    bad = {x for x, s in sites.items() if len(s) >= least and re.search(r"[^\x20\x09-\x0D]", x)}
    out = []
    for k, text, *_ in rows:
        parts = None if text is None else text.split("\n")
        real = [x for x in parts or [] if re.search(r"[^\x20\x09-\x0D]", x)]
        out.append((k, len(real), sum(x in bad for x in real), None if parts is None else "\n".join(x for x in parts if x not in bad)))
    return sorted(out, key=str)


def test_operator(docs, no_docs, rows):
    for least in (2, 8, 30):
        got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in lines.line_report(docs, min_sites=least).collect()), key=str)
        assert got == brute(rows, least)
    assert lines.line_report(no_docs).count() == 0


def test_both_ways_and_columns(docs, rows):
    found = lines.boilerplate(docs, min_sites=8)
    a, b = lines.remove_lines(docs, found), lines.remove_lines(docs, found, max_sent=0)
    assert a.columns == b.columns == [c for c in docs.columns if c != "line_count"] + ["line_count", "lines_removed"]
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == len(rows)


def test_many_sites(spark):
    """Sketches alone decide far from the threshold, and exact counts near it; few registers and a large threshold."""
    rows = [(k, f"common\nline {k % 7}\nclose" if k < 100 else f"common\nline {k % 7}", f"s{k}") for k in range(400)] + [(1000 + k, "one site", "s1") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = lines.boilerplate(docs, min_sites=100, registers=64)
    gone = {x for r in lines.remove_lines(docs, found).filter("doc_id < 7").collect() for x in rows[r.doc_id][1].split("\n") if x not in r.text.split("\n")}
    assert gone == {"common", "close"}
    sketch = {r.n: r.sites for r in lines.site_sketches(docs, registers=256).collect()}
    assert abs(sketch[400] - 400) < 100 and sketch[300] < 1.1
