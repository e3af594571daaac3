import re
import string
import time

from plexum.llm import surrogates
from plexum.llm.surrogates import detect, replace, surrogate

KEY = b"k"
TEXT = 'Mr. John Smith (john.smith@mail.com, +1 (017) 555-7713) met Frau Müller. Smith paid with 4465 7583 8288 9437 from 97.51.17.173; token = "04dbebab91ab85687d33eeaaf9ac699e1188f962". JOHN.SMITH@MAIL.COM, 4465758382889437 4465758382889437. Госпожа Иванова.'


def test_kinds_and_formats():
    new, found = replace(TEXT, KEY, {})
    assert [k for k, _ in found] == ["given-m", "family", "email", "phone", "family", "family", "card", "ip", "secret", "email", "card", "card", "family"]
    assert not any(x in new for x in ("John", "Smith", "Müller", "smith@", "555-7713", "9437", "97.51", "04dbebab", "Иванова"))
    assert re.search(r"Mr\. [A-Z][a-z]+ [A-Z][a-z]+ \([a-z]+\.[a-z]+@[a-z]+\.com, \+1 \(\d{3}\) \d{3}-\d{4}\)", new)
    spaced, plain = re.search(r"with ((?:\d{4} ){3}\d{4}) from", new)[1], re.findall(r"\b\d{16}\b", new)
    assert plain[0] == plain[1] == spaced.replace(" ", "")
    mail = re.search(r"[a-z.]+@[a-z]+\.com", new)[0]
    assert mail.upper() in new
    assert re.search(r'"[0-9a-f]{40}"', new) and re.search(r"Госпожа [А-Я][а-я]+\.", new)
    family = surrogate("family", "smith", KEY).capitalize()
    assert new.count(family) == 2


def test_keyed_and_luhn():
    assert surrogate("card", "4539578763621486", KEY) != surrogate("card", "4539578763621486", b"other")
    assert surrogates._luhn("4539578763621486") == 0 == surrogates._luhn(surrogate("card", "4539578763621486", KEY))
    assert surrogate("given-f", "anna", KEY).endswith(("ina", "ella", "ia", "ana"))


def test_clean_text():
    text = "In 1999 there were 12,000 of them; version 1.2.3 cost 3.50, see 10-12 and page 555. The ratio was 12:30."
    assert detect(text) == [] and replace(text, KEY, {}) == (text, [])


def test_operator(spark, docs, no_docs):
    rows = [(1, TEXT, "a"), (1, TEXT, "a"), (2, None, None), (None, "mail me at joe@x.org", ""), (3, "", ""), (4, "nothing here " * 50_000, "")]
    out = surrogates.replace_private(spark.createDataFrame(rows, "doc_id long, text string, kinds string"), KEY).collect()
    by = sorted(out, key=lambda r: r.doc_id or 0)
    assert [(r.doc_id, r.n_entities) for r in by] == [(None, 1), (1, 13), (1, 13), (2, 0), (3, 0), (4, 0)]
    assert by[1].text == by[2].text and by[3].text is None and by[5].text == rows[5][1]
    assert surrogates.replace_private(no_docs, KEY).count() == 0


def test_collisions(spark, monkeypatch):
    """Two-digit numbers have few surrogates: all stay distinct, and both ways of sending redrawn entities agree."""
    rows = [(k, f"token: {k}{k}{k:05d}ab") for k in range(10, 60)]
    real = surrogates._drawn
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def run(**kw):
        return {r.doc_id: r.text for r in surrogates.replace_private(docs, KEY, **kw).collect()}

    a = run()
    assert run(max_sent=-1) == a and len(set(a.values())) == len(rows)
    scratch = surrogates.Scratch(spark, "test")
    people = spark.createDataFrame([(k, f"Mr. {a}{b}{c}o went.") for k, (a, b, c) in enumerate((a, b, c) for a in "BCDFGHKLMNPRST" for b in "aeiou" for c in "bcdfghklmnprstvwz")], "doc_id long, text string")
    odd = surrogates.redraws(people, KEY, scratch).collect()
    table = {(r.kind, r.canon): r.new for r in odd}
    names = [detect(r.text)[0][2:] for r in people.collect()]
    new = [table.get(x) or surrogate(*x, KEY) for x in names]
    assert len(set(new)) == len(set(names)) and not set(new) & {c for _, c in names}
    assert real is surrogates._drawn


def test_emitted_texts(spark):
    """Of every kind, each mention keeps its format and two entities never become one text."""
    kinds = {
        "ssn": (lambda k: f"{100 + k}-{10 + k % 90}-{1000 + 7 * k}", r"\d{3}-\d{2}-\d{4}"),
        "card": (lambda k: f"4465 7583 8288 {1000 + k}", r"4\d{3}(?: \d{4}){3}"),
        "phone": (lambda k: f"+1 (017) 555-{1000 + k}", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
        "iban": (lambda k: f"DE89 3704 0044 0532 {1000 + k} 00", r"DE\d\d(?: \d{4}){4} \d\d"),
        "ip": (lambda k: f"97.51.{k}.9", r"\d{1,3}(?:\.\d{1,3}){3}"),
        "email": (lambda k: f"a{k}@mail.com", r"[a-z]\d+@[a-z]+\.com"),
        "secret": (lambda k: f"AKIA{k:016d}", r"[A-Z]{4}\d{16}"),
        "family": (lambda k: f"Mr. Q{'aeiou'[k % 5]}{'bcdfghklmn'[k // 5 % 10]}{'aeiou'[k // 50 % 5]}x", r"Mr\. [A-Z][a-z]+"),
    }
    rows = [(f"{kind}", k, made(k)) for kind, (made, _) in kinds.items() for k in range(200)]
    out = surrogates.replace_private(spark.createDataFrame([(i, x[2]) for i, x in enumerate(rows)], "doc_id long, text string"), KEY).collect()
    for kind, (_, form) in kinds.items():
        new = [r.text for r in out if rows[r.doc_id][0] == kind]
        assert {r.kinds for r in out if rows[r.doc_id][0] == kind} == {kind}
        assert len(set(new)) == 200 and all(re.fullmatch(form, x) for x in new), kind
    assert replace("123-45-6789 and 123-45-6789", KEY, {("ssn", "123456789"): "456789012"})[0] == "456-78-9012 and 456-78-9012"


def test_short_addresses(spark):
    """More one-letter addresses than one-letter surrogates: all stay distinct, and none is an address of the corpus."""
    mails = [f"{a}@{b}.com" for a in string.ascii_lowercase for b in string.ascii_lowercase]
    out = surrogates.replace_private(spark.createDataFrame(list(enumerate(mails)), "doc_id long, text string"), KEY).collect()
    assert len({r.text for r in out}) == 676 and not {r.text for r in out} & set(mails)


def test_many_entities():
    """Time follows the number of entities."""
    took = []
    for n in (10_000, 100_000):
        text = " ".join(f"user{k}@mail{k % 97}.com Mr. {chr(65 + k % 26)}{'aeiou'[k % 5]}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}o" for k in range(n // 2))
        start = time.process_time()
        assert len(detect(text)) == n
        took.append(time.process_time() - start)
    assert took[1] < 30 * took[0] + 1


def test_against_pairs(spark, rows):
    """Over a whole corpus, held against every pair of mentions: one entity one surrogate, two entities two, no entity left, all else as it was."""
    texts = [(k, f"{TEXT} {r[1] or ''} Mail a{k % 5}@mail.org or call +1 (017) 555-{7000 + k % 9}. Mrs. Anna Q{'aeiou'[k % 5]}rt.") for k, r in enumerate(rows)]
    out = {r.doc_id: r.text for r in surrogates.replace_private(spark.createDataFrame(texts, "doc_id long, text string"), KEY).collect()}
    seen = {}
    for k, text in texts:
        at, rest = 0, out[k]
        found = detect(text)
        for (a, b, kind, canon), nxt in zip(found, [*found[1:], None]):
            plain = text[at:a]
            assert rest.startswith(plain)
            rest = rest[len(plain) :]
            between = text[b : nxt[0]] if nxt else text[b:]
            end = rest.index(between) if between else len(rest)
            new, rest, at = rest[:end], rest[end:], b
            form = re.sub(r"\W", "", new).lower() if kind in ("phone", "card") else new.lower()
            assert seen.setdefault((kind.partition("-")[0], canon), form) == form
            assert len(new) == b - a or kind.startswith("given") or kind in ("family", "ip", "email")
        assert rest == text[at:]
    by_space = {}
    for (space, canon), form in seen.items():
        assert by_space.setdefault((space, form), canon) == canon
        assert (space, form) not in seen
