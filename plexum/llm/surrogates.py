"""Personal data: each detected entity gets a keyed surrogate of its own type.

A surrogate is drawn letter by letter from HMAC-SHA256 of the key, the kind, the canonical entity and an attempt number. Digits give digits,
letters give letters of the same script and case, separators stay; card numbers keep their first digit and a valid check digit; given
names end as names of their gender do. One canonical entity has one surrogate everywhere, whatever the mention's format, so coreference holds
within and across documents. Distinctness is checked over the whole corpus: of entities with one surrogate all but the first draw
again, and so do surrogates that are themselves an entity of the corpus.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plexum.llm.common import Scratch, sliced

#: Redrawn entities that are sent to every task at most; more are joined by document.
MAX_SENT = 200_000
#: Titles, and given names that mark a person with a capitalised word after them; f, m.
TITLES = {
    "f": ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Mme", "Mme.", "Mlle", "Madame", "Señora", "Señorita", "Sra.", "Srta.", "Госпожа", "Κυρία"),
    "m": ("Mr.", "Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr.", "Господин", "Κύριος"),
    "": ("Dr.", "Prof."),
}
GIVEN = {
    "f": "Mary Anna Anne Emma Julia Laura Sarah Elizabeth Jennifer Linda Susan Claire Sophie Camille Marie Carmen Lucía María Elena Petra Ursula Sabine Ольга Мария Елена Анна".split(),
    "m": "John James Robert Michael William David Richard Thomas Peter Hans Klaus Jürgen Stefan Pierre Jean Luc Antoine Carlos José Juan Miguel Pedro Иван Пётр Сергей Дмитрий".split(),
}
_GENDER = {name.lower(): g for g, names in GIVEN.items() for name in names}
_TITLE_GENDER = {t: g for g, titles in TITLES.items() for t in titles}

_CAPITAL = r"[A-ZÀ-ÖØ-ÞΑ-ΩЀ-Я][a-zß-öø-ÿά-ώа-џ]+(?:[-'’][A-ZÀ-ÖØ-ÞΑ-ΩЀ-Я][a-zß-öø-ÿά-ώа-џ]+)?"
_ALL_TITLES = sorted((t for titles in TITLES.values() for t in titles), key=len, reverse=True)
PERSON = re.compile(rf"(?<!\w)(?:(?P<title>{'|'.join(map(re.escape, _ALL_TITLES))})[ \u00a0](?P<names>{_CAPITAL}(?: {_CAPITAL}){{0,2}})|(?P<given>{'|'.join(sorted(map(re.escape, GIVEN['f'] + GIVEN['m']), key=len, reverse=True))}) (?P<family>{_CAPITAL}))(?!\w)")
EMAIL = re.compile(r"(?<![\w.%+-])[\w%+-][\w.%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
SECRET = re.compile(
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?P<block>.*?)-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd|auth)\b)[\"']?\s*[:=]\s*[\"']?(?P<value>[^\s\"',;]{8,})"
    r"|(?<![\w-])(?P<known>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abp]-[\w-]{10,}|sk-[\w-]{16,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![\w-])",
    re.S,
)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")
IP6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
CARD = re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])")
PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}(?:[ .-]?(?:\(\d{1,5}\)|\d{1,7})){1,5}|(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4})(?!\w|[.-]\d)")
_DIGIT = re.compile(r"\d")
WORD = re.compile(r"(?<!\w)(\w+)(?:[-'’](\w+))?(?!\w)")


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of entities, in order and without overlap; an earlier rule keeps what it has found."""
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))

    def take(a: int, b: int, kind: str, canon: str) -> None:
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\1" * (b - a)
            found.append((a, b, kind, canon))

    if "@" in text:
        for m in EMAIL.finditer(text):
            take(m.start(), m.end(), "email", m[0].lower())
    if _DIGIT.search(text) or "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            name = m.lastgroup
            take(m.start(name), m.end(name), "secret", m[name])
    if _DIGIT.search(text):
        for kind, rule in (("iban", IBAN), ("ip", IP), ("ip", IP6), ("ssn", SSN)):
            for m in rule.finditer(text):
                take(m.start(), m.end(), kind, m[0].replace("-" if kind == "ssn" else " ", "").lower())
        # One number after another, with a space between, is not one long number.
        for m in re.finditer(r"(?<![\w-])\d{13,19}(?![\w-])", text):
            take(m.start(), m.end(), "card", m[0])
        for m in CARD.finditer(text):
            take(m.start(), m.end(), "card", re.sub(r"\D", "", m[0]))
        for m in PHONE.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 8 <= len(digits) <= 15 and (m[0][0] in "+(" or len(digits) >= 9):
                take(m.start(), m.end(), "phone", digits)
    people: dict[str, str] = {}
    for m in PERSON.finditer(text):
        if m["title"]:
            words, gender = m["names"].split(" "), _TITLE_GENDER[m["title"]]
            at = m.start("names")
            for k, w in enumerate(words):
                given = len(words) > 1 and k < len(words) - 1
                people.setdefault(w, f"given-{gender or _GENDER.get(w.lower(), '')}" if given else "family")
                take(at, at + len(w), people[w], w.lower())
                at += len(w) + 1
        else:
            people.setdefault(m["given"], f"given-{_GENDER[m['given'].lower()]}")
            people.setdefault(m["family"], "family")
            take(m.start("given"), m.end("given"), people[m["given"]], m["given"].lower())
            take(m.start("family"), m.end("family"), people[m["family"]], m["family"].lower())
    if people:
        # Later mentions by one name only; of a double word the whole, or the parts that are names.
        for m in WORD.finditer(text):
            if m[0] in people:
                take(m.start(), m.end(), people[m[0]], m[0].lower())
            elif m.end(1) < m.end():
                for k in (1, 2):
                    if m[k] in people:
                        take(m.start(k), m.end(k), people[m[k]], m[k].lower())
    return sorted(found)


class _Stream:
    """Numbers drawn from HMAC-SHA256 blocks."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.n, self.left = key, "\x1f".join(parts).encode("utf-8", "replace"), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.n.to_bytes(4, "big") + self.seed, hashlib.sha256).digest()
            self.n += 1
        got, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return got % n


_ALPHABETS = {
    "LATIN": ("aeiou", "bcdfghklmnprstvwz"),
    "CYRILLIC": ("аеиоу", "бвгдзклмнпрст"),
    "GREEK": ("αειου", "βγδκλμνπρστ"),
}
_ENDINGS = {
    ("LATIN", "f"): ("ina", "ella", "ia", "ana"), ("LATIN", "m"): ("o", "us", "er", "an"), ("LATIN", ""): ("y", "is", "en"),
    ("CYRILLIC", "f"): ("ина", "ия", "ана"), ("CYRILLIC", "m"): ("ий", "ан", "ор"), ("CYRILLIC", ""): ("ей", "ен"),
    ("GREEK", "f"): ("ια", "ινα"), ("GREEK", "m"): ("ος", "ης"), ("GREEK", ""): ("ι", "ω"),
}


def script(text: str) -> str:
    """The script of the first letter that has one of the alphabets; Latin else."""
    for c in text:
        if c.isalpha():
            name = unicodedata.name(c, "").split(" ")[0]
            if name in _ALPHABETS:
                return name
    return "LATIN"


def _drawn(text: str, stream: _Stream) -> str:
    vowels, consonants = _ALPHABETS[script(text)]
    out = []
    for c in text:
        if c.isdecimal():
            out.append(str(stream.below(10)))
        elif c.isalpha():
            base = unicodedata.normalize("NFD", c)[0].lower()
            pool = vowels if base in vowels else consonants
            new = pool[stream.below(len(pool))]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10


def surrogate(kind: str, canon: str, key: bytes, attempt: int = 0) -> str:
    """The canonical surrogate of an entity."""
    stream = _Stream(key, kind, canon, str(attempt))
    if kind == "email":
        local, _, domain = canon.partition("@")
        host, _, top = domain.rpartition(".")
        # Short addresses have few surrogates of their length; redrawn ones grow, so that there are always enough.
        grown = "".join(p[stream.below(len(p))] for p in _ALPHABETS["LATIN"] * (attempt // 2))
        return f"{_drawn(local, stream)}{grown}@{_drawn(host, _Stream(key, 'domain', domain, str(attempt)))}.{top}"
    if kind == "ip" and ":" not in canon:
        return ".".join(str(1 + stream.below(254)) for _ in range(4))
    if kind == "ip":
        return re.sub(r"[0-9a-f]", lambda _: "0123456789abcdef"[stream.below(16)], canon)
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canon):
        letters = "0123456789abcdef" if canon == canon.lower() else "0123456789ABCDEF"
        return "".join(letters[stream.below(16)] for _ in canon)
    if kind == "card":
        out = canon[0] + _drawn(canon[1:-1], stream)
        return out + (str(-_luhn(out + "0") % 10) if not _luhn(canon) else str(stream.below(10)))
    if kind == "iban":
        return canon[:2] + _drawn(canon[2:], stream)
    if kind == "phone":
        head = 1 if len(canon) == 11 and canon[0] == "1" else 0
        return canon[:head] + _drawn(canon[head:], stream)
    if kind.startswith("given") or kind == "family":
        vowels, consonants = _ALPHABETS[script(canon)]
        stem = "".join(p[stream.below(len(p))] for p in (consonants, vowels) * (2 + attempt // 4) + ((consonants,)))
        ends = _ENDINGS[script(canon), kind.partition("-")[2]]
        return stem + (ends[stream.below(len(ends))] if kind != "family" else "".join(p[stream.below(len(p))] for p in (vowels, consonants)))
    return _drawn(canon, stream)


def dress(new: str, mention: str, kind: str) -> str:
    """The surrogate in the mention's format: its separators between digits, its case in names and addresses."""
    if kind in ("phone", "card", "ssn", "iban"):
        left = iter(new)
        return "".join((n.upper() if c.isupper() else n) if c.isalnum() and (n := next(left, None)) is not None else c for c in mention)
    if kind.startswith("given") or kind in ("family", "email", "ip"):
        if mention.isupper() and len(mention) > 1:
            return new.upper()
        if kind != "ip" and mention[:1].isupper():
            return new[:1].upper() + new[1:]
    return new


def replace(text: str, key: bytes, redrawn: dict[tuple[str, str], str]) -> tuple[str, list[tuple[str, str]]]:
    """The text with surrogates, and the entities in order."""
    found = detect(text)
    if not found:
        return text, []
    out, at = [], 0
    for a, b, kind, canon in found:
        out += [text[at:a], dress(redrawn.get((kind, canon)) or surrogate(kind, canon, key), text[a:b], kind)]
        at = b
    return "".join([*out, text[at:]]), [x[2:] for x in found]


def _entities(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A row per document and distinct entity: the columns of keep, kind, canon. docs: keep, text."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for *own, text in zip(*(batch.column(k).to_pylist() for k in range(len(keep) + 1))):
                rows += [(*own, kind, canon) for kind, canon in dict.fromkeys(x[2:] for x in detect(text or ""))]
            if rows:
                kinds = [*(batch.schema.field(k).type for k in range(len(keep))), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[*keep, "kind", "canon"])

    schema = StructType([docs.schema[c] for c in keep]).add("kind", "string").add("canon", "string")
    return docs.select(*keep, "text").mapInArrow(run, schema)


def _draw(entities: DataFrame, key: bytes) -> DataFrame:
    def run(batches):
        for batch in batches:
            kinds, canons, attempts = (batch.column(k).to_pylist() for k in range(3))
            new = [surrogate(k, c, key, a) for k, c, a in zip(kinds, canons, attempts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(new, pa.string())], names=["kind", "canon", "attempt", "new"])

    return entities.select("kind", "canon", "attempt").mapInArrow(run, "kind string, canon string, attempt int, new string")


def redraws(texts: DataFrame, key: bytes, scratch: Scratch, most_rounds: int = 100) -> DataFrame:
    """(kind, canon, new) of the entities whose first surrogate collided, with surrogates that do not.

    Kinds of given names are one name space, so that two names never become one whatever their gender.
    """
    now = scratch.save(_draw(_entities(texts, []).distinct().withColumn("attempt", F.lit(0)), key), "drawn-0")
    space = F.split("kind", "-")[0]
    for k in range(1, most_rounds + 1):
        rows = now.withColumn("space", space)
        first = rows.groupBy("space", "new").agg(F.min(F.struct("canon", "kind")).alias("first"), F.count(F.lit(1)).alias("n"))
        shared = rows.join(first.filter(F.col("n") > 1), ["space", "new"]).filter((F.col("canon") != F.col("first.canon")) | (F.col("kind") != F.col("first.kind"))).select("kind", "canon")
        real = rows.select("space", F.col("canon").alias("new")).distinct()
        taken = rows.join(real, ["space", "new"], "left_semi").select("kind", "canon")
        again = scratch.save(shared.unionByName(taken).distinct().withColumn("again", F.lit(1)), f"again-{k}")
        if again.isEmpty():
            scratch.drop(f"again-{k}")
            break
        moved = now.join(again, ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("again", F.lit(0))).cast("int").alias("attempt"))
        step = scratch.save(_draw(moved, key), f"drawn-{k}")
        scratch.drop(f"drawn-{k - 1}", f"again-{k}")
        now = step
    else:
        raise RuntimeError("surrogates did not become distinct")
    return now.filter(F.col("attempt") > 0).select("kind", "canon", "new")


def replace_private(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", max_sent: int = MAX_SENT) -> DataFrame:
    """One row per document: doc_id, text with surrogates, n_entities (mentions), n_distinct, kinds (sorted, comma between).

    A null text stays null and has no entities; repeated rows and null ids come back as they are; other columns are not read. Texts do
    not move: the entities of all documents are drawn and checked first, and of those only the redrawn ones go to the tasks, or, beyond
    `max_sent`, are joined to the documents that mention them. Whoever has the key can tell whether a surrogate is that of a given entity.
    """
    if not key:
        raise ValueError("a key is needed")
    scratch = Scratch(docs.sparkSession, "surrogates")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    odd = redraws(texts, key, scratch)
    schema = "doc_id long, text string, n_entities long, n_distinct long, kinds string"

    def rows_of(ids, contents, tables) -> pa.RecordBatch:
        out = []
        for doc_id, text, redrawn in zip(ids, contents, tables):
            new, found = (None, []) if text is None else replace(text, key, redrawn)
            out.append((doc_id, new, len(found), len(set(found)), ",".join(sorted({k.partition("-")[0] for k, _ in found}))))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "text", "n_entities", "n_distinct", "kinds"])

    sent = odd.limit(max_sent + 1).collect()
    if len(sent) <= max_sent:
        table = {(r.kind, r.canon): r.new for r in sent}

        def run(batches):
            for batch in sliced(batches):
                yield rows_of(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [table] * batch.num_rows)

        return texts.mapInArrow(run, schema)
    keyed = texts.select(F.xxhash64("doc_id", "text").alias("rk"), F.xxhash64(F.lit(1), "text", "doc_id").alias("rk2"), "doc_id", "text")
    lists = _entities(keyed, ["rk", "rk2"]).distinct().join(odd, ["kind", "canon"]).groupBy("rk", "rk2").agg(F.collect_list(F.struct("kind", "canon", "new")).alias("own"))

    def run_joined(batches):
        for batch in sliced(batches):
            yield rows_of(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [{(x["kind"], x["canon"]): x["new"] for x in own or ()} for own in batch.column(2).to_pylist()])

    return keyed.join(lists, ["rk", "rk2"], "left").select("doc_id", "text", "own").mapInArrow(run_joined, schema)
