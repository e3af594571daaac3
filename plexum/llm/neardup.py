"""Near-duplicate documents by bottom-k sketches of one hash function.

Each document keeps the k least hashes of its shingles. Equal sets are one class. Inverted lists of the retained values give classes that
overlap: a pair at the threshold shares `_overlap` values of its sketches (surely for sets of under k shingles, but for a chance of under
1e-9 for larger ones), so each class is listed under its rarest values only, as many as make sure that such a pair meets. Values that
most documents retain are so left out without a cap. In each list all classes are held against the first; those that are
then still in different components are held against each other, in pairs or, where a list is long, in blocks. The estimate from the sketch of
the union drops most pairs, and the full sets confirm the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexum.llm.common import Scratch, as_bytes, map_arrow
from plexum.llm.components import components

#: Retained values, and of a full sketch how many a pair at the threshold shares but for a chance of under 1e-9.
K = 64
FULL_OVERLAP = 28
#: Lists up to this length give pairs; longer ones are compared in blocks.
SHORT = 16
#: Classes of one block, about.
BLOCK = 256
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


class _Words(dict):
    """64-bit hashes of words, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(data: bytes, width: int, cache: _Words | None = None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; the whole sequence is one if it is shorter."""
    words = data.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    cache = _Words() if cache is None else cache
    if len(cache) > 100_000:
        cache.clear()
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    x = np.full(n, min(width, len(h)), np.uint64)
    for i in range(min(width, len(h))):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i])
    return np.unique(x)


def sketches(docs: DataFrame, width: int, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (set size), s1 and s2 (a 128-bit hash of the set), sketch (its k least hashes)."""

    def run(batch: pa.RecordBatch) -> dict:
        cache, rows = _Words(), []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = shingles(as_bytes(text), width, cache)
            a, b = np.frombuffer(xxhash.xxh128_digest(x.tobytes()), np.int64)
            rows.append((key, len(x), a, b, x[:k].view(np.int64)))
        return dict(zip(("doc_id", "n", "s1", "s2", "sketch"), zip(*rows)))

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), run, "doc_id long, n long, s1 long, s2 long, sketch array<long>")


def _overlap(n: Column, k: int, full: int, num: int, den: int) -> Column:
    """Sketch values that a partner at the threshold shares at least."""
    exact = F.ceil(n * num / den).cast("long")
    return F.when(n * den <= k * num, exact).otherwise(F.least(F.lit(full).cast("long"), exact))


def inverted_lists(heads: DataFrame, k: int, full: int, num: int, den: int) -> DataFrame:
    """(v, doc_id, n): the rarest retained values of each class that another class has too."""
    values = heads.select("doc_id", "n", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    # A sketch counts as one value in Spark's estimate of the size, so the values are not to be broadcast.
    own = values.hint("merge").join(shared, "v").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("own"))
    held = F.least(F.col("n"), F.lit(k))
    room = held - _overlap(F.col("n"), k, full, num, den) + 1 - (held - F.size("own"))
    return own.withColumn("room", room.cast("int")).filter(F.col("room") > 0).select("doc_id", "n", F.explode(F.slice("own", F.lit(1), F.col("room"))).alias("o")).select("o.v", "doc_id", "n")


def _band(n: Column, num: int, den: int) -> Column:
    """Sizes within the threshold of each other are in one band or in two that follow each other."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(den / num)) - 1e-9).cast("int")


def _sized(num: int, den: int) -> Column:
    return (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)


def verify(pairs: DataFrame, docs: DataFrame, heads: DataFrame, width: int, k: int, full: int, num: int, den: int, scratch: Scratch, tag: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, as u and v. First the union's sketch drops those it excludes."""
    # The upper halves of the values estimate as well, and what they take for equal in two sets is only confirmed once more. Where they take
    # two values of one set for equal, they count too few shared ones, so that the pair is confirmed whatever they say.
    upper = F.transform("sketch", lambda x: F.shiftright(x, 32).cast("int"))
    one = heads.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), upper.alias("sa"))
    two = heads.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), upper.alias("sb"))
    drawn = pairs.join(two, "b").join(one, "a")

    def estimate(batch: pa.RecordBatch) -> dict | None:
        names = batch.schema.names
        a, b, na, nb, sa, sb = (batch.column(names.index(x)) for x in ("a", "b", "na", "nb", "sa", "sb"))
        keep = []
        for i in range(batch.num_rows):
            x, y = (np.unique(s[i].values.to_numpy().view(np.uint32)) for s in (sa, sb))
            if len(x) < len(sa[i].values) or len(y) < len(sb[i].values):
                keep.append(True)
                continue
            union = np.union1d(x, y)
            whole = na[i].as_py() <= k and nb[i].as_py() <= k
            shared = np.intersect1d(x, y, assume_unique=True)
            if whole:
                ok = len(shared) * den >= len(union) * num
            else:
                ok = int((shared <= union[min(k, len(union)) - 1]).sum()) >= full
            keep.append(ok)
        mask = pa.array(keep)
        return {"a": a.filter(mask), "b": b.filter(mask)} if any(keep) else None

    close = scratch.save(map_arrow(drawn, estimate, "a long, b long"), f"{tag}-close")
    used = close.select(F.col("a").alias("doc_id")).unionByName(close.select(F.col("b").alias("doc_id"))).distinct()
    texts = scratch.save(docs.join(used, "doc_id", "left_semi"), f"{tag}-texts")
    both = close.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")

    def confirm(batch: pa.RecordBatch) -> dict | None:
        names = batch.schema.names
        cache, last, rows, x = _Words(), None, [], None
        for a, b, ta, tb in zip(*(batch.column(names.index(c)).to_pylist() for c in ("a", "b", "ta", "tb"))):
            if last is None or a != last[0] or ta is not last[1] and ta != last[1]:
                last, x = (a, ta), shingles(as_bytes(ta), width, cache)
            y = shingles(as_bytes(tb), width, cache)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if shared * den >= (len(x) + len(y) - shared) * num:
                rows.append((a, b))
        return dict(zip("uv", zip(*rows))) if rows else None

    links = scratch.save(map_arrow(both, confirm, "u long, v long"), f"{tag}-links")
    scratch.drop(f"{tag}-close", f"{tag}-texts")
    return links


def rivals(placed: DataFrame, docs: DataFrame, heads: DataFrame, width: int, k: int, full: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that connect, as links do, classes that were held against the same first class and are still in different components.

    placed: a (the first class), doc_id, n, root. Two classes of one list have its first class in common, so the groups by first class
    hold all pairs of all lists. A group is dealt
    into blocks of about BLOCK classes of like size, and each pair of blocks is one small task. The task gets sketches first and keeps the
    classes that the union's sketch leaves a partner; only their texts follow, and the full sets give a forest: no pair that
    fails is ever a row, and of those that hold no more than there are classes.
    """
    groups = placed.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter(F.col("lo") < F.col("hi"))
    band = _band(F.col("n"), num, den)
    dealt = placed.join(groups.select("a", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts")), "a").select("a", "doc_id", "root", "parts", band.alias("band"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))
    dealt = scratch.save(dealt, "dealt")
    # A block meets itself, its band's later blocks, and all blocks of the next band; (x, y) and (y, x) are one task.
    own, step = F.struct(F.col("band").alias("g"), F.col("part").alias("p")), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step")
    keys = dealt.select("a", "doc_id", "root", "band", "part", "parts", step).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    other = F.struct((F.col("band") + F.col("step")).alias("g"), F.col("q").alias("p"))
    keys = keys.select("a", "doc_id", "root", F.least(own, other).alias("x"), F.greatest(own, other).alias("y"), (own <= other).alias("is_x"), (own >= other).alias("is_y"))
    task = ["a", "xg", "xp", "yg", "yp"]
    keys = keys.select("a", "doc_id", "root", "is_x", "is_y", F.col("x.g").alias("xg"), F.col("x.p").alias("xp"), F.col("y.g").alias("yg"), F.col("y.p").alias("yp"))
    # Tasks of one component, and those of a block and an empty one, are left out before any sketch moves.
    live = keys.groupBy(*task).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("is_x").alias("x"), F.max("is_y").alias("y"))
    live = live.filter((F.col("lo") < F.col("hi")) & F.col("x") & F.col("y")).select(*task)
    # Keys grow with the square of a long list, but Spark takes them for as small as the file they come from, and would gather them on the driver
    # to broadcast them.
    drawn = keys.drop("is_x", "is_y").hint("merge").join(live, task).hint("merge").join(heads.select("doc_id", "n", "sketch"), "doc_id")

    def estimate(pdf):
        return pdf.loc[_with_partner(pdf, k, full, num, den), [*task, "doc_id", "root"]]

    near = scratch.save(drawn.groupBy(*task).applyInPandas(estimate, "a long, xg int, xp int, yg int, yp int, doc_id long, root long").distinct(), "near")
    texts = docs.join(near.select("doc_id").distinct(), "doc_id", "left_semi").distinct()

    def compare(pdf):
        return _block_links(pdf, width, num, den)

    return near.hint("merge").join(texts, "doc_id").groupBy(*task).applyInPandas(compare, "u long, v long").distinct()


def _shared(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many values each two of the sets share, from products of the shared values' incidence matrix."""
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    number = np.full(len(values), -1)
    number[count > 1] = np.arange(int((count > 1).sum()))
    at = number[at]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        a, b = np.searchsorted(at, [low, low + columns])
        matrix = np.zeros((len(sets), columns), np.float32)
        matrix[owner[a:b], at[a:b] - low] = 1
        shared += matrix @ matrix.T
    return np.rint(shared).astype(np.int64)


def _with_partner(pdf, k: int, full: int, num: int, den: int) -> np.ndarray:
    """Which rows of a block have a row of another root that the sketch of their union does not exclude; `verify` draws the same line.

    Sets that their sketches hold whole are compared exactly. Of others, a pair must share `full` values among the union's k least.
    """
    ids, roots, n = (pdf[c].to_numpy() for c in ("doc_id", "root", "n"))
    own = [np.sort(np.asarray(x).astype(np.int64, copy=False).view(np.uint64)) for x in pdf["sketch"]]
    shared = _shared(own)
    one, two = n[:, None], n[None, :]
    open_ = (roots[:, None] != roots[None, :]) & (ids[:, None] != ids[None, :]) & (one * den >= two * num) & (two * den >= one * num)
    whole = (one <= k) & (two <= k)
    keep = (open_ & whole & (shared * den >= (one + two - shared) * num)).any(axis=1)
    # A pair shares no more values among the union's least than in all.
    open_ &= ~whole & (shared >= full)
    padded = np.full((len(own), k), np.iinfo(np.uint64).max, np.uint64)
    for i, x in enumerate(own):
        padded[i, : len(x)] = x[:k]
    for i in np.flatnonzero(open_.any(axis=1)):
        if not keep[i]:
            x, rows = own[i][:k], np.flatnonzero(open_[i])
            theirs = padded[rows][:, None, :]
            same = (theirs == x[None, :, None]).any(axis=2)
            # The rank in the union of each value of x: those before it on either side, shared ones once.
            rank = np.arange(len(x)) + (theirs < x[None, :, None]).sum(axis=2) - (np.cumsum(same, axis=1) - same)
            passed = rows[(same & (rank < k)).sum(axis=1) >= full]
            keep[passed] = True
            keep[i] = len(passed) > 0
    return keep


def _block_links(pdf, width: int, num: int, den: int):
    """Stars that connect what the links between rows of a block whose roots differ connect."""
    import pandas as pd

    cache = _Words()
    ids, roots = pdf["doc_id"].to_numpy(), pdf["root"].to_numpy()
    sets = [shingles(as_bytes(x), width, cache) for x in pdf["text"]]
    sizes, shared = np.array([len(x) for x in sets]), _shared(sets)
    hit = (shared * den >= (sizes[:, None] + sizes[None, :] - shared) * num) & (shared > 0) & (roots[:, None] != roots[None, :]) & (ids[:, None] < ids[None, :])
    # Only who is reached from whom counts: a star for each component of the block, not all of its links.
    hit |= hit.T
    least = np.arange(len(ids))
    while True:
        new = np.minimum(least, np.where(hit, least[None, :], len(ids)).min(axis=1, initial=len(ids)))
        new = new[new]
        if (new == least).all():
            break
        least = new
    i = np.flatnonzero(least != np.arange(len(ids)))
    return pd.DataFrame({"u": ids[least[i]], "v": ids[i]})


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, k: int = K, full: int = FULL_OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable over links), kept (doc_id = component_id).

    Documents are linked when their shingle sets' Jaccard similarity is num/den or more. A null, empty or wordless text has no shingles
    and no links. A row without an id is linked with nothing, its component is null and it is kept. Rows of one id are one node. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    base = scratch.save(sketches(docs, width, k), "sketches")
    sets = base.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # Written first, so that the next join has plain exchanges, which Spark can split for a text with very many copies.
    classes = scratch.save(sets.groupBy("s1", "s2").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("size")), "classes")
    member = sets.select("doc_id", "s1", "s2").join(classes.filter(F.col("size") > 1), ["s1", "s2"]).filter(F.col("doc_id") != F.col("head")).select("doc_id", F.col("head").alias("to"))
    member = scratch.save(member.distinct(), "members")
    heads = sets.join(classes.select(F.col("head").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"], "left_semi").select("doc_id", "n", "sketch").dropDuplicates(["doc_id", "n"])
    heads = scratch.save(heads, "heads")
    lists = scratch.save(inverted_lists(heads, k, full, num, den), "lists")

    # Sets at the threshold are of like size: a list is dealt by size, each class into its own band and the next.
    band = _band(F.col("n"), num, den)
    lists = lists.select("v", "doc_id", "n", F.explode(F.array(band, band + 1)).alias("g"))
    first = lists.groupBy("v", "g").agg(F.min(F.struct("doc_id", "n")).alias("f"), F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1).select("v", "g", "c", F.col("f.doc_id").alias("a"), F.col("f.n").alias("na"))
    # The file of a large group's lists is small, as each repeats the same ids; its rows are not, so they are not to be broadcast.
    others = scratch.save(lists.select("v", "g", F.col("doc_id").alias("b"), F.col("n").alias("nb")).hint("merge").join(first, ["v", "g"]).filter(F.col("a") != F.col("b")), "others")
    scratch.drop("lists")
    star = others.filter(_sized(num, den)).select("a", "b").distinct()
    links = verify(star, docs, heads, width, k, full, num, den, scratch, "star")
    roots = scratch.save(components(links, scratch, "first"), "roots")

    # Of lists of three and more, the classes that are still apart: pairs where a list is short, blocks where it is long.
    apart = others.filter(F.col("c") > 2).join(roots.withColumnRenamed("node", "b"), "b", "left").select("v", "g", "c", "a", "b", "nb", F.coalesce("root", "b").alias("root"))
    short = apart.filter(F.col("c") <= SHORT)
    left = short.select("v", "g", F.col("b").alias("a"), F.col("nb").alias("na"), F.col("root").alias("ra"))
    right = short.select("v", "g", "b", "nb", F.col("root").alias("rb"))
    pairs = left.join(right, ["v", "g"]).filter((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _sized(num, den)).select("a", "b").distinct()
    more = verify(pairs, docs, heads, width, k, full, num, den, scratch, "short")
    long = scratch.save(rivals(apart.filter(F.col("c") > SHORT).select("a", F.col("b").alias("doc_id"), F.col("nb").alias("n"), "root").distinct(), docs, heads, width, k, full, num, den, scratch), "long")
    more = more.unionByName(long)
    edges = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more).unionByName(member.select(F.col("doc_id").alias("u"), F.col("to").alias("v")))
    final = scratch.save(components(edges, scratch, "last").filter(F.col("node") != F.col("root")), "final")
    out = base.select("doc_id", F.col("n").alias("n_shingles")).join(final, base["doc_id"] == final["node"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all columns, without the documents whose component has a lesser id; rows without an id stay."""
    gone = near_duplicates(docs, width, num, den, id_col=id_col, text_col=text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
