import itertools
import math
import random

import numpy as np
import pytest

from plexum.operators import graphs, kernels, vectors, wl
from plexum.plans.experiment import structural_vector, wl_counts

KEYS = ["g"]


def population(spark, **named):
    g = spark.createDataFrame([(k, n) for k, (n, _) in named.items()], "g string, num_nodes int")
    e = spark.createDataFrame([(k, *x) for k, (_, es) in named.items() for x in es], "g string, u int, v int")
    return g, e


def sampled(seed, n=9, p=0.35):
    rng = random.Random(seed)
    return n, [(u, v) for u, v in itertools.combinations(range(n), 2) if rng.random() < p]


CYCLE = (6, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5)])
TRIANGLES = (6, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)])


def test_structure_of_controls(spark):
    g, e = population(spark, cycle=CYCLE, tri=TRIANGLES, empty=(3, []), one=(1, []))
    out = {r.g: [r[c] for c in graphs.STRUCTURAL] for r in graphs.structural_statistics(g, e, KEYS).collect()}
    assert out["cycle"] == pytest.approx([6, 6, 0.4, 2, 0, 0, 0, 0, 1])
    assert out["tri"] == pytest.approx([6, 6, 0.4, 2, 0, 1, 2, 1, 2])
    assert out["empty"] == [3, 0, 0, 0, 0, 0, 0, 0, 3] and out["one"] == [1, 0, 0, 0, 0, 0, 0, 0, 1]
    for k, (n, es) in {"cycle": CYCLE, "tri": TRIANGLES, "empty": (3, [])}.items():
        assert structural_vector(n, es) == pytest.approx(out[k])


def test_native_against_kernel(spark):
    named = {f"r{s}": sampled(s) for s in range(8)}
    g, e = population(spark, **named)
    out = {r.g: [r[c] for c in graphs.STRUCTURAL] for r in graphs.structural_statistics(g, e, KEYS).collect()}
    features = {}
    for r in wl.wl_features(g, e, KEYS, 3).collect():
        features.setdefault(r.g, {})[r.feature] = r.value
    for k, (n, es) in named.items():
        assert structural_vector(n, es) == pytest.approx(out[k])
        assert wl_counts(n, es, 3) == features[k]
    pairs = {k: set(itertools.combinations(range(n), 2)) for k, (n, _) in named.items()}
    near = {k: kernels.adjacency(n, es) for k, (n, es) in named.items()}
    collect = lambda df: {k: {(r.u, r.v) for r in rows} for k, rows in itertools.groupby(sorted(df.collect()), lambda r: r.g)}
    absent = collect(graphs.non_edges(g, e, KEYS))
    wedges, sides = collect(graphs.open_wedges(e, KEYS)), collect(graphs.triangle_edges(e, KEYS))
    for k, (n, es) in named.items():
        assert absent[k] == pairs[k] - set(es)
        assert wedges.get(k, set()) == {x for x in pairs[k] - set(es) if near[k][x[0]] & near[k][x[1]]}
        assert sides.get(k, set()) == {x for x in es if near[k][x[0]] & near[k][x[1]]}


def test_edges_as_sets(spark):
    _, e = population(spark, a=(4, [(0, 1), (1, 2)]))
    more = spark.createDataFrame([("a", 2, 1), ("a", 3, 0)], "g string, u int, v int")
    assert {(r.u, r.v) for r in graphs.add_edges(e, more, KEYS).collect()} == {(0, 1), (1, 2), (0, 3)}
    assert {(r.u, r.v) for r in graphs.remove_edges(e, more, KEYS).collect()} == {(0, 1)}
    assert graphs.has_edges(more, e, KEYS).count() == 1
    with pytest.raises(Exception, match="loop"):
        graphs.normalized(spark.createDataFrame([("a", 1, 1)], "g string, u int, v int"), KEYS).collect()


def test_edits(spark):
    g, a = population(spark, p=(4, [(0, 1), (1, 2), (2, 3)]), q=(2, [(0, 1)]))
    _, b = population(spark, p=(4, [(0, 1), (2, 3), (0, 3)]), q=(2, [(0, 1)]))
    ops = graphs.edit_ops(a, b, KEYS)
    assert {(r.op, r.u, r.v) for r in ops.collect()} == {("remove", 1, 2), ("add", 0, 3)}
    assert {r.g: (r.edit_distance_raw, r.edit_distance_weighted) for r in graphs.edit_distances(g, ops, KEYS).collect()} == {"p": (2, 2.0), "q": (0, 0.0)}
    n, es = 8, [*itertools.combinations(range(4), 2), *itertools.combinations(range(4, 8), 2), (3, 4)]
    node, edge = kernels.betweenness(n, es)
    assert max(edge, key=edge.get) == (3, 4) and edge[3, 4] == 16 and node[3] == 12
    g2, e2 = population(spark, bar=(n, es))
    ask = spark.createDataFrame([("bar", 3, 4), ("bar", 0, 1)], "g string, u int, v int")
    w = {(r.u, r.v): r.weight for r in graphs.product_weights(ask, kernels.node_betweenness(g2, e2, KEYS), KEYS).collect()}
    assert w == {(3, 4): 2.0, (0, 1): 1.0}


def test_spectra_and_spread():
    assert kernels.laplacian_spectrum(2, [(0, 1)]) == pytest.approx([0, 2])
    assert kernels.laplacian_spectrum(3, [(0, 1), (1, 2)]) == pytest.approx([0, 1, 2], abs=1e-9)
    assert kernels.laplacian_spectrum(5, [(0, 1), (2, 3)]) == pytest.approx([0, 0, 0, 2, 2], abs=1e-9)
    assert kernels.laplacian_spectrum(50, list(itertools.combinations(range(50), 2))) == pytest.approx([0] + [50 / 49] * 49, abs=1e-9)
    assert kernels.heat_trace(2, [(0, 1)], np.array([0.0, 1.0]), "none") == pytest.approx([2, 1 + math.exp(-2)])
    assert kernels.heat_trace(4, [], normalization="empty") == pytest.approx([1] * 250)
    assert kernels.spread(2, [(0, 1)]) == pytest.approx(2 / (1 + math.exp(-1)))
    assert kernels.spread(3, [(0, 1), (1, 2)]) == pytest.approx(2 / (1 + math.exp(-1) + math.exp(-2)) + 1 / (1 + 2 * math.exp(-1)))
    d = kernels.distances(3, [(0, 1)])
    assert d[0, 1] == 1 and math.isinf(d[0, 2])


def test_diversity():
    assert kernels.diversity_curve(3, [], [1, 2, 3]) == pytest.approx([1, 2, 3])
    n, es = 5, [(0, 1), (1, 2), (2, 3), (2, 4)]
    move = {0: 3, 1: 0, 2: 4, 3: 1, 4: 2}
    other = sorted(tuple(sorted((move[u], move[v]))) for u, v in es)
    a, b = (kernels.diversity_curve(n, x, range(1, 8)) for x in (es, other))
    assert a[0] == pytest.approx(1) and a[4] == pytest.approx(kernels.spread(n, es)) == pytest.approx(b[4])
    assert kernels.contract(3, [(0, 1), (1, 2)], (0, 1)) == (2, [(0, 1)])
    assert sorted(kernels.duplicate(2, [(0, 1)], 0)[1]) == [(0, 1), (0, 2), (1, 2)]


def test_communities_and_components():
    clique = lambda a: list(itertools.combinations(range(a, a + 6), 2))
    assert kernels.communities(12, clique(0) + clique(6) + [(5, 6)]) == [0] * 6 + [1] * 6
    assert kernels.communities(3, []) == [0, 1, 2]
    assert kernels.component_labels(5, [(0, 1), (2, 3)]) == [0, 0, 2, 2, 4]


@pytest.mark.parametrize("kind", ["edge_insertion", "edge_deletion", "triangle_insertion", "triangle_deletion", "community_weakening", "hub_modification"])
def test_perturbations(spark, kind):
    n, es = sampled(3, 14, 0.4)
    base, facts = kernels.perturb(n, es, kind, 0.0, 1)
    assert base == sorted(es) and facts["removed"] == 0
    last = -1
    for alpha in (0.2, 0.5, 1.0):
        new, facts = kernels.perturb(n, es, kind, alpha, 1)
        assert (new, facts) == kernels.perturb(n, list(reversed(es)), kind, alpha, 1)
        assert all(u < v < n for u, v in new) and len(new) == len(es) - facts["removed"] + facts["added"] and len(set(es) - set(new)) == facts["removed"]
        if kind in ("edge_insertion", "edge_deletion"):
            assert facts["added"] + facts["removed"] == min(math.floor(alpha * len(es)), n * (n - 1) // 2 - len(es) if kind == "edge_insertion" else len(es))
        if kind in ("community_weakening", "hub_modification"):
            assert facts["added"] <= facts["removed"]
        assert facts["removed"] + facts["added"] >= last
        last = facts["removed"] + facts["added"]
    g, e = population(spark, a=(n, es))
    native = {"edge_insertion": graphs.edge_insertion, "edge_deletion": graphs.edge_deletion, "triangle_insertion": graphs.triangle_insertion, "triangle_deletion": graphs.triangle_deletion}.get(kind)
    if native:
        want = kernels.perturb(n, es, kind, 0.5, 1)[1]
        assert native(g, e, KEYS, 0.5).count() == want["added"] + want["removed"]
    with pytest.raises(ValueError):
        kernels.perturb(n, es, kind, 1.5, 1)


def test_generators():
    for family, kw in (("erdos_renyi", {"p": 0.3}), ("stochastic_block_model", {"p": 0.8, "p_out": 0.05, "blocks": 3}), ("barabasi_albert", {"m": 2})):
        a, labels = kernels.generate(family, 20, 7, **kw)
        assert a == kernels.generate(family, 20, 7, **kw)[0] != kernels.generate(family, 20, 8, **kw)[0]
        assert all(0 <= u < v < 20 for u, v in a) and len(set(a)) == len(a)
        assert (labels is not None) == (family == "stochastic_block_model")
    assert len(kernels.generate("barabasi_albert", 20, 1, m=2)[0]) == 3 + 17 * 2
    assert kernels.block_sizes(10, 4) == [3, 3, 2, 2]
    seeds = {kernels.derive_seed(s, "p", g, k) for s in range(20) for g in range(50) for k in "abcdef"}
    assert len(seeds) == 6000 and kernels.canonical_json({"b": 1, "a": [1.5]}) == '{"a":[1.5],"b":1}'


def test_wl_names(spark):
    g, e = population(spark, path=(3, [(0, 1), (1, 2)]), edge=(3, [(0, 1)]))
    f = {}
    for r in wl.wl_features(g.filter("g = 'path'"), e.filter("g = 'path'"), KEYS, 1, ranked=True).collect():
        f[r.feature] = r.value
    assert f == {"h0:degree:1": 2, "h0:degree:2": 1, "h1:c1:0": 2, "h1:c1:1": 1}
    both = wl.wl_features(g, e, KEYS, 1)
    names = {k: {r.feature for r in both.filter(f"g = '{k}'").collect() if r.feature.startswith("h1:")} for k in ("path", "edge")}
    assert not names["path"] & names["edge"]
    lab = spark.createDataFrame([("path", 0, "C"), ("path", 1, "N")], "g string, node int, label string")
    with pytest.raises(Exception, match="no label"):
        wl.wl_features(g, e, KEYS, 1, labels=lab).collect()


def test_kernels_and_contributions(spark):
    xs, ys = [[0.0, 1.0], [1.0, 0.0], [2.0, 3.0]], [[3.0, 1.0], [1.0, 1.0], [2.0, 2.0]]
    x, y = (spark.createDataFrame([(i, v) for i, v in enumerate(d)], "id int, x array<double>") for d in (xs, ys))
    k = lambda a, b: np.exp(-((np.array(a)[:, None] - np.array(b)[None]) ** 2).sum(-1) / 8)
    want = k(xs, xs).mean() + k(ys, ys).mean() - 2 * k(xs, ys).mean()
    assert vectors.rbf_mmd(x, y, bandwidth=2.0).first().mmd == pytest.approx(want)
    assert vectors.rbf_mmd(x, x, bandwidth=2.0).first().mmd == pytest.approx(0, abs=1e-12)
    parts = [r.contribution for r in vectors.mmd_contributions(x, y, bandwidth=2.0).collect()]
    assert len(parts) == 3 and np.mean(parts) == pytest.approx(want)
    lin = [r.contribution for r in vectors.linear_contributions(x, y).collect()]
    assert np.mean(lin) == pytest.approx(((np.mean(xs, 0) - np.mean(ys, 0)) ** 2).sum())
    d = [np.linalg.norm(np.subtract(p, q)) for p, q in itertools.combinations(xs, 2)]
    assert vectors.median_bandwidth(x).first().bandwidth == pytest.approx(np.median(d))
    line = spark.createDataFrame([(i, [float(i), float(i)]) for i in range(3)], "id int, x array<double>")
    assert vectors.kernel_nearly_constant(line, bandwidth=1000.0).first().nearly_constant and not vectors.kernel_nearly_constant(line, bandwidth=0.1).first().nearly_constant
    short = spark.createDataFrame([(0, [1.0])], "id int, x array<double>")
    with pytest.raises(Exception, match="differ in length"):
        vectors.paired_distances(x, short).collect()


def test_blocks_do_not_change_kernels(spark, monkeypatch):
    rng = random.Random(0)
    rows = [("c", i, [rng.random(), rng.random()]) for i in range(40)]
    df = spark.createDataFrame(rows, "c string, id int, x array<double>")
    whole = vectors.rbf_mmd(df, df.limit(30), ["c"], 1.0).first()
    med = vectors.median_bandwidth(df, ["c"]).first().bandwidth
    monkeypatch.setattr(vectors, "BLOCK", 7)
    part = vectors.rbf_mmd(df, df.limit(30), ["c"], 1.0).first()
    assert part.mmd == pytest.approx(whole.mmd) and vectors.median_bandwidth(df, ["c"]).first().bandwidth == pytest.approx(med)


def test_sparse(spark):
    row = lambda d: spark.createDataFrame([("c", i, f, float(v)) for i, x in enumerate(d) for f, v in x.items()], "c string, id int, feature string, value double")
    x, y = row([{"a": 1}, {"b": 2}, {"a": 4, "b": 3}]), row([{"a": 2, "b": 1}, {"b": 5}, {"a": 1}])
    n = spark.createDataFrame([("c", 3)], "c string, n long")
    assert vectors.sparse_linear_mmd(x, y, n, n, ["c"]).first().mmd == pytest.approx((5 / 3 - 1) ** 2 + (5 / 3 - 2) ** 2)
    assert vectors.sparse_l2(x.filter("id = 0"), y.filter("id = 1"), ["c"]).first().distance == pytest.approx(math.sqrt(26))


def brute(xs):
    return [math.sqrt(((np.array(p) - np.array(q)) ** 2).sum()) for p, q in itertools.combinations(xs, 2)]


def cells(spark, **xs):
    return spark.createDataFrame([(c, i, [float(v) for v in x]) for c, rows in xs.items() for i, x in enumerate(rows)], "c string, id int, x array<double>")


def test_median_of_packs(spark, monkeypatch):
    """Copies, far offsets, close vectors, equal distances, a gap in the middle and what is no number: as from all pairs, of which none is a row."""
    rng = np.random.default_rng(3)
    normal = rng.normal(size=(60, 5))
    xs = {
        "normal": normal, "copies": np.concatenate([normal[:20], *[normal[:1]] * 30, normal[5:9]]), "offset": normal + 1e7, "close": 1 + 1e-9 * normal, "one": normal[:1], "same": np.ones((9, 3)),
        "corners": np.eye(12), "gap": [[0.0], [1.0], [100.0], [101.0]], "two": [[0.0], [0.5]], "zero": [[0.0, 0.0], [-0.0, 0.0], [3.0, 4.0]], "odd": [[0.0], [1.0], [3.0], [7.0], [15.0], [31.0], [math.nan], [math.inf]],
    }
    monkeypatch.setattr(vectors, "PACK", 16)
    monkeypatch.setattr(vectors, "_over_blocks", None)
    got = {r.c: r.bandwidth for r in vectors.median_bandwidth(cells(spark, **xs), ["c"]).collect()}
    assert got.keys() == xs.keys()
    for c, x in xs.items():
        d = sorted((v for v in brute(x) if not v <= 0), key=lambda v: (math.isnan(v), v))
        want = (d[(len(d) - 1) // 2] + d[len(d) // 2]) / 2 if d else 1.0
        assert got[c] == pytest.approx(want, rel=1e-12), c
    whole = vectors.median_bandwidth(cells(spark, a=normal)).first().bandwidth
    assert whole == pytest.approx(np.median(brute(normal)), rel=1e-12)
    assert vectors.median_bandwidth(cells(spark, a=normal[:1])).first().bandwidth == 1.0
    with pytest.raises(Exception, match="differ in length"):
        vectors.median_bandwidth(cells(spark, a=[[1.0], [1.0, 2.0]])).collect()


def test_nearly_constant_by_the_farthest(spark, monkeypatch):
    """Decided by bounds or by the vectors that are left, as from all pairs."""
    rng = np.random.default_rng(4)
    ball = rng.normal(size=(50, 4))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    # A triangle's corners are farther from its mean than half of a side: neither bound decides.
    limit = 10 * math.sqrt(-2 * math.log(0.99))
    triangle = np.array([[math.cos(a), math.sin(a)] for a in (0, 2 * math.pi / 3, 4 * math.pi / 3)]) / math.sqrt(3) * limit
    xs = {"inside": ball * 0.3 * limit, "between": ball * 0.45 * limit, "edge": ball * 0.53 * limit, "outside": ball * 3 * limit, "under": triangle * 0.999, "over": triangle * 1.001, "one": ball[:1], "copies": np.ones((7, 2)), "offset": ball * 0.45 * limit + 1e6, "nan": [[0.0], [math.nan]], "nans": [[0.0], [math.nan], [limit * 1.1]], "inf": [[0.0], [math.inf]]}
    monkeypatch.setattr(vectors, "PACK", 16)
    got = {r.c: r.nearly_constant for r in vectors.kernel_nearly_constant(cells(spark, **xs), ["c"]).collect()}
    for c, x in xs.items():
        k = [math.exp(-v * v / 200) for v in brute(x)]
        numbers = [v for v in k if not math.isnan(v)]
        assert got[c] == (bool(k) and (not numbers or min(numbers) >= 0.99)), c
    monkeypatch.setattr(vectors, "_farthest", None)
    assert vectors.kernel_nearly_constant(cells(spark, a=ball * 0.3 * limit)).first().nearly_constant
    with pytest.raises(Exception, match="differ in length"):
        vectors.kernel_nearly_constant(cells(spark, a=[[1.0], [1.0, 2.0]])).collect()


def test_gram_by_packs(spark, monkeypatch):
    """Common, rare and lone features, negative values and zeros, copies, text ids, several cells: as from a join, which no plan has."""
    rng = random.Random(5)
    vecs = {}
    for c, n in (("counts", 50), ("signed", 40), ("one", 1)):
        for i in range(n):
            x = {f"common{rng.randrange(3)}": rng.randrange(1, 4) for _ in range(2)} | {f"rare{rng.randrange(60)}": rng.randrange(1, 3) for _ in range(3)} | ({f"own{i}": 1} if i % 3 else {})
            vecs[c, f"v{i}"] = {f: float(v if c != "signed" else rng.choice([-1, 0, 0.5, v])) for f, v in x.items()}
    for i in range(6):
        vecs["counts", f"w{i}"] = dict(vecs["counts", "v3"])
    vecs["counts", "apart"] = {"lone": 2.0}
    df = spark.createDataFrame([(c, i, f, v) for (c, i), x in vecs.items() for f, v in x.items()], "c string, id string, feature string, value double")
    dot = lambda x, y: sum(v * y.get(f, 0.0) for f, v in x.items())
    pairs = [(c, *sorted((i, j))) for (c, i), (d, j) in itertools.combinations_with_replacement(vecs, 2) if c == d]
    monkeypatch.setattr(vectors, "PACK", 16)
    monkeypatch.setattr(vectors, "ROWS_PACK", 16)
    got = {(r.c, r.i, r.j): r.k for r in vectors.gram(df, ["c"]).collect()}
    want = {(c, i, j): dot(vecs[c, i], vecs[c, j]) for c, i, j in pairs if vecs[c, i].keys() & vecs[c, j].keys()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    found = vectors.gram_distances(df, ["c"])
    far = {c: sorted(max(dot(x, x) + dot(y, y) - 2 * dot(x, y), 0.0) for c2, i, j in pairs if c2 == c and i != j for x, y in [(vecs[c, i], vecs[c, j])]) for c in ("counts", "signed")}
    for c, d2 in far.items():
        rows = sorted((r.d2, r.n) for r in found.filter(f"c = '{c}'").collect())
        assert [v for v, n in rows for _ in range(n)] == pytest.approx(d2)
        r = vectors.rbf_from_distances(found.filter(f"c = '{c}'"), ["c"]).first()
        h = np.median([math.sqrt(v) for v in d2 if v > 0])
        assert (r.bandwidth, r.kernel) == (pytest.approx(h), pytest.approx(np.mean([math.exp(-v / (2 * h * h)) for v in d2])))
    assert found.filter("c = 'counts'").count() < 60
    assert vectors.rbf_from_distances(vectors.gram_distances(df.filter("c = 'counts'"))).first().bandwidth == pytest.approx(np.median([math.sqrt(v) for v in far["counts"] if v > 0]))


def test_gram_deals_no_copies(spark, monkeypatch):
    """Packs meet in a product of tables, not as copies in an exchange, and features of a graph come from a kernel as from joins."""
    graphs = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3)], "g string, num_nodes int")
    edges = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 0, 4), ("b", 2, 3), ("b", 0, 3)], "g string, u int, v int")
    found = wl.wl_features_by_graph(graphs, edges, ["g"], 2)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wl.wl_features(graphs, edges, ["g"], 2).collect()))
    monkeypatch.setattr(vectors, "ROWS_PACK", 1)
    out = vectors.gram(found, [], "g")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate explode" not in plan
    assert {(r.i, r.j) for r in out.collect()} >= {("a", "a"), ("a", "b"), ("b", "b"), ("c", "c")}
