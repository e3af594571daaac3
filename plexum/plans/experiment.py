"""The experiment as one plan: configurations and seeds -> originals -> perturbed pairs -> representations -> scores by cell.

Originals and their representations depend on dataset and seed only, so they are made once and joined to the pairs of every perturbation and strength.
"""

from __future__ import annotations

import functools
import hashlib
import json
import logging
import platform
import resource
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow
import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plexum import schema as S
from plexum.operators import kernels as K
from plexum.shipping import ship
from plexum.sources import artifacts, molecules
from plexum.sources import results as R

PROTOCOL, VERSION = "hash_streams_v1", "pairs_v1"


@dataclass(frozen=True)
class Dataset:
    name: str
    family: str
    graphs: int = 100
    nodes: int = 50
    p: float = 0.0
    p_out: float = 0.0
    blocks: int = 1
    m: int = 1
    #: Of family "molecules": the cache's folder and split, and the fingerprint it must have.
    root: str = ""
    split: str = ""
    fingerprint: str = ""

    def params(self) -> str:
        return K.canonical_json({k: v for k, v in asdict(self).items() if k not in ("name", "root") and (v or k not in ("split", "fingerprint"))})


@dataclass(frozen=True)
class Experiment:
    name: str
    datasets: tuple[Dataset, ...]
    perturbations: tuple[str, ...] = S.PERTURBATIONS
    alphas: tuple[float, ...] = S.ALPHAS
    seeds: tuple[int, ...] = tuple(range(5))
    workflows: tuple[str, ...] = S.WORKFLOWS
    options: dict = field(default_factory=lambda: {"bandwidth": 10.0, "wl_iterations": 3, "repetitions": 3, "normalization": "empty"})


def default_datasets(graphs: int = 100, nodes: int = 50) -> tuple[Dataset, ...]:
    # The three families' parameters.
    return (
        Dataset("erdos_renyi", "erdos_renyi", graphs, nodes, p=0.12),
        Dataset("stochastic_block_model", "stochastic_block_model", graphs, nodes, p=0.28, p_out=0.04, blocks=4),
        Dataset("barabasi_albert", "barabasi_albert", graphs, nodes, m=2),
    )


def debug_experiment() -> Experiment:
    return Experiment("debug", default_datasets(5, 8), alphas=(0.0, 0.5, 1.0), seeds=(0, 1))


def full_experiment() -> Experiment:
    return Experiment("full", default_datasets())


def replication_experiment() -> Experiment:
    return Experiment("replication", default_datasets(), seeds=tuple(range(24)))


def _pilot(name: str, family: str, perturbation: str) -> Experiment:
    return Experiment(name, tuple(d for d in default_datasets() if d.family == family), (perturbation,), seeds=(0, 1, 2))


def ba_pilot_experiment() -> Experiment:
    return _pilot("ba_pilot", "barabasi_albert", "triangle_insertion")


def er_pilot_experiment() -> Experiment:
    return _pilot("er_pilot", "erdos_renyi", "community_weakening")


EXPERIMENTS: dict[str, Callable[[], Experiment]] = {
    "debug": debug_experiment, "full": full_experiment, "replication": replication_experiment, "ba_pilot": ba_pilot_experiment, "er_pilot": er_pilot_experiment,
}
#: Molecule runs by name: split, graphs, strengths, seeds.
MOLECULE_RUNS = {"molecules_debug": ("val", 10, (0.0, 0.5, 1.0), 2), "molecules_pilot": ("val", 100, S.ALPHAS, 3), "molecules": ("train", 100, S.ALPHAS, 24)}


def molecule_run(name: str, root: str, fingerprint: str = "") -> Experiment:
    split, graphs, alphas, seeds = MOLECULE_RUNS[name]
    return replace(molecule_experiment(root, split, graphs, seeds=tuple(range(seeds)), fingerprint=fingerprint, alphas=alphas), name=name)


def seeds_from_count(n: int, base: int = 0) -> tuple[int, ...]:
    if n < 1:
        raise ValueError("a seed at least")
    return tuple(range(base, base + n))


def with_seed_range(config: Experiment, text: str | None) -> Experiment:
    """'A:B': the seeds at places A up to B, B excluded."""
    if not text:
        return config
    a, b = (int(x) for x in text.split(":"))
    if not 0 <= a < b <= len(config.seeds):
        raise ValueError(f"seed range {text} of {len(config.seeds)}")
    return replace(config, seeds=config.seeds[a:b])


def config_hash(config: Experiment) -> str:
    """Eight digits that change with anything that changes results, shards of seeds aside."""
    payload = {k: v for k, v in asdict(config).items() if k not in ("name", "seeds")}
    return hashlib.sha1(K.canonical_json(payload).encode()).hexdigest()[:8]


def code_files() -> dict[str, str]:
    """The checksum of each of the package's files that results depend on."""
    root = Path(__file__).resolve().parent.parent
    files = [*root.glob("*.py"), *(f for part in ("functions", "operators", "plans", "sources") for f in (root / part).glob("*.py"))]
    return {str(f.relative_to(root)): hashlib.sha256(f.read_bytes()).hexdigest() for f in sorted(files)}


@functools.cache
def _code_digest() -> str:
    return hashlib.sha256(K.canonical_json(code_files()).encode()).hexdigest()


def code_fingerprint(config: Experiment) -> str:
    """Changes with the code and with the configuration, so that neither's results are mixed."""
    return f"{_code_digest()[:12]}-{config_hash(config)}"


def git_commit() -> str | None:
    """The commit that the package's repository is at, read from its files; none without a repository."""
    git = Path(__file__).resolve().parent.parent.parent / ".git"
    try:
        head = (git / "HEAD").read_text().strip()
        return (git / head[5:]).read_text().strip() if head.startswith("ref: ") else head
    except OSError:
        return None


def run_id(config: Experiment, now: datetime | None = None) -> str:
    return f"{(now or datetime.now(timezone.utc)).strftime('%Y-%m-%dT%H%M')}_{config_hash(config)}"


def expected_rows(config: Experiment) -> int:
    return len(config.datasets) * len(config.perturbations) * len(config.alphas) * len(config.seeds) * len(config.workflows)


def cells(spark: SparkSession, config: Experiment) -> DataFrame:
    """One row per dataset, seed, perturbation, strength and workflow, exploded from one row of small arrays: no product of partitions."""
    out = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(d.name).alias("dataset"), F.lit(d.params()).alias("dataset_params")) for d in config.datasets))).alias("d")).select("d.*")
    for name, values, kind in (("seed", config.seeds, "int"), ("perturbation", config.perturbations, "string"), ("alpha", config.alphas, "double"), ("workflow", config.workflows, "string")):
        out = out.withColumn(name, F.explode(F.array(*(F.lit(v).cast(kind) for v in values))))
    return out.withColumn("workflow_params", F.lit(K.canonical_json(config.options)))


_GRAPH = "dataset string, seed int, graph_index int, num_nodes int, edges array<struct<u:int,v:int>>, labels array<int>"


def _rows(frames, fn, names):
    for pdf in frames:
        out = [x for row in pdf.itertuples(index=False) for x in fn(row)]
        if out:
            yield pd.DataFrame.from_records(out, columns=names)


def _pack_edges(edges) -> list[dict]:
    return [{"u": int(u), "v": int(v)} for u, v in edges]


def originals(spark: SparkSession, config: Experiment, wanted: DataFrame | None = None) -> DataFrame:
    """The graphs of each dataset and seed (of `wanted`, if given), each from its own stream."""
    ship(spark)
    byname = {d.name: d for d in config.datasets}
    units = (wanted if wanted is not None else cells(spark, config)).select("dataset", "seed").distinct()
    drawn = [molecule_graphs(spark, d, units) for d in config.datasets if d.family == "molecules"]
    units = units.filter(~F.col("dataset").isin([d.name for d in config.datasets if d.family == "molecules"]))
    sizes = F.create_map(*[F.lit(x) for d in config.datasets for x in (d.name, d.graphs)])
    units = K.spread_out(units.select("dataset", "seed", F.explode(F.sequence(F.lit(0), sizes[F.col("dataset")] - 1)).alias("graph_index")), ["dataset", "seed", "graph_index"])

    def make(row):
        d = byname[row.dataset]
        stream = K.derive_seed(int(row.seed), "graph", d.params(), int(row.graph_index))
        edges, labels = K.generate(d.family, d.nodes, stream, d.p, d.p_out, d.blocks, d.m)
        return [(row.dataset, int(row.seed), int(row.graph_index), d.nodes, _pack_edges(edges), labels)]

    names = [f.split()[0] for f in _GRAPH.split(", ")]
    out = units.mapInPandas(lambda it: _rows(it, make, names), _GRAPH)
    for more in drawn:
        out = out.unionByName(more)
    return out


def molecule_graphs(spark: SparkSession, dataset: Dataset, units: DataFrame) -> DataFrame:
    """For each seed of the dataset's units, its sample of the cache's split."""
    cache = molecules.load_manifest(spark, dataset.root, dataset.fingerprint or None)
    records = molecules.read_split(spark, dataset.root, dataset.split, cache)
    out = spark.createDataFrame([], _GRAPH)
    for row in units.filter(F.col("dataset") == dataset.name).select("seed").distinct().collect():
        edges = F.sort_array(F.transform("edges", lambda e: F.struct(F.array_min(e).alias("u"), F.array_max(e).alias("v"))))
        got = molecules.sample(records, dataset.graphs, int(row.seed))
        out = out.unionByName(got.select(F.lit(dataset.name).alias("dataset"), F.lit(int(row.seed)).alias("seed"), F.col("graph_index").cast("int"), "num_nodes", edges.alias("edges"), F.lit(None).cast("array<int>").alias("labels")))
    return out


def molecule_experiment(root: str, split: str = "train", graphs: int = 100, nodes: int = 40, seeds: Sequence[int] = tuple(range(3)), fingerprint: str = "", perturbations: Sequence[str] = S.PERTURBATIONS, alphas: Sequence[float] = S.ALPHAS) -> Experiment:
    """An experiment over a molecule cache; `nodes` is the largest scale of diversity curves."""
    data = Dataset("molecules", "molecules", graphs, nodes, root=root, split=split, fingerprint=fingerprint)
    return Experiment("molecules", (data,), tuple(perturbations), tuple(alphas), tuple(seeds))


_PAIR = "dataset string, seed int, graph_index int, perturbation string, alpha double, num_nodes int, edges array<struct<u:int,v:int>>, requested int, removed int, added int, edits int, weighted double, label_source string, no_op_reason string, graph_sha256 string"


def pairs(base: DataFrame, config: Experiment) -> DataFrame:
    """Each original under every perturbation and strength. One stream per perturbation serves all strengths, so that they nest."""
    kinds, alphas = list(config.perturbations), [float(a) for a in config.alphas]

    def make(row):
        old = [(e["u"], e["v"]) for e in row.edges]
        n, out = int(row.num_nodes), []
        labels = None if row.labels is None else [int(x) for x in row.labels]
        score = K.betweenness(n, old)[0]
        top = max(score, default=0.0) or 1.0
        found = None
        for kind in kinds:
            if kind == "community_weakening" and labels is None and found is None:
                found = K.communities(n, sorted(old))
            seed = K.derive_seed(int(row.seed), "perturbation", row.dataset, int(row.graph_index), kind)
            for alpha in alphas:
                own = labels if labels is not None else found
                new, facts = K.perturb(n, old, kind, alpha, seed, own)
                if kind == "community_weakening" and labels is None:
                    facts["label_source"] = "detected"
                edits = set(old) ^ set(new)
                weight = sum(1 + score[u] / top * score[v] / top for u, v in edits)
                why = None if edits else "alpha_zero" if alpha == 0 else "rounded_budget_zero" if not facts["requested"] else "operations_cancelled" if facts["removed"] + facts["added"] else "no_feasible_change"
                sha = hashlib.sha256(K.canonical_json([n, sorted(map(list, new))]).encode()).hexdigest()
                out.append((row.dataset, int(row.seed), int(row.graph_index), kind, alpha, n, _pack_edges(new), facts["requested"], facts["removed"], facts["added"], len(edits), float(weight), facts["label_source"], why, sha))
        return out

    target = StructType.fromDDL(_PAIR)
    names = target.names
    return K.spread_out(base, ["dataset", "seed", "graph_index"]).mapInPandas(lambda it: _rows(it, make, names), target)


def structural_vector(n: int, edges: Sequence[K.Edge]) -> list[float]:
    near = K.adjacency(n, edges)
    degree = np.array([len(x) for x in near], float)
    corner = [sum(len(near[u] & near[x]) for u in near[x]) / 2 for x in range(n)]
    wedges = degree * (degree - 1) / 2
    local = np.divide(corner, wedges, out=np.zeros(n), where=wedges > 0)
    m, t, w = float(len(edges)), sum(corner) / 3, float(wedges.sum())
    return [float(n), m, 0.0 if n < 2 else 2 * m / (n * (n - 1)), float(degree.mean()) if n else 0.0, float(degree.var()) if n else 0.0, float(local.mean()) if n else 0.0, t, 3 * t / w if w else 0.0, float(len(set(K.component_labels(n, edges))))]


def wl_counts(n: int, edges: Sequence[K.Edge], iterations: int = 3) -> dict[str, float]:
    """Subtree label counts by content-addressed name, over all levels."""
    near = K.adjacency(n, edges)
    label = [f"degree:{len(x)}" for x in near]
    out: dict[str, float] = {}
    for level in range(iterations + 1):
        if level:
            label = [hashlib.sha256(f"{label[x]}({','.join(sorted(label[y] for y in near[x]))})".encode()).hexdigest() for x in range(n)]
        for x in label:
            key = f"h{level}:{x}"
            out[key] = out.get(key, 0.0) + 1
    return out


#: Workflows of one's own: name -> function (n, edges, options) to a dense list or a sparse dict. Scores follow the kind of vector.
CUSTOM: dict[str, Callable] = {}


def register_workflow(name: str, fn: Callable[[int, list[K.Edge], dict], list[float] | dict[str, float]]) -> None:
    if name in S.WORKFLOWS:
        raise ValueError(f"{name} is taken")
    CUSTOM[name] = fn


def representation(workflow: str, n: int, edges: list[K.Edge], options: dict, scales: Sequence[int]) -> tuple[list[float] | None, dict[str, float] | None]:
    """A dense or a sparse vector."""
    if workflow == "structural_statistics_mmd":
        return structural_vector(n, edges), None
    if workflow == "wl_subtree_kernel_mmd":
        return None, wl_counts(n, edges, options.get("wl_iterations", 3))
    if workflow == "native_netlsd":
        return K.heat_trace(n, edges, normalization=options.get("normalization", "empty")), None
    if workflow in ("diversity_curves_shortest_path", "diversity_curves_l2"):
        return K.diversity_curve(n, edges, scales, options.get("repetitions", 3)), None
    raise ValueError(f"unknown workflow {workflow}")


def represent(graphs: DataFrame, keys: Sequence[str], config: Experiment) -> DataFrame:
    """keys, workflow, dense, sparse, seconds and error for each graph and workflow. A failure is a row, not an exception."""
    scales = list(range(1, max(d.nodes for d in config.datasets) + 1))
    flows, options, custom = list(config.workflows), dict(config.options), dict(CUSTOM)
    target = StructType([graphs.schema[k] for k in keys])
    for f in StructType.fromDDL("workflow string, dense array<double>, sparse map<string,double>, seconds double, memory double, error string"):
        target = target.add(f)

    def make(row):
        key = tuple(getattr(row, k) for k in keys)
        edges = [(int(e["u"]), int(e["v"])) for e in row.edges]
        out = []
        for w in flows:
            start = time.perf_counter()
            try:
                if w in custom:
                    got = custom[w](int(row.num_nodes), edges, options)
                    dense, sparse, error = (None, got, None) if isinstance(got, dict) else ([float(v) for v in got], None, None)
                else:
                    dense, sparse, error = *representation(w, int(row.num_nodes), edges, options, scales), None
            except Exception as ex:  # noqa: BLE001  becomes the row's status
                dense, sparse, error = None, None, f"{type(ex).__name__}: {ex}"
            # The worker's highest resident memory so far, in MB.
            out.append((*key, w, dense, sparse, time.perf_counter() - start, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, error))
        return out

    return K.spread_out(graphs.select(*keys, "num_nodes", "edges"), keys).mapInPandas(lambda it: _rows(it, make, target.names), target)


def dense_scores(x: np.ndarray, y: np.ndarray, bandwidth: float | None) -> tuple[float, float, float]:
    """Distribution score (RBF MMD, or the distance of means without a bandwidth), mean shift and mean paired distance."""
    shift, paired = float(np.linalg.norm(x.mean(0) - y.mean(0))), float(np.linalg.norm(x - y, axis=1).mean())
    if bandwidth is None:
        return shift, shift, paired
    k = lambda a, b: np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2) / (2 * bandwidth**2)).mean()
    return max(0.0, float(k(x, x) + k(y, y) - 2 * k(x, y))), shift, paired


def sparse_scores(x: list[dict], y: list[dict]) -> tuple[float, float, float]:
    """Linear MMD, its root, and mean paired distance."""
    names = {f: i for i, f in enumerate(sorted({f for d in (*x, *y) for f in d}))}
    a, b = (np.zeros((len(s), len(names))) for s in (x, y))
    for m, s in ((a, x), (b, y)):
        for i, d in enumerate(s):
            for f, v in d.items():
                m[i, names[f]] = v
    shift = float(np.linalg.norm(a.mean(0) - b.mean(0)))
    return shift * shift, shift, float(np.linalg.norm(a - b, axis=1).mean())


def representation_details(workflow: str, x: list, y: list, bandwidth: float) -> dict:
    """What a cell's scores are made of: paired distances, and for the two kernels their means or displacement and each pair's part of the MMD."""
    if not x or len(x) != len(y):
        raise ValueError("paired representations are needed")
    if isinstance(x[0], dict):
        names = {f: i for i, f in enumerate(sorted({f for d in (*x, *y) for f in d}))}
        a, b = (np.zeros((len(s), len(names))) for s in (x, y))
        for m, s in ((a, x), (b, y)):
            for i, d in enumerate(s):
                m[i, [names[f] for f in d]] = list(d.values())
    else:
        a, b = np.array(x, float), np.array(y, float)
    out = {"available": True, "paired_distances": np.linalg.norm(a - b, axis=1).tolist()}
    if isinstance(x[0], dict):
        delta = b.mean(0) - a.mean(0)
        out |= {"squared_mean_displacement": float(delta @ delta), "mmd_contributions": ((b - a) @ delta).tolist()}
    elif workflow == "structural_statistics_mmd":
        k = lambda p, q: np.exp(-((p[:, None, :] - q[None, :, :]) ** 2).sum(axis=2) / (2 * bandwidth**2))
        xx, yy, xy = k(a, a), k(b, b), k(a, b)
        out |= {"kernel_means": {"xx": float(xx.mean()), "yy": float(yy.mean()), "xy": float(xy.mean())}, "mmd_contributions": (xx.mean(1) + yy.mean(1) - xy.mean(1) - xy.mean(0)).tolist()}
    return out


def assert_reconstructed(details: dict, score: float, paired: float, tolerance: float = 1e-9) -> None:
    """The scores follow from the details."""
    again = [(float(np.mean(details["paired_distances"])), paired)]
    if "kernel_means" in details:
        m = details["kernel_means"]
        again.append((max(0.0, m["xx"] + m["yy"] - 2 * m["xy"]), score))
    if "squared_mean_displacement" in details:
        again.append((details["squared_mean_displacement"], score))
    if "mmd_contributions" in details:
        again.append((max(0.0, float(np.mean(details["mmd_contributions"]))), score))
    for got, want in again:
        if abs(got - want) > tolerance * max(1.0, abs(want)):
            raise ValueError(f"score not reconstructed: {got} and {want}")


_CELL = ["dataset", "seed", "perturbation", "alpha"]
_SCORE = "dataset string, seed int, perturbation string, alpha double, workflow string, graph_count int, distribution_score double, mean_shift_score double, paired_score double, runtime_seconds double, diagnostic_seconds double, memory_mb double, workflow_body string, status string, error_message string"


def cell_scores(before: DataFrame, after: DataFrame, config: Experiment) -> DataFrame:
    """A row per cell and workflow, with its details as a record's body. before: dataset, seed, graph_index, workflow, ...; after: with perturbation and alpha too."""
    bandwidth = float(config.options.get("bandwidth", 10.0))
    a = before.select("dataset", "seed", "graph_index", "workflow", *(F.col(c).alias(f"{c}0") for c in ("dense", "sparse", "seconds", "memory", "error")))
    both = after.join(a, ["dataset", "seed", "graph_index", "workflow"])
    names = StructType.fromDDL(_SCORE).names

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        first, start = pdf.iloc[0], time.perf_counter()
        pdf = pdf.sort_values("graph_index")
        error = next((e for e in [*pdf["error"], *pdf["error0"]] if isinstance(e, str)), None)
        got, body, spent = (None, None, None), None, None
        if error is None:
            try:
                if isinstance(first.dense, type(None)):
                    x, y = [dict(d) for d in pdf["sparse0"]], [dict(d) for d in pdf["sparse"]]
                    got = sparse_scores(x, y)
                else:
                    x, y = list(np.stack(pdf["dense0"])), list(np.stack(pdf["dense"]))
                    got = dense_scores(np.stack(x), np.stack(y), bandwidth if first.workflow == "structural_statistics_mmd" else None)
                scored = time.perf_counter()
                details = representation_details(first.workflow, x, y, bandwidth)
                assert_reconstructed(details, got[0], got[2])
                body = K.canonical_json({**{c: first[c].item() if hasattr(first[c], "item") else first[c] for c in _CELL}, "workflow": first.workflow, "graph_index": [int(i) for i in pdf["graph_index"]], **details})
                spent = time.perf_counter() - scored
            except Exception as ex:  # noqa: BLE001
                got, error = (None, None, None), f"{type(ex).__name__}: {ex}"
        seconds = float(pdf["seconds"].sum() + pdf["seconds0"].sum() + time.perf_counter() - start - (spent or 0.0))
        memory = float(max(pdf["memory"].max(), pdf["memory0"].max()))
        return pd.DataFrame([(*(first[c] for c in _CELL), first.workflow, len(pdf), *got, seconds, spent, memory, body, "success" if error is None else "failed", error or "")], columns=names)

    return both.groupBy(*_CELL, "workflow").applyInPandas(score, _SCORE)


def graph_bodies(base: DataFrame, made: DataFrame) -> DataFrame:
    """A record's body for each cell: its pairs of graphs in order, with edits and hashes. A cell has as many graphs as its dataset says."""
    old = base.select("dataset", "seed", "graph_index", F.col("edges").alias("original"))
    pair = F.struct("graph_index", "num_nodes", F.col("original"), F.col("edges").alias("perturbed"), F.col("edits").alias("raw_edits"), (F.col("edits") == 0).alias("no_op"), "no_op_reason", F.sha2(F.to_json(F.struct("num_nodes", F.sort_array("original").alias("edges"))), 256).alias("original_hash"), F.sha2(F.to_json(F.struct("num_nodes", F.sort_array("edges").alias("edges"))), 256).alias("perturbed_hash"))
    cell = made.join(old, ["dataset", "seed", "graph_index"]).groupBy(*_CELL).agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    return cell.select(*_CELL, F.to_json(F.struct(*_CELL, "pairs")).alias("graph_body"))


def results(spark: SparkSession, config: Experiment, wanted: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None, bodies: bool = False) -> DataFrame:
    """The results table of the configuration, or of the wanted cells; keep(df, name) may store a step that two later ones read. With
    `bodies`, the records that its checksums are of come as the columns graph_body and workflow_body."""
    keep = keep or (lambda df, name: df)
    base = keep(originals(spark, config, wanted), "originals")
    made = pairs(base, config)
    if wanted is not None:
        made = made.join(F.broadcast(wanted.select(*_CELL).distinct()), _CELL, "left_semi")
    made = keep(made, "pairs")
    scores = cell_scores(represent(base, ["dataset", "seed", "graph_index"], config), represent(made, ["dataset", "seed", "graph_index", "perturbation", "alpha"], config), config)
    m0 = base.groupBy("dataset", "seed").agg(F.min(F.size("edges")).alias("lo0"), F.max(F.size("edges")).alias("hi0"))
    facts = made.groupBy(*_CELL).agg(F.avg("edits").alias("edit_distance_raw"), F.avg("weighted").alias("edit_distance_weighted"), F.min(F.size("edges")).alias("lo"), F.max(F.size("edges")).alias("hi"), F.min("num_nodes").alias("node_count_min"), F.max("num_nodes").alias("node_count_max"), F.min(F.when(F.col("label_source").isNotNull(), F.struct("graph_index", "label_source")))["label_source"].alias("label_source"))
    names = F.create_map(*[F.lit(x) for d in config.datasets for x in (d.name, d.params())])
    out = scores.join(facts, _CELL).join(m0, ["dataset", "seed"]).join(graph_bodies(base, made), _CELL)
    for kind in ("graph", "workflow"):
        sha = F.sha2(F.col(f"{kind}_body").cast("binary"), 256)
        out = out.withColumn(f"{kind}_sha256", sha).withColumn(f"{kind}_artifact", F.concat(F.lit(f"{kind}/"), sha))
    out = out.withColumns({
        "dataset_params": names[F.col("dataset")], "workflow_params": F.lit(K.canonical_json(config.options)), "perturbation_params": F.lit("{}"), "schema_version": F.lit(VERSION), "randomness_protocol": F.lit(PROTOCOL), "code_fingerprint": F.lit(code_fingerprint(config)),
        "edge_count_min": F.least("lo", "lo0"), "edge_count_max": F.greatest("hi", "hi0"), "perturbation_family": F.split_part("perturbation", F.lit("_"), F.lit(1)), "perturbation_direction": F.split_part("perturbation", F.lit("_"), F.lit(2)),
    })
    target = StructType.fromDDL(S.RESULTS)
    if wanted is not None:
        out = out.join(wanted.select(*_CELL, "workflow").distinct(), [*_CELL, "workflow"], "left_semi")
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target), *(["graph_body", "workflow_body"] if bodies else []))


_KEY = [c for c in S.ROW_KEY]


def pending(grid: DataFrame, done: DataFrame, rerun_failed: bool = False) -> DataFrame:
    """Cells of the grid without a row; failed rows do not count if they are to run again."""
    have = done.filter(F.col("status") != "failed") if rerun_failed else done
    return grid.join(have.select(*_KEY).distinct(), _KEY, "left_anti")


def check_compatible(done: DataFrame, config: Experiment) -> None:
    """Results of another protocol, schema or configuration are not resumed."""
    row = done.agg(*(F.collect_set(c).alias(c) for c in ("schema_version", "randomness_protocol", "code_fingerprint"))).first()
    for c, mine in (("schema_version", VERSION), ("randomness_protocol", PROTOCOL), ("code_fingerprint", code_fingerprint(config))):
        if set(row[c]) - {mine}:
            raise ValueError(f"{c} differs: {sorted(row[c])} and {mine}")


def run_experiment(spark: SparkSession, config: Experiment, out_dir: str, resume: bool = False, rerun_failed: bool = False, seed_range: str | None = None) -> DataFrame:
    """Compute what the results folder lacks and append it, by dataset and seed; gives the whole table. A run that was cut off is resumed by key."""
    config = with_seed_range(config, seed_range)
    path = f"{out_dir}/results"
    R.recover_dir(spark, path)
    grid = cells(spark, config)
    wanted = None
    started = datetime.now(timezone.utc)
    if R.exists(spark, f"{path}/_SUCCESS"):
        if not resume:
            raise FileExistsError(path)
        done = spark.read.parquet(path)
        check_compatible(done, config)
        # Written first: the table it is made from may be rewritten next.
        todo = pending(grid, done, rerun_failed).select(*_CELL, "workflow")
        todo.write.mode("overwrite").parquet(f"{out_dir}/.todo")
        wanted = spark.read.schema(todo.schema).parquet(f"{out_dir}/.todo")
        if rerun_failed:
            # Written beside and then put in its place, so that the table is whole in one of the two at any time.
            done.filter(F.col("status") != "failed").write.mode("overwrite").partitionBy("dataset", "seed").parquet(f"{out_dir}/.kept")
            R.replace_dir(spark, f"{out_dir}/.kept", path)
        if wanted.isEmpty():
            return R.read_results(spark, path)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out_dir}/{name}")
        return spark.read.schema(df.schema).parquet(f"{out_dir}/{name}")

    log = logger(out_dir)
    log.info("run %s: %s rows expected", run_id(config, started), expected_rows(config))
    rows = keep(results(spark, config, wanted, keep, bodies=True), ".rows")
    records = [rows.filter(F.col(f"{k}_body").isNotNull()).select(F.lit(k).alias("kind"), F.col(f"{k}_body").alias("body")) for k in ("graph", "workflow")]
    artifacts.write(records[0].unionByName(records[1]), f"{out_dir}/artifacts")
    rows.drop("graph_body", "workflow_body").write.mode("append").partitionBy("dataset", "seed").parquet(path)
    R.write_json(f"{out_dir}/run_manifest.json", manifest(config, started))
    log.info("finished")
    return R.read_results(spark, path)


def logger(out_dir: str) -> logging.Logger:
    """Progress on the console and, where the folder is a local one, in run.log."""
    log = logging.getLogger(f"plexum.{hashlib.sha1(out_dir.encode()).hexdigest()[:8]}")
    if not log.handlers:
        log.setLevel(logging.INFO)
        log.propagate = False
        handlers: list[logging.Handler] = [logging.StreamHandler()]
        if "://" not in out_dir:
            Path(out_dir).mkdir(parents=True, exist_ok=True)
            handlers.append(logging.FileHandler(f"{out_dir}/run.log"))
        for h in handlers:
            h.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
            log.addHandler(h)
    return log


def acceleration_summary() -> dict[str, str]:
    """What solves eigenvalue problems, for the manifest."""
    return {"device": "cpu", "eigenvalue_solver": "numpy.linalg.eigvalsh"}


def default_workers(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


#: One thread for each task's numerical libraries; tasks are the parallelism.
THREAD_CAPS = {f"spark.executorEnv.{x}": "1" for x in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS")}


def manifest(config: Experiment, started: datetime) -> dict:
    return {
        "run_id": run_id(config, started), "config": json.loads(json.dumps(asdict(config))), "config_hash": config_hash(config), "expected_rows": expected_rows(config), "started_at": started.isoformat(), "ended_at": datetime.now(timezone.utc).isoformat(),
        "versions": {"python": platform.python_version(), "spark": pyspark.__version__, "numpy": np.__version__, "pandas": pd.__version__, "pyarrow": pyarrow.__version__}, "schema_version": VERSION, "randomness_protocol": PROTOCOL,
        "code_fingerprint": code_fingerprint(config), "code_files": code_files(), "git_commit": git_commit(), "acceleration": acceleration_summary(), "status": "finished",
    }


def run_debug_experiment(spark: SparkSession, out_dir: str, **options) -> DataFrame:
    return run_experiment(spark, debug_experiment(), out_dir, **options)


def run_full_experiment(spark: SparkSession, out_dir: str, **options) -> DataFrame:
    return run_experiment(spark, full_experiment(), out_dir, **options)


def merge_runs(shards: Sequence[DataFrame]) -> DataFrame:
    """One table of all shards: of rows with one key the first shard's; shards of another protocol, schema or configuration are an error."""
    if not shards:
        raise ValueError("no shards")
    out = None
    for k, s in enumerate(shards):
        part = s.withColumn("_shard", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    row = out.agg(*(F.count_distinct(F.coalesce(c, F.lit(""))).alias(c) for c in ("schema_version", "randomness_protocol", "code_fingerprint"))).first()
    bad = [c for c in row.asDict() if row[c] > 1]
    configs = out.groupBy("dataset").agg(F.count_distinct("dataset_params").alias("n")).filter("n > 1").count()
    if bad or configs:
        raise ValueError(f"shards do not fit: {bad or 'dataset parameters'}")
    w = Window.partitionBy(*_KEY).orderBy("_shard")
    first = out.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_shard")
    return first.orderBy(*(F.col(c).cast("string") for c in _KEY))
