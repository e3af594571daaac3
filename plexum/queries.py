"""Registered queries over the generic tables, each with the SQL that states the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexum import schema as S
from plexum.functions.columns import rounded
from plexum.operators import charts, diagnose, evaluate, graphs, kernels, stats, vectors, wl
from plexum.plans import experiment
from plexum.sources.fixtures import GRAPH_SQL, NODES, RESULTS_SQL, VECTOR_SQL, graph_view, results_view, vector_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _results(body: str) -> str:
    return f"WITH {RESULTS_SQL}, ok AS (SELECT * FROM rview WHERE status = 'success')\n{body}"


def _rank(value: str, part: str) -> str:
    return f"rank() OVER (PARTITION BY {part} ORDER BY {value}) + CAST(count(*) OVER (PARTITION BY {part}, {value}) - 1 AS DOUBLE) / 2"


_KEYS = "workflow, dataset, perturbation"
_CORR = "coalesce(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 0)"


def _spearman(x: str, y: str, name: str, source: str = "ok", keys: str = _KEYS) -> str:
    return f"(SELECT {keys}, {_CORR} AS {name} FROM (SELECT {keys}, {_rank(x, keys)} AS rx, {_rank(y, keys)} AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {keys})"


_MONO = f"""(SELECT {_KEYS}, coalesce(avg(CASE WHEN b IS NOT NULL THEN CASE WHEN round(m - b, 12) < 0 THEN 1.0 ELSE 0.0 END END), 0) AS monotonicity FROM
  (SELECT {_KEYS}, m, lag(m) OVER (PARTITION BY {_KEYS} ORDER BY alpha) AS b FROM (SELECT {_KEYS}, alpha, avg(distribution_score) AS m FROM ok GROUP BY {_KEYS}, alpha)) GROUP BY {_KEYS})"""
_CV = f"""(SELECT {_KEYS}, CASE WHEN abs(avg(m)) < 1e-12 THEN CASE WHEN stddev_pop(m) < 1e-12 THEN 0 ELSE CAST('inf' AS DOUBLE) END ELSE stddev_pop(m) / abs(avg(m)) END AS robustness_cv FROM
  (SELECT {_KEYS}, seed, avg(distribution_score) AS m FROM ok GROUP BY {_KEYS}, seed) GROUP BY {_KEYS})"""
_RUNTIME_ROWS = "(SELECT *, CASE WHEN coalesce(min(CASE WHEN runtime_seconds >= 0 THEN runtime_seconds END) OVER w, 0) <= 0 THEN 1 ELSE runtime_seconds / min(CASE WHEN runtime_seconds >= 0 THEN runtime_seconds END) OVER w END AS relative_runtime FROM ok WINDOW w AS (PARTITION BY dataset, perturbation, alpha, seed))"
_TAU = """(WITH m AS (SELECT dataset, perturbation, seed, workflow, avg(distribution_score) AS m FROM ok GROUP BY ALL),
  p AS (SELECT a.dataset, a.perturbation, a.seed, a.workflow AS w1, b.workflow AS w2, sign(round(a.m - b.m, 12)) AS d FROM m a JOIN m b ON a.dataset = b.dataset AND a.perturbation = b.perturbation AND a.seed = b.seed AND a.workflow < b.workflow),
  s AS (SELECT DISTINCT dataset, perturbation, seed FROM ok),
  e AS (SELECT a.dataset, a.perturbation, a.seed AS s1, b.seed AS s2 FROM s a JOIN s b ON a.dataset = b.dataset AND a.perturbation = b.perturbation AND a.seed < b.seed),
  t AS (SELECT p.dataset, p.perturbation, p.seed AS s1, q.seed AS s2, sum(p.d * q.d) / nullif(sum(abs(p.d * q.d)), 0) AS tau FROM p JOIN p q ON p.dataset = q.dataset AND p.perturbation = q.perturbation AND p.w1 = q.w1 AND p.w2 = q.w2 AND p.seed < q.seed GROUP BY ALL)
  SELECT c.dataset, c.perturbation, coalesce(avg(CASE WHEN e.s1 IS NOT NULL THEN coalesce(t.tau, 1) END), 1) AS ranking_stability_tau
  FROM (SELECT DISTINCT dataset, perturbation FROM ok) c LEFT JOIN e USING (dataset, perturbation) LEFT JOIN t USING (dataset, perturbation, s1, s2) GROUP BY c.dataset, c.perturbation)"""


def _case(value: str, op: str, steps, last: str) -> str:
    return "CASE " + " ".join(f"WHEN round({value}, 9) {op} CAST({b} AS DOUBLE) THEN '{name}'" for b, name in steps) + f" ELSE '{last}' END"


def _table_case(column: str, table: dict, default: str) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {text(v)}" for k, v in table.items()) + f" ELSE {default} END"


def _summary_cte(granularity: str = _table_case("perturbation", S.GRANULARITY, "'unknown'")) -> str:
    parts = [_spearman(x, y, name) for name, (x, y) in evaluate.MEASURES.items()]
    joins = " ".join(f"LEFT JOIN {p} j{k} USING ({_KEYS})" for k, p in enumerate(parts))
    names = ", ".join(f"coalesce({n}, 0) AS {n}" for n in evaluate.MEASURES)
    return f"""summary AS (SELECT k.workflow, k.dataset, k.perturbation, {names}, monotonicity, robustness_cv, ranking_stability_tau, relative_runtime,
  {_table_case('k.workflow', S.INTERPRETABILITY, '1')} AS interpretability_score, {granularity.replace('CASE perturbation', 'CASE k.perturbation')} AS granularity_label, same AS mean_shift_duplicates_distribution
  FROM (SELECT {_KEYS}, coalesce(bool_and(abs(mean_shift_score - distribution_score) <= 1e-12), false) AS same FROM ok GROUP BY {_KEYS}) k {joins}
  LEFT JOIN {_MONO} m USING ({_KEYS}) LEFT JOIN {_CV} c USING ({_KEYS}) LEFT JOIN {_TAU} t USING (dataset, perturbation)
  LEFT JOIN (SELECT {_KEYS}, avg(relative_runtime) AS relative_runtime FROM {_RUNTIME_ROWS} GROUP BY {_KEYS}) r USING ({_KEYS}))"""


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary with labels of the six perturbations in place of line numbers, so that scales and notes vary."""
    labels = F.when(F.col("perturbation").isin("1", "2"), "local").when(F.col("perturbation").isin("3", "4"), "local/mesoscopic").when(F.col("perturbation") == "5", "mesoscopic").otherwise("global")
    return evaluate.evaluation_summary(results_view(spark, sf_dir)).withColumn("granularity_label", labels).withColumn("sensitivity", F.col("sensitivity") * 4 + 0.4)


_SCALED = _summary_cte("CASE WHEN perturbation IN ('1', '2') THEN 'local' WHEN perturbation IN ('3', '4') THEN 'local/mesoscopic' WHEN perturbation = '5' THEN 'mesoscopic' ELSE 'global' END".replace("perturbation", "k.perturbation")) + ",\nscaled AS (SELECT * REPLACE (sensitivity * 4 + CAST(0.4 AS DOUBLE) AS sensitivity) FROM summary)"

_ROUNDED_SUMMARY = ", ".join(f"round({c}, 6) AS {c}" for c in (*evaluate.MEASURES, "monotonicity", "robustness_cv", "ranking_stability_tau", "relative_runtime"))


@query(_results("").rstrip() + f", {_summary_cte()}\nSELECT {_KEYS}, {_ROUNDED_SUMMARY}, interpretability_score, granularity_label, mean_shift_duplicates_distribution FROM summary")
def evaluation_summary(spark, sf_dir):
    return evaluate.evaluation_summary(results_view(spark, sf_dir))


@query(
    _results("").rstrip()
    + f""", {_SCALED},
means AS (SELECT workflow, avg(sensitivity) AS s, avg(monotonicity) AS m, avg(paired_detectability) AS p, avg(mean_shift_detectability) AS ms, avg(robustness_cv) AS cv, avg(relative_runtime) AS rt, avg(interpretability_score) AS i, bool_and(mean_shift_duplicates_distribution) AS same FROM scaled GROUP BY workflow),
ex AS (SELECT workflow, dataset, perturbation, sensitivity, unnest(string_split(granularity_label, '/')) AS scale FROM scaled),
sc AS (SELECT workflow, scale, avg(sensitivity) AS m FROM ex GROUP BY ALL),
g AS (SELECT workflow, CASE WHEN count(*) FILTER (WHERE round(m, 9) >= 0.5) >= 3 THEN 'multiscale' WHEN count(*) FILTER (WHERE round(m, 9) >= 0.5) > 0 THEN string_agg(scale, '/' ORDER BY scale) FILTER (WHERE round(m, 9) >= 0.5) ELSE arg_max(scale, m) END AS granularity_label FROM sc GROUP BY workflow)
SELECT workflow, {_case('s', '>=', evaluate.CORRELATION, 'Low')} AS sensitivity_label, {_case('m', '<=', evaluate.VIOLATIONS, 'Low')} AS monotonicity_label, {_case('p', '>=', evaluate.CORRELATION, 'Low')} AS paired_label,
CASE WHEN same THEN 'Duplicate' ELSE {_case('ms', '>=', evaluate.CORRELATION, 'Low')} END AS mean_shift_label, granularity_label, {_case('cv', '<=', evaluate.ROBUSTNESS, 'Low')} AS robustness_label,
{_case('rt', '<=', evaluate.EFFICIENCY, 'Low')} AS efficiency_label, {_case('i', '>=', ((3, 'Very high'), (2, 'High')), 'Medium')} AS interpretability_label FROM means JOIN g USING (workflow)"""
)
def final_matrix(spark, sf_dir):
    return evaluate.final_matrix(_scaled(spark, sf_dir))


_FAILURES = """
ed AS (SELECT dataset, perturbation, avg(e) AS mean_e, max(e) AS max_e FROM (SELECT dataset, perturbation, alpha, avg(edit_distance_raw) AS e FROM ok GROUP BY ALL) WHERE alpha > 0 GROUP BY ALL),
be AS (SELECT *, row_number() OVER (PARTITION BY dataset, perturbation ORDER BY sensitivity DESC, workflow) AS r FROM scaled),
fm0 AS (SELECT c.dataset, c.perturbation, n, coalesce(mean_e, 0) AS mean_e, coalesce(max_e, 0) AS max_e, be.workflow, be.sensitivity AS s, be.monotonicity AS m, be.robustness_cv AS cv
  FROM (SELECT dataset, perturbation, count(*) FILTER (WHERE status = 'success') AS n FROM rview GROUP BY ALL) c LEFT JOIN ed USING (dataset, perturbation) LEFT JOIN (SELECT * FROM be WHERE r = 1) be USING (dataset, perturbation)),
fm AS (SELECT *, CASE WHEN n = 0 THEN 'inapplicable' WHEN round(max_e, 9) < 1 THEN 'perturbation_starved' WHEN s IS NULL OR round(s, 9) < CAST(0.3 AS DOUBLE) THEN 'method_blind' WHEN round(m, 9) > CAST(0.3 AS DOUBLE) OR round(cv, 9) > CAST(0.35 AS DOUBLE) THEN 'unstable' ELSE 'ok' END AS cause FROM fm0)"""


@query(
    _results("").rstrip()
    + f""", {_SCALED},{_FAILURES}
SELECT dataset, perturbation, cause, round_even(round(mean_e, 9), 4) AS mean_edit_distance_raw, round_even(round(max_e, 9), 4) AS max_edit_distance_raw, coalesce(workflow, '') AS best_workflow, round_even(round(s, 9), 4) AS best_sensitivity, round_even(round(m, 9), 4) AS monotonicity, round_even(round(cv, 9), 4) AS robustness_cv,
CASE cause WHEN 'inapplicable' THEN 'no successful rows (cell skipped)' WHEN 'perturbation_starved' THEN 'max mean edits at alpha>0 = ' || format('{{:.2f}}', round_even(round(max_e, 9), 2)) || ' (< 1.0)' WHEN 'method_blind' THEN 'edits occurred but best sensitivity = ' || format('{{:.2f}}', round_even(round(s, 9), 2))
  WHEN 'unstable' THEN 'monotonicity=' || format('{{:.2f}}', round_even(round(m, 9), 2)) || ', cv=' || format('{{:.2f}}', round_even(round(cv, 9), 2)) ELSE 'sensitivity=' || format('{{:.2f}}', round_even(round(s, 9), 2)) || ', cv=' || format('{{:.2f}}', round_even(round(cv, 9), 2)) END AS note FROM fm"""
)
def failure_map(spark, sf_dir):
    return evaluate.failure_map(results_view(spark, sf_dir), _scaled(spark, sf_dir))


@query(_results(f"SELECT dataset, workflow, round(sensitivity, 6) AS sensitivity FROM {_spearman('alpha', 'distribution_score', 'sensitivity', keys='dataset, workflow')}"))
def spearman_by_setting(spark, sf_dir):
    return evaluate.spearman(evaluate.successes(results_view(spark, sf_dir)), ["dataset", "workflow"], {"sensitivity": ("alpha", "distribution_score")})


@query(_results(f"SELECT {_KEYS}, round(monotonicity, 6) AS monotonicity FROM {_MONO}"))
def monotonicity(spark, sf_dir):
    return evaluate.monotonicity(evaluate.successes(results_view(spark, sf_dir)), list(S.SETTING))


@query(_results(f"SELECT {_KEYS}, round(robustness_cv, 6) AS robustness_cv FROM {_CV}"))
def seed_cv(spark, sf_dir):
    return evaluate.seed_variation(evaluate.successes(results_view(spark, sf_dir)), list(S.SETTING))


@query(_results(f"SELECT dataset, perturbation, round(ranking_stability_tau, 6) AS ranking_stability_tau FROM {_TAU}"))
def kendall_stability(spark, sf_dir):
    return evaluate.ranking_stability(evaluate.successes(results_view(spark, sf_dir)))


@query(_results(f"SELECT {_KEYS}, alpha, seed, round(relative_runtime, 6) AS relative_runtime FROM {_RUNTIME_ROWS}"))
def relative_runtime(spark, sf_dir):
    return evaluate.relative_runtime(evaluate.successes(results_view(spark, sf_dir))).select(*S.SETTING, "alpha", "seed", "relative_runtime")


@query(_results("").rstrip() + f", {_SCALED}\nSELECT workflow, scale, round(avg(s), 6) AS value FROM (SELECT workflow, least(greatest(sensitivity, 0), 1) AS s, unnest(list_append(string_split(granularity_label, '/'), 'multiscale')) AS scale FROM scaled) GROUP BY ALL")
def granularity_labels(spark, sf_dir):
    return charts.granularity_values(_scaled(spark, sf_dir))


@query(_results("SELECT *, max(greatest(success, failed, skipped)) OVER () AS highest FROM (SELECT workflow, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM rview GROUP BY workflow)"))
def status_pivot(spark, sf_dir):
    return charts.status_pivot(results_view(spark, sf_dir))


@query(_results("SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(DISTINCT dataset) AS datasets, count(DISTINCT workflow) AS workflows FROM rview"))
def status_summary(spark, sf_dir):
    return charts.status_summary(results_view(spark, sf_dir))


@query(_results("").rstrip() + f", {_summary_cte()}\nSELECT perturbation, round(avg(sensitivity) FILTER (WHERE workflow = 'A'), 6) AS \"A\", round(avg(sensitivity) FILTER (WHERE workflow = 'N'), 6) AS \"N\", round(avg(sensitivity) FILTER (WHERE workflow = 'R'), 6) AS \"R\" FROM summary GROUP BY perturbation")
def sensitivity_pivot(spark, sf_dir):
    return charts.metric_pivot(evaluate.evaluation_summary(results_view(spark, sf_dir)), values=["A", "N", "R"])


@query(_results("SELECT workflow, alpha, round(avg(distribution_score), 6) AS mean, round(stddev_pop(distribution_score), 6) AS std, count(*) AS n, round(avg(distribution_score) - stddev_pop(distribution_score), 6) AS lower, round(avg(distribution_score) + stddev_pop(distribution_score), 6) AS upper FROM ok GROUP BY ALL"))
def seed_band(spark, sf_dir):
    return charts.seed_band(evaluate.successes(results_view(spark, sf_dir)))


@query(_results("SELECT workflow, alpha, round(m / greatest(max(m) OVER w, 1e-12), 6) AS mean, round(sd / greatest(max(m) OVER w, 1e-12), 6) AS std, n FROM (SELECT workflow, alpha, avg(distribution_score) AS m, stddev_pop(distribution_score) AS sd, count(*) AS n FROM ok GROUP BY ALL) WINDOW w AS (PARTITION BY workflow)"))
def seed_band_normalized(spark, sf_dir):
    return charts.seed_band_normalized(evaluate.successes(results_view(spark, sf_dir)))


@query(_results(f"SELECT {_KEYS}, alpha, seed, round(distribution_score / CASE WHEN max(distribution_score) OVER w > 0 THEN max(distribution_score) OVER w ELSE 1 END, 6) AS normalized FROM ok WINDOW w AS (PARTITION BY {_KEYS})"))
def normalized_scores(spark, sf_dir):
    return charts.normalized_scores(evaluate.successes(results_view(spark, sf_dir))).select(*S.SETTING, "alpha", "seed", "normalized")


@query(_results("SELECT dataset, perturbation, workflow, alpha, round(avg(distribution_score), 6) AS y FROM ok GROUP BY ALL"))
def line_means(spark, sf_dir):
    return charts.line_means(evaluate.successes(results_view(spark, sf_dir)))


@query(_results("SELECT dataset, perturbation, workflow, alpha, round(m / CASE WHEN max(m) OVER w = 0 THEN 1 ELSE max(m) OVER w END, 6) AS mean, round(sd / CASE WHEN max(m) OVER w = 0 THEN 1 ELSE max(m) OVER w END, 6) AS std FROM (SELECT dataset, perturbation, workflow, alpha, avg(distribution_score) AS m, stddev_pop(distribution_score) AS sd FROM ok GROUP BY ALL) WINDOW w AS (PARTITION BY dataset, perturbation, workflow)"))
def line_panels(spark, sf_dir):
    return charts.line_panels(evaluate.successes(results_view(spark, sf_dir)))


@query(_results("SELECT workflow, alpha, round(m, 6) AS mean, round(sd, 6) AS std, n, round(coalesce(m / nullif(max(m) OVER (PARTITION BY workflow), 0), 0), 6) AS normalized FROM (SELECT workflow, alpha, avg(distribution_score) AS m, coalesce(stddev_samp(distribution_score), 0) AS sd, count(*) AS n FROM ok GROUP BY ALL)"))
def alpha_stats(spark, sf_dir):
    return charts.alpha_stats(evaluate.successes(results_view(spark, sf_dir)))


@query(_results("SELECT dataset, label_source, alpha, round(y, 6) AS y, round(y / greatest(max(y) OVER (PARTITION BY dataset), 1e-12), 6) AS normalized FROM (SELECT dataset, CASE WHEN seed % 2 = 0 THEN 'ground_truth' ELSE 'detected' END AS label_source, alpha, avg(distribution_score) AS y FROM ok GROUP BY ALL)"))
def community_means(spark, sf_dir):
    return charts.community_means(evaluate.successes(results_view(spark, sf_dir)).withColumn("label_source", F.when(F.col("seed") % 2 == 0, "ground_truth").otherwise("detected")))


def _goodness_sql() -> str:
    up, down = ("sensitivity", "paired_detectability"), ("monotonicity", "robustness_cv", "relative_runtime")
    means = ", ".join(f"avg({c}) AS {c}" for c in (*up, *down))
    scaled = lambda c: f"CASE WHEN round(max({c}) OVER () - min({c}) OVER (), 12) = 0 THEN 0.5 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"
    cols = ", ".join(f"round({'' if c in up else '1 - '}{scaled(c)}, 6) AS {c}" for c in (*up, *down))
    return _results("").rstrip() + f", {_summary_cte()}\nSELECT workflow, {cols} FROM (SELECT workflow, {means} FROM summary GROUP BY workflow)"


@query(_goodness_sql())
def minmax_goodness(spark, sf_dir):
    return charts.minmax_goodness(evaluate.evaluation_summary(results_view(spark, sf_dir)))


@query(_results("").rstrip() + f", {_SCALED},{_FAILURES}\nSELECT d.dataset, p.perturbation, coalesce(cause, 'inapplicable') AS cause FROM (SELECT DISTINCT dataset FROM fm) d CROSS JOIN (SELECT DISTINCT perturbation FROM fm) p LEFT JOIN fm USING (dataset, perturbation)")
def failure_matrix(spark, sf_dir):
    return charts.failure_matrix(evaluate.failure_map(results_view(spark, sf_dir), _scaled(spark, sf_dir)))


@query(_results("SELECT workflow, dataset, perturbation, alpha, seed, round(mean_shift_score / max(mean_shift_score) OVER (), 6) AS px, round(paired_score / CASE WHEN max(paired_score) OVER () > 0 THEN max(paired_score) OVER () ELSE 1 END, 6) AS py FROM ok"))
def mean_vs_paired(spark, sf_dir):
    return charts.scatter_scaled(evaluate.successes(results_view(spark, sf_dir))).select(*S.SETTING, "alpha", "seed", "px", "py")


@query(
    _results(
        f"""SELECT {_KEYS}, round(max(y), 6) AS peak, min(CASE WHEN y = top THEN alpha END) AS peak_alpha, round(arg_max(y, alpha), 6) AS endpoint,
  round(max(CASE WHEN abs(alpha - CAST(0.1 AS DOUBLE)) < 1e-9 THEN y END) / nullif(max(y), 0), 6) AS early_fraction, round((max(y) - arg_max(y, alpha)) / nullif(max(y), 0), 6) AS endpoint_drop
  FROM (SELECT *, max(y) OVER (PARTITION BY {_KEYS}) AS top FROM (SELECT {_KEYS}, alpha, round(avg(distribution_score), 9) AS y FROM ok GROUP BY ALL)) GROUP BY {_KEYS}"""
    )
)
def first_peak(spark, sf_dir):
    return charts.curve_summary(evaluate.successes(results_view(spark, sf_dir)))


@query(_results("").rstrip() + f", {_SCALED}\nSELECT dataset, workflow, round(s, 6) AS sensitivity, CASE WHEN round(s, 9) >= 0.75 THEN 'strong' WHEN round(s, 9) >= 0.5 THEN 'moderate' ELSE 'weak' END AS tier, CAST(row_number() OVER (PARTITION BY dataset ORDER BY round(s, 9) DESC, workflow) AS INTEGER) AS place FROM (SELECT dataset, workflow, avg(sensitivity) AS s FROM scaled GROUP BY ALL)")
def tiers(spark, sf_dir):
    return charts.tiers(_scaled(spark, sf_dir))


@query(_results("SELECT workflow, count(*) AS rows, round(sum(runtime_seconds), 6) AS total_seconds, round(avg(runtime_seconds), 6) AS mean_seconds, round(max(runtime_seconds), 6) AS max_seconds, round(sum(runtime_seconds) / sum(sum(runtime_seconds)) OVER (), 6) AS share FROM ok GROUP BY workflow"))
def run_resources(spark, sf_dir):
    return charts.run_resources(evaluate.successes(results_view(spark, sf_dir)))


@query()
def bootstrap_band(spark, sf_dir):
    return charts.bootstrap_band(evaluate.successes(results_view(spark, sf_dir)))


# Populations of graphs.

_K = ["gid", "side"]
_ORDER = "(u * 7919 + v * 104729) % 1000003, u, v"


def _graph(body: str, ctes: str = "") -> str:
    extra = (""",
nb AS (SELECT gid, side, u AS node, v AS other FROM gedges UNION ALL SELECT gid, side, v, u FROM gedges),
deg AS (SELECT n.gid, n.side, n.node, count(nb.other) AS degree FROM gnodes n LEFT JOIN nb USING (gid, side, node) GROUP BY ALL),
tri AS (SELECT x.gid, x.side, x.u AS a, x.v AS b, y.v AS c FROM gedges x JOIN gedges y ON x.gid = y.gid AND x.side = y.side AND x.u = y.u AND x.v < y.v JOIN gedges z ON x.gid = z.gid AND x.side = z.side AND z.u = x.v AND z.v = y.v),
corner AS (SELECT gid, side, node, count(*) AS t FROM (SELECT gid, side, unnest([a, b, c]) AS node FROM tri) GROUP BY ALL),
tedges AS (SELECT DISTINCT gid, side, u, v FROM (SELECT gid, side, a AS u, b AS v FROM tri UNION ALL SELECT gid, side, a, c FROM tri UNION ALL SELECT gid, side, b, c FROM tri)),
absent AS (SELECT p.gid, p.side, p.node AS u, q.node AS v FROM gnodes p JOIN gnodes q ON p.gid = q.gid AND p.side = q.side AND p.node < q.node ANTI JOIN gedges e ON e.gid = p.gid AND e.side = p.side AND e.u = p.node AND e.v = q.node),
wedge AS (SELECT DISTINCT x.gid, x.side, x.other AS u, y.other AS v FROM nb x JOIN nb y ON x.gid = y.gid AND x.side = y.side AND x.node = y.node AND x.other < y.other ANTI JOIN gedges e ON e.gid = x.gid AND e.side = x.side AND e.u = x.other AND e.v = y.other),
sizes AS (SELECT g.gid, g.side, g.num_nodes, count(e.u) AS num_edges FROM ggraphs g LEFT JOIN gedges e USING (gid, side) GROUP BY ALL)""")
    return f"WITH RECURSIVE {GRAPH_SQL}{extra}{ctes}\n{body}"


_REACH = """,
reach AS (SELECT gid, side, node, node AS r FROM gnodes UNION SELECT n.gid, n.side, n.other, reach.r FROM reach JOIN nb n ON n.gid = reach.gid AND n.side = reach.side AND n.node = reach.node),
comp AS (SELECT gid, side, node, min(r) AS component FROM reach GROUP BY ALL)"""
_WALKS = f""",
walks AS (SELECT gid, side, node AS s, node AS t, 0 AS d FROM gnodes UNION SELECT w.gid, w.side, w.s, n.other, w.d + 1 FROM walks w JOIN nb n ON n.gid = w.gid AND n.side = w.side AND n.node = w.t WHERE w.d < {NODES - 1}),
dist AS (SELECT gid, side, s, t, min(d) AS d FROM walks GROUP BY ALL)"""
_LOCAL = "CASE WHEN d.degree < 2 THEN 0 ELSE 2.0 * coalesce(c.t, 0) / (d.degree * (d.degree - 1)) END"


def _order():
    return [(F.col("u") * 7919 + F.col("v") * 104729) % 1000003, F.col("u"), F.col("v")]


@query(_graph("SELECT gid, side, node, degree FROM deg"))
def graph_degrees(spark, sf_dir):
    return graphs.degrees(*graph_view(spark, sf_dir), _K)


@query(_graph("SELECT gid, side, num_nodes, num_edges, round(2.0 * num_edges / (num_nodes * (num_nodes - 1)), 6) AS density FROM sizes"))
def density(spark, sf_dir):
    return graphs.density(*graph_view(spark, sf_dir), _K)


@query(_graph("SELECT g.gid, g.side, count(t.a) AS triangles FROM ggraphs g LEFT JOIN tri t USING (gid, side) GROUP BY ALL"))
def triangles(spark, sf_dir):
    return graphs.triangle_counts(*graph_view(spark, sf_dir), _K)


@query(_graph("SELECT gid, side, u, v FROM tedges"))
def triangle_edges(spark, sf_dir):
    return graphs.triangle_edges(graph_view(spark, sf_dir)[1], _K)


@query(_graph("SELECT gid, side, u, v FROM wedge"))
def open_wedges(spark, sf_dir):
    return graphs.open_wedges(graph_view(spark, sf_dir)[1], _K)


@query(_graph("SELECT gid, side, u, v FROM absent"))
def non_edges(spark, sf_dir):
    return graphs.non_edges(*graph_view(spark, sf_dir), _K)


@query(_graph(f"SELECT d.gid, d.side, round(avg({_LOCAL}), 6) AS average_clustering FROM deg d LEFT JOIN corner c USING (gid, side, node) GROUP BY ALL"))
def clustering(spark, sf_dir):
    return graphs.clustering(*graph_view(spark, sf_dir), _K)


@query(_graph("SELECT gid, side, node, component FROM comp", _REACH))
def connected_components(spark, sf_dir):
    return kernels.connected_components(*graph_view(spark, sf_dir), _K)


@query(
    _graph(
        f"""SELECT s.gid, s.side, CAST(s.num_nodes AS DOUBLE) AS num_nodes, CAST(num_edges AS DOUBLE) AS num_edges, round(2.0 * num_edges / (s.num_nodes * (s.num_nodes - 1)), 6) AS density, round(mean_degree, 6) AS mean_degree, round(degree_variance, 6) AS degree_variance,
  round(average_clustering, 6) AS average_clustering, CAST(triangles AS DOUBLE) AS triangles, round(coalesce(3 * triangles / nullif(wedges, 0), 0), 6) AS transitivity, CAST(k AS DOUBLE) AS components
FROM sizes s JOIN (SELECT d.gid, d.side, avg(d.degree) AS mean_degree, var_pop(d.degree) AS degree_variance, avg({_LOCAL}) AS average_clustering, sum(coalesce(c.t, 0)) / 3 AS triangles, sum(d.degree * (d.degree - 1) / 2) AS wedges
  FROM deg d LEFT JOIN corner c USING (gid, side, node) GROUP BY ALL) l USING (gid, side) JOIN (SELECT gid, side, count(DISTINCT component) AS k FROM comp GROUP BY ALL) n USING (gid, side)""",
        _REACH,
    )
)
def structural_statistics(spark, sf_dir):
    return graphs.structural_statistics(*graph_view(spark, sf_dir), _K)


@query(_graph("SELECT p.gid, p.side, p.node AS u, q.node AS v, CAST(d.d AS DOUBLE) AS distance FROM gnodes p JOIN gnodes q ON p.gid = q.gid AND p.side = q.side AND p.node < q.node LEFT JOIN dist d ON d.gid = p.gid AND d.side = p.side AND d.s = p.node AND d.t = q.node", _WALKS))
def shortest_paths(spark, sf_dir):
    return kernels.shortest_paths(*graph_view(spark, sf_dir), _K)


@query(_graph("SELECT gid, side, round(sum(1 / z), 6) AS spread FROM (SELECT gid, side, s, sum(exp(-d)) AS z FROM dist GROUP BY ALL) GROUP BY ALL", _WALKS))
def spread(spark, sf_dir):
    return kernels.spreads(*graph_view(spark, sf_dir), _K)


def _sides(spark, sf_dir):
    g, e = graph_view(spark, sf_dir)
    part = lambda d, s: d.filter(F.col("side") == s).drop("side")
    return part(g, "original"), part(e, "original"), part(e, "perturbed")


_OPS = """,
eo AS (SELECT gid, u, v FROM gedges WHERE side = 'original'), ep AS (SELECT gid, u, v FROM gedges WHERE side = 'perturbed'),
ops AS (SELECT *, 'remove' AS op FROM (SELECT * FROM eo EXCEPT SELECT * FROM ep) UNION ALL SELECT *, 'add' FROM (SELECT * FROM ep EXCEPT SELECT * FROM eo))"""


@query(_graph("SELECT gid, op, u, v FROM ops", _OPS))
def edit_ops(spark, sf_dir):
    _, a, b = _sides(spark, sf_dir)
    return graphs.edit_ops(a, b, ["gid"])


@query(_graph("SELECT g.gid, count(o.u) AS edit_distance_raw, round(coalesce(sum(1 + CAST(du.degree AS DOUBLE) / mx * dv.degree / mx), 0), 6) AS edit_distance_weighted FROM (SELECT DISTINCT gid FROM ggraphs) g LEFT JOIN ops o USING (gid) LEFT JOIN deg du ON du.gid = o.gid AND du.side = 'original' AND du.node = o.u LEFT JOIN deg dv ON dv.gid = o.gid AND dv.side = 'original' AND dv.node = o.v LEFT JOIN (SELECT gid, nullif(max(degree), 0) AS mx FROM deg WHERE side = 'original' GROUP BY gid) m ON m.gid = o.gid GROUP BY g.gid", _OPS))
def edit_distance(spark, sf_dir):
    g, a, b = _sides(spark, sf_dir)
    ops = graphs.edit_ops(a, b, ["gid"])
    scores = graphs.degrees(g, a, ["gid"]).withColumnRenamed("degree", "score")
    return graphs.edit_distances(g, ops, ["gid"], graphs.product_weights(ops, scores, ["gid"]))


@query(_graph("SELECT min(num_nodes) AS node_count_min, max(num_nodes) AS node_count_max, min(num_edges) AS edge_count_min, max(num_edges) AS edge_count_max FROM sizes"))
def graph_size_summary(spark, sf_dir):
    return graphs.size_summary(*graph_view(spark, sf_dir), _K)


@query(_graph("SELECT a.gid, CAST(sum(abs(a.degree - b.degree)) AS BIGINT) AS degree_l1, max(a.degree) AS max_degree_before, max(b.degree) AS max_degree_after FROM deg a JOIN deg b ON a.gid = b.gid AND a.node = b.node AND a.side = 'original' AND b.side = 'perturbed' GROUP BY a.gid"))
def degree_l1(spark, sf_dir):
    g, a, b = _sides(spark, sf_dir)
    return graphs.degree_changes(graphs.degrees(g, a, ["gid"]), graphs.degrees(g, b, ["gid"]), ["gid"])


_LABELS = ",\nlab AS (SELECT gid, side, node, node % 4 AS label FROM gnodes)"


def _labels(g):
    return graphs.nodes(g, _K).withColumn("label", F.col("node") % 4)


@query(
    _graph(
        """SELECT s.gid, s.side, round(coalesce(w / nullif(pin, 0), 0), 6) AS intra_density, round(coalesce((num_edges - w) / nullif(n * (n - 1) / 2 - pin, 0), 0), 6) AS inter_density, round(coalesce(w / nullif(num_edges, 0), 0) - coalesce(d2 / nullif(4.0 * num_edges * num_edges, 0), 0), 6) AS modularity
FROM sizes s JOIN (SELECT gid, side, sum(k * (k - 1) / 2) AS pin, CAST(sum(k) AS DOUBLE) AS n, sum(d * d) AS d2 FROM (SELECT l.gid, l.side, l.label, CAST(count(*) AS DOUBLE) AS k, CAST(sum(degree) AS DOUBLE) AS d FROM lab l JOIN deg USING (gid, side, node) GROUP BY ALL) GROUP BY ALL) p USING (gid, side)
LEFT JOIN (SELECT e.gid, e.side, CAST(count(*) FILTER (WHERE e.u % 4 = e.v % 4) AS DOUBLE) AS w FROM gedges e GROUP BY ALL) i USING (gid, side)""",
        _LABELS,
    )
)
def partition_modularity(spark, sf_dir):
    g, e = graph_view(spark, sf_dir)
    return graphs.partition_stats(g, e, _labels(g), _K)


def _topk(source: str, budget: str = "floor(CAST(0.3 AS DOUBLE) * num_edges)") -> str:
    return _graph(f"SELECT gid, side, u, v FROM (SELECT x.*, row_number() OVER (PARTITION BY x.gid, x.side ORDER BY {_ORDER}) AS r, {budget} AS k FROM {source} x JOIN sizes USING (gid, side)) WHERE r <= k")


@query(_topk("gedges"))
def edge_deletion_topk(spark, sf_dir):
    return graphs.edge_deletion(*graph_view(spark, sf_dir), _K, 0.3, _order())


@query(_topk("absent"))
def edge_insertion_topk(spark, sf_dir):
    return graphs.edge_insertion(*graph_view(spark, sf_dir), _K, 0.3, _order())


@query(_topk("wedge", "floor(CAST(0.3 AS DOUBLE) * greatest(1, num_edges))"))
def triangle_insertion_topk(spark, sf_dir):
    return graphs.triangle_insertion(*graph_view(spark, sf_dir), _K, 0.3, _order())


@query(_topk("tedges"))
def triangle_deletion_topk(spark, sf_dir):
    return graphs.triangle_deletion(*graph_view(spark, sf_dir), _K, 0.3, _order())


_HUBS = f",\nhub AS (SELECT * FROM (SELECT gid, side, node, degree, CAST(row_number() OVER (PARTITION BY gid, side ORDER BY degree DESC, node) AS INTEGER) AS place FROM deg) WHERE place <= greatest(1, ceil(CAST(0.1 AS DOUBLE) * {NODES})))"


@query(_graph("SELECT gid, side, node, degree, place FROM hub", _HUBS))
def hub_targets(spark, sf_dir):
    return graphs.hubs(*graph_view(spark, sf_dir), _K)


@query(
    _graph(
        f"""SELECT gid, side, 'remove' AS op, u, v FROM gone UNION ALL
SELECT gid, side, 'add', u, v FROM (SELECT a.*, row_number() OVER (PARTITION BY a.gid, a.side ORDER BY {_ORDER}) AS r FROM absent a WHERE EXISTS (SELECT 1 FROM hub h WHERE h.gid = a.gid AND h.side = a.side AND (h.node = a.u OR h.node = a.v))) x
WHERE r <= (SELECT count(*) FROM gone g WHERE g.gid = x.gid AND g.side = x.side)""",
        _HUBS
        + f""",
gone AS (SELECT gid, side, u, v FROM (SELECT e.*, num_edges, row_number() OVER (PARTITION BY e.gid, e.side ORDER BY {_ORDER}) AS r FROM gedges e JOIN sizes USING (gid, side) WHERE EXISTS (SELECT 1 FROM hub h WHERE h.gid = e.gid AND h.side = e.side AND (h.node = e.u OR h.node = e.v))) WHERE r <= floor(CAST(0.3 AS DOUBLE) * num_edges))""",
    )
)
def hub_modification_topk(spark, sf_dir):
    return graphs.hub_modification(*graph_view(spark, sf_dir), _K, 0.3, _order())


@query(
    _graph(
        f"""SELECT gid, side, o.u, o.v, n.u AS add_u, n.v AS add_v FROM
(SELECT *, row_number() OVER (PARTITION BY gid, side ORDER BY {_ORDER}) AS r, count(*) OVER (PARTITION BY gid, side) AS m FROM gedges WHERE u % 4 = v % 4) o
JOIN (SELECT *, row_number() OVER (PARTITION BY gid, side ORDER BY {_ORDER}) AS r FROM absent WHERE u % 4 <> v % 4) n USING (gid, side, r) WHERE r <= floor(CAST(0.3 AS DOUBLE) * m)"""
    )
)
def community_rewire_candidates(spark, sf_dir):
    g, e = graph_view(spark, sf_dir)
    return graphs.community_rewiring(g, e, _labels(g), _K, 0.3, _order())


_WL = """,
l0 AS (SELECT gid, side, node, 'degree:' || degree AS label FROM deg),
l1 AS (SELECT l.gid, l.side, l.node, sha256(l.label || '(' || coalesce(string_agg(m.label, ',' ORDER BY m.label), '') || ')') AS label FROM l0 l LEFT JOIN nb n USING (gid, side, node) LEFT JOIN l0 m ON m.gid = n.gid AND m.side = n.side AND m.node = n.other GROUP BY l.gid, l.side, l.node, l.label),
l2 AS (SELECT l.gid, l.side, l.node, sha256(l.label || '(' || coalesce(string_agg(m.label, ',' ORDER BY m.label), '') || ')') AS label FROM l1 l LEFT JOIN nb n USING (gid, side, node) LEFT JOIN l1 m ON m.gid = n.gid AND m.side = n.side AND m.node = n.other GROUP BY l.gid, l.side, l.node, l.label),
wl AS (SELECT gid, side, feature, count(*) AS value FROM (SELECT gid, side, 'h0:' || label AS feature FROM l0 UNION ALL SELECT gid, side, 'h1:' || label FROM l1 UNION ALL SELECT gid, side, 'h2:' || label FROM l2) GROUP BY ALL),
ws AS (SELECT feature, coalesce(sum(value) FILTER (WHERE side = 'original'), 0) AS a, coalesce(sum(value) FILTER (WHERE side = 'perturbed'), 0) AS b FROM wl GROUP BY feature)"""


def _wl(spark, sf_dir):
    f = wl.wl_features(*graph_view(spark, sf_dir), _K, 2)
    return f, f.filter("side = 'original'"), f.filter("side = 'perturbed'")


@query(_graph("SELECT gid, side, feature, value FROM wl", _WL))
def wl_features(spark, sf_dir):
    return _wl(spark, sf_dir)[0]


@query(_graph(f"SELECT round(sum((a - b) / n * ((a - b) / n)), 6) AS mmd FROM (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM ws), (SELECT CAST(count(DISTINCT gid) AS DOUBLE) AS n FROM ggraphs)", _WL))
def wl_linear_mmd(spark, sf_dir):
    _, a, b = _wl(spark, sf_dir)
    n = graph_view(spark, sf_dir)[0].filter("side = 'original'").groupBy(F.lit(0).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return vectors.sparse_linear_mmd(a.withColumn("cell", F.lit(0)), b.withColumn("cell", F.lit(0)), n, n, ["cell"]).drop("cell")


@query(_graph("SELECT level, sum(a * a) AS xx, sum(b * b) AS yy, sum(a * b) AS xy, round(coalesce(sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0), 0), 6) AS cosine FROM (SELECT split_part(feature, ':', 1) AS level, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM ws) GROUP BY level", _WL))
def wl_level_decomposition(spark, sf_dir):
    return wl.level_parts(*_wl(spark, sf_dir)[1:])


@query(_graph("SELECT split_part(feature, ':', 1) AS level, count(*) AS labels, round(avg(CASE WHEN a + b = 1 THEN 1.0 ELSE 0.0 END), 6) AS singleton_share, count(*) FILTER (WHERE a > 0 AND b > 0) AS shared FROM ws GROUP BY 1", _WL))
def wl_resolution(spark, sf_dir):
    return wl.resolution(*_wl(spark, sf_dir)[1:])


@query(_graph("SELECT x.gid, x.side, y.gid AS other, CAST(sum(x.value * y.value) AS DOUBLE) AS k FROM wl x JOIN wl y ON x.side = y.side AND x.feature = y.feature AND x.gid <= y.gid GROUP BY ALL", _WL))
def gram_matrix(spark, sf_dir):
    return vectors.gram(wl.wl_features_by_graph(*graph_view(spark, sf_dir), _K, 2), ["side"], "gid").select("side", F.col("i").alias("gid"), F.col("j").alias("other"), "k")


# Vectors.


def _vec(body: str) -> str:
    return f"WITH {VECTOR_SQL}, x AS (SELECT pair AS id, x FROM vview WHERE side = 'X'), y AS (SELECT pair AS id, x FROM vview WHERE side = 'Y')\n{body}"


def _xy(spark, sf_dir):
    v = vector_view(spark, sf_dir)
    side = lambda s: v.filter(F.col("side") == s).select(F.col("pair").alias("id"), "x")
    return side("X"), side("Y")


def _k(p: str, q: str, h: str) -> str:
    return f"(SELECT avg(exp(-pow(list_distance(a.x, b.x), 2) / (2 * {h} * {h}))) FROM {p} a, {q} b)"


@query(_vec("SELECT id, round(list_distance(x.x, y.x), 6) AS distance FROM x JOIN y USING (id)"))
def l2_pairs(spark, sf_dir):
    return vectors.paired_distances(*_xy(spark, sf_dir))


@query(_vec("SELECT side, i, round(avg(v), 6) AS m FROM (SELECT side, unnest(x) AS v, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS i FROM vview) GROUP BY ALL"))
def mean_vector(spark, sf_dir):
    return vectors.dense_mean(vector_view(spark, sf_dir), ["side"]).select("side", F.posexplode("x").alias("i", "m"))


@query(_vec(f"SELECT round(xx, 6) AS xx, round(yy, 6) AS yy, round(xy, 6) AS xy, round(greatest(xx + yy - 2 * xy, 0), 6) AS mmd FROM (SELECT {_k('x', 'x', '10')} AS xx, {_k('y', 'y', '10')} AS yy, {_k('x', 'y', '10')} AS xy)"))
def rbf_mmd(spark, sf_dir):
    return vectors.rbf_mmd(*_xy(spark, sf_dir))


@query(_vec("SELECT bandwidth, round(xx, 6) AS xx, round(yy, 6) AS yy, round(xy, 6) AS xy, round(greatest(xx + yy - 2 * xy, 0), 6) AS mmd FROM (" + " UNION ALL ".join(f"SELECT CAST({h} AS DOUBLE) AS bandwidth, {_k('x', 'x', h)} AS xx, {_k('y', 'y', h)} AS yy, {_k('x', 'y', h)} AS xy" for h in ("1.0", "5.0", "25.0")) + ")"))
def bandwidth_sweep(spark, sf_dir):
    return vectors.bandwidth_sweep(*_xy(spark, sf_dir), [1.0, 5.0, 25.0])


def _row_mean(p: str, q: str) -> str:
    return f"(SELECT a.id, avg(exp(-pow(list_distance(a.x, b.x), 2) / 200)) AS k FROM {p} a, {q} b GROUP BY a.id)"


@query(_vec(f"SELECT id, round(xx.k + yy.k - xy.k - yx.k, 6) AS contribution FROM {_row_mean('x', 'x')} xx JOIN {_row_mean('y', 'y')} yy USING (id) JOIN {_row_mean('x', 'y')} xy USING (id) JOIN {_row_mean('y', 'x')} yx USING (id)"))
def mmd_contributions(spark, sf_dir):
    return vectors.mmd_contributions(*_xy(spark, sf_dir))


_LONG = "lx AS (SELECT id, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM x), ly AS (SELECT id, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM y), mx AS (SELECT i, avg(v) AS m, avg(v * v) AS q FROM lx GROUP BY i), my AS (SELECT i, avg(v) AS m, avg(v * v) AS q FROM ly GROUP BY i)"


def _vec_long(body: str) -> str:
    return _vec("").rstrip() + f", {_LONG}\n{body}"


@query(_vec_long("SELECT lx.id, round(sum((ly.v - lx.v) * (my.m - mx.m)), 6) AS contribution FROM lx JOIN ly ON lx.id = ly.id AND lx.i = ly.i JOIN mx ON mx.i = lx.i JOIN my ON my.i = lx.i GROUP BY lx.id"))
def linear_contributions(spark, sf_dir):
    return vectors.linear_contributions(*_xy(spark, sf_dir))


@query(_vec_long("SELECT round(sqrt(sum((mx.m - my.m) * (mx.m - my.m))), 6) AS mean_shift FROM mx JOIN my USING (i)"))
def linear_mmd(spark, sf_dir):
    return vectors.mean_distance(*_xy(spark, sf_dir))


@query(_vec_long("SELECT CAST(i - 1 AS INTEGER) AS i, round(d / sum(d) OVER (), 6) AS share FROM (SELECT i, mx.q + my.q - 2 * mx.m * my.m AS d FROM mx JOIN my USING (i))"))
def feature_shares(spark, sf_dir):
    return vectors.feature_shares(*_xy(spark, sf_dir))


@query(_vec("SELECT side, round(median(d), 6) AS bandwidth FROM (SELECT a.side, list_distance(a.x, b.x) AS d FROM vview a JOIN vview b ON a.side = b.side AND a.pair < b.pair) WHERE d > 0 GROUP BY side"))
def median_bandwidth(spark, sf_dir):
    return vectors.median_bandwidth(vector_view(spark, sf_dir), ["side"], "pair")


@query(_vec("SELECT side, (1 - min(k) <= 0.001 OR min(k) >= 0.99) AS nearly_constant FROM (SELECT a.side, exp(-pow(list_distance(a.x, b.x), 2) / 2000000) AS k FROM vview a JOIN vview b ON a.side = b.side AND a.pair < b.pair) GROUP BY side"))
def kernel_collapse(spark, sf_dir):
    return vectors.kernel_nearly_constant(vector_view(spark, sf_dir), ["side"], 1000.0, "pair")


@query(_vec_long("SELECT round(s / nullif(p, 0), 6) AS coherence, round(p, 6) AS paired, round(q[1], 6) AS q10, round(q[2], 6) AS q25, round(q[3], 6) AS q50, round(q[4], 6) AS q75, round(q[5], 6) AS q90 FROM (SELECT avg(d) AS p, quantile_cont(d, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM (SELECT list_distance(x.x, y.x) AS d FROM x JOIN y USING (id))), (SELECT sqrt(sum((mx.m - my.m) * (mx.m - my.m))) AS s FROM mx JOIN my USING (i))"))
def coherence(spark, sf_dir):
    x, y = _xy(spark, sf_dir)
    return vectors.coherence(vectors.paired_distances(x, y), vectors.mean_distance(x, y))


# Contrasts, tests and audits.

_TOL = "CAST(1e-12 AS DOUBLE) * greatest(1, max(abs(s)) OVER (PARTITION BY workflow, dataset, perturbation))"
_STEPS = f"""base AS (SELECT {_KEYS}, seed, alpha, distribution_score AS s, edit_distance_raw AS e FROM ok), tb AS (SELECT *, {_TOL} AS tol FROM base),
steps AS (SELECT {_KEYS}, seed, tol, alpha AS alpha_low, lead(alpha) OVER w AS alpha_high, lead(s) OVER w - s AS d, lead(e) OVER w - e AS de, 'adjacent' AS contrast FROM tb WINDOW w AS (PARTITION BY {_KEYS}, seed ORDER BY alpha)),
ends AS (SELECT {_KEYS}, seed, max(tol) AS tol, max(CASE WHEN abs(alpha - 1) < 1e-9 THEN s END) - max(CASE WHEN abs(alpha - CAST(0.1 AS DOUBLE)) < 1e-9 THEN s END) AS d FROM tb GROUP BY ALL),
contrasts AS (SELECT {_KEYS}, seed, tol, alpha_low, alpha_high, d, contrast FROM steps WHERE alpha_high IS NOT NULL UNION ALL SELECT {_KEYS}, seed, tol, CAST(0.1 AS DOUBLE), 1.0, d, 'endpoint' FROM ends WHERE d IS NOT NULL)"""


def _steps(body: str, more: str = "") -> str:
    return _results("").rstrip() + f", {_STEPS}{more}\n{body}"


def _contrasts(spark, sf_dir):
    return stats.contrasts(evaluate.successes(results_view(spark, sf_dir)))


@query(_steps(f"SELECT {_KEYS}, seed, contrast, alpha_low, alpha_high, round(d, 6) AS d FROM contrasts"))
def contrasts(spark, sf_dir):
    return _contrasts(spark, sf_dir).drop("tol")


@query(
    _steps(
        f"""SELECT *, against AS opposes_nonzero, against AND 2 * greatest(positive, negative) > n AS opposes_majority FROM (SELECT {_KEYS}, contrast, alpha_low, alpha_high, round(avg(d), 6) AS mean_change, round(median(d), 6) AS median_change,
  count(*) FILTER (WHERE d > tol) AS positive, count(*) FILTER (WHERE d < -tol) AS negative, count(*) FILTER (WHERE abs(d) <= tol) AS zero, count(*) AS n,
  (avg(d) > max(tol) AND count(*) FILTER (WHERE d < -tol) > count(*) FILTER (WHERE d > tol)) OR (avg(d) < -max(tol) AND count(*) FILTER (WHERE d > tol) > count(*) FILTER (WHERE d < -tol)) AS against FROM contrasts GROUP BY ALL)"""
    ).replace("SELECT *, against AS", "SELECT * EXCLUDE (n, against), against AS")
)
def adjacent_steps(spark, sf_dir):
    return stats.step_summary(_contrasts(spark, sf_dir))


@query(_steps(f"SELECT {_KEYS}, count(*) AS seeds, count(*) FILTER (WHERE falls) AS seeds_with_decrease, count(*) FILTER (WHERE NOT falls) AS seeds_nondecreasing, CAST(sum(unchanged) AS BIGINT) AS unchanged_with_more_edits FROM (SELECT {_KEYS}, seed, coalesce(bool_or(alpha_low > 0 AND d < -tol), false) AS falls, count(*) FILTER (WHERE abs(d) <= tol AND de > 1e-9) AS unchanged FROM steps WHERE d IS NOT NULL GROUP BY ALL) GROUP BY ALL"))
def seed_granularity(spark, sf_dir):
    return stats.seed_granularity(evaluate.successes(results_view(spark, sf_dir)))


@query(_results(f"SELECT {_KEYS}, seed, alpha AS peak_alpha FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS}, seed ORDER BY distribution_score DESC, alpha) AS r FROM ok) WHERE r = 1"))
def seed_peaks(spark, sf_dir):
    return stats.first_peaks(evaluate.successes(results_view(spark, sf_dir)))


@query(_results(f"SELECT {_KEYS}, alpha, round(avg(distribution_score), 6) AS mean, round(quantile_cont(distribution_score, 0.25), 6) AS q25, round(median(distribution_score), 6) AS median, round(quantile_cont(distribution_score, 0.75), 6) AS q75 FROM ok GROUP BY ALL"))
def shape_quantiles(spark, sf_dir):
    return stats.quantile_curves(evaluate.successes(results_view(spark, sf_dir)))


_SIGNS = """,
sg AS (SELECT workflow, dataset, perturbation, alpha_low, alpha_high, count(*) FILTER (WHERE x > t) AS positive, count(*) FILTER (WHERE x < -t) AS negative, count(*) FILTER (WHERE abs(x) <= t) AS zero
  FROM (SELECT *, d AS x, CAST(1e-12 AS DOUBLE) * greatest(1, max(abs(d)) OVER (PARTITION BY workflow, dataset, perturbation, alpha_low, alpha_high)) AS t FROM contrasts WHERE contrast = 'adjacent') GROUP BY ALL),
sp AS (SELECT *, CASE WHEN positive + negative = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(least(positive, negative) + 1), lambda i: CAST(factorial(CAST(positive + negative AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(i AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(positive + negative - i AS INTEGER)) AS DOUBLE))) / pow(2, positive + negative)) END AS p FROM sg)"""
_FAMILY = ["workflow", "dataset", "perturbation", "alpha_low", "alpha_high"]


def _sign_rows(spark, sf_dir):
    return stats.sign_summary(_contrasts(spark, sf_dir).filter("contrast = 'adjacent'"), _FAMILY)


@query(_steps("SELECT workflow, dataset, perturbation, alpha_low, alpha_high, positive, negative, zero, round(p, 6) AS p FROM sp", _SIGNS))
def sign_counts(spark, sf_dir):
    return _sign_rows(spark, sf_dir)


@query(_steps("SELECT workflow, dataset, perturbation, alpha_low, alpha_high, round(p, 6) AS p, round(least(1, max(p * k) OVER (PARTITION BY dataset ORDER BY p, workflow, perturbation, alpha_low ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM (SELECT *, count(*) OVER (PARTITION BY dataset) - row_number() OVER (PARTITION BY dataset ORDER BY p, workflow, perturbation, alpha_low) + 1 AS k FROM (SELECT * REPLACE (round(p, 9) AS p) FROM sp))", _SIGNS))
def holm(spark, sf_dir):
    rows = _sign_rows(spark, sf_dir).withColumn("p", F.round("p", 9))
    return stats.holm(rows, "p", ["dataset"], ["workflow", "perturbation", "alpha_low"]).select(*_FAMILY, "p", "p_holm")


@query(_steps(f"SELECT {_KEYS}, n, round(m, 6) AS mean, round(q[3], 6) AS median, round(sd, 6) AS sd, round(sk, 6) AS skewness, round((q[4] + q[2] - 2 * q[3]) / nullif(q[4] - q[2], 0), 6) AS bowley, round((q[5] + q[1] - 2 * q[3]) / nullif(q[5] - q[1], 0), 6) AS tail, CASE WHEN q[4] - q[2] > 1e-9 THEN len(list_filter(xs, lambda x: x < q[2] - 1.5 * (q[4] - q[2]) OR x > q[4] + 1.5 * (q[4] - q[2])))::DOUBLE END AS tukey_outliers FROM (SELECT {_KEYS}, count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd, skewness(d) AS sk, quantile_cont(d, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q, list(d) AS xs FROM ends WHERE d IS NOT NULL GROUP BY ALL)"))
def shape(spark, sf_dir):
    return stats.shape(_contrasts(spark, sf_dir).filter("contrast = 'endpoint'"), S.SETTING).drop("constant", "excess_kurtosis").withColumn("tukey_outliers", F.col("tukey_outliers").cast("double"))


@query(_results(f"SELECT {_KEYS}, seed, round(rho, 6) AS rho, round(b - a, 6) AS endpoint_difference FROM {_spearman('alpha', 'distribution_score', 'rho', '(SELECT * FROM ok WHERE alpha > 0)', _KEYS + ', seed')} JOIN (SELECT {_KEYS}, seed, max(CASE WHEN abs(alpha - CAST(0.1 AS DOUBLE)) < 1e-9 THEN distribution_score END) AS a, max(CASE WHEN abs(alpha - 1) < 1e-9 THEN distribution_score END) AS b FROM ok GROUP BY ALL) USING ({_KEYS}, seed)"))
def seed_trends(spark, sf_dir):
    return stats.seed_trends(evaluate.successes(results_view(spark, sf_dir)))


@query(_results("SELECT dataset, perturbation, workflow, min(alpha) AS plateau_alpha FROM (SELECT *, bool_and(same) OVER (PARTITION BY dataset, perturbation, workflow ORDER BY alpha DESC) AS stays FROM (SELECT dataset, perturbation, workflow, alpha, bool_and(abs(x - z) <= 1e-10) AS same FROM (SELECT *, last(x) OVER (PARTITION BY dataset, perturbation, workflow, seed ORDER BY alpha ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM (SELECT *, floor(least(alpha, 0.6) * 10 + seed) AS x FROM ok)) GROUP BY ALL)) WHERE stays GROUP BY ALL"))
def plateaus(spark, sf_dir):
    rows = evaluate.successes(results_view(spark, sf_dir)).withColumn("edit_distance_raw", F.floor(F.least("alpha", F.lit(0.6)) * 10 + F.col("seed")).cast("double"))
    return stats.plateaus(rows)


@query(_results("SELECT workflow, round(min(distribution_score), 6) AS low, round(max(distribution_score), 6) AS high, round(max(abs(distribution_score - pow(mean_shift_score, CASE workflow WHEN 'A' THEN 2 ELSE 1 END))), 6) AS max_error FROM ok GROUP BY workflow"))
def score_identities(spark, sf_dir):
    return stats.score_identities(evaluate.successes(results_view(spark, sf_dir)), {"A": 2})


@query(_results("SELECT dataset, perturbation, workflow, n_rows, count(*) AS n FROM rview GROUP BY ALL HAVING count(*) > 1"))
def duplicate_guard(spark, sf_dir):
    return stats.duplicate_keys(results_view(spark, sf_dir), ["dataset", "perturbation", "workflow", "n_rows"])


@query(_results(f"SELECT k.*, a.alpha, s.seed FROM (SELECT DISTINCT {_KEYS} FROM ok) k CROSS JOIN (SELECT DISTINCT alpha FROM ok) a CROSS JOIN (SELECT DISTINCT seed FROM ok) s ANTI JOIN ok o ON o.workflow = k.workflow AND o.dataset = k.dataset AND o.perturbation = k.perturbation AND o.alpha = a.alpha AND o.seed = s.seed"))
def grid_completeness(spark, sf_dir):
    return stats.missing_cells(evaluate.successes(results_view(spark, sf_dir)))


@query(
    _results(
        """SELECT 'not_successful' AS "check", count(*) FILTER (WHERE status <> 'success') AS n FROM rview UNION ALL SELECT 'score_not_finite', count(*) FILTER (WHERE distribution_score IS NULL OR paired_score IS NULL OR mean_shift_score IS NULL) FROM ok
UNION ALL SELECT 'score_negative', count(*) FILTER (WHERE distribution_score < 0 OR paired_score < 0 OR mean_shift_score < 0) FROM ok UNION ALL SELECT 'edits_negative', count(*) FILTER (WHERE edit_distance_raw < 0) FROM ok
UNION ALL SELECT 'edits_at_alpha_zero', count(*) FILTER (WHERE alpha = 0 AND edit_distance_raw <> 0) FROM ok UNION ALL SELECT 'score_at_alpha_zero', count(*) FILTER (WHERE alpha = 0 AND distribution_score > 1e-9) FROM ok
UNION ALL SELECT 'alpha_out_of_range', count(*) FILTER (WHERE alpha NOT BETWEEN 0 AND 1) FROM rview UNION ALL SELECT 'rbf_mmd_above_two', 0 UNION ALL SELECT 'weighted_below_raw', count(*) FILTER (WHERE edit_distance_weighted < edit_distance_raw - 1e-9) FROM ok
UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT 1 FROM rview GROUP BY dataset, perturbation, alpha, seed, workflow HAVING count(*) > 1)"""
    )
)
def constraint_audit(spark, sf_dir):
    return stats.constraint_audit(results_view(spark, sf_dir))


@query()
def contrast_tests(spark, sf_dir):
    return stats.contrast_tests(_contrasts(spark, sf_dir))


@query()
def corrected_slots(spark, sf_dir):
    return stats.corrected_slots(stats.contrast_tests(_contrasts(spark, sf_dir)))


@query()
def screen_counts(spark, sf_dir):
    return stats.screen_counts(stats.contrast_tests(_contrasts(spark, sf_dir)))


# Kernels, generators and the run layer.


@query()
def netlsd_signature(spark, sf_dir):
    return kernels.netlsd(*graph_view(spark, sf_dir), _K).select("gid", "side", F.posexplode("x").alias("i", "h"))


#: Traces of powers of the normalised Laplacian, which are power sums of its eigenvalues.
_MOMENTS = """,
pe AS (SELECT e.gid, e.side, sum(1.0 / (CAST(a.degree AS DOUBLE) * b.degree)) AS s FROM gedges e JOIN deg a ON a.gid = e.gid AND a.side = e.side AND a.node = e.u JOIN deg b ON b.gid = e.gid AND b.side = e.side AND b.node = e.v GROUP BY ALL),
pt AS (SELECT t.gid, t.side, sum(1.0 / (CAST(a.degree AS DOUBLE) * b.degree * c.degree)) AS s FROM tri t JOIN deg a ON a.gid = t.gid AND a.side = t.side AND a.node = t.a JOIN deg b ON b.gid = t.gid AND b.side = t.side AND b.node = t.b JOIN deg c ON c.gid = t.gid AND c.side = t.side AND c.node = t.c GROUP BY ALL),
mo AS (SELECT d.gid, d.side, count(*) AS n, CAST(count(*) FILTER (WHERE degree > 0) AS DOUBLE) AS m1, count(*) FILTER (WHERE degree > 0) + 2 * coalesce(any_value(pe.s), 0) AS m2, count(*) FILTER (WHERE degree > 0) + 6 * coalesce(any_value(pe.s), 0) - 6 * coalesce(any_value(pt.s), 0) AS m3
  FROM deg d LEFT JOIN pe USING (gid, side) LEFT JOIN pt USING (gid, side) GROUP BY d.gid, d.side)"""


@query(_graph("SELECT gid, side, round(m1, 6) AS m1, round(m2, 6) AS m2, round(m3, 6) AS m3 FROM mo", _MOMENTS))
def spectral_moments(spark, sf_dir):
    x = F.col("eigenvalue")
    return kernels.spectra(*graph_view(spark, sf_dir), _K).groupBy(*_K).agg(F.sum(x).alias("m1"), F.sum(x * x).alias("m2"), F.sum(x * x * x).alias("m3"))


@query(_graph("SELECT gid, side, round((n - t * m1 + t * t / 2 * m2 - t * t * t / 6 * m3) / n, 6) AS h FROM mo, (SELECT CAST(0.01 AS DOUBLE) AS t)", _MOMENTS))
def heat_trace_start(spark, sf_dir):
    """The heat trace at its first time, where its series is short."""
    return kernels.netlsd(*graph_view(spark, sf_dir), _K).select("gid", "side", F.col("x")[0].alias("h"))


@query()
def spectra(spark, sf_dir):
    return kernels.spectra(*graph_view(spark, sf_dir), _K)


@query()
def diversity_curve(spark, sf_dir):
    return kernels.diversity(*graph_view(spark, sf_dir), _K, range(1, NODES + 1)).select("gid", "side", F.posexplode("x").alias("i", "spread"))


#: Shortest paths one by one, their number by pair of ends, and node and edge shares.
_PATHS = _WALKS + """,
sp AS (SELECT gid, side, node AS s, node AS t, 0 AS d FROM gnodes UNION ALL SELECT p.gid, p.side, p.s, n.other, p.d + 1 FROM sp p JOIN nb n ON n.gid = p.gid AND n.side = p.side AND n.node = p.t JOIN dist x ON x.gid = p.gid AND x.side = p.side AND x.s = p.s AND x.t = n.other AND x.d = p.d + 1),
sig AS (SELECT gid, side, s, t, any_value(d) AS d, CAST(count(*) AS DOUBLE) AS c FROM sp GROUP BY gid, side, s, t),
eb AS (SELECT e.gid, e.side, e.u, e.v, sum(a.c * b.c / z.c) AS weight FROM gedges e JOIN sig a ON a.gid = e.gid AND a.side = e.side AND a.t = e.u JOIN sig b ON b.gid = e.gid AND b.side = e.side AND b.s = e.v JOIN sig z ON z.gid = e.gid AND z.side = e.side AND z.s = a.s AND z.t = b.t AND z.d = a.d + 1 + b.d GROUP BY ALL),
nw AS (SELECT a.gid, a.side, a.t AS node, sum(a.c * b.c / z.c) AS score FROM sig a JOIN sig b ON a.gid = b.gid AND a.side = b.side AND a.t = b.s AND a.s <> a.t AND b.t <> b.s AND a.s < b.t JOIN sig z ON z.gid = a.gid AND z.side = a.side AND z.s = a.s AND z.t = b.t AND z.d = a.d + b.d WHERE a.side = 'original' GROUP BY ALL)"""


@query(_graph("SELECT o.gid, o.u, o.v, round(1 + coalesce(x.score, 0) / coalesce(m, 1) * coalesce(y.score, 0) / coalesce(m, 1), 6) AS weight FROM (SELECT DISTINCT gid, u, v FROM ops) o LEFT JOIN nw x ON x.gid = o.gid AND x.node = o.u LEFT JOIN nw y ON y.gid = o.gid AND y.node = o.v LEFT JOIN (SELECT gid, max(score) AS m FROM nw GROUP BY gid) k ON k.gid = o.gid", _OPS + _PATHS))
def betweenness_weights(spark, sf_dir):
    g, a, b = _sides(spark, sf_dir)
    ops = graphs.edit_ops(a, b, ["gid"])
    return graphs.product_weights(ops, kernels.node_betweenness(g, a, ["gid"]), ["gid"])


@query(_graph("SELECT gid, side, u, v, round(weight, 6) AS weight FROM eb", _PATHS))
def edge_betweenness(spark, sf_dir):
    return kernels.edge_betweenness(*graph_view(spark, sf_dir), _K)


@query()
def communities(spark, sf_dir):
    return kernels.detect_communities(*graph_view(spark, sf_dir), _K)


@query(_graph("SELECT gid, side, d.node, d.degree, coalesce(near, '') AS near, coalesce(far, '') AS far FROM deg d LEFT JOIN (SELECT n.gid, n.side, n.node, string_agg(CAST(e.degree AS VARCHAR), ',' ORDER BY e.degree) AS near FROM nb n JOIN deg e ON e.gid = n.gid AND e.side = n.side AND e.node = n.other GROUP BY ALL) a USING (gid, side, node) LEFT JOIN (SELECT p.gid, p.side, p.node, string_agg(CAST(e.degree AS VARCHAR), ',' ORDER BY e.degree) AS far FROM (SELECT DISTINCT x.gid, x.side, x.node, y.other AS t FROM nb x JOIN nb y ON x.gid = y.gid AND x.side = y.side AND x.other = y.node AND x.node <> y.other) p JOIN deg e ON e.gid = p.gid AND e.side = p.side AND e.node = p.t GROUP BY ALL) b USING (gid, side, node)"))
def local_signatures(spark, sf_dir):
    out = graphs.local_signatures(*graph_view(spark, sf_dir), _K)
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("near", "far")})


@query(_graph("SELECT gid, bool_and(a IS NOT DISTINCT FROM b) AS equal FROM (SELECT gid, sum(CASE WHEN side = 'original' THEN u * 100 + v END) AS a, sum(CASE WHEN side = 'perturbed' THEN u * 100 + v END) AS b FROM gedges GROUP BY gid) GROUP BY gid"))
def structurally_equal(spark, sf_dir):
    g, a, b = _sides(spark, sf_dir)
    return graphs.structurally_equal(graphs.edge_hash(a, g, ["gid"]), graphs.edge_hash(b, g, ["gid"]), ["gid"])


_GRID = "SELECT d.dataset, p.perturbation, a.alpha, s.seed, w.workflow FROM (SELECT DISTINCT dataset FROM rview) d, (SELECT DISTINCT perturbation FROM rview) p, (SELECT DISTINCT alpha FROM rview) a, (SELECT DISTINCT seed FROM rview) s, (SELECT DISTINCT workflow FROM rview) w"


@query(_results(f"SELECT g.* FROM ({_GRID}) g ANTI JOIN rview r ON r.dataset = g.dataset AND r.perturbation = g.perturbation AND r.alpha = g.alpha AND r.seed = g.seed AND r.workflow = g.workflow AND r.status <> 'failed'"))
def resume_antijoin(spark, sf_dir):
    """The grid's cells that have no row but a failed one."""
    blank = {c: F.lit("{}") for c in ("dataset_params", "workflow_params")}
    done = results_view(spark, sf_dir).withColumns(blank)
    grid = done.select("dataset").distinct()
    for c in ("perturbation", "alpha", "seed", "workflow"):
        grid = grid.crossJoin(done.select(c).distinct())
    return experiment.pending(grid.withColumns(blank), done, rerun_failed=True).select("dataset", "perturbation", "alpha", "seed", "workflow")


@query(_results("SELECT dataset, perturbation, alpha, seed, workflow, distribution_score FROM (SELECT *, row_number() OVER (PARTITION BY dataset, perturbation, alpha, seed, workflow ORDER BY shard) AS r FROM (SELECT *, 0 AS shard FROM rview WHERE seed < 4 UNION ALL SELECT * REPLACE (distribution_score + 1 AS distribution_score), 1 FROM rview WHERE seed >= 2)) WHERE r = 1"))
def merge_dedup(spark, sf_dir):
    """Two shards that overlap, the first one's rows winning."""
    same = {c: F.lit("{}") for c in ("dataset_params", "workflow_params")} | {c: F.lit("x") for c in ("schema_version", "randomness_protocol", "code_fingerprint")}
    rows = results_view(spark, sf_dir).withColumns(same)
    out = experiment.merge_runs([rows.filter("seed < 4"), rows.filter("seed >= 2").withColumn("distribution_score", F.col("distribution_score") + 1)])
    return out.select("dataset", "perturbation", "alpha", "seed", "workflow", "distribution_score")


@query()
def generated_graphs(spark, sf_dir):
    """A small population of each family, with its structure."""
    config = experiment.Experiment("small", experiment.default_datasets(20, 30), seeds=(0, 1))
    rows = experiment.originals(spark, config)
    return rows.select("dataset", "seed", "graph_index", "num_nodes", F.size("edges").alias("num_edges"))


@query()
def experiment_results(spark, sf_dir):
    """The debug experiment from generation to scores; runtimes are left out, as they differ from run to run."""
    return experiment.results(spark, experiment.debug_experiment()).select("dataset", "seed", "perturbation", "alpha", "workflow", "graph_count", "distribution_score", "mean_shift_score", "paired_score", "edit_distance_raw", "edit_distance_weighted", "status")


@query(_graph("SELECT side, round(h, 6) AS bandwidth, round(avg(exp(-d2 / (2 * h * h))), 6) AS kernel FROM (SELECT p.side, p.d2, m.h FROM gd p JOIN (SELECT side, coalesce(median(sqrt(d2)) FILTER (WHERE d2 > 0), 1) AS h FROM gd GROUP BY side) m USING (side)) GROUP BY side, h", _WL + ",\ngk AS (SELECT x.side, x.gid AS i, y.gid AS j, CAST(sum(x.value * y.value) AS DOUBLE) AS k FROM wl x JOIN wl y ON x.side = y.side AND x.feature = y.feature AND x.gid <= y.gid GROUP BY ALL),\ngd AS (SELECT a.side, a.i, b.i AS j, greatest(a.k + b.k - 2 * coalesce(g.k, 0), 0) AS d2 FROM gk a JOIN gk b ON a.side = b.side AND a.i = a.j AND b.i = b.j AND a.i < b.i LEFT JOIN gk g ON g.side = a.side AND g.i = a.i AND g.j = b.i)"))
def wl_rbf(spark, sf_dir):
    """An RBF kernel on subtree features, through dot products, at the median distance."""
    return vectors.rbf_from_distances(vectors.gram_distances(_wl(spark, sf_dir)[0], ["side"], "gid"), ["side"])


@query()
def trace_bands(spark, sf_dir):
    return kernels.trace_bands(kernels.netlsd(*graph_view(spark, sf_dir), _K), _K)


@query(_graph("""SELECT g.gid, g.side, sha256(CAST(g.num_nodes AS VARCHAR) || '|' || coalesce('[' || string_agg('{"u":' || e.u || ',"v":' || e.v || '}', ',' ORDER BY e.u, e.v) || ']', '[]')) AS graph_sha256 FROM ggraphs g LEFT JOIN gedges e USING (gid, side) GROUP BY g.gid, g.side, g.num_nodes"""))
def graph_hashes(spark, sf_dir):
    g, e = graph_view(spark, sf_dir)
    return graphs.edge_hash(e, g, _K)


@query(_graph("SELECT side AS split, count(*) AS records, count(*) - count(DISTINCT gid) AS duplicates, min(num_nodes) AS num_nodes_min, CAST(median(num_nodes) AS DOUBLE) AS num_nodes_median, max(num_nodes) AS num_nodes_max, min(num_edges) AS num_edges_min, CAST(median(num_edges) AS DOUBLE) AS num_edges_median, max(num_edges) AS num_edges_max FROM sizes GROUP BY side"))
def cache_audit(spark, sf_dir):
    d = graphs.density(*graph_view(spark, sf_dir), _K).withColumnsRenamed({"side": "split", "gid": "source_id"})
    return stats.cache_audit(d)


@query(_results("SELECT dataset, perturbation, array_to_string(list_sort(list_distinct(list(status || ' at ' || CAST(seed AS VARCHAR)))), '; ') AS error_message FROM rview WHERE status <> 'failed' GROUP BY ALL HAVING bool_and(status = 'skipped')"))
def skip_errors(spark, sf_dir):
    rows = results_view(spark, sf_dir).filter("status <> 'failed'").withColumn("error_message", F.concat("status", F.lit(" at "), F.col("seed").cast("string")))
    return graphs.skip_errors(rows, ["dataset", "perturbation"])


@query(_results("SELECT dataset, perturbation, alpha, round(sum(edit_distance_raw), 6) AS edit_distance_raw, arg_min(CASE WHEN seed > 1 THEN workflow END, seed) FILTER (WHERE seed > 1) AS label_source FROM (SELECT *, row_number() OVER (PARTITION BY dataset, perturbation, alpha, seed ORDER BY workflow) AS r FROM ok) WHERE r = 1 GROUP BY ALL"))
def perturbation_summary(spark, sf_dir):
    """Cell sums of edits, and of labels the first that is there in order."""
    rows = evaluate.successes(results_view(spark, sf_dir)).groupBy("dataset", "perturbation", "alpha", "seed").agg(F.min(F.struct("workflow", "edit_distance_raw")).alias("f"))
    rows = rows.select("dataset", "perturbation", "alpha", F.col("seed").alias("graph_index"), F.col("f.edit_distance_raw").alias("edit_distance_raw"), F.when(F.col("seed") > 1, F.col("f.workflow")).alias("label_source"), F.lit(None).cast("string").alias("perturbation_family"), F.lit(None).cast("string").alias("perturbation_direction"))
    return graphs.perturbation_summary(rows, ["dataset", "perturbation", "alpha"], ["edit_distance_raw"]).select("dataset", "perturbation", "alpha", "edit_distance_raw", "label_source")


# Analyses of pairs: the seeds of a setting stand for its graphs, scores for distances.

_PAIR = "pr AS (SELECT dataset, perturbation, workflow, seed AS graph_index, alpha, distribution_score AS distance, paired_score AS contribution, edit_distance_raw AS raw_edits, mean_shift_score AS shift FROM ok)"


def _pairs_sql(body: str, more: str = "") -> str:
    return _results("").rstrip() + f", {_PAIR}{more}\n{body}"


def _pairs(spark, sf_dir):
    rows = evaluate.successes(results_view(spark, sf_dir))
    return rows.select("dataset", "perturbation", "workflow", F.col("seed").alias("graph_index"), "alpha", F.col("distribution_score").alias("distance"), F.col("paired_score").alias("contribution"), F.col("edit_distance_raw").alias("raw_edits"), F.col("mean_shift_score").alias("shift"))


_SET = ["dataset", "perturbation", "workflow"]


@query(_pairs_sql("SELECT dataset, perturbation, alpha, count(*) AS graphs, count(*) FILTER (WHERE raw_edits = 0) AS no_ops, round(avg(raw_edits) + CAST(1e-8 AS DOUBLE), 6) AS mean_raw_edits, round(avg(distance), 6) AS mean_distance, round(avg(shift), 6) AS mean_shift FROM pr GROUP BY ALL"))
def cell_structure(spark, sf_dir):
    out = diagnose.cell_structure(_pairs(spark, sf_dir), ["distance"], ["shift"], ["dataset", "perturbation", "alpha"])
    # Away from ties of rounding.
    return out.withColumn("mean_raw_edits", F.col("mean_raw_edits") + 1e-8)


@query(_pairs_sql("SELECT dataset, perturbation, workflow, alpha, round(avg(distance), 6) AS paired_score, round(q[1], 6) AS q0, round(q[2], 6) AS q25, round(q[3], 6) AS q50, round(q[4], 6) AS q75, round(q[5], 6) AS q90, round(q[6], 6) AS q100, changed_graphs, changed_at_zero FROM (SELECT dataset, perturbation, workflow, alpha, avg(distance) AS distance, quantile_cont(distance, [0, 0.25, 0.5, 0.75, 0.9, 1]) AS q, count(*) FILTER (WHERE raw_edits > 0) AS changed_graphs, count(*) FILTER (WHERE raw_edits > 0 AND distance <= 1e-10) AS changed_at_zero FROM pr GROUP BY ALL) GROUP BY ALL"))
def distance_rows(spark, sf_dir):
    return diagnose.distance_rows(_pairs(spark, sf_dir), [*_SET, "alpha"])


@query(
    _pairs_sql(
        """SELECT dataset, perturbation, workflow, count(*) AS graphs, count(*) FILTER (WHERE f > 0) AS graphs_that_fall, CAST(sum(d) AS BIGINT) AS falls_despite_more_edits, CAST(sum(m) AS BIGINT) AS steps_with_more_edits FROM
  (SELECT dataset, perturbation, workflow, graph_index, count(*) FILTER (WHERE distance - d0 < -tol AND a0 > 0) AS f, count(*) FILTER (WHERE distance - d0 < -tol AND raw_edits > e0) AS d, count(*) FILTER (WHERE raw_edits > e0) AS m FROM st GROUP BY ALL) GROUP BY ALL""",
        """,
st AS (SELECT *, lag(distance) OVER w AS d0, lag(raw_edits) OVER w AS e0, lag(alpha) OVER w AS a0, CAST(1e-10 AS DOUBLE) * greatest(1, max(abs(distance)) OVER (PARTITION BY dataset, perturbation, workflow)) AS tol FROM pr WINDOW w AS (PARTITION BY dataset, perturbation, workflow, graph_index ORDER BY alpha))""",
    )
)
def distance_trajectories(spark, sf_dir):
    return diagnose.trajectories(_pairs(spark, sf_dir), _SET)


@query(
    _pairs_sql(
        """SELECT dataset, perturbation, workflow, count(*) AS graphs, count(*) FILTER (WHERE d > 1e-10) AS rises, count(*) FILTER (WHERE d < -1e-10) AS falls, count(*) FILTER (WHERE abs(d) <= 1e-10) AS stays, round(avg(d), 6) AS mean_change, round(median(d), 6) AS median_change,
  count(*) FILTER (WHERE c > 1e-10) AS contribution_rises, count(*) FILTER (WHERE c < -1e-10) AS contribution_falls, round(avg(c), 6) AS mmd_change FROM tr WHERE d IS NOT NULL GROUP BY ALL""",
        """,
tr AS (SELECT dataset, perturbation, workflow, graph_index, max(CASE WHEN abs(alpha - CAST(0.4 AS DOUBLE)) < 1e-9 THEN distance END) - max(CASE WHEN abs(alpha - CAST(0.3 AS DOUBLE)) < 1e-9 THEN distance END) AS d, max(CASE WHEN abs(alpha - CAST(0.4 AS DOUBLE)) < 1e-9 THEN contribution END) - max(CASE WHEN abs(alpha - CAST(0.3 AS DOUBLE)) < 1e-9 THEN contribution END) AS c FROM pr GROUP BY ALL)""",
    )
)
def distance_transitions(spark, sf_dir):
    return diagnose.transitions(_pairs(spark, sf_dir), keys=_SET)


@query(_results(f"SELECT {_KEYS}, alpha, seed, distribution_score AS saved, mean_shift_score AS again, round(abs(distribution_score - mean_shift_score), 6) AS error, abs(distribution_score - mean_shift_score) <= 5 AS reproduced FROM ok"))
def score_reproduction(spark, sf_dir):
    rows = evaluate.successes(results_view(spark, sf_dir))
    keys = [*S.SETTING, "alpha", "seed"]
    return diagnose.reproduction(rows, rows.drop("distribution_score").withColumnRenamed("mean_shift_score", "distribution_score"), "distribution_score", keys, 5.0)


@query(
    _results("").rstrip()
    + f""", ho AS (SELECT dataset, workflow, perturbation, seed, rho FROM {_spearman('alpha', 'distribution_score', 'rho', '(SELECT * FROM ok WHERE alpha > 0)', _KEYS + ', seed')}),
fa AS (SELECT {_KEYS}, seed, count(*) FILTER (WHERE d < -1e-10) AS falls FROM (SELECT {_KEYS}, seed, distribution_score - lag(distribution_score) OVER (PARTITION BY {_KEYS}, seed ORDER BY alpha) AS d FROM ok WHERE alpha > 0) GROUP BY ALL)
SELECT dataset, workflow, perturbation, count(*) AS replicates, round(median(rho), 6) AS median_rho, CAST(sum(falls) AS BIGINT) AS falls FROM ho JOIN fa USING (dataset, workflow, perturbation, seed) GROUP BY ALL"""
)
def community_comparison(spark, sf_dir):
    return diagnose.community_comparison(evaluate.successes(results_view(spark, sf_dir)), ("dataset", "workflow", "perturbation"))


@query(
    _vec("").rstrip()
    + """, dr AS (SELECT CAST(w AS INTEGER) AS without FROM range(8) t(w)), cut AS (SELECT side, pair AS id, without, list_filter(x[1:8], lambda v, i: i <> without + 1) AS x FROM vview, dr),
kk AS (SELECT a.without, a.side AS p, b.side AS q, avg(exp(-pow(list_distance(a.x, b.x), 2) / 2)) AS k FROM cut a JOIN cut b ON a.without = b.without GROUP BY ALL)
SELECT without, round(greatest(sum(CASE WHEN p = q THEN k ELSE -k END), 0), 6) AS mmd FROM kk GROUP BY without"""
)
def descriptor_ablation(spark, sf_dir):
    x, y = (d.withColumn("x", F.slice("x", 1, 8)) for d in _xy(spark, sf_dir))
    return diagnose.ablation(x, y, 8, 1.0)
