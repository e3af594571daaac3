"""Operators on populations of graphs.

A population is two tables: graphs (key columns, num_nodes) and edges (key columns, u, v) with u < v. Keys are any columns; every operator
takes them as `keys`. Isolated nodes stand in num_nodes only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexum.functions.columns import finite


def normalized(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """u < v, each edge once. A loop is an error."""
    loop = F.assert_true(F.col("u") != F.col("v"), F.lit("a loop is no edge"))
    checked = edges.filter(loop.isNull())
    return checked.select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def nodes(graphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    some = graphs.filter(F.col("num_nodes") > 0)
    return some.select(*keys, F.explode(F.sequence(F.lit(0), F.col("num_nodes") - 1)).alias("node"))


def neighbours(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(node, other) in both directions, without a second scan."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))).alias("e")
    return edges.select(*keys, ends).select(*keys, "e.node", "e.other")


def add_edges(edges: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    return edges.select(*keys, "u", "v").unionByName(normalized(more, keys)).distinct()


def remove_edges(edges: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return edges.join(normalized(gone, keys), [*keys, "u", "v"], "left_anti")


def has_edges(pairs: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The pairs that are edges, in either order of their ends."""
    return pairs.withColumns({"_u": F.least("u", "v"), "_v": F.greatest("u", "v")}).join(edges.select(*keys, F.col("u").alias("_u"), F.col("v").alias("_v")), [*keys, "_u", "_v"], "left_semi").drop("_u", "_v")


def non_edges(graphs: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All pairs u < v that are no edge; pairs are made within a graph by sequences, not by a join."""
    pairs = nodes(graphs.select(*keys, "num_nodes"), keys).withColumnRenamed("node", "u").join(graphs.select(*keys, "num_nodes"), list(keys)).filter(F.col("u") < F.col("num_nodes") - 1)
    pairs = pairs.select(*keys, "u", F.explode(F.sequence(F.col("u") + 1, F.col("num_nodes") - 1)).alias("v"))
    return pairs.join(edges, [*keys, "u", "v"], "left_anti")


def degrees(graphs: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(node, degree), nodes without edges too."""
    found = neighbours(edges, keys).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes(graphs, keys).join(found, [*keys, "node"], "left").fillna(0, ["degree"])


def density(graphs: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """num_edges and density, 0 under two nodes."""
    counts = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_edges"))
    n = F.col("num_nodes").cast("double")
    out = graphs.select(*keys, "num_nodes").join(counts, list(keys), "left").fillna(0, ["num_edges"])
    return out.withColumn("density", F.when(n < 2, 0.0).otherwise(F.try_divide(2 * F.col("num_edges"), n * (n - 1))))


def triangles(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(a, b, c), a < b < c: two edges from the lowest node, closed by the third."""
    x = edges.select(*keys, F.col("u").alias("a"), F.col("v").alias("b"))
    y = edges.select(*keys, F.col("u").alias("a"), F.col("v").alias("c"))
    wedge = x.join(y, [*keys, "a"]).filter(F.col("b") < F.col("c"))
    return wedge.join(edges.select(*keys, F.col("u").alias("b"), F.col("v").alias("c")), [*keys, "b", "c"], "left_semi").select(*keys, "a", "b", "c")


def triangle_counts(graphs: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    found = triangles(edges, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("triangles"))
    return graphs.select(*keys).join(found, list(keys), "left").fillna(0, ["triangles"])


def triangle_edges(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    sides = F.explode(F.array(*(F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in ("ab", "ac", "bc")))).alias("e")
    return triangles(edges, keys).select(*keys, sides).select(*keys, "e.u", "e.v").distinct()


def open_wedges(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs u < v that have a neighbour in common and no edge."""
    n = neighbours(edges, keys)
    ends = n.select(*keys, "node", F.col("other").alias("u")).join(n.select(*keys, "node", F.col("other").alias("v")), [*keys, "node"]).filter(F.col("u") < F.col("v"))
    return ends.select(*keys, "u", "v").distinct().join(edges, [*keys, "u", "v"], "left_anti")


def clustering(graphs: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean local clustering over all nodes; a node of degree under two has 0."""
    corner = triangles(edges, keys).select(*keys, F.explode(F.array("a", "b", "c")).alias("node")).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("t"))
    local = degrees(graphs, edges, keys).join(corner, [*keys, "node"], "left")
    d = F.col("degree").cast("double")
    c = F.when(d < 2, 0.0).otherwise(F.try_divide(2 * F.coalesce("t", F.lit(0)), d * (d - 1)))
    found = local.groupBy(*keys).agg(F.avg(c).alias("average_clustering"))
    return graphs.select(*keys).join(found, list(keys), "left").fillna(0.0, ["average_clustering"])


def structural_statistics(graphs: DataFrame, edges: DataFrame, keys: Sequence[str], components: DataFrame | None = None) -> DataFrame:
    """Nodes, edges, density, mean degree, population degree variance, mean clustering, triangles, transitivity and components by graph.

    components: (keys, components), found by the grouped kernel if not given.
    """
    if components is None:
        from plexum.operators.kernels import component_counts

        components = component_counts(graphs, edges, keys)
    deg = degrees(graphs, edges, keys)
    corner = triangles(edges, keys).select(*keys, F.explode(F.array("a", "b", "c")).alias("node")).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("t"))
    d = F.col("degree").cast("double")
    local = deg.join(corner, [*keys, "node"], "left").fillna(0, ["t"])
    c = F.when(d < 2, 0.0).otherwise(F.try_divide(2 * F.col("t"), d * (d - 1)))
    sums = local.groupBy(*keys).agg(F.avg(d).alias("mean_degree"), F.var_pop(d).alias("degree_variance"), F.avg(c).alias("average_clustering"), (F.sum("t") / 3).cast("long").alias("triangles"), F.sum(d * (d - 1) / 2).alias("wedges"), (F.sum("degree") / 2).cast("long").alias("num_edges"))
    n = F.col("num_nodes").cast("double")
    out = graphs.select(*keys, "num_nodes").join(sums, list(keys), "left").join(components, list(keys), "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return out.select(
        *keys, n.alias("num_nodes"), zero(F.col("num_edges").cast("double")).alias("num_edges"), F.when(n < 2, 0.0).otherwise(zero(F.try_divide(2 * F.col("num_edges"), n * (n - 1)))).alias("density"),
        zero(F.col("mean_degree")).alias("mean_degree"), zero(F.col("degree_variance")).alias("degree_variance"), zero(F.col("average_clustering")).alias("average_clustering"), zero(F.col("triangles").cast("double")).alias("triangles"),
        zero(F.try_divide(3 * F.col("triangles"), F.nullif(F.col("wedges"), F.lit(0.0)))).alias("transitivity"), zero(F.col("components").cast("double")).alias("components"),
    )


STRUCTURAL = ("num_nodes", "num_edges", "density", "mean_degree", "degree_variance", "average_clustering", "triangles", "transitivity", "components")


def edge_hash(edges: DataFrame, graphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A SHA-256 of the node count and the sorted edges, equal for equal topologies."""
    lists = edges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("edges"))
    out = graphs.select(*keys, "num_nodes").join(lists, list(keys), "left")
    text = F.concat_ws("|", F.col("num_nodes").cast("string"), F.coalesce(F.to_json("edges"), F.lit("[]")))
    return out.select(*keys, F.sha2(text, 256).alias("graph_sha256"))


def structurally_equal(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key whether the two hash tables of edge_hash agree."""
    both = left.join(right.withColumnRenamed("graph_sha256", "_other"), list(keys), "full_outer")
    return both.select(*keys, F.coalesce(F.col("graph_sha256") == F.col("_other"), F.lit(False)).alias("equal"))


def local_signatures(graphs: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per node: degree, sorted neighbour degrees, and sorted degrees at distance two (through any path of two edges, itself left out)."""
    deg = degrees(graphs, edges, keys)
    n = neighbours(edges, keys)
    one = n.join(deg.select(*keys, F.col("node").alias("other"), F.col("degree").alias("d")), [*keys, "other"]).groupBy(*keys, "node").agg(F.array_sort(F.collect_list("d")).alias("near"))
    pairs = n.alias("p").join(n.select(*keys, F.col("node").alias("other"), F.col("other").alias("far")), [*keys, "other"]).filter(F.col("node") != F.col("far")).select(*keys, "node", "far").distinct()
    two = pairs.join(deg.select(*keys, F.col("node").alias("far"), F.col("degree").alias("d")), [*keys, "far"]).groupBy(*keys, "node").agg(F.array_sort(F.collect_list("d")).alias("far"))
    empty = F.array().cast("array<bigint>")
    return deg.join(one, [*keys, "node"], "left").join(two, [*keys, "node"], "left").withColumns({"near": F.coalesce("near", empty), "far": F.coalesce("far", empty)})


# Two sides of a pair.


def edit_ops(original: DataFrame, perturbed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(op, u, v): 'remove' for edges that are gone, 'add' for new ones; one full join on the edge."""
    a = original.select(*keys, "u", "v").withColumn("_a", F.lit(1))
    b = perturbed.select(*keys, "u", "v").withColumn("_b", F.lit(1))
    both = a.join(b, [*keys, "u", "v"], "full_outer").filter(F.col("_a").isNull() | F.col("_b").isNull())
    return both.select(*keys, F.when(F.col("_b").isNull(), "remove").otherwise("add").alias("op"), "u", "v")


def edit_distances(pairs: DataFrame, ops: DataFrame, keys: Sequence[str], weights: DataFrame | None = None) -> DataFrame:
    """Per pair the number of edits, and their weights' sum (weights: keys, u, v, weight; without a row 0; 1 each without a table)."""
    w = ops.withColumn("weight", F.lit(1.0)) if weights is None else ops.join(weights, [*keys, "u", "v"], "left").fillna(0.0, ["weight"])
    sums = w.groupBy(*keys).agg(F.count(F.lit(1)).alias("edit_distance_raw"), F.sum("weight").alias("edit_distance_weighted"))
    return pairs.select(*keys).distinct().join(sums, list(keys), "left").fillna(0, ["edit_distance_raw"]).fillna(0.0, ["edit_distance_weighted"])


def product_weights(ops: DataFrame, node_scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """1 plus the product of both ends' scores over the graph's highest. node_scores: keys, node, score."""
    top = F.max("score").over(Window.partitionBy(*keys))
    share = node_scores.select(*keys, "node", F.coalesce(F.try_divide(F.col("score"), F.nullif(top, F.lit(0.0))), F.lit(0.0)).alias("s"))
    out = ops.select(*keys, "u", "v").distinct()
    for end in "uv":
        out = out.join(share.select(*keys, F.col("node").alias(end), F.col("s").alias(f"s{end}")), [*keys, end], "left")
    return out.select(*keys, "u", "v", (1 + F.coalesce("su", F.lit(0.0)) * F.coalesce("sv", F.lit(0.0))).alias("weight"))


def cell_edit_distances(distances: DataFrame, cell: Sequence[str]) -> DataFrame:
    return distances.groupBy(*cell).agg(F.avg("edit_distance_raw").alias("edit_distance_raw"), F.avg("edit_distance_weighted").alias("edit_distance_weighted"))


def size_summary(graphs: DataFrame, edges: DataFrame, keys: Sequence[str], cell: Sequence[str] = ()) -> DataFrame:
    """Least and most nodes and edges over all graphs of a cell."""
    d = density(graphs, edges, keys)
    return d.groupBy(*cell).agg(F.min("num_nodes").alias("node_count_min"), F.max("num_nodes").alias("node_count_max"), F.min("num_edges").alias("edge_count_min"), F.max("num_edges").alias("edge_count_max"))


def degree_changes(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of two degree tables: L1 distance and both highest degrees."""
    both = left.withColumnRenamed("degree", "d0").join(right.withColumnRenamed("degree", "d1"), [*keys, "node"], "full_outer").fillna(0, ["d0", "d1"])
    return both.groupBy(*keys).agg(F.sum(F.abs(F.col("d0") - F.col("d1"))).alias("degree_l1"), F.max("d0").alias("max_degree_before"), F.max("d1").alias("max_degree_after"))


def partition_stats(graphs: DataFrame, edges: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inside and between density and modularity of a given partition. labels: keys, node, label."""
    e = edges.join(labels.select(*keys, F.col("node").alias("u"), F.col("label").alias("lu")), [*keys, "u"]).join(labels.select(*keys, F.col("node").alias("v"), F.col("label").alias("lv")), [*keys, "v"])
    inside = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("lu") == F.col("lv")).alias("within"))
    sizes = labels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("s")).groupBy(*keys).agg(F.sum(F.col("s") * (F.col("s") - 1) / 2).alias("pairs_in"), F.sum("s").alias("n"))
    deg = degrees(graphs, edges, keys).join(labels, [*keys, "node"]).groupBy(*keys, "label").agg(F.sum("degree").alias("d")).groupBy(*keys).agg(F.sum(F.col("d") * F.col("d")).cast("double").alias("d2"))
    out = sizes.join(inside, list(keys), "left").fillna(0, ["m", "within"]).join(deg, list(keys), "left")
    m, w, between = F.col("m").cast("double"), F.col("within").cast("double"), F.col("n") * (F.col("n") - 1) / 2 - F.col("pairs_in")
    safe = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0.0))), F.lit(0.0))
    return out.select(*keys, safe(w, F.col("pairs_in")).alias("intra_density"), safe(m - w, between).alias("inter_density"), (safe(w, m) - safe(F.col("d2"), 4 * m * m)).alias("modularity"))


# Perturbations as top-k by a stated order; `order` is any column over (keys, u, v), a hash of the seed by default.


def hash_order(seed: Column | int = 0) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string"), "u", "v"), 256)


def _first(candidates: DataFrame, budget: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return candidates.join(budget, list(keys)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.col("budget")).select(*keys, "u", "v", "_r")


def edge_budget(graphs: DataFrame, edges: DataFrame, keys: Sequence[str], alpha: float, least: int = 0) -> DataFrame:
    """floor(alpha * edges) in doubles, over `least` edges at least."""
    m = F.greatest(F.col("num_edges"), F.lit(least)).cast("double")
    return density(graphs, edges, keys).select(*keys, F.floor(F.lit(float(alpha)) * m).alias("budget"))


def edge_deletion(graphs, edges, keys, alpha: float, order: Sequence[Column] | None = None) -> DataFrame:
    """The edges to remove."""
    return _first(edges, edge_budget(graphs, edges, keys, alpha), keys, order or [hash_order()]).drop("_r")


def edge_insertion(graphs, edges, keys, alpha: float, order: Sequence[Column] | None = None) -> DataFrame:
    """The edges to add."""
    return _first(non_edges(graphs, edges, keys), edge_budget(graphs, edges, keys, alpha), keys, order or [hash_order()]).drop("_r")


def triangle_insertion(graphs, edges, keys, alpha: float, order: Sequence[Column] | None = None) -> DataFrame:
    return _first(open_wedges(edges, keys), edge_budget(graphs, edges, keys, alpha, 1), keys, order or [hash_order()]).drop("_r")


def triangle_deletion(graphs, edges, keys, alpha: float, order: Sequence[Column] | None = None) -> DataFrame:
    return _first(triangle_edges(edges, keys), edge_budget(graphs, edges, keys, alpha), keys, order or [hash_order()]).drop("_r")


def community_rewiring(graphs, edges, labels, keys, alpha: float, order: Sequence[Column] | None = None) -> DataFrame:
    """(u, v, add_u, add_v): floor(alpha * inner edges) inner edges, each with an absent edge between communities; as many as there are of both."""
    order = order or [hash_order()]
    lab = lambda e: e.join(labels.select(*keys, F.col("node").alias("u"), F.col("label").alias("lu")), [*keys, "u"]).join(labels.select(*keys, F.col("node").alias("v"), F.col("label").alias("lv")), [*keys, "v"])
    inner = lab(edges).filter(F.col("lu") == F.col("lv")).select(*keys, "u", "v")
    budget = inner.groupBy(*keys).agg(F.floor(F.lit(float(alpha)) * F.count(F.lit(1)).cast("double")).alias("budget"))
    old = _first(inner, budget, keys, order)
    new = _first(lab(non_edges(graphs, edges, keys)).filter(F.col("lu") != F.col("lv")).select(*keys, "u", "v"), budget, keys, order)
    return old.join(new.select(*keys, "_r", F.col("u").alias("add_u"), F.col("v").alias("add_v")), [*keys, "_r"]).drop("_r")


def hubs(graphs: DataFrame, edges: DataFrame, keys: Sequence[str], share: float = 0.1) -> DataFrame:
    """The ceil(share * n) nodes (one at least) of highest degree, of equals the lowest: node, place."""
    w = Window.partitionBy(*keys).orderBy(F.desc("degree"), "node")
    d = degrees(graphs, edges, keys).withColumn("place", F.row_number().over(w)).join(graphs.select(*keys, "num_nodes"), list(keys))
    return d.filter(F.col("place") <= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("num_nodes").cast("double")))).select(*keys, "node", "degree", "place")


def hub_modification(graphs, edges, keys, alpha: float, order: Sequence[Column] | None = None) -> DataFrame:
    """(op, u, v): up to the budget of hub edges go, and as many new hub edges come, none of those that went."""
    order = order or [hash_order()]
    top = hubs(graphs, edges, keys).select(*keys, "node")
    touch = lambda e: e.join(top.withColumnRenamed("node", "u"), [*keys, "u"], "left_semi").unionByName(e.join(top.withColumnRenamed("node", "v"), [*keys, "v"], "left_semi")).select(*keys, "u", "v").distinct()
    gone = _first(touch(edges), edge_budget(graphs, edges, keys, alpha), keys, order)
    budget = gone.groupBy(*keys).agg(F.count(F.lit(1)).alias("budget"))
    new = _first(touch(non_edges(graphs, edges, keys)), budget, keys, order)
    return gone.select(*keys, F.lit("remove").alias("op"), "u", "v").unionByName(new.select(*keys, F.lit("add").alias("op"), "u", "v"))


def no_op_reason(alpha: Column, requested: Column, changed: Column, net: Column) -> Column:
    """Why a pair has no edits: the first that holds of alpha_zero, rounded_budget_zero, operations_cancelled, no_feasible_change; else null."""
    return F.when(net != 0, F.lit(None)).when(alpha == 0, "alpha_zero").when(requested == 0, "rounded_budget_zero").when(changed > 0, "operations_cancelled").otherwise("no_feasible_change")


def perturbation_summary(pairs: DataFrame, cell: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """Cell sums, and of family, direction and label source the first that is there in graph order."""
    firsts = [F.min(F.when(F.col(c).isNotNull(), F.struct("graph_index", F.col(c).alias("x"))))["x"].alias(c) for c in ("perturbation_family", "perturbation_direction", "label_source")]
    return pairs.groupBy(*cell).agg(*(F.sum(finite(c)).alias(c) for c in totals), *firsts)


def skip_errors(rows: DataFrame, cell: Sequence[str]) -> DataFrame:
    """The distinct messages of cells whose rows are all skipped, sorted and joined by '; '."""
    out = rows.groupBy(*cell).agg(F.bool_and(F.col("status") == "skipped").alias("_all"), F.array_join(F.array_sort(F.collect_set("error_message")), "; ").alias("error_message"))
    return out.filter("_all").drop("_all")
