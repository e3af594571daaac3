"""Table schemas and domain constants."""

from __future__ import annotations

#: The results table, as DDL: one row per dataset, perturbation, strength, seed and workflow.
RESULTS = (
    "schema_version string, code_fingerprint string, randomness_protocol string, graph_artifact string, graph_sha256 string, workflow_artifact string, workflow_sha256 string, "
    "diagnostic_seconds double, dataset string, dataset_params string, perturbation string, perturbation_params string, alpha double, seed int, workflow string, "
    "implementation_mode string, workflow_params string, perturbation_family string, perturbation_direction string, label_source string, graph_count int, node_count_min int, "
    "node_count_max int, edge_count_min int, edge_count_max int, distribution_score double, mean_shift_score double, paired_score double, edit_distance_raw double, "
    "edit_distance_weighted double, runtime_seconds double, memory_mb double, status string, error_message string"
)
ROW_KEY = ("dataset", "dataset_params", "perturbation", "alpha", "seed", "workflow", "workflow_params")
SETTING = ("workflow", "dataset", "perturbation")

# Strengths, perturbations, workflows and their notes.
ALPHAS = tuple(round(i / 10, 1) for i in range(11))
PERTURBATIONS = ("edge_insertion", "edge_deletion", "triangle_insertion", "triangle_deletion", "community_weakening", "hub_modification")
WORKFLOWS = ("structural_statistics_mmd", "wl_subtree_kernel_mmd", "native_netlsd", "diversity_curves_shortest_path")
GRANULARITY = {
    "edge_insertion": "local",
    "edge_deletion": "local",
    "edge_addition_deletion": "local",
    "triangle_insertion": "local/mesoscopic",
    "triangle_deletion": "local/mesoscopic",
    "triangle_injection_removal": "local/mesoscopic",
    "community_weakening": "mesoscopic",
    "hub_modification": "global",
}
INTERPRETABILITY = {"structural_statistics_mmd": 3, "wl_subtree_kernel_mmd": 2, "native_netlsd": 2, "diversity_curves_shortest_path": 3, "diversity_curves_l2": 3}
DUPLICATE_MEAN_SHIFT = ("native_netlsd", "diversity_curves_shortest_path", "diversity_curves_l2")
#: Failure causes: edits, sensitivity, violations and variation at which a cell counts as starved, blind or unstable.
STARVED_EDITS, BLIND_SENSITIVITY, UNSTABLE_VIOLATIONS, UNSTABLE_CV = 1.0, 0.30, 0.30, 0.35
# End of fixed values.

SUMMARY_COLUMNS = (*SETTING, "sensitivity", "monotonicity", "paired_detectability", "mean_shift_detectability", "edit_distance_validation", "paired_edit_distance_validation", "robustness_cv", "ranking_stability_tau", "relative_runtime", "interpretability_score", "granularity_label")
