"""SVG charts of small aggregates. The queries run on Spark; only their few rows come to the driver."""

from __future__ import annotations

import os
from collections.abc import Sequence
from html import escape

from pyspark.sql import DataFrame

from plexum.operators import charts, evaluate

PALETTE = ("#2b5c8a", "#c2573a", "#3f7d58", "#8a5aa3", "#b0872d", "#4d4d4d")


def _svg(width: int, height: int, body: Sequence[str], title: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11"><text x="10" y="18" font-size="14">{escape(title)}</text>{"".join(body)}</svg>'


def bars(rows: Sequence[tuple[str, float]], title: str, width: int = 520) -> str:
    top = max((v for _, v in rows), default=0) or 1
    body = []
    for k, (name, v) in enumerate(rows):
        y = 36 + 24 * k
        body.append(f'<text x="10" y="{y + 12}">{escape(name[:28])}</text><rect x="190" y="{y}" width="{max(0, v) / top * (width - 260):.1f}" height="16" fill="{PALETTE[k % len(PALETTE)]}"/><text x="{width - 60}" y="{y + 12}">{v:.3g}</text>')
    return _svg(width, 50 + 24 * len(rows), body, title)


def heat(rows: Sequence[str], columns: Sequence[str], values: dict[tuple[str, str], object], title: str) -> str:
    body = [f'<text x="{170 + 110 * j}" y="40">{escape(c[:16])}</text>' for j, c in enumerate(columns)]
    for i, r in enumerate(rows):
        y = 50 + 26 * i
        body.append(f'<text x="10" y="{y + 16}">{escape(r[:24])}</text>')
        for j, c in enumerate(columns):
            v = values.get((r, c))
            number = isinstance(v, (int, float))
            shade = f"rgb({255 - int(150 * min(1, max(0, v)))},{255 - int(90 * min(1, max(0, v)))},255)" if number else "#eeeeee"
            body.append(f'<rect x="{165 + 110 * j}" y="{y}" width="106" height="22" fill="{shade}"/><text x="{170 + 110 * j}" y="{y + 15}">{f"{v:.2f}" if number else escape(str(v or ""))[:18]}</text>')
    return _svg(180 + 110 * len(columns), 70 + 26 * len(rows), body, title)


def lines(panels: dict[str, dict[str, list[tuple[float, float, float]]]], title: str) -> str:
    """panels: title -> series -> (x, mean, deviation) in 0..1."""
    body = []
    for k, (name, series) in enumerate(sorted(panels.items())):
        left, top = 20 + 260 * (k % 3), 50 + 190 * (k // 3)
        at = lambda x, y: (left + 220 * x, top + 140 * (1 - min(1.2, max(-0.1, y)) / 1.2))  # noqa: E731, B023
        body.append(f'<text x="{left}" y="{top - 6}">{escape(name)}</text><rect x="{left}" y="{top}" width="220" height="140" fill="none" stroke="#999"/>')
        for i, (label, points) in enumerate(sorted(series.items())):
            color, points = PALETTE[i % len(PALETTE)], sorted(points)
            band = [at(x, m + s) for x, m, s in points] + [at(x, m - s) for x, m, s in reversed(points)]
            body.append(f'<polygon points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in band)}" fill="{color}" opacity="0.15"/><polyline points="{" ".join("%.1f,%.1f" % at(x, m) for x, m, _ in points)}" fill="none" stroke="{color}"><title>{escape(label)}</title></polyline>')
    return _svg(800, 80 + 190 * (1 + (len(panels) - 1) // 3), body, title)


def generate(results: DataFrame, out_dir: str) -> list[str]:
    """Write the charts of a results table; gives their paths."""
    os.makedirs(out_dir, exist_ok=True)
    ok = evaluate.successes(results).cache()
    summary = evaluate.evaluation_summary(results).cache()
    out = {}
    out["runtime.svg"] = bars([(r.workflow, r.runtime_seconds or 0.0) for r in charts.workflow_means(ok, ["runtime_seconds"]).orderBy("workflow").collect()], "Mean runtime in seconds")
    status = charts.status_pivot(results).orderBy("workflow").collect()
    out["status.svg"] = bars([(f"{r.workflow} {s}", float(r[s])) for r in status for s in ("success", "failed", "skipped")], "Rows by status")
    found = summary.select("workflow", "perturbation", "sensitivity").groupBy("workflow", "perturbation").avg("sensitivity").collect()
    values = {(r[0], r[1]): r[2] for r in found}
    out["sensitivity.svg"] = heat(sorted({k[0] for k in values}), sorted({k[1] for k in values}), values, "Sensitivity")
    g = {(r.workflow, r.scale): r.value for r in charts.granularity_values(summary).collect()}
    out["granularity.svg"] = heat(sorted({k[0] for k in g}), ["local", "mesoscopic", "global", "multiscale"], g, "Sensitivity by scale")
    f = {(r.dataset, r.perturbation): r.cause for r in charts.failure_matrix(evaluate.failure_map(results, summary)).collect()}
    out["failures.svg"] = heat(sorted({k[0] for k in f}), sorted({k[1] for k in f}), f, "Causes of failure")
    panels: dict = {}
    for r in charts.line_panels(ok).collect():
        panels.setdefault(f"{r.dataset} / {r.perturbation}", {}).setdefault(r.workflow, []).append((r.alpha, r["mean"], r["std"]))
    out["curves.svg"] = lines(panels, "Score over strength, by workflow")
    pairs: dict = {}
    for r in charts.scatter_scaled(ok).select("workflow", "px", "py").groupBy("workflow").avg("px", "py").collect():
        pairs[r.workflow] = (r[1], r[2])
    out["mean_vs_paired.svg"] = heat(sorted(pairs), ["mean shift", "paired"], {(w, c): v for w, p in pairs.items() for c, v in zip(("mean shift", "paired"), p)}, "Scaled means")
    for name, text in out.items():
        with open(f"{out_dir}/{name}", "w", encoding="utf-8") as file:
            file.write(text)
    ok.unpersist()
    summary.unpersist()
    return [f"{out_dir}/{n}" for n in out]
