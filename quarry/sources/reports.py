"""Reports as JSON, text, Markdown and a self-contained HTML page."""

from __future__ import annotations

import html
import json
import math


def to_json(report, indent: int = 2) -> str:
    return json.dumps(report.to_dict() if hasattr(report, "to_dict") else report, indent=indent, default=str)


def shown_score(score: float | None, metric: str) -> str:
    """Negative squared error is shown as its root."""
    if score is None or math.isnan(score):
        return "N/A"
    return f"{math.sqrt(abs(score)):.4f}" if metric == "neg_mse" else f"{score:.4f}"


def score_name(metric: str) -> str:
    return "RMSE" if metric == "neg_mse" else metric


def summary(r: dict) -> str:
    top = ", ".join(f"{f['feature']} ({f['importance']})" for f in r["feature_importances"][:3]) or "none"
    lines = [
        f"Task: {r['task']}", f"Target: {r['target']}", f"Rows: {r['n_rows']}", f"Features: {r['n_features_in']} in, {r['n_features_out']} out",
        f"Best model: {r['best_model']}", f"Best {score_name(r['metric'])}: {shown_score(r['best_score'], r['metric'])}", f"Top features: {top}", f"Seconds: {r['elapsed_seconds']:.2f}",
    ]
    return "\n".join(lines + ([f"Warnings: {len(r['warnings'])}"] if r["warnings"] else []))


def markdown(r: dict) -> str:
    name = score_name(r["metric"])
    out = [f"## Best model: {r['best_model']}", "", "| what | value |", "| --- | --- |", f"| task | {r['task']} |", f"| target | {r['target']} |", f"| rows | {r['n_rows']} |", f"| {name} | {shown_score(r['best_score'], r['metric'])} |", "", "### Features"]
    out += [f"- {f['feature']}: {'#' * round(20 * f['importance'])} {f['importance']}" for f in r["feature_importances"][:5]]
    out += ["", "### Parameters", *[f"- {k}: {v}" for k, v in (r["best_params"] or {}).items()], "", f"### Models by {name}"]
    out += [f"{i}. {m['model']}: {shown_score(m['score'], r['metric'])}" for i, m in enumerate(r["rankings"], 1)]
    if r["warnings"]:
        out += ["", "### Warnings", *[f"- {w}" for w in r["warnings"]]]
    return "\n".join([*out, "", "<details><summary>JSON</summary>", "", "```json", to_json(r), "```", "</details>"])


def page(r: dict, source: str = "", n_total: int | None = None) -> str:
    e = lambda x: html.escape(str(x))
    name = score_name(r["metric"])
    widest = max((f["importance"] for f in r["feature_importances"]), default=1) or 1
    bars = "".join(f'<text x="0" y="{20 * i + 14}">{e(f["feature"])}</text><rect x="200" y="{20 * i + 3}" width="{300 * f["importance"] / widest:.1f}" height="14"/><text x="510" y="{20 * i + 14}">{f["importance"]}</text>' for i, f in enumerate(r["feature_importances"][:10]))
    rows = "".join(f"<tr><td>{i}</td><td>{e(m['model'])}</td><td>{shown_score(m['score'], r['metric'])}</td></tr>" for i, m in enumerate(r["rankings"], 1))
    facts = {"source": source, "rows": n_total or r["n_rows"], "task": r["task"], "target": r["target"], "best model": r["best_model"], name: shown_score(r["best_score"], r["metric"])}
    return (
        "<!doctype html><meta charset='utf-8'><title>Model report</title><style>body{font-family:sans-serif;max-width:60em;margin:2em auto}rect{fill:#46a}td,th{padding:.2em 1em;text-align:left}</style>"
        + "<h1>Model report</h1><table>" + "".join(f"<tr><th>{e(k)}</th><td>{e(v)}</td></tr>" for k, v in facts.items()) + f"</table><h2>Models by {e(name)}</h2><table>{rows}</table><h2>Features</h2><svg width='600' height='{20 * min(10, len(r['feature_importances'])) + 10}'>{bars}</svg>"
        + "<h2>Parameters</h2><ul>" + "".join(f"<li>{e(k)}: {e(v)}</li>" for k, v in (r["best_params"] or {}).items()) + "</ul><h2>Warnings</h2><ul>" + "".join(f"<li>{e(w)}</li>" for w in r["warnings"]) + "</ul>"
    )
