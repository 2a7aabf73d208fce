"""Metrics runs as Markdown, put between the markers of a document.

What is shown is declared: a list of labels, fields and formats for each layer. One function makes a table
of cells, one a line of labelled values, and the document is cut at the places of its markers.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Row

# The markers, labels and formats that documents show.
MARKER = re.compile(r"<!-- METRICS:(\w+):(START|END) -->")
REPORTED_K = (3, 5, 10)
NOTHING, UNKNOWN = "_No runs recorded yet._", "—"
SHARE, SCORE = "{:.1%}", "{:.3f}"
RUN = (("Run", "commit", "`{:.8}`"), ("", "timestamp", "{}"), ("embeddings", "embeddings", "`{}`"), ("config", "retrieval_config_hash", "`{}`"), ("", "api_cost_usd", "${:.2f}"), ("", "duration_s", "{:.0f}s"))
AUDIT = (("Precision", "precision", SHARE), ("Recall", "recall", SHARE), ("F1", "f1", SCORE), ("Contracts", "n_contracts", "{}"), ("Planted violations", "n_planted_violations", "{}"))
RETRIEVAL = (("Questions", "n_questions", "{}"), ("MRR", "mrr", SCORE), ("Faithfulness", "faithfulness", SHARE))


def markdown(rows: Iterable[Sequence[str]]) -> str:
    """A table whose first row is the header."""
    lines = ["| " + " | ".join(cells) + " |" for cells in rows]
    lines.insert(1, "|" + "---|" * (lines[0].count(" | ") + 1))
    return "\n".join(lines)


def shown(value, form: str) -> str:
    return UNKNOWN if value is None else form.format(value)


def line(fields: dict, spec: Sequence[tuple[str, str, str]], bold: bool = False) -> str:
    """Labelled values in a row; what was not measured is left out."""
    parts = []
    for label, name, form in spec:
        if fields.get(name) is not None:
            value = form.format(fields[name])
            parts.append(f"{label} **{value}**" if bold else f"{label} {value}".strip())
    return " · ".join(parts)


def _section(row: Row | None, layer: str, rows, spec) -> str:
    if row is None or row.metrics.layer != layer:
        return NOTHING
    metrics, context = row.metrics.asDict(), row.context.asDict()
    context["embeddings"] = "@".join((context["embedding_model"], context["embedding_revision"] or "unpinned"))
    return "\n\n".join((markdown(rows(metrics)), line(metrics, spec, bold=True), f"<sub>{line(context, RUN)}</sub>"))


def _recalls(metrics: dict) -> list[list[str]]:
    by_k = metrics["recall_at_k"] or {}
    return [["Metric", *(f"k={k}" for k in REPORTED_K)], ["Recall@k on article IDs", *(shown(by_k.get(str(k)), SHARE) for k in REPORTED_K)]]


def _kinds(metrics: dict) -> list[list[str]]:
    kinds = sorted((metrics["per_violation_type"] or {}).items())
    return [["Violation type", "F1"], *([name, shown(f1, SCORE)] for name, f1 in [("**Overall**", metrics["f1"]), *kinds])]


def splice(document: str, marker: str, body: str) -> str:
    """`document` with `body` between the two markers of that name; an error unless there is one such pair."""
    places = {m[2]: m for m in MARKER.finditer(document) if m[1] == marker}
    if len(places) != 2 or places["START"].end() > places["END"].start():
        raise ValueError(f"the document needs METRICS:{marker}:START and METRICS:{marker}:END, in this order")
    return f"{document[: places['START'].end()]}\n{body}\n{document[places['END'].start() :]}"


def render(document: str, retrieval: Row | None, audit: Row | None) -> str:
    """`document` with the tables of both layers; rendering its own output changes nothing."""
    document = splice(document, "LAYER1", _section(retrieval, "retrieval", _recalls, RETRIEVAL))
    return splice(document, "LAYER2", _section(audit, "audit", _kinds, AUDIT))


def is_current(document: str, retrieval: Row | None, audit: Row | None) -> bool:
    document = document.replace("\r\n", "\n")
    return document == render(document, retrieval, audit)
