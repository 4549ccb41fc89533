"""Figures as data: every plot is a dictionary of titles, axes and series that any plotting library can draw."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import metrics
from quarry.plans import explain

#: Most points of one series that go to the driver; more are thinned to even steps of their order.
MAX_POINTS = 2000


def _points(df: DataFrame, x: str, y: str) -> dict:
    n = df.count()
    rows = df.orderBy(x, y).select(x, y)
    if n > MAX_POINTS:
        rows = rows.where(F.rand(0) < MAX_POINTS / n).limit(2 * MAX_POINTS)
    got = sorted(tuple(r) for r in rows.collect())
    return {"x": [a for a, _ in got], "y": [b for _, b in got], "n": n}


def figure(title: str, x: str, y: str, **series: dict) -> dict:
    return {"title": title, "x": x, "y": y, "series": series}


def roc(df: DataFrame, y: str, score: str) -> dict:
    area = metrics.auc(df, y, score).first()["AUC"]
    return figure(f"ROC, area {area:.3f}", "false positive rate", "true positive rate", model=_points(metrics.roc_points(df, y, score), "fpr", "tpr"), chance={"x": [0, 1], "y": [0, 1]})


def precision_recall(df: DataFrame, y: str, score: str) -> dict:
    return figure("Precision and recall", "recall", "precision", model=_points(metrics.pr_points(df, y, score), "recall", "precision"))


def confusion(df: DataFrame, y: str, pred: str, normalize: str | None = "true") -> dict:
    cells = [(str(r.label), str(r.predicted), r.value) for r in metrics.confusion(df, y, pred, normalize).collect()]  # one for each pair of classes
    return figure("Confusion matrix", "predicted", "label", cells={"cells": sorted(cells)})


def threshold(df: DataFrame, y: str, score: str, objective: str = "F1", steps: int = 100) -> dict:
    return figure(f"{objective} by threshold", "threshold", objective, model=_points(explain.objective_vs_threshold(df, y, score, objective, steps), "threshold", "score"))


def prediction_vs_actual(df: DataFrame, y: str, pred: str, outlier_threshold: float | None = None) -> dict:
    t = explain.prediction_vs_actual(df, y, pred, outlier_threshold)
    return figure("Prediction and actual", "prediction", "actual", usual=_points(t.where("not outlier"), "prediction", "actual"), outliers=_points(t.where("outlier"), "prediction", "actual"))


def over_time(df: DataFrame, time_index: str, y: str, pred: str) -> dict:
    return figure("Prediction and actual over time", time_index, "value", actual=_points(df, time_index, y), prediction=_points(df, time_index, pred))


def bars(table: DataFrame, name: str, value: str, title: str, least: float = 0.0) -> dict:
    """Bars of a short table, such as importances, at least so long."""
    rows = [(r[0], r[1]) for r in table.where(F.abs(value) >= least).orderBy(F.desc(F.abs(value)), name).select(name, value).limit(MAX_POINTS).collect()]
    return figure(title, name, value, bars={"x": [a for a, _ in rows], "y": [b for _, b in rows]})


def dependence(table: DataFrame, feature: str) -> dict:
    """A partial dependence table of one feature as a line, of two as cells."""
    if "value" in table.columns:
        return figure(f"Partial dependence of {feature}", feature, "average", model=_points(table, "value", "average"))
    return figure(f"Partial dependence of {feature}", "value_1", "value_2", cells={"cells": sorted(tuple(r) for r in table.select("value_1", "value_2", "average").collect())})  # the grid


def embedding(table: DataFrame) -> dict:
    return figure("t-SNE", "component_0", "component_1", rows=_points(table, "component_0", "component_1"))


def search_progress(points: list[tuple[int, float, float]], objective: str) -> dict:
    """The score of each iteration of a search and the best so far."""
    return figure("Search", "iteration", objective, score={"x": [p[0] for p in points], "y": [p[1] for p in points]}, best={"x": [p[0] for p in points], "y": [p[2] for p in points]})


def force(rows: DataFrame, key: str) -> dict:
    """Force data of a few rows (explain them, not tables)."""
    got = [(str(r[key]), r.base, r.prediction, [(f.feature, f.effect) for f in r.features]) for r in rows.limit(MAX_POINTS).collect()]
    return figure("Forces", "feature", "effect", rows={"rows": got})


def tree_dot(nodes: list[dict]) -> str:
    """A decision tree, given as nodes with id, label and children, in the DOT language."""
    lines = [f'  n{n["id"]} [shape=box, label="{n["label"]}"];' for n in nodes] + [f"  n{n['id']} -> n{c};" for n in nodes for c in n.get("children", [])]
    return "\n".join(["digraph tree {", *lines, "}"])


def save(fig: dict | str, path: str, spark=None) -> str:
    """Store a figure as JSON (or DOT text) below a path: by Spark if a session is given, else as a local file."""
    text = fig if isinstance(fig, str) else json.dumps(fig, default=str)
    if spark is not None:
        spark.createDataFrame([(text,)], "figure string").coalesce(1).write.mode("overwrite").text(path)
        return path
    with open(path, "w") as f:
        f.write(text)
    return path
