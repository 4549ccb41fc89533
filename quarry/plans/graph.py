"""Components composed to pipelines: a graph of named steps is run as one lazy plan."""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import schema
from quarry.functions import metrics
from quarry.operators import columns, decompose, encode, featurize, impute, sample, series  # noqa: F401 - registers components
from quarry.operators.base import Component, component
from quarry.plans import estimators as est
from quarry.plans.profile import Action, Message, actions_of


def topological(edges: dict[str, list[str]]) -> list[str]:
    """Steps so that parents come first; raises for cycles, unknown parents and several sinks."""
    waits = {n: sum(p in edges for p in ps) for n, ps in edges.items()}
    unknown = {p for ps in edges.values() for p in ps if p not in edges and p not in ("X", "y")}
    if unknown:
        raise ValueError(f"unknown parents {sorted(unknown)}")
    ready, order = deque(n for n, k in waits.items() if not k), []
    while ready:
        n = ready.popleft()
        order.append(n)
        for m, ps in edges.items():
            if n in ps:
                waits[m] -= ps.count(n)
                if not waits[m]:
                    ready.append(m)
    if len(order) != len(edges):
        raise ValueError("the graph has a cycle")
    sinks = [n for n in edges if not any(n in ps for ps in edges.values())]
    if len(sinks) > 1:
        raise ValueError(f"the graph has several sinks: {sinks}")
    return order


class ComponentGraph:
    """Named steps with parents: ``{name: [component, parent, ...]}``, where a parent is a step, "X" or "y".

    A step sees the columns of all its parents' tables side by side. All tables come from one input by projections and row
    filters, so steps with several parents join them on the row key.
    """

    def __init__(self, steps: dict[str, list], key: str | None = None):
        self.steps, self.key = steps, key
        self.edges = {n: [p.split(".")[0] for p in parts[1:]] or ["X"] for n, parts in steps.items()}
        self.order = topological(self.edges)
        self.components: dict[str, Component | est.Estimator] = {}

    def _make(self, name: str, parameters: dict):
        kind = self.steps[name][0]
        if isinstance(kind, str) and kind in est.ESTIMATORS:
            return est.Estimator(kind, **parameters)
        return component(kind)(**parameters)

    def _input(self, name: str, tables: dict[str, DataFrame]) -> DataFrame:
        parents = [p for p in dict.fromkeys(self.edges[name]) if p != "y"] or ["X"]
        out = tables[parents[0]]
        for p in parents[1:]:
            more = [c for c in tables[p].columns if c not in out.columns]
            if more:
                if not self.key:
                    raise ValueError("a step with several parents needs a row key")
                out = out.join(tables[p].select(self.key, *[f"`{c}`" for c in more]), self.key)
        return out

    def features(self, df: DataFrame, y: str | None) -> list[str]:
        types = schema.logical_types(df)
        return [c for c in df.columns if c not in (y, self.key) and types[c] in ("integer", "double", "boolean")]

    def fit(self, df: DataFrame, y: str, parameters: dict | None = None) -> ComponentGraph:
        tables = {"X": df}
        for name in self.order:
            step = self._make(name, (parameters or {}).get(name, {}))
            table = self._input(name, tables)
            if isinstance(step, est.Estimator):
                table = table.persist()
                step.fit(table, y, self.features(table, y))
                table.unpersist()
            else:
                held = table.drop(self.key) if self.key and self.key in table.columns and not step.training_only else table
                step.fit(held, y)
                tables[name] = step.transform(table)
            self.components[name] = step
        return self

    def transform(self, df: DataFrame, training: bool = False) -> DataFrame:
        """The table before the final estimator (or after the last transformer)."""
        tables, out = {"X": df}, df
        for name in self.order:
            step, table = self.components[name], self._input(name, tables)
            if isinstance(step, est.Estimator):
                return table
            skip = step.training_only and not training or step.modifies_target and step.learnt().get("y") not in table.columns
            out = tables[name] = table if skip else step.transform(table)
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        last = self.components[self.order[-1]]
        if not isinstance(last, est.Estimator):
            raise ValueError("the graph ends in no estimator")
        return last.predict(self.transform(df))

    def inverse_target(self, df: DataFrame, column: str = "prediction") -> DataFrame:
        for name in reversed(self.order):
            step = self.components[name]
            if isinstance(step, Component) and step.modifies_target and not isinstance(step, impute.TargetImputer):
                df = step.inverse_transform(df, column)
        return df

    def describe(self) -> dict:
        return {n: {"component": self.steps[n][0] if isinstance(self.steps[n][0], str) else self.steps[n][0].__name__, "parameters": getattr(self.components.get(n), "parameters", {})} for n in self.order}

    def dot(self) -> str:
        """The graph in the DOT language."""
        lines = [f'  "{n}" [shape=record, label="{n}|{facts["component"]}"];' for n, facts in self.describe().items()]
        return "\n".join(["digraph components {", "  rankdir=LR;", *lines, *[f'  "{p}" -> "{n}";' for n, ps in self.edges.items() for p in ps], "}"])

    def graph_dict(self) -> dict:
        return {"nodes": self.describe(), "edges": [[p, n] for n, ps in self.edges.items() for p in ps]}

    def provenance(self, df: DataFrame, y: str) -> dict[str, list[str]]:
        """For each input column the names that were made from it, by the components' naming."""
        made = self.transform(df).columns
        return {c: [m for m in made if m != c and (m.startswith(f"{c}_") or f"({c})" in m)] for c in df.columns if c != y}


def linear_graph(names: list, key: str | None = None) -> ComponentGraph:
    """A graph from a list of components, each fed by the one before."""
    steps, before = {}, "X"
    for i, n in enumerate(names):
        label = n if isinstance(n, str) else n.__name__
        label = label if label not in steps else f"{label}_{i}"
        steps[label] = [n, before, "y"]
        before = label
    return ComponentGraph(steps, key)


def preprocessing(df: DataFrame, y: str, problem: str, estimator: str, sampler: str | None = None) -> list[str]:
    """Components that the schema and the estimator call for, in order."""
    types = {c: k for c, k in schema.logical_types(df).items() if c != y}
    kinds = set(types.values())
    family = est.ESTIMATORS[estimator].family if estimator in est.ESTIMATORS else ""
    classify = "regression" not in problem
    out = ["LabelEncoder"] if classify else []
    if types and any(s >= 1 for s in columns.null_shares(df, list(types)).values()):
        out.append("DropNullColumns")
    if "unknown" in kinds:
        out.append("DropColumns")
    out += [c for kind, c in (("url", "URLFeaturizer"), ("email", "EmailFeaturizer")) if kind in kinds]
    if "datetime" in kinds and family not in ("arima", "prophet", "varmax", "exponential_smoothing"):
        out.append("DateTimeFeaturizer")
    if "text" in kinds:
        out.append("NaturalLanguageFeaturizer")
    if kinds & {"integer", "double", "boolean", "category"}:
        out.append("Imputer")
    if kinds & {"category", "url", "email"} and family != "catboost":
        out.append("OneHotEncoder")
    elif "category" in kinds:
        out.append("TargetEncoder")
    if classify and sampler:
        out.append(sampler)
    if family == "linear_model":
        out.append("StandardScaler")
    return out


class Pipeline:
    """A graph with its parameters, problem and, for two classes, threshold."""

    def __init__(self, graph: ComponentGraph, problem: str, parameters: dict | None = None, name: str | None = None):
        self.graph, self.problem, self.parameters = graph, problem, parameters or {}
        self.name = name or " + ".join(graph.order)
        self.threshold: float | None = None

    def fit(self, df: DataFrame, y: str) -> Pipeline:
        self.y = y
        self.graph.fit(df, y, self.parameters)
        return self

    def _predicted(self, df: DataFrame) -> DataFrame:
        out = self.graph.predict(df)
        if self.problem.endswith("binary") and "probability" in out.columns and self.threshold is not None:
            out = out.withColumn("prediction", (F.get("probability", F.lit(1)) > self.threshold).cast("double"))
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        return self.graph.inverse_target(self._predicted(df))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self._predicted(df)

    def optimize_threshold(self, df: DataFrame, objective: str = "F1") -> float:
        out = self._predicted(df).select(F.get("probability", F.lit(1)).alias("p"), F.col(f"`{self.y}`").cast("int").alias("y"))
        first = metrics.best_threshold(out, "y", "p", objective).first()
        self.threshold = first["threshold"] if first else 0.5
        return self.threshold

    def score(self, df: DataFrame, names: list[str]) -> metrics.Scores:
        out = self._predicted(df)
        y, extra = F.col(f"`{self.y}`").cast("double").alias("y"), {}
        cols = [y, F.col("prediction").cast("double").alias("p")]
        if "probability" in out.columns:
            size = 2 if self.problem.endswith("binary") else len(self.graph.components["LabelEncoder"].learnt()["labels"])
            cols += [F.coalesce(F.get("probability", F.lit(i)), F.lit(0.0)).alias(f"p{i}") for i in range(size)]
            extra = {"proba": "p1", "probas": {float(i): f"p{i}" for i in range(size)}}
        table = out.select(*cols).persist()
        got = metrics.score_all(table, self.problem, names, "y", "p", **extra)
        table.unpersist()
        return got

    def feature_importance(self) -> dict[str, float]:
        return self.graph.components[self.graph.order[-1]].importance()

    def clone(self) -> Pipeline:
        return self.new(self.parameters)

    def new(self, parameters: dict) -> Pipeline:
        return Pipeline(ComponentGraph(self.graph.steps, self.graph.key), self.problem, parameters, self.name)

    def describe(self) -> dict:
        return {"name": self.name, "problem": self.problem, "threshold": self.threshold, "components": self.graph.describe()}

    def can_tune_threshold_with(self, objective: str) -> bool:
        """Whether an objective asks for labels of two classes, so that a threshold decides them."""
        o = metrics.objective(objective)
        return self.problem.endswith("binary") and self.problem in o.problems and not o.needs_proba

    def example(self, path: str) -> str:
        """Python that builds the pipeline, fits it on a table, predicts and scores."""
        return self.code() + f"\ndf = spark.read.parquet({path!r})\nfitted = pipeline.fit(df, {getattr(self, 'y', 'y')!r})\npredicted = fitted.predict(df)\nscores = fitted.score(df, {[metrics.default_objective(self.problem)]!r})\n"

    def code(self) -> str:
        """Python that builds the pipeline anew."""
        steps = {n: [p if isinstance(p, str) else p.__name__ for p in parts] for n, parts in self.graph.steps.items()}
        return f"from quarry.plans.graph import ComponentGraph, Pipeline\n\npipeline = Pipeline(ComponentGraph({steps!r}, {self.graph.key!r}), {self.problem!r}, {self.parameters!r}, {self.name!r})\n"

    def save(self, path: str) -> None:
        """Transformers as JSON and a Spark model below one path, in any store that Spark writes."""
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        last = self.graph.components[self.graph.order[-1]]
        facts = {"problem": self.problem, "parameters": self.parameters, "name": self.name, "threshold": self.threshold, "key": self.graph.key, "y": self.y, "steps": {n: [p if isinstance(p, str) else p.__name__ for p in parts] for n, parts in self.graph.steps.items()}, "components": {n: c.to_json() for n, c in self.graph.components.items() if isinstance(c, Component)}}
        if isinstance(last, est.Estimator):
            facts["features"] = last.features
            facts["model"] = last.stored(f"{path}/model")
        spark.createDataFrame([(json.dumps(facts, default=str),)], "facts string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @staticmethod
    def load(spark, path: str) -> Pipeline:
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        out = Pipeline(ComponentGraph(facts["steps"], facts["key"]), facts["problem"], facts["parameters"], facts["name"])
        out.threshold, out.y = facts["threshold"], facts["y"]
        for n, text in facts["components"].items():
            out.graph.components[n] = Component.from_json(text)
        last = out.graph.order[-1]
        if last not in out.graph.components:
            model = est.Estimator(facts["steps"][last][0], **facts["parameters"].get(last, {}))
            model.y, model.features = facts["y"], facts["features"]
            model.restore(spark, f"{path}/model", facts["model"])
            out.graph.components[last] = model
        return out


def make_pipeline(df: DataFrame, y: str, estimator: str, problem: str, parameters: dict | None = None, sampler: str | None = None, key: str | None = None) -> Pipeline:
    table = df.drop(key) if key else df
    names = [*preprocessing(table, y, problem, estimator, sampler), estimator]
    p = dict(parameters or {})
    unknown = [c for c in schema.of_type(table, "unknown") if c != y]
    if "DropColumns" in names:
        p.setdefault("DropColumns", {"columns": unknown})
    if sampler == "Undersampler" and key:
        p.setdefault("Undersampler", {"key": key})
    if sampler == "Oversampler" and "Oversampler" not in p:
        p["Oversampler"] = {}
    if "OneHotEncoder" in names:
        p.setdefault("OneHotEncoder", {"handle_missing": "as_category"})
    return Pipeline(linear_graph(names, key), problem, p, f"{estimator} w/ {' + '.join(names[:-1])}")


def cleaning_steps(actions: list[Action]) -> list[tuple[str, dict]]:
    """Components that carry out actions; columns to drop come together, other kinds of actions are not repairs."""
    drop = [c for a in actions if a.code == "drop_col" for c in a.metadata.get("columns", [])]
    out = [("DropColumns", {"columns": sorted(set(drop))})] if drop else []
    for a in actions:
        if a.code == "impute_col" and a.metadata.get("is_target"):
            out.append(("TargetImputer", {"impute_strategy": a.metadata.get("strategy", "most_frequent")}))
        elif a.code == "impute_col":
            wanted = {c: {"impute_strategy": "most_frequent"} for c in a.metadata.get("columns", [])}
            out.append(("PerColumnImputer", {"impute_strategies": wanted}))
        elif a.code == "drop_rows" and a.check == "InvalidTargetDataCheck":
            out.append(("DropNaNRowsTransformer", {}))
        elif a.code == "regularize_and_impute_dataset":
            out += [("TimeSeriesRegularizer", {"time_index": a.metadata["time_index"]}), ("TimeSeriesImputer", {"time_index": a.metadata["time_index"]})]
    return out


def cleaned(df: DataFrame, y: str, messages: list[Message]) -> DataFrame:
    """The table after the default actions of all messages."""
    for name, parameters in cleaning_steps(actions_of(messages)):
        df = component(name)(**parameters).fit(df, y).transform(df)
    return df
