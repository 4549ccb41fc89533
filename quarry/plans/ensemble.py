"""Stacked ensembles as pipelines: a final learner over what base pipelines predict for rows that they have not seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import metrics
from quarry.operators.split import hashed_folds
from quarry.plans import estimators as est
from quarry.plans.graph import Pipeline


class StackedPipeline:
    """Base pipelines and a final estimator on their out-of-fold predictions, joined by the row key."""

    def __init__(self, bases: list[Pipeline], problem: str, key: str, final: str | None = None, folds: int = 3):
        if len(bases) < 2:
            raise ValueError("an ensemble needs two pipelines or more")
        self.bases, self.problem, self.key, self.folds = bases, problem, key, folds
        self.final_name = final or ("ElasticNetRegressor" if "regression" in problem else "LogisticRegressionClassifier")
        self.name = f"Stacked {self.final_name} over {len(bases)} pipelines"

    def _columns(self, i: int, predicted: DataFrame) -> list:
        if "probability" not in predicted.columns:
            return [F.col("prediction").cast("double").alias(f"base_{i}")]
        return [F.coalesce(F.get("probability", F.lit(c)), F.lit(0.0)).alias(f"base_{i}_{c}") for c in range(1, self.classes)]

    def _stack(self, predict, y: str | None) -> DataFrame:
        out = None
        for i in range(len(self.bases)):
            got = predict(i)
            label = [F.col(f"`{y}`").cast("double").alias("_y")] if y and i == 0 else []
            part = got.select(self.key, *label, *self._columns(i, got))
            out = part if out is None else out.join(part, self.key)
        return out

    def fit(self, df: DataFrame, y: str) -> StackedPipeline:
        self.y = y
        self.classes = 0 if "regression" in self.problem else df.select(y).where(F.col(f"`{y}`").isNotNull()).distinct().count()
        dealt = hashed_folds(df, self.key, self.folds, 1).persist()

        def unseen(i: int) -> DataFrame:
            out = None
            for k in range(self.folds):
                fitted = self.bases[i].clone().fit(dealt.where(F.col("fold") != k).drop("fold"), y)
                got = fitted.predict_proba(dealt.where(F.col("fold") == k).drop("fold"))
                got = got.select(self.key, y, *[c for c in ("prediction", "probability") if c in got.columns])
                out = got if out is None else out.unionByName(got)
            return out

        table = self._stack(unseen, y).persist()
        features = [c for c in table.columns if c.startswith("base_")]
        self.final = est.Estimator(self.final_name).fit(table, "_y", features)
        self.bases = [b.clone().fit(df, y) for b in self.bases]
        table.unpersist()
        dealt.unpersist()
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self.final.predict(self._stack(lambda i: self.bases[i].predict_proba(df), self.y if self.y in df.columns else None))

    def predict(self, df: DataFrame) -> DataFrame:
        """(key, prediction, ...); classes are numbers in the order of the label encoder."""
        return self.predict_proba(df)

    def score(self, df: DataFrame, names: list[str]) -> metrics.Scores:
        out = self.predict_proba(df)
        cols, extra = [F.col("_y").alias("y"), F.col("prediction").cast("double").alias("p")], {}
        if "probability" in out.columns:
            cols += [F.coalesce(F.get("probability", F.lit(i)), F.lit(0.0)).alias(f"p{i}") for i in range(self.classes)]
            extra = {"proba": "p1", "probas": {float(i): f"p{i}" for i in range(self.classes)}}
        return metrics.score_all(out.select(*cols), self.problem, names, "y", "p", **extra)

    def clone(self) -> StackedPipeline:
        return StackedPipeline([b.clone() for b in self.bases], self.problem, self.key, self.final_name, self.folds)

    def describe(self) -> dict:
        return {"name": self.name, "problem": self.problem, "final": self.final_name, "bases": [b.describe() for b in self.bases]}
