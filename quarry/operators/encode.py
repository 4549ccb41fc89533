"""Encoders, scalers and projections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import schema
from quarry.operators.base import Component, features_of


def value_counts(df: DataFrame, columns: list[str]) -> dict[str, list[tuple[str | None, int]]]:
    """Values as text with their counts, most frequent first and ties by value, for categorical columns in one shuffle."""
    if not columns:
        return {}
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns]))
    rows = df.select(cells.alias("x")).groupBy("x.c", "x.v").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each category
    out: dict = {c: [] for c in columns}
    for r in rows:
        out[r.c].append((r.v, r.n))
    return {c: sorted(v, key=lambda x: (-x[1], x[0] is None, x[0] or "")) for c, v in out.items()}


class OneHotEncoder(Component):
    """A boolean column for each of the most frequent categories; of two values the more frequent one gets none."""

    def fit_state(self, df, y=None, top_n=10, features_to_encode=None, categories=None, drop="if_binary", handle_unknown="ignore", handle_missing="error"):
        columns = [c for c in (features_to_encode or schema.of_type(df, "category", "email", "url")) if c != y]
        given = dict(zip(columns, categories, strict=True)) if categories else {}
        counts = value_counts(df, [c for c in columns if c not in given])
        chosen = {}
        for c in columns:
            if c in given:
                chosen[c] = list(given[c])
                continue
            if handle_missing == "error" and any(v is None for v, _ in counts[c]):
                raise ValueError(f"column {c} holds nulls")
            values = [(v if v is not None else "nan") for v, _ in counts[c]]
            if drop == "if_binary" and len(values) == 2:
                chosen[c] = values[1:]
            else:
                chosen[c] = sorted(values[:top_n] if top_n else values)
        names, taken = {}, set(df.columns) - set(columns)
        for c in columns:
            names[c] = []
            for v in chosen[c]:
                name, i = f"{c}_{v}", 1
                while name in taken:
                    name, i = f"{c}_{v}_{i}", i + 1
                taken.add(name)
                names[c].append(name)
        return {"categories": chosen, "names": names, "all": {c: [v for v, _ in counts.get(c, [])] for c in columns}}

    def categories(self, feature: str) -> list[str]:
        return self.learnt()["categories"][feature]

    def get_feature_names(self) -> list[str]:
        return [n for names in self.learnt()["names"].values() for n in names]

    def transform(self, df: DataFrame) -> DataFrame:
        s, p = self.learnt(), self.parameters
        new = {}
        for c, values in s["categories"].items():
            text = F.col(f"`{c}`").cast("string")
            if p["handle_missing"] == "as_category":
                text = F.coalesce(text, F.lit("nan"))
            if p["handle_unknown"] == "error":
                known = [v for v in (s["all"][c] or values) if v is not None]
                text = F.when(text.isin(known) | text.isNull(), text).otherwise(F.raise_error(F.concat(F.lit(f"unknown category of {c}: "), text)))
            for name, v in zip(s["names"][c], values, strict=True):
                new[name] = F.coalesce(text == F.lit(v), F.lit(False))
        return df.withColumns(new).drop(*s["categories"])


class OrdinalEncoder(Component):
    """Codes by a declared order of categories."""

    def fit_state(self, df, y=None, features_to_encode=None, categories=None, handle_unknown="error", unknown_value=None, encoded_missing_value=None):
        columns = features_to_encode or list(categories or {})
        orders = categories if isinstance(categories, dict) else dict(zip(columns, categories or [], strict=False))
        missing = [c for c in columns if c not in orders]
        found = value_counts(df, missing)
        return {"orders": {c: list(orders[c]) if c in orders else sorted(v for v, _ in found[c] if v is not None) for c in columns}}

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.parameters
        new = {}
        for c, order in self.learnt()["orders"].items():
            col = F.col(f"`{c}`").cast("string")
            code = None
            for i, v in enumerate(order):
                code = F.when(col == v, float(i)) if code is None else code.when(col == v, float(i))
            missing = F.lit(p["encoded_missing_value"]).cast("double")
            unknown = F.raise_error(F.concat(F.lit(f"unknown category of {c}: "), col)).cast("double") if p["handle_unknown"] == "error" else F.lit(p["unknown_value"]).cast("double")
            new[f"{c}_ordinal_encoding"] = F.when(col.isNull(), missing).otherwise(code.otherwise(unknown) if code is not None else unknown)
        return df.withColumns(new).drop(*self.learnt()["orders"])


def smoothed(mean: Column, n: Column, prior: Column, smoothing: float, min_samples: float = 20.0) -> Column:
    """Category mean drawn to the overall mean, the more the fewer rows there are."""
    weight = 1 / (1 + F.exp(-(n - min_samples) / smoothing))
    return prior * (1 - weight) + mean * weight


class TargetEncoder(Component):
    def fit_state(self, df, y=None, cols=None, smoothing=1, handle_unknown="value", handle_missing="value"):
        columns = cols or [c for c in schema.of_type(df, "category") if c != y]
        prior = df.agg(F.avg(F.col(f"`{y}`").cast("double"))).first()[0]
        out = {}
        for c in columns:
            rows = df.groupBy(F.col(f"`{c}`").cast("string").alias("v")).agg(F.avg(F.col(f"`{y}`").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
            out[c] = {str(r.v): r.e for r in rows.select("v", smoothed(F.col("m"), F.col("n"), F.lit(prior), float(smoothing)).alias("e")).collect()}
        return {"prior": prior, "codes": out}

    def transform(self, df: DataFrame) -> DataFrame:
        """Categories beyond a few hundred are looked up by a join with the table of codes."""
        s = self.learnt()
        for c, codes in s["codes"].items():
            table = df.sparkSession.createDataFrame([(k, float(v)) for k, v in codes.items()] or [("", 0.0)], "_k string, _e double")
            key = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None"))
            df = df.withColumn("_j", key).join(table, F.col("_j") == F.col("_k"), "left").withColumn(c, F.coalesce("_e", F.lit(s["prior"]))).drop("_j", "_k", "_e")
        return df


class LabelEncoder(Component):
    """Labels as 0 to k-1 in sorted order, or the positive label as 1; unseen labels raise."""

    modifies_target = True

    def fit_state(self, df, y=None, positive_label=None):
        values = sorted(r[0] for r in df.select(y).where(F.col(f"`{y}`").isNotNull()).distinct().collect())
        if positive_label is not None:
            if len(values) != 2 or positive_label not in values:
                raise ValueError("a positive label needs two labels, it among them")
            values = [v for v in values if v != positive_label] + [positive_label]
        return {"labels": values}

    def transform(self, df: DataFrame) -> DataFrame:
        y = self.learnt()["y"]
        if y not in df.columns:
            return df
        col, code = F.col(f"`{y}`"), None
        for i, v in enumerate(self.learnt()["labels"]):
            code = F.when(col == v, i) if code is None else code.when(col == v, i)
        return df.withColumn(y, F.when(col.isNotNull(), code.otherwise(F.raise_error(F.concat(F.lit("unseen label: "), col.cast("string"))).cast("int"))))

    def inverse_transform(self, df: DataFrame, column: str | None = None) -> DataFrame:
        column = column or self.learnt()["y"]
        return df.withColumn(column, F.get(F.array(*[F.lit(v) for v in self.learnt()["labels"]]), F.col(f"`{column}`").cast("int")))


class StandardScaler(Component):
    """(x - mean) / population standard deviation of numbers; constant columns are only centred, dates dropped."""

    def fit_state(self, df, y=None):
        columns = [c for c in features_of(df, y) if schema.logical_types(df)[c] in schema.NUMERIC]
        got = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if columns else {}
        return {"mean": {c: got[f"m{i}"] for i, c in enumerate(columns)}, "std": {c: got[f"s{i}"] or 1.0 for i, c in enumerate(columns)}, "drop": [c for c in schema.of_type(df, "datetime") if c != y]}

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.learnt()
        return df.drop(*s["drop"]).withColumns({c: (F.col(f"`{c}`") - s["mean"][c]) / s["std"][c] for c in s["mean"] if c in df.columns})


def moments(df: DataFrame, columns: list[str]):
    """Count, mean vector and population covariance of numbers, from one aggregation of sums of products."""
    import numpy as np

    x = [F.col(f"`{c}`").cast("double") for c in columns]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"m{i}") for i, a in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]]
    got = df.agg(*aggs).first()
    cov = np.array([[got[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(x))] for i in range(len(x))])
    return got["n"], np.array([got[f"m{i}"] or 0.0 for i in range(len(x))]), cov


class _Projection(Component):
    prefix = "component"

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.learnt()
        centred = [F.col(f"`{c}`").cast("double") - m for c, m in zip(s["columns"], s["mean"], strict=True)]
        new = {}
        for k, direction in enumerate(s["directions"]):
            total = F.lit(0.0)
            for x, w in zip(centred, direction, strict=True):
                total = total + x * float(w)
            new[f"{self.prefix}_{k}"] = total
        return df.withColumns(new).drop(*s["columns"])


class PCA(_Projection):
    """Directions of the covariance that explain the wanted share of variance, signs fixed by the largest weight."""

    hyperparameters = {"variance": (0.25, 1.0)}

    def fit_state(self, df, y=None, variance=0.95, n_components=None):
        import numpy as np

        columns = features_of(df, y)
        types = schema.logical_types(df)
        if any(types[c] not in schema.NUMERIC for c in columns):
            raise ValueError("all features must be numbers")
        _, mean, cov = moments(df, columns)
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1], vectors[:, ::-1]
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        k = n_components or int(np.searchsorted(share, variance - 1e-12) + 1)
        chosen = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(0), range(k)])
        return {"columns": columns, "mean": mean.tolist(), "directions": chosen.T.tolist(), "explained": (values[:k] / max(values.sum(), 1e-300)).tolist()}


class LinearDiscriminantAnalysis(_Projection):
    """Directions that part the classes' means against the spread within classes."""

    def fit_state(self, df, y=None, n_components=None):
        import numpy as np

        columns = features_of(df, y)
        labels = [r[0] for r in df.select(y).distinct().collect()]
        k = n_components or min(len(labels) - 1, len(columns))
        if k > min(len(labels) - 1, len(columns)):
            raise ValueError("more components than classes and features allow")
        n, mean, total = moments(df, columns)
        rows = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).collect()
        between = sum(r.n / n * np.outer(d, d) for r in rows for d in [np.array([r[f"m{i}"] for i in range(len(columns))]) - mean])
        within = total - between + 1e-9 * np.trace(total) / len(columns) * np.eye(len(columns))
        values, vectors = np.linalg.eig(np.linalg.solve(within, between))
        order = np.argsort(-values.real)[:k]
        chosen = vectors[:, order].real
        chosen = chosen / np.sqrt(np.einsum("ij,ik,kj->j", chosen, within, chosen))
        chosen = chosen * np.sign(chosen[np.abs(chosen).argmax(0), range(k)])
        return {"columns": columns, "mean": mean.tolist(), "directions": chosen.T.tolist()}


def vectors(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    numbers = df.withColumns({f"_v{i}": F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for i, c in enumerate(columns)})
    return VectorAssembler(inputCols=[f"_v{i}" for i in range(len(columns))], outputCol=out).transform(numbers).drop(*[f"_v{i}" for i in range(len(columns))])


class _ForestSelector(Component):
    classifier = True

    def importances(self, df, y, columns, trees, depth):
        from pyspark.ml import classification, regression

        kind = classification.RandomForestClassifier if self.classifier else regression.RandomForestRegressor
        data = vectors(df, columns).select("features", F.col(f"`{y}`").cast("double").alias("label"))
        return list(kind(numTrees=trees, maxDepth=depth or 5, seed=0).fit(data).featureImportances.toArray())

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.learnt()["drop"])


class RFClassifierSelectFromModel(_ForestSelector):
    """Features whose importance reaches the threshold, at most the given share of them."""

    def fit_state(self, df, y=None, number_features=None, n_estimators=10, max_depth=None, percent_features=0.5, threshold="median"):
        import statistics

        columns = features_of(df, y)
        values = self.importances(df, y, columns, n_estimators, max_depth)
        least = statistics.median(values) if threshold == "median" else statistics.mean(values) if threshold == "mean" else threshold
        most = max(1, int(percent_features * (number_features or len(columns))))
        kept = [c for v, c in sorted(((v, c) for v, c in zip(values, columns, strict=True) if v >= least), key=lambda x: -x[0])[:most]]
        return {"drop": [c for c in columns if c not in kept]}


class RFRegressorSelectFromModel(RFClassifierSelectFromModel):
    classifier = False


class RFClassifierRFESelector(_ForestSelector):
    """Drops the least important features step by step and keeps the set with the best validation score."""

    def fit_state(self, df, y=None, step=0.2, min_features_to_select=1, n_estimators=10, max_depth=None):
        from pyspark.ml import classification, regression

        columns = features_of(df, y)
        kind = classification.RandomForestClassifier if self.classifier else regression.RandomForestRegressor
        fold = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(5))
        train, test = df.where(fold != 0), df.where(fold == 0)
        left, best = columns, (-math.inf, columns)
        while True:
            model = kind(numTrees=n_estimators, maxDepth=max_depth or 5, seed=0).fit(vectors(train, left).withColumn("label", F.col(f"`{y}`").cast("double")))
            out = model.transform(vectors(test, left)).select(F.col(f"`{y}`").cast("double").alias("t"), "prediction")
            error = F.avg((F.col("t") == F.col("prediction")).cast("double")) if self.classifier else -F.avg((F.col("t") - F.col("prediction")) ** 2)
            score = out.agg(error).first()[0] or -math.inf
            if score >= best[0]:
                best = (score, left)
            if len(left) <= min_features_to_select:
                break
            drop = max(1, int(step * len(left))) if step < 1 else int(step)
            order = sorted(zip(model.featureImportances.toArray(), left, strict=True), reverse=True)
            left = [c for _, c in order[: max(min_features_to_select, len(left) - drop)]]
        return {"drop": [c for c in columns if c not in best[1]]}


class RFRegressorRFESelector(RFClassifierRFESelector):
    classifier = False
