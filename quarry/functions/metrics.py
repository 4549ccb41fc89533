"""Objectives as aggregations over labels and predictions, and curves as cumulative sums.

Algebraic objectives are expressions over one aggregation, so any number of them is one pass. Ranking objectives sort by
score once. Curves work on the table of distinct scores, with counts of both classes at each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.ordered import running, with_previous

EPS = 2.220446049250313e-16


def _div(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b.cast("double"), F.lit(0.0)))


def _n(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def binary_parts(y: Column, p: Column) -> dict[str, Column]:
    return {"tp": _n((y == 1) & (p == 1)), "tn": _n((y == 0) & (p == 0)), "fp": _n((y == 0) & (p == 1)), "fn": _n((y == 1) & (p == 0))}


def _mcc(c):
    return _div(c["tp"] * c["tn"] - c["fp"] * c["fn"], F.sqrt((c["tp"] + c["fp"]).cast("double") * (c["tp"] + c["fn"]) * (c["tn"] + c["fp"]) * (c["tn"] + c["fn"])))


BINARY = {
    "AccuracyBinary": lambda c: _div(c["tp"] + c["tn"], c["tp"] + c["tn"] + c["fp"] + c["fn"]),
    "BalancedAccuracyBinary": lambda c: (_div(c["tp"], c["tp"] + c["fn"]) + _div(c["tn"], c["tn"] + c["fp"])) / 2,
    "F1": lambda c: _div(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]),
    "Precision": lambda c: _div(c["tp"], c["tp"] + c["fp"]),
    "Recall": lambda c: _div(c["tp"], c["tp"] + c["fn"]),
    "MCCBinary": _mcc,
}


def binary_scores(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """All thresholded binary objectives, one row (for each group)."""
    parts = binary_parts(F.col(y).cast("int"), F.col(pred).cast("int"))
    counts = df.groupBy(*(by or [])).agg(*[v.alias(k) for k, v in parts.items()])
    c = {k: F.col(k) for k in parts}
    return counts.select(*(by or []), *[f(c).alias(name) for name, f in BINARY.items()])


def class_parts(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Per class: tp, number of true and of predicted rows."""
    cells = df.groupBy(F.col(y).cast("string").alias("t"), F.col(pred).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(F.explode(F.array(
        F.struct(F.col("t").alias("c"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p")),
    )).alias("x")).select("x.*")
    return both.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))


def multiclass_scores(df: DataFrame, y: str, pred: str) -> DataFrame:
    """All multiclass label objectives in one row."""
    c = class_parts(df, y, pred)
    precision, recall = _div(F.col("tp"), F.col("p")), _div(F.col("tp"), F.col("t"))
    f1 = _div(2 * F.col("tp"), F.col("t") + F.col("p"))
    tp, t = F.sum("tp"), F.sum("t")
    weighted = lambda v: F.sum(v * F.col("t")) / t
    s, cc = t.cast("double"), tp.cast("double")
    num = cc * s - F.sum(F.col("t").cast("double") * F.col("p"))
    den = F.sqrt((s * s - F.sum(F.pow(F.col("p").cast("double"), F.lit(2)))) * (s * s - F.sum(F.pow(F.col("t").cast("double"), F.lit(2)))))
    return c.agg(
        (tp / t).alias("AccuracyMulticlass"),
        F.avg(F.when(F.col("t") > 0, recall)).alias("BalancedAccuracyMulticlass"),
        (tp / t).alias("F1Micro"), F.avg(f1).alias("F1Macro"), weighted(f1).alias("F1Weighted"),
        (tp / t).alias("PrecisionMicro"), F.avg(precision).alias("PrecisionMacro"), weighted(precision).alias("PrecisionWeighted"),
        (tp / t).alias("RecallMicro"), F.avg(recall).alias("RecallMacro"), weighted(recall).alias("RecallWeighted"),
        _div(num, den).alias("MCCMulticlass"),
    )


REGRESSION = {
    "RootMeanSquaredError": lambda y, p: F.sqrt(F.avg((y - p) * (y - p))),
    "MSE": lambda y, p: F.avg((y - p) * (y - p)),
    "MAE": lambda y, p: F.avg(F.abs(y - p)),
    "MedianAE": lambda y, p: F.percentile(F.abs(y - p), F.lit(0.5)),
    "MaxError": lambda y, p: F.max(F.abs(y - p)),
    "R2": lambda y, p: 1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y)),
    "ExpVariance": lambda y, p: 1 - F.var_pop(y - p) / F.var_pop(y),
    "MeanSquaredLogError": lambda y, p: F.avg(F.pow(F.log1p(y) - F.log1p(p), F.lit(2))),
    "RootMeanSquaredLogError": lambda y, p: F.sqrt(F.avg(F.pow(F.log1p(y) - F.log1p(p), F.lit(2)))),
    "MAPE": lambda y, p: 100 * F.avg(F.abs(y - p) / F.when(y == 0, F.raise_error(F.lit("MAPE is undefined for zeros")).cast("double")).otherwise(F.abs(y))),
    "SMAPE": lambda y, p: 100 * F.avg(2 * F.abs(y - p) / F.when((y == 0) & (p == 0), F.raise_error(F.lit("SMAPE is undefined where both are zero")).cast("double")).otherwise(F.abs(y) + F.abs(p))),
}


def regression_scores(df: DataFrame, y: str, pred: str, names: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Regression objectives in one row (for each group), from one aggregation."""
    t, p = F.col(y).cast("double"), F.col(pred).cast("double")
    return df.groupBy(*(by or [])).agg(*[REGRESSION[n](t, p).alias(n) for n in names or REGRESSION])


def mase(df: DataFrame, y: str, pred: str, train: DataFrame, y_train: str, time_index: str) -> DataFrame:
    """Mean absolute error over that of the naive one-step forecast of the training series."""
    step = F.abs(F.col(y_train) - F.lag(y_train).over(W.partitionBy(F.lit(0)).orderBy(time_index)))
    naive = train.select(step.alias("d")).agg(F.avg("d").alias("naive"))
    return df.agg(F.avg(F.abs(F.col(y) - F.col(pred))).alias("mae")).crossJoin(naive).select((F.col("mae") / F.when(F.col("naive") == 0, F.raise_error(F.lit("MASE is undefined for a constant training series")).cast("double")).otherwise(F.col("naive"))).alias("MASE"))


def log_loss(p_of_label: Column) -> Column:
    """Mean negative logarithm of the probability of the label, clamped away from 0 and 1."""
    return F.avg(-F.ln(F.greatest(F.least(p_of_label, F.lit(1 - EPS)), F.lit(EPS))))


def score_table(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Positives and negatives at each distinct score."""
    return df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*(by or []), F.col(score).alias("score")).agg(_n(F.col(y) == 1).cast("bigint").alias("pos"), _n(F.col(y) != 1).cast("bigint").alias("neg"))


def auc(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve and Gini: a positive beats all negatives of smaller scores and half of those that tie."""
    t = score_table(df, y, score, by)
    if by:
        t = t.withColumn("under", F.coalesce(F.sum("neg").over(W.partitionBy(*by).orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    else:
        t = running(t, {"under": "neg"}, "score").withColumn("under", F.col("under") - F.col("neg"))
    area = F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))
    return t.groupBy(*(by or [])).agg(area.alias("AUC"), (2 * area - 1).alias("Gini"))


def multiclass_auc(df: DataFrame, y: str, probas: dict) -> DataFrame:
    """Micro, macro and weighted one-versus-rest AUC; ``probas`` maps a class to its probability column."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(str(k)).alias("c"), (F.col(y).cast("string") == str(k)).cast("int").alias("y"), F.col(p).cast("double").alias("s")) for k, p in probas.items()])).alias("x")).select("x.*")
    each = auc(cells, "y", "s", ["c"]).join(cells.groupBy("c").agg(F.sum("y").alias("n")), "c")
    return each.agg(F.avg("AUC").alias("AUCMacro"), (F.sum(F.col("AUC") * F.col("n")) / F.sum("n")).alias("AUCWeighted")).crossJoin(auc(cells, "y", "s").select(F.col("AUC").alias("AUCMicro")))


def curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """For each distinct score as threshold (score >= threshold): tp, fp, and the totals."""
    t = score_table(df, y, score)
    totals = t.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return running(t, {"tp": "pos", "fp": "neg"}, F.desc("score")).crossJoin(F.broadcast(totals)).select("score", "tp", "fp", "p", "n")  # totals are one row


def roc_points(df: DataFrame, y: str, score: str) -> DataFrame:
    return curve(df, y, score).select(F.col("score").alias("threshold"), (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"))


def pr_points(df: DataFrame, y: str, score: str) -> DataFrame:
    return curve(df, y, score).select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("p")).alias("recall"))


def best_threshold(df: DataFrame, y: str, score: str, objective: str = "F1") -> DataFrame:
    """The threshold (score > threshold) with the best value of a binary objective, found exactly over all scores."""
    c = with_previous(curve(df, y, score), "score", "score", "next").withColumn("next", F.coalesce("next", F.lit(0.0)))
    parts = {"tp": F.col("tp"), "fp": F.col("fp"), "fn": F.col("p") - F.col("tp"), "tn": F.col("n") - F.col("fp")}
    return c.select(F.col("next").alias("threshold"), BINARY[objective](parts).alias("value")).orderBy(F.desc("value"), F.desc("threshold")).limit(1)


def confusion(df: DataFrame, y: str, pred: str, normalize: str | None = "true") -> DataFrame:
    """(label, predicted, value): counts, or shares of the label's, the prediction's or all rows."""
    cells = df.groupBy(F.col(y).alias("label"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    of = {"true": ["label"], "pred": ["predicted"], "all": [F.lit(0)]}.get(normalize)
    value = F.col("n").cast("double") if of is None else F.col("n") / F.sum("n").over(W.partitionBy(*of))
    return cells.select("label", "predicted", value.alias("value"))


def cost_benefit(y: Column, p: Column, true_positive: float, true_negative: float, false_positive: float, false_negative: float) -> Column:
    return F.avg(F.when((y == 1) & (p == 1), true_positive).when((y == 0) & (p == 0), true_negative).when(p == 1, false_positive).otherwise(false_negative))


def fraud_cost(y: Column, p: Column, amount: Column, retry_percentage: float = 0.5, interchange_fee: float = 0.02, fraud_payout_percentage: float = 1.0) -> Column:
    """Cost of missed and of wrongly refused payments over all amounts, and 1 more where all predictions agree."""
    missed = F.sum(F.when((y == 1) & (p == 0), amount * fraud_payout_percentage).otherwise(0.0))
    refused = F.sum(F.when((y == 0) & (p == 1), amount * (1 - retry_percentage) * interchange_fee).otherwise(0.0))
    return (missed + refused) / F.sum(amount) + (2 - F.count_distinct(p))


def lead_scoring(y: Column, p: Column, true_positives: float = 1, false_positives: float = -1) -> Column:
    return (true_positives * _n((y == 1) & (p == 1)) + false_positives * _n((y == 0) & (p == 1))) / F.count(F.lit(1)) - (2 - F.count_distinct(p))


def sensitivity_low_alert(df: DataFrame, y: str, score: str, alert_rate: float = 0.01) -> DataFrame:
    """Recall when only the rows with the highest scores, a share of ``alert_rate``, are flagged."""
    cut = df.agg(F.percentile(F.col(score), F.lit(1 - alert_rate)).alias("cut"))
    return df.crossJoin(F.broadcast(cut)).agg(_div(_n((F.col(y) == 1) & (F.col(score) >= F.col("cut"))), _n(F.col(y) == 1)).alias("SensitivityLowAlert"))


@dataclass(frozen=True)
class Objective:
    """What a search needs to know about an objective."""

    name: str
    problems: tuple[str, ...]
    greater_is_better: bool = True
    needs_proba: bool = False
    perfect: float = 1.0
    bounds: tuple[float, float] = (0.0, 1.0)
    percentage: bool = True
    positive_only: bool = False
    core: bool = True

    def percent_better(self, score: float, baseline: float) -> float:
        """Signed per cent better than a baseline; a plain difference for percentage-like objectives."""
        if score is None or baseline is None:
            return float("nan")
        if abs(score - baseline) < 1e-10:
            return 0.0
        gain = score - baseline if self.greater_is_better else baseline - score
        if self.percentage:
            return 100 * gain
        return float("inf") if baseline == 0 else 100 * gain / abs(baseline)


_B, _M, _R, _TR = ("binary", "time_series_binary"), ("multiclass", "time_series_multiclass"), ("regression", "time_series_regression", "multiseries_time_series_regression"), ("time_series_regression", "multiseries_time_series_regression")
_INF = (0.0, float("inf"))
OBJECTIVES: dict[str, Objective] = {o.name: o for o in [
    *[Objective(n, _B) for n in ("AccuracyBinary", "BalancedAccuracyBinary", "F1", "Precision")],
    Objective("Recall", _B, core=False),
    *[Objective(n, _M) for n in ("AccuracyMulticlass", "BalancedAccuracyMulticlass", "F1Micro", "F1Macro", "F1Weighted", "PrecisionMicro", "PrecisionMacro", "PrecisionWeighted")],
    *[Objective(n, _M, core=False) for n in ("RecallMicro", "RecallMacro", "RecallWeighted")],
    Objective("AUC", _B, needs_proba=True),
    *[Objective(n, _M, needs_proba=True) for n in ("AUCMicro", "AUCMacro", "AUCWeighted")],
    Objective("Gini", _B, needs_proba=True, bounds=(-1.0, 1.0), percentage=False),
    Objective("LogLossBinary", _B, greater_is_better=False, needs_proba=True, perfect=0.0, percentage=False),
    Objective("LogLossMulticlass", _M, greater_is_better=False, needs_proba=True, perfect=0.0, percentage=False),
    Objective("MCCBinary", _B, bounds=(-1.0, 1.0), percentage=False),
    Objective("MCCMulticlass", _M, bounds=(-1.0, 1.0), percentage=False),
    *[Objective(n, _R, greater_is_better=False, perfect=0.0, bounds=_INF, percentage=False) for n in ("RootMeanSquaredError", "MAE", "MSE", "MedianAE", "MaxError")],
    *[Objective(n, _R, greater_is_better=False, perfect=0.0, bounds=_INF, percentage=False, positive_only=True, core=False) for n in ("RootMeanSquaredLogError", "MeanSquaredLogError")],
    Objective("R2", _R, bounds=(-1.0, 1.0), percentage=False),
    Objective("ExpVariance", _R, bounds=(float("-inf"), 1.0), percentage=False),
    Objective("MAPE", _TR, greater_is_better=False, perfect=0.0, bounds=_INF, percentage=False, positive_only=True),
    Objective("SMAPE", _TR, greater_is_better=False, perfect=0.0, bounds=(0.0, 200.0), positive_only=True),
    Objective("MASE", _TR, greater_is_better=False, perfect=0.0, bounds=_INF, percentage=False),
    Objective("CostBenefitMatrix", _B, bounds=(float("-inf"), float("inf")), perfect=float("inf"), percentage=False, core=False),
    Objective("FraudCost", _B, greater_is_better=False, perfect=0.0, core=False),
    Objective("LeadScoring", _B, bounds=(float("-inf"), float("inf")), perfect=float("inf"), percentage=False, core=False),
    Objective("SensitivityLowAlert", _B, core=False),
]}


def objective(name: str) -> Objective:
    if name not in OBJECTIVES:
        raise ValueError(f"no objective {name!r}")
    return OBJECTIVES[name]


def objectives_for(problem: str, core_only: bool = True) -> list[Objective]:
    return [o for o in OBJECTIVES.values() if problem in o.problems and (o.core or not core_only)]


def default_objective(problem: str) -> str:
    """What a search optimises when nothing is asked for."""
    fixed = {"binary": "LogLossBinary", "multiclass": "LogLossMulticlass", "regression": "R2", "time_series_regression": "MedianAE", "time_series_binary": "LogLossBinary", "time_series_multiclass": "LogLossMulticlass", "multiseries_time_series_regression": "MedianAE"}
    return fixed[problem]


def normalized(results: DataFrame, names: list[str], by: str = "pipeline") -> DataFrame:
    """Objectives as 0 to 1, larger better; bounded ones and R2 stay, minima and maxima count 0 among the values."""
    whole = W.partitionBy(F.lit(0))
    cols = []
    for n in names:
        o = objective(n)
        if o.percentage or n == "R2":
            cols.append(F.col(n).alias(n))
            continue
        low, high = F.least(F.min(n).over(whole), F.lit(0.0)), F.greatest(F.max(n).over(whole), F.lit(0.0))
        share = _div(F.col(n) - low, high - low)
        cols.append((share if o.greater_is_better else 1 - share).alias(n))
    return results.select(by, *cols)


def recommendation(results: DataFrame, names: list[str], by: str = "pipeline", prioritized: str | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """100 times the weighted mean of normalised objectives; a prioritised one weighs one half."""
    if weights is None:
        rest = [n for n in names if n != prioritized]
        weights = {n: 1 / len(names) for n in names} if prioritized is None else {prioritized: 0.5 if rest else 1.0} | {n: 0.5 / len(rest) for n in rest}
    total = F.lit(0.0)
    for n in names:
        total = total + F.col(n) * F.lit(float(weights.get(n, 0.0)))
    return normalized(results, names, by).select(by, (100 * total).alias("recommendation"))


def _given(value, message: str):
    if value is None:
        raise ValueError(message)
    return value


class CustomObjective:
    """An objective to subclass: ``score`` turns a table of labels and predictions into a number.

    ``decision`` turns probabilities into labels at a threshold, and ``best_threshold`` tries the distinct scores' even
    quantiles for it, each in the same pass if ``score_column`` is given as an aggregate.
    """

    name, problems, greater_is_better, perfect, bounds, percentage, positive_only = "Custom", (), True, 1.0, (0.0, 1.0), False, False

    def score_column(self, y: Column, pred: Column) -> Column:
        """The objective as an aggregate of two columns."""
        raise NotImplementedError

    def validate(self, df: DataFrame, y: str, pred: str) -> None:
        """Raise for empty tables, nulls, infinite predictions, and labels that must be positive and are not."""
        bad = F.col(pred).isNull() | F.col(y).isNull()
        if df.schema[pred].dataType.typeName() in ("float", "double"):
            bad = bad | F.isnan(pred) | (F.abs(pred) == float("inf"))
        low = F.count(F.when(F.col(y) <= 0, 1)) if self.positive_only else F.lit(0)
        n, wrong, small = df.agg(F.count(F.lit(1)), F.count(F.when(bad, 1)), low).first()
        if not n:
            raise ValueError("there are no rows")
        if wrong:
            raise ValueError(f"{wrong} rows have null or infinite values")
        if small:
            raise ValueError(f"{self.name} is undefined where labels are not positive")

    def score(self, df: DataFrame, y: str, pred: str) -> float:
        self.validate(df, y, pred)
        return df.agg(self.score_column(F.col(y), F.col(pred)).alias("s")).first()["s"]

    def decision(self, proba: Column, threshold: float = 0.5) -> Column:
        return (proba > threshold).cast("int")

    def best_threshold(self, df: DataFrame, y: str, proba: str, steps: int = 100) -> float:
        values = [i / steps for i in range(steps)]
        got = df.agg(*[self.score_column(F.col(y), self.decision(F.col(proba), t)).alias(str(i)) for i, t in enumerate(values)]).first()
        pairs = [(v, -t) if self.greater_is_better else (-v, -t) for v, t in zip(got, values, strict=True) if v is not None]
        return -max(pairs)[1] if pairs else 0.5

    def percent_better(self, score: float, baseline: float) -> float:
        return Objective(self.name, tuple(self.problems), self.greater_is_better, percentage=self.percentage).percent_better(score, baseline)


#: Objectives that rank pipelines but are not optimised, and those that recommendations weigh by default.
RANKING_ONLY = ("RootMeanSquaredLogError", "MeanSquaredLogError", "MAPE", "SMAPE", "MASE", "Recall", "RecallMicro", "RecallMacro", "RecallWeighted")
RECOMMENDED = {
    "binary": ("F1", "BalancedAccuracyBinary", "AUC", "LogLossBinary"),
    "binary_imbalanced": ("F1", "AUC", "LogLossBinary"),
    "multiclass": ("F1Macro", "BalancedAccuracyMulticlass", "AUCMacro", "LogLossMulticlass"),
    "multiclass_imbalanced": ("F1Weighted", "AUCWeighted", "LogLossMulticlass"),
    "regression": ("MSE", "MAE", "MedianAE", "R2"),
    "time_series_regression": ("MSE", "MAE", "MedianAE", "R2"),
    "multiseries_time_series_regression": ("MSE", "MAE", "MedianAE", "R2"),
}


def ranking_only_objectives() -> list[Objective]:
    return [OBJECTIVES[n] for n in RANKING_ONLY]


def optimization_objectives(problem: str) -> list[Objective]:
    return [o for o in objectives_for(problem) if o.name not in RANKING_ONLY]


def ranking_objectives(problem: str) -> list[Objective]:
    return objectives_for(problem) + [o for o in ranking_only_objectives() if problem in o.problems and not o.core]


def recommended_objectives(problem: str, imbalanced: bool = False) -> list[str]:
    """What a recommendation score weighs for a problem; imbalanced classes have a set of their own."""
    kind = problem.removeprefix("time_series_") if problem.endswith(("binary", "multiclass")) else problem
    return list(RECOMMENDED[f"{kind}_imbalanced" if imbalanced and f"{kind}_imbalanced" in RECOMMENDED else kind])


def organized_objectives(problem: str, include: list[str] | None = None, exclude: list[str] | None = None, imbalanced: bool = False) -> list[str]:
    """The recommended objectives with some more and without others; both must be known, and not overlap."""
    for n in [*(include or []), *(exclude or [])]:
        objective(n)
    if set(include or []) & set(exclude or []):
        raise ValueError(f"both included and excluded: {sorted(set(include) & set(exclude))}")
    base = [n for n in recommended_objectives(problem, imbalanced) if n not in (exclude or [])]
    return base + [n for n in include or [] if n not in base]


@dataclass
class Scores:
    """Objectives of one prediction table, and what failed."""

    values: dict[str, float] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


def score_all(df: DataFrame, problem: str, names: list[str], y: str, pred: str, proba: str | None = None, probas: dict | None = None, amount: str | None = None, costs: tuple[float, float, float, float] = (1.0, 1.0, -1.0, -1.0), train: tuple[DataFrame, str, str] | None = None) -> Scores:
    """Every objective asked for; label objectives come from one aggregation, and one that fails leaves the others.

    ``amount`` is the column that FraudCost weighs by, ``costs`` what CostBenefitMatrix counts for true and false positives
    and negatives (tp, tn, fp, fn), ``train`` the training series with its value and time columns that MASE compares with.
    """
    out = Scores()
    plans: dict[str, object] = {}
    if problem in _B:
        plans = {n: (lambda: binary_scores(df, y, pred)) for n in BINARY}
        plans |= {n: (lambda: auc(df, y, proba)) for n in ("AUC", "Gini")}
        plans["LogLossBinary"] = lambda: df.agg(log_loss(F.when(F.col(y) == 1, F.col(proba)).otherwise(1 - F.col(proba))).alias("LogLossBinary"))
        plans["SensitivityLowAlert"] = lambda: sensitivity_low_alert(df, y, proba)
        plans["CostBenefitMatrix"] = lambda: df.agg(cost_benefit(F.col(y), F.col(pred), *costs).alias("CostBenefitMatrix"))
        plans["LeadScoring"] = lambda: df.agg(lead_scoring(F.col(y), F.col(pred)).alias("LeadScoring"))
        plans["FraudCost"] = lambda: df.agg(fraud_cost(F.col(y), F.col(pred), F.col(_given(amount, "FraudCost needs the amount column"))).alias("FraudCost"))
    elif problem in _M:
        labels = ("AccuracyMulticlass", "BalancedAccuracyMulticlass", "F1Micro", "F1Macro", "F1Weighted", "PrecisionMicro", "PrecisionMacro", "PrecisionWeighted", "RecallMicro", "RecallMacro", "RecallWeighted", "MCCMulticlass")
        plans = {n: (lambda: multiclass_scores(df, y, pred)) for n in labels}
        plans |= {n: (lambda: multiclass_auc(df, y, probas)) for n in ("AUCMicro", "AUCMacro", "AUCWeighted")}
        pick = F.coalesce(*[F.when(F.col(y).cast("string") == str(k), F.col(p)) for k, p in (probas or {"": pred}).items()])
        plans["LogLossMulticlass"] = lambda: df.agg(log_loss(pick).alias("LogLossMulticlass"))
    else:
        plans = {n: (lambda: regression_scores(df, y, pred, [x for x in names if x in REGRESSION and x not in ("MAPE", "SMAPE")])) for n in REGRESSION}
        plans |= {n: (lambda k=n: regression_scores(df, y, pred, [k])) for n in ("MAPE", "SMAPE")}
        plans["MASE"] = lambda: mase(df, y, pred, *_given(train, "MASE needs the training series"))
    done: dict[str, float] = {}
    for n in names:
        if n in done:
            out.values[n] = done[n]
            continue
        try:
            row = plans[n]().first().asDict()
            done |= row
            out.values[n] = row[n]
        except Exception as e:  # noqa: BLE001 - reported beside the other objectives
            out.errors[n] = str(e).splitlines()[0]
    return out
