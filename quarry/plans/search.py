"""Search over pipelines: tuners propose parameters, a pool of Spark jobs evaluates them, rankings sort the results."""

from __future__ import annotations

import itertools
import time
import json
from concurrent.futures import Executor, Future, ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import metrics
from quarry.operators.sample import best_sampler, class_counts
from quarry.operators.split import hashed_folds, make_splitter
from quarry.plans import estimators as est
from quarry.plans.ensemble import StackedPipeline
from quarry.plans.graph import ComponentGraph, Pipeline, make_pipeline
from quarry.plans.profile import Message, default_checks
from quarry.plans.timeseries import Horizon, TimeSeriesPipeline, baseline_pipeline, make_timeseries_pipeline, rolling_origins


def _values(space, n: int) -> list:
    """A list stays; a range of whole numbers or of numbers becomes n even steps."""
    if isinstance(space, list):
        return list(space)
    low, high = space
    if isinstance(low, int) and isinstance(high, int):
        return sorted({int(round(v)) for v in np.linspace(low, high, n)})
    return [float(v) for v in np.linspace(low, high, n)]


class NoParamsLeft(Exception):
    """A tuner has proposed all that it can."""


class GridSearchTuner:
    """All combinations of ``n_points`` values of each range, in order."""

    def __init__(self, space: dict, n_points: int = 10, random_seed: int = 0):
        self.space = space
        self._grid = iter(itertools.product(*[_values(v, n_points) for v in space.values()]))

    def propose(self) -> dict:
        got = next(self._grid, None)
        if got is None:
            raise NoParamsLeft
        return dict(zip(self.space, got, strict=True))

    def add(self, parameters: dict, score: float) -> None:
        return None

    def search_space_exhausted(self) -> bool:
        self._grid, ahead = itertools.tee(self._grid)
        return next(ahead, None) is None


class RandomSearchTuner:
    """Random parameters, without repeats unless asked for."""

    def __init__(self, space: dict, with_replacement: bool = False, replacement_max_attempts: int = 10, random_seed: int = 0):
        self.space, self.again, self.attempts = space, with_replacement, replacement_max_attempts
        self.rng, self.seen = np.random.default_rng(random_seed), set()

    def draw(self) -> dict:
        out = {}
        for k, v in self.space.items():
            if isinstance(v, list):
                out[k] = v[int(self.rng.integers(len(v)))]
            elif isinstance(v[0], int) and isinstance(v[1], int):
                out[k] = int(self.rng.integers(v[0], v[1] + 1))
            else:
                out[k] = float(self.rng.uniform(*v))
        return out

    def propose(self) -> dict:
        for _ in range(self.attempts if not self.again else 1):
            got = self.draw()
            mark = repr(sorted(got.items()))
            if self.again or mark not in self.seen:
                self.seen.add(mark)
                return got
        raise NoParamsLeft

    def add(self, parameters: dict, score: float) -> None:
        return None


class BayesianTuner(RandomSearchTuner):
    """Of many random parameters the one that a smoother over the scores so far expects most of, with a bonus for distance."""

    def __init__(self, space: dict, random_seed: int = 0, n_initial: int = 5, n_candidates: int = 200):
        super().__init__(space, with_replacement=True, random_seed=random_seed)
        self.n_initial, self.n_candidates, self.history = n_initial, n_candidates, []

    def _point(self, p: dict) -> np.ndarray:
        out = []
        for k, v in self.space.items():
            out.append(v.index(p[k]) / max(len(v) - 1, 1) if isinstance(v, list) else (p[k] - v[0]) / ((v[1] - v[0]) or 1))
        return np.array(out, dtype=float)

    def propose(self) -> dict:
        if len(self.history) < self.n_initial:
            return self.draw()
        x = np.array([h[0] for h in self.history])
        y = np.array([h[1] for h in self.history])
        drawn = [self.draw() for _ in range(self.n_candidates)]
        d2 = ((np.array([self._point(p) for p in drawn])[:, None, :] - x[None, :, :]) ** 2).sum(2)
        w = np.exp(-d2 / 0.1) + 1e-9
        expected = (w @ y) / w.sum(1)
        bonus = (y.std() + 1e-9) * np.sqrt(d2.min(1))
        return drawn[int(np.argmax(expected + bonus))]

    def add(self, parameters: dict, score: float) -> None:
        if score == score:
            self.history.append((self._point(parameters), score))


def best_per_name(results: DataFrame, name: str, score: str, greater_is_better: bool) -> DataFrame:
    """Each pipeline name's best row."""
    order = F.desc(score) if greater_is_better else F.asc(score)
    return results.withColumn("_r", F.row_number().over(W.partitionBy(name).orderBy(order))).where("_r = 1").drop("_r")


@dataclass
class Progress:
    """Stop rules: time, iterations, batches, and a number of results without enough improvement."""

    max_seconds: float | None = None
    max_iterations: int | None = None
    max_batches: int | None = None
    patience: int | None = None
    tolerance: float = 0.0
    started: float = field(default_factory=time.time)

    def go_on(self, n_results: int, n_batches: int, scores: list[float]) -> bool:
        if self.max_seconds is not None and time.time() - self.started >= self.max_seconds:
            return False
        if self.max_iterations is not None and n_results >= self.max_iterations or self.max_batches is not None and n_batches >= self.max_batches:
            return False
        if self.patience is not None and len(scores) > self.patience:
            best, since = scores[0], 0
            for s in scores[1:]:
                better = s > best and (best == 0 or abs(s - best) / abs(best) > self.tolerance)
                best, since = (s, 0) if better else (best, since + 1)
            return since < self.patience
        return True


class SequentialEngine(Executor):
    """Work is done at once, in the caller's thread."""

    def submit(self, fn, /, *args, **kwargs) -> Future:
        out: Future = Future()
        try:
            out.set_result(fn(*args, **kwargs))
        except Exception as e:  # noqa: BLE001 - the future carries it
            out.set_exception(e)
        return out


def engine(name: str, workers: int = 2) -> Executor:
    """"sequential", or "threads": jobs of several pipelines are on the cluster at a time. Spark itself spreads each job's
    work and keeps tables there, so engines need no other cluster."""
    if name == "sequential":
        return SequentialEngine()
    if name in ("threads", "cf_threaded", "cluster"):
        return ThreadPoolExecutor(workers)
    raise ValueError(f"no engine {name!r}")


def raise_error(error: Exception, pipeline: str) -> None:
    raise error


def silent(error: Exception, pipeline: str) -> None:
    return None


def log_error(error: Exception, pipeline: str) -> None:
    import logging

    logging.getLogger(__name__).warning("%s failed: %s", pipeline, str(error).splitlines()[0] if str(error) else type(error).__name__)


class IterativeAlgorithm:
    """Batches: every estimator with its defaults, then in turn tuned ones of the best, and an ensemble after each round of them."""

    def __init__(self, names: list[str], tuner, seed: int = 0, per_batch: int = 3, ensembling: bool = False):
        self.names, self.per_batch, self.ensembling, self.batch = list(names), per_batch, ensembling, 0
        self.tuners = {e: tuner(est.ESTIMATORS[e].space, random_seed=seed) for e in names if e in est.ESTIMATORS and est.ESTIMATORS[e].space}

    def next_batch(self, best: list[str]) -> list[tuple[str, dict]]:
        """(estimator, parameters) to try; ("ensemble", {}) asks for one. ``best`` has the estimators by score."""
        self.batch += 1
        if self.batch == 1:
            return [(e, {}) for e in self.names]
        if self.ensembling and self.batch % 2 == 1:
            return [("ensemble", {})] if len(best) > 1 else []
        return self._tuned(best)

    def _tuned(self, best: list[str]) -> list[tuple[str, dict]]:
        out = []
        for e in [e for e in best if e in self.tuners][: self.per_batch]:
            try:
                out.append((e, self.tuners[e].propose()))
            except NoParamsLeft:
                continue
        return out

    def add(self, name: str, parameters: dict, gain: float) -> None:
        if parameters and name in self.tuners:
            self.tuners[name].add(parameters, gain)


class DefaultAlgorithm(IterativeAlgorithm):
    """Batches: linear models and forests first, as they are fast; then the other estimators; then tuned ones and ensembles."""

    FIRST = ("linear_model", "random_forest")

    def next_batch(self, best: list[str]) -> list[tuple[str, dict]]:
        first = [e for e in self.names if est.ESTIMATORS[e].family in self.FIRST] or self.names
        rest = [e for e in self.names if e not in first]
        self.batch += 1
        if self.batch == 1:
            return [(e, {}) for e in first]
        if self.batch == 2 and rest:
            return [(e, {}) for e in rest]
        if self.ensembling and self.batch % 2 == 0:
            return [("ensemble", {})] if len(best) > 1 else []
        return self._tuned(best)


ALGORITHMS = {"iterative": IterativeAlgorithm, "default": DefaultAlgorithm}


@dataclass
class Result:
    id: int
    pipeline: Pipeline
    batch: int
    cv_scores: list[float]
    scores: dict[str, float]
    errors: dict[str, str]
    seconds: float

    @property
    def mean_cv_score(self) -> float:
        return float(np.mean(self.cv_scores)) if self.cv_scores else float("nan")

    def high_variance(self, objective: metrics.Objective, threshold: float = 0.5) -> bool:
        """Whether folds differ by more than a share of the objective's range (or of the mean, where it is unbounded)."""
        if len(self.cv_scores) < 2:
            return False
        spread = max(self.cv_scores) - min(self.cv_scores)
        low, high = objective.bounds
        width = high - low if high - low != float("inf") else abs(self.mean_cv_score)
        return spread > threshold * width


class AutoMLSearch:
    """Batches of pipelines as an algorithm plans them: defaults, tuned ones, and ensembles if asked for.

    Folds are a column of one cached table, or rolling origins of a series, in which no training row is later than a test
    row. An engine keeps several Spark jobs in flight.
    """

    def __init__(self, df: DataFrame, y: str, problem: str, key: str, objective: str = "auto", families: list[str] | None = None, excluded: list[str] | None = None, estimators: list[str] | None = None, n_splits: int = 3, max_batches: int = 1, max_iterations: int | None = None, max_seconds: float | None = None, patience: int | None = None, tolerance: float = 0.0, parallel: int = 2, parameters: dict | None = None, tuner=BayesianTuner, random_seed: int = 0, on_error: str = "log", horizon: Horizon | None = None, ensembling: bool = False, algorithm: str = "iterative", engine_name: str = "threads", tune_threshold: bool = False, error_callback=log_error, after_result=None):
        self.df, self.y, self.problem, self.key = df, y, problem, key
        self.objective = metrics.objective(metrics.default_objective(problem) if objective == "auto" else objective)
        self.names = estimators or est.estimators_for(problem, families, excluded)
        self.n_splits, self.parallel, self.parameters, self.tuner, self.seed, self.on_error = n_splits, parallel, parameters or {}, tuner, random_seed, on_error
        if "time_series" in problem and horizon is None:
            raise ValueError("a time-series search needs a horizon")
        self.horizon, self.ensembling, self.algorithm, self.engine_name, self.tune_threshold, self.callback, self.after_result = horizon, ensembling, algorithm, engine_name, tune_threshold, error_callback, after_result
        self.progress = Progress(max_seconds, max_iterations, max_batches, patience, tolerance)
        self.results: list[Result] = []
        self.errors: list[tuple[str, str]] = []

    def search(self) -> AutoMLSearch:
        n = self.df.count()
        sampler = None
        if "regression" not in self.problem:
            sampler = best_sampler(n, class_counts(self.df, self.y))
        self.sampler, plan = sampler, make_splitter(n, self.problem, self.n_splits)
        table = None
        if plan["kind"] == "time_series":
            series = self.df.select(self.horizon.series_id).distinct().count() if self.horizon.series_id else 1
            self.pairs = rolling_origins(self.df, self.horizon, self.n_splits, series)
        else:
            single = plan["kind"] == "single"
            folds = 4 if single else self.n_splits
            table = hashed_folds(self.df, self.key, folds, self.seed).persist()
            part = lambda c: table.where(c).drop("fold")
            self.pairs = [(part(F.col("fold") == 0), part(F.col("fold") != 0))] if single else [(part(F.col("fold") != k), part(F.col("fold") == k)) for k in range(folds)]
        plans = ALGORITHMS[self.algorithm](self.names, self.tuner, self.seed, ensembling=self.ensembling)
        batch, counter = 0, itertools.count(len(self.results))
        while self.progress.go_on(len(self.results), batch, [self._gain(r) for r in self.results]):
            work = plans.next_batch(self._best_estimators(len(self.names)))
            if not work:
                break
            with engine(self.engine_name, self.parallel) as pool:
                done = list(pool.map(lambda w, b=batch: self._evaluate(next(counter), w[0], w[1], b), work))
            for (e, p), r in zip(work, done, strict=True):
                if r is not None:
                    self.results.append(r)
                    plans.add(e, p, self._gain(r))
                    if self.after_result:
                        self.after_result(r, self)
            batch += 1
        if table is not None:
            table.unpersist()
        return self

    def _gain(self, r: Result) -> float:
        return r.mean_cv_score if self.objective.greater_is_better else -r.mean_cv_score

    def _best_estimators(self, k: int) -> list[str]:
        return list(dict.fromkeys(r.pipeline.graph.order[-1] for r in self._ranked()))[:k]

    def _ranked(self) -> list[Result]:
        single = [r for r in self.results if not isinstance(r.pipeline, StackedPipeline) and r.cv_scores]
        return sorted(single, key=lambda r: -self._gain(r) if self._gain(r) == self._gain(r) else float("inf"))

    def ensemble_inputs(self, k: int = 3) -> list[Pipeline]:
        """The best pipeline of each of the k best estimators, which an ensemble would be built from."""
        best: dict[str, Pipeline] = {}
        for r in self._ranked():
            best.setdefault(r.pipeline.graph.order[-1], r.pipeline)
        return list(best.values())[:k]

    def make(self, name: str, parameters: dict | None = None) -> Pipeline | StackedPipeline:
        """The pipeline that the search tries for an estimator and parameters."""
        if name == "ensemble":
            return StackedPipeline([p.clone() for p in self.ensemble_inputs()], self.problem, self.key)
        p = {**self.parameters, name: self.parameters.get(name, {}) | (parameters or {})}
        if self.horizon:
            return make_timeseries_pipeline(self.df, self.y, name, self.problem, self.horizon, p)
        return make_pipeline(self.df, self.y, name, self.problem, p, getattr(self, "sampler", None), self.key)

    def _evaluate(self, i: int, name: str, parameters: dict, batch: int) -> Result | None:
        try:
            return self._result(i, self.make(name, parameters), batch)
        except Exception as e:  # noqa: BLE001 - one pipeline's failure must not end the search
            if self.on_error == "raise":
                raise
            self.errors.append((name, str(e).splitlines()[0] if str(e) else type(e).__name__))
            self.callback(e, name)
            return None

    def _result(self, i: int, pipeline: Pipeline | StackedPipeline, batch: int) -> Result:
        """Scores over all folds; the last fitted pipeline stays in the result."""
        began, cv, other, errors, fitted = time.time(), [], {}, {}, pipeline
        for train, test in self.pairs:
            fitted = pipeline.clone().fit(train, self.y)
            if self.tune_threshold and isinstance(fitted, Pipeline) and fitted.can_tune_threshold_with(self.objective.name):
                fitted.optimize_threshold(train, self.objective.name)
            got = fitted.score(test, [self.objective.name], train) if isinstance(fitted, TimeSeriesPipeline) else fitted.score(test, [self.objective.name])
            errors |= got.errors
            if self.objective.name in got.values:
                cv.append(got.values[self.objective.name])
            other = got.values
        return Result(i, fitted, batch, cv, other, errors, time.time() - began)

    def threshold_tuning(self, pipeline: Pipeline) -> tuple[bool, str]:
        """Whether thresholds are tuned for a pipeline, and the objective that decides."""
        return self.tune_threshold and pipeline.can_tune_threshold_with(self.objective.name), self.objective.name

    def add_to_rankings(self, pipeline: Pipeline) -> Result:
        """Score a pipeline of the user's own over the search's folds and rank it with the others."""
        if not getattr(self, "pairs", None):
            raise ValueError("search first")
        if any(r.pipeline.name == pipeline.name and getattr(r.pipeline, "parameters", None) == pipeline.parameters for r in self.results):
            raise ValueError(f"{pipeline.name} with these parameters is ranked already")
        out = self._result(len(self.results), pipeline, -1)
        self.results.append(out)
        return out

    def train_pipelines(self, pipelines: list[Pipeline]) -> dict[str, Pipeline]:
        """Pipelines fitted on the whole table, by name."""
        unique_names(pipelines)
        with engine(self.engine_name, self.parallel) as pool:
            return dict(zip([p.name for p in pipelines], pool.map(lambda p: p.clone().fit(self.df, self.y), pipelines), strict=True))

    def score_pipelines(self, pipelines: list[Pipeline], df: DataFrame, objectives: list[str]) -> dict[str, dict[str, float]]:
        """Scores of fitted pipelines on a table, by name."""
        unique_names(pipelines)
        with engine(self.engine_name, self.parallel) as pool:
            return dict(zip([p.name for p in pipelines], pool.map(lambda p: p.score(df, objectives).values, pipelines), strict=True))

    def recommendation_scores(self, objectives: list[str], prioritized: str | None = None) -> DataFrame:
        """Each ranked pipeline's recommendation score, from its scores on the last fold."""
        rows = []
        for r in self.results:
            train, test = self.pairs[-1]
            got = r.pipeline.score(test, objectives, train) if isinstance(r.pipeline, TimeSeriesPipeline) else r.pipeline.score(test, objectives)
            rows.append((r.id, *[got.values.get(o) for o in objectives]))
        table = self.df.sparkSession.createDataFrame(rows, "id int, " + ", ".join(f"{o} double" for o in objectives))
        return metrics.recommendation(table, objectives, "id", prioritized)

    def best_so_far(self) -> list[tuple[int, float, float]]:
        """(iteration, score, best score until then): what a plot of the search would draw."""
        out, best = [], None
        for i, r in enumerate(self.results):
            s = r.mean_cv_score
            if s == s and (best is None or (s > best) == self.objective.greater_is_better):
                best = s
            out.append((i, s, best))
        return out

    def save(self, path: str) -> None:
        """Results below one path: facts as JSON, and each fitted pipeline that is not an ensemble."""
        spark = self.df.sparkSession
        facts = [{"id": r.id, "batch": r.batch, "cv": r.cv_scores, "scores": r.scores, "errors": r.errors, "seconds": r.seconds, "name": r.pipeline.name, "stored": isinstance(r.pipeline, Pipeline) and not isinstance(r.pipeline, TimeSeriesPipeline)} for r in self.results]
        for r, f in zip(self.results, facts, strict=True):
            if f["stored"]:
                r.pipeline.save(f"{path}/pipeline-{r.id}")
        options = {"y": self.y, "problem": self.problem, "key": self.key, "objective": self.objective.name, "names": self.names, "results": facts}
        spark.createDataFrame([(json.dumps(options),)], "facts string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @staticmethod
    def load(df: DataFrame, path: str) -> AutoMLSearch:
        """The search with its results, on a table to go on with; pipelines that were not stored have their names only."""
        spark = df.sparkSession
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        out = AutoMLSearch(df, facts["y"], facts["problem"], facts["key"], facts["objective"], estimators=facts["names"])
        for f in facts["results"]:
            pipeline = Pipeline.load(spark, f"{path}/pipeline-{f['id']}") if f["stored"] else Pipeline(ComponentGraph({}), facts["problem"], {}, f["name"])
            out.results.append(Result(f["id"], pipeline, f["batch"], f["cv"], f["scores"], f["errors"], f["seconds"]))
        return out

    def full_rankings(self) -> DataFrame:
        rows = [(r.id, r.pipeline.name, r.batch, r.mean_cv_score, r.high_variance(self.objective), r.seconds) for r in self.results]
        t = self.df.sparkSession.createDataFrame(rows, "id int, pipeline_name string, batch int, mean_cv_score double, high_variance_cv boolean, seconds double")
        return t.orderBy(F.desc("mean_cv_score") if self.objective.greater_is_better else F.asc("mean_cv_score"))

    def rankings(self) -> DataFrame:
        return best_per_name(self.full_rankings(), "pipeline_name", "mean_cv_score", self.objective.greater_is_better)

    def best_pipeline(self) -> Pipeline:
        best = max((r for r in self.results if r.cv_scores), key=self._gain)
        return best.pipeline.clone().fit(self.df, self.y)

    def describe(self, i: int) -> dict:
        r = next(r for r in self.results if r.id == i)
        return r.pipeline.describe() | {"cv_scores": r.cv_scores, "scores": r.scores, "errors": r.errors, "seconds": r.seconds}


def unique_names(pipelines: list[Pipeline]) -> None:
    names = [p.name for p in pipelines]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"pipelines share the names {twice}")


def pipelines_of(graphs: dict[str, dict[str, list]], problem: str, key: str | None = None, parameters: dict | None = None) -> list[Pipeline]:
    """Pipelines from component graphs by name."""
    return [Pipeline(ComponentGraph(steps, key), problem, {n: (parameters or {})[n] for n in steps if n in (parameters or {})}, name) for name, steps in graphs.items()]


def search_iterative(df: DataFrame, y: str, problem: str, key: str, **options) -> tuple[AutoMLSearch | None, list[Message]]:
    """:func:`search` by the iterative algorithm."""
    return search(df, y, problem, key, **options | {"algorithm": "iterative"})


def search(df: DataFrame, y: str, problem: str, key: str, **options) -> tuple[AutoMLSearch | None, list[Message]]:
    """Data checks, then a search; errors of the checks stop it."""
    messages = default_checks(df.drop(key), y, problem, options.pop("problem_configuration", None))
    if any(m.level == "error" for m in messages):
        return None, messages
    return AutoMLSearch(df, y, problem, key, **options).search(), messages
