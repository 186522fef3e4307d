"""Cross-validated search over a table.

Up to MAX_CELLS, the matrix (features, label, fold) is collected once and sent to the
tasks, of which each fits a candidate on a fold; estimators there are any class with
``fit(X, y)`` and ``predict(X)``. A larger table stays where it is: each fold of a
candidate is fitted and scored by the Spark estimator that SPARK names for the class.
An error of a candidate (its parameters, or the data it was given) is a missing score and
its text is kept; a candidate without the score of every fold has no mean and comes last, and
a strict search ends with that error. What fails otherwise, as a job, a lost worker or a lack
of memory, ends any search.
"""

from __future__ import annotations

import itertools
import json
import math
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import local_models as L
from quarry.operators import models as mod
from quarry.operators.evaluate import assign_folds, evaluated

MAX_CELLS = 20_000_000

#: Errors that say nothing of a candidate.
ENGINE_ERRORS = (PySparkException, Py4JError, MemoryError, OSError)


def _f1_parts(y, p):
    hit = float(((y == 1) & (p == 1)).sum())
    a, b = float((p == 1).sum()), float((y == 1).sum())
    return (hit / a if a else 0.0), (hit / b if b else 0.0)


def _r2(y, p):
    total, residual = float(((y - y.mean()) ** 2).sum()), float(((y - p) ** 2).sum())
    return (1.0 - residual / total) if total else (1.0 if residual == 0 else 0.0)


SCORES = {
    "accuracy": lambda y, p: float((y == p).mean()),
    "precision": lambda y, p: _f1_parts(y, p)[0],
    "recall": lambda y, p: _f1_parts(y, p)[1],
    "f1": lambda y, p: (2 * a * b / (a + b)) if (a := _f1_parts(y, p)[0]) + (b := _f1_parts(y, p)[1]) else 0.0,
    "r2": _r2,
    "neg_mse": lambda y, p: -float(((y - p) ** 2).mean()),
    "neg_mae": lambda y, p: -float(np.abs(y - p).mean()),
}


@dataclass
class CVResult:
    params: dict
    fold_scores: list[float]
    mean_score: float
    std_score: float
    elapsed_seconds: float
    error: str | None = None


def grid(space: dict[str, list]) -> list[dict]:
    if not space or any(not v for v in space.values()):
        raise ValueError("an empty grid")
    return [dict(zip(space, values)) for values in itertools.product(*space.values())]


def draw(space: dict[str, Any], rng: np.random.Generator) -> dict:
    """One pick: a list's element, a uniform float of (low, high), or log-uniform with "log"."""
    out = {}
    for name, s in space.items():
        if isinstance(s, tuple) and len(s) in (2, 3) and all(isinstance(v, (int, float)) for v in s[:2]):
            low, high = s[:2]
            if low >= high:
                raise ValueError(f"{name}: an empty range")
            if len(s) == 3:
                if s[2] != "log" or low <= 0:
                    raise ValueError(f"{name}: a log range is above 0")
                out[name] = float(math.exp(rng.uniform(math.log(low), math.log(high))))
            else:
                out[name] = float(rng.uniform(low, high))
        elif len(s):
            out[name] = s[int(rng.integers(len(s)))]
        else:
            raise ValueError(f"{name}: nothing to pick")
    return out


def checked(y, p) -> tuple[np.ndarray, np.ndarray]:
    """Labels and predictions as arrays of one dimension, as long as each other and not empty."""
    y, p = np.asarray(y), np.asarray(p)
    if y.ndim != 1 or p.ndim != 1 or len(y) != len(p):
        raise ValueError(f"labels and predictions of different shapes: {y.shape} and {p.shape}")
    if not len(y):
        raise ValueError("no labels to score")
    return y, p


#: Local estimator -> the Spark estimator with the same parameters, for tables beyond MAX_CELLS.
SPARK = {
    L.Tree: lambda task="classification", criterion=None, max_depth=5, min_samples_split=2: mod.DecisionTree(task, max_depth, min_samples_split),
    L.Forest: lambda n_trees=100, task="classification", max_depth=5, min_samples_split=2, random_state=42: mod.RandomForest(n_trees, task, max_depth, min_samples_split, random_state),
    L.NaiveBayes: lambda smoothing=1e-9: mod.GaussianNaiveBayes(smoothing),
    L.Linear: lambda lr=0.01, n_iter=1000, lr_schedule="constant", decay=0.001: mod.LinearRegression(lr, n_iter, lr_schedule, decay),
    L.Logistic: lambda lr=0.01, n_iter=1000, lr_schedule="constant", decay=0.001: mod.LogisticRegression(lr, n_iter, lr_schedule, decay),
    L.Neighbours: lambda k=5, task="classification", metric="euclidean": mod.KNN(int(k), task, metric),
}


def fit_spark(estimator: type, params: dict, df: DataFrame, features: list[str], label: str, key: str) -> mod.Estimator:
    """The Spark estimator for a local class, fitted."""
    if estimator not in SPARK:
        raise ValueError(f"{estimator.__name__} has no Spark counterpart, and the table has more than {MAX_CELLS} cells")
    model = SPARK[estimator](**params)
    return model.fit(df, features, label, key) if isinstance(model, (mod.KNN, mod.RandomForest)) else model.fit(df, features, label)


def matrix(folded: DataFrame, features: list[str], label: str, key: str) -> pd.DataFrame:
    """Features, label and fold in key order on the driver: within MAX_CELLS only."""
    rows = folded.orderBy(key).select(*[F.col(f"`{f}`").cast("double").alias(f) for f in features], F.col(f"`{label}`").cast("double").alias("__y"), "fold")
    return rows.toPandas()


class Search:
    """Grid (``n_iter=None``) or random search over K folds."""

    def __init__(self, estimator: type, space: dict, scoring: str = "accuracy", cv: int = 5, n_iter: int | None = None, time_budget: float | None = None, seed: int = 42, shuffle: bool = True, strict: bool = False):
        if scoring not in SCORES:
            raise ValueError(f"unknown metric {scoring!r}; one of {sorted(SCORES)}")
        self.estimator, self.space, self.scoring, self.cv = estimator, space, scoring, cv
        self.n_iter, self.time_budget, self.seed, self.shuffle = n_iter, time_budget, seed, shuffle
        self.strict = strict  # an error of any candidate ends the search
        self.results: list[CVResult] | None = None  # until a search is done
        self.stopped = False  # the time budget ended the search

    def candidates(self) -> list[dict]:
        if self.n_iter is None:
            return grid(self.space)
        rng = np.random.default_rng(self.seed)
        return [draw(self.space, rng) for _ in range(self.n_iter)]

    def fit(self, df: DataFrame, features: list[str], label: str, key: str) -> Search:
        folded = assign_folds(df, key, self.cv, self.shuffle, self.seed)
        if df.count() * (len(features) + 2) > MAX_CELLS:
            return self.fit_frame(folded, features, label, key)
        return self.fit_arrays(df.sparkSession, matrix(folded, features, label, key))

    def _over(self, began: float) -> bool:
        self.stopped = self.time_budget is not None and time.time() - began > self.time_budget
        return self.stopped

    def _result(self, params: dict, rows: list[tuple[float, float, str | None]]) -> CVResult:
        """A candidate's result from (score, seconds, error) of its folds; no mean where a fold has no score."""
        scores = [score for score, _, _ in rows]
        whole = not any(math.isnan(x) for x in scores)
        error = next((e for _, _, e in rows if e), None if whole else "ValueError: a score is no number")
        if error and self.strict:
            raise RuntimeError(f"{self.estimator.__name__} with {params}: {error}")
        return CVResult(params, scores, float(np.mean(scores)) if whole else float("nan"), float(np.std(scores)) if whole else float("nan"), sum(t for _, t, _ in rows), error)

    def _ranked(self, kept: list[CVResult]) -> Search:
        if not kept:
            raise RuntimeError("no candidate was finished in time")
        self.results = sorted(kept, key=lambda r: (math.isnan(r.mean_score), -r.mean_score if not math.isnan(r.mean_score) else 0.0))
        return self

    def fit_frame(self, folded: DataFrame, features: list[str], label: str, key: str) -> Search:
        """Folds of any size, one after another; the time budget is looked at before each candidate."""
        if self.estimator not in SPARK:
            fit_spark(self.estimator, {}, folded, features, label, key)
        folded = folded.persist()
        began, self.results, kept = time.time(), None, []
        try:
            for params in self.candidates():
                if kept and self._over(began):
                    break
                rows = []
                for k in range(self.cv):
                    t, score, error = time.time(), float("nan"), None
                    try:
                        model = fit_spark(self.estimator, params, folded.filter(F.col("fold") != k), features, label, key)
                        score = evaluated(model.transform(folded.filter(F.col("fold") == k)), label, "prediction", self.scoring)
                    except ENGINE_ERRORS:
                        raise
                    except Exception as e:  # the candidate's score is missing, the search goes on unless it is strict
                        error = f"{type(e).__name__}: {e}"
                    rows.append((score, time.time() - t, error))
                kept.append(self._result(params, rows))
        finally:
            folded.unpersist()
        return self._ranked(kept)

    def fit_arrays(self, spark, data: pd.DataFrame) -> Search:
        """All candidates at once, or one after another where a time budget is looked at before each."""
        x, y, fold = data.iloc[:, :-2].to_numpy(float), data["__y"].to_numpy(float), data["fold"].to_numpy()
        shared = spark.sparkContext.broadcast((x, y, fold))
        estimator, metric, todo, cv = self.estimator, SCORES[self.scoring], self.candidates(), self.cv
        began, self.results, kept = time.time(), None, []

        def work(tasks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, y, fold = shared.value
            out = []
            for c, k in ((c, k) for task in tasks for c, k in zip(task["candidate"], task["fold"])):
                t, score, error = time.time(), float("nan"), None
                try:
                    on = fold != k
                    model = estimator(**todo[c])
                    model.fit(x[on], y[on])
                    score = metric(*checked(y[~on], model.predict(x[~on])))
                except ENGINE_ERRORS:
                    raise
                except Exception as e:  # the candidate's score is missing, the search goes on unless it is strict
                    error = f"{type(e).__name__}: {e}"
                out.append((c, k, score, time.time() - t, error))
            yield pd.DataFrame(out, columns=["candidate", "fold", "score", "seconds", "error"])

        batch = 1 if self.time_budget is not None else max(1, len(todo))
        for first in range(0, len(todo), batch):
            if kept and self._over(began):
                break
            low, high = first * cv, min(first + batch, len(todo)) * cv
            # A partition for each pair: a shuffle of so few rows would be coalesced into one task.
            tasks = spark.range(low, high, 1, high - low).selectExpr(f"cast(id div {cv} as int) AS candidate", f"cast(id % {cv} as int) AS fold")
            got = tasks.mapInPandas(work, "candidate int, fold int, score double, seconds double, error string").collect()
            for c in range(first, min(first + batch, len(todo))):
                own = sorted((r for r in got if r["candidate"] == c), key=lambda r: r["fold"])
                kept.append(self._result(todo[c], [(float("nan") if r["score"] is None else r["score"], r["seconds"], r["error"]) for r in own]))
        shared.unpersist()
        return self._ranked(kept)

    @property
    def best_params_(self) -> dict:
        if not self.results:
            raise RuntimeError("fit comes first")
        return self.results[0].params

    @property
    def best_score_(self) -> float:
        if not self.results:
            raise RuntimeError("fit comes first")
        return self.results[0].mean_score

    def report(self) -> dict:
        return {"scoring": self.scoring, "cv": self.cv, "best_params": self.best_params_, "best_score": self.best_score_, "results": [asdict(r) for r in self.results]}


@dataclass
class OrchestratorConfig:
    search_type: str = "grid"
    cv: int = 5
    n_iter: int = 20
    time_budget: float | None = None
    shuffle: bool = True
    random_state: int = 42

    def __post_init__(self) -> None:
        rules = {
            f"search_type is grid or random, not {self.search_type!r}": self.search_type in ("grid", "random"),
            f"cv is at least 2, not {self.cv}": self.cv >= 2,
            f"n_iter is at least 1, not {self.n_iter}": self.n_iter >= 1,
            f"time_budget is above 0, not {self.time_budget}": self.time_budget is None or self.time_budget > 0,
        }
        broken = [rule for rule, holds in rules.items() if not holds]
        if broken:
            raise ValueError("; ".join(broken))


@dataclass
class OptimizationReport:
    search_type: str
    best_params: dict
    best_score: float
    n_candidates_evaluated: int
    n_splits: int
    elapsed_seconds: float
    scoring: str
    time_budget_hit: bool
    all_results: list[dict]
    warnings: list[str]

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self, indent: int = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent, default=str)


class Orchestrator:
    """One search from a validated config to a report with warnings."""

    def __init__(self, config: OrchestratorConfig | None = None):
        self.config = config or OrchestratorConfig()

    def run(self, df: DataFrame, features: list[str], label: str, key: str, estimator: type, space: dict, scoring: str = "accuracy") -> OptimizationReport:
        c, began = self.config, time.time()
        budget = c.time_budget if c.search_type == "random" else None
        search = Search(estimator, space, scoring, c.cv, c.n_iter if c.search_type == "random" else None, budget, c.random_state, c.shuffle).fit(df, features, label, key)
        done, failed = len(search.results), [r for r in search.results if r.error]
        warnings = [f"stopped after {done} candidates: the time budget of {budget} s was reached"] if search.stopped else []
        warnings += [f"{len(failed)} of {done} candidates had errors; the first: {failed[0].error}"] if failed else []
        return OptimizationReport(c.search_type, search.best_params_, search.best_score_, done, c.cv, time.time() - began, scoring, search.stopped, [asdict(r) for r in search.results], warnings)
