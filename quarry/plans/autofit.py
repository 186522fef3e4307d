"""From a table and a target to ranked models: inspect, clean, search, report, refit."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import missing as M
from quarry.functions import stats as S
from quarry.operators import local_models as L
from quarry.operators.prepare import Cleaner, CleanerConfig, detect_task, encode_target, finalise, id_columns, sample_exact, split_target
from quarry.functions.values import aggregate
from quarry.operators.profile import inspect
from quarry.operators import search as search_module
from quarry.operators.evaluate import assign_folds
from quarry.operators.search import Search
from quarry.sources import csv_source, reports

# The parameter grids that are searched for each task.
_TREES = {"max_depth": [3, 5, 10, None], "min_samples_split": [2, 5, 10]}
_FOREST = {"n_trees": [10, 30, 50], "max_depth": [3, 5, 10], "min_samples_split": [2, 5]}
_KNN = {"k": [3, 5, 7, 11], "metric": ["euclidean"]}
CANDIDATES = {
    "classification": [("DecisionTree", L.Tree, {"task": ["classification"], "criterion": ["gini"], **_TREES}), ("RandomForest", L.Forest, {"task": ["classification"], **_FOREST}), ("GaussianNaiveBayes", L.NaiveBayes, {}), ("LogisticRegression", L.Logistic, {"lr": [0.001, 0.01, 0.1], "n_iter": [200, 500]}), ("KNN", L.Neighbours, {"task": ["classification"], **_KNN})],
    "regression": [("DecisionTree", L.Tree, {"task": ["regression"], "criterion": ["mse"], **_TREES}), ("RandomForest", L.Forest, {"task": ["regression"], **_FOREST}), ("LinearRegression", L.Linear, {"lr": [0.001, 0.01], "n_iter": [200, 500]}), ("KNN", L.Neighbours, {"task": ["regression"], **_KNN})],
}


#: Rows above which a message's table is searched with fewer and faster settings.
MANY_ROWS = 500


def candidates(task: str, fast: bool = False) -> list[tuple]:
    """(name, estimator, space) of each model; ``fast``: no neighbours, and forests of five trees."""
    out = [(name, estimator, dict(space)) for name, estimator, space in CANDIDATES[task] if not (fast and name == "KNN")]
    if fast:
        out = [(name, estimator, space | {"n_trees": [5]} if "n_trees" in space else space) for name, estimator, space in out]
    return out


@dataclass
class AutoFitConfig:
    cv: int = 5
    n_iter: int | None = 15
    time_budget: float | None = 120.0
    seed: int = 42
    cleaner: CleanerConfig = field(default_factory=CleanerConfig)
    drop_ids: bool = False
    without: tuple[str, ...] = ()
    fast: bool = False
    max_rows: int | None = None  # a sample for a quick look; off by default
    strict: bool = False  # an error of any candidate ends it; else it is a warning, and the model or candidate has no score


@dataclass
class AutoFitReport:
    task: str
    target: str
    metric: str
    n_rows: int
    n_features_in: int
    n_features_out: int
    best_model: str
    best_score: float
    best_params: dict
    rankings: list[dict]
    feature_importances: list[dict]
    inspection: dict
    cleaning: dict
    warnings: list[str]
    elapsed_seconds: float
    model: Any = None

    def to_dict(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "model"}

    def to_json(self, indent: int = 2) -> str:
        return reports.to_json(self, indent)

    def summary(self) -> str:
        return reports.summary(self.to_dict())


def feature_importances(df: DataFrame, features: list[str], label: str) -> list[dict]:
    """|Pearson r| with the label, constants left out, largest first; one pass."""
    label_ = F.col(f"`{label}`")
    got = aggregate(df, {f"r{i}": F.when((F.min(F.col(f"`{f}`")) < F.max(F.col(f"`{f}`"))) & (F.min(label_) < F.max(label_)), S.pearson(F.col(f"`{f}`"), label_)) for i, f in enumerate(features)})
    out = [{"feature": f, "importance": round(abs(got[f"r{i}"]), 4)} for i, f in enumerate(features) if got[f"r{i}"] is not None]
    return sorted(out, key=lambda x: -x["importance"])


def autofit(df: DataFrame, target: str, key: str, config: AutoFitConfig | None = None) -> AutoFitReport:
    """``key`` names rows (folds and ties are by it) and is no feature."""
    config, began, warnings = config or AutoFitConfig(), time.time(), []
    if config.drop_ids:
        df = df.drop(*[c for c in id_columns(df.drop(key), target)])
    if config.max_rows:
        df = sample_exact(df, key, config.max_rows, config.seed)
    split_target(df, target)
    task = detect_task(df, target)
    metric = "accuracy" if task == "classification" else "neg_mse"
    raw = df.drop(target, key)
    inspection = inspect(raw)
    cleaner = Cleaner(config.cleaner).fit(raw)
    empty = [s["column"] for s in cleaner.imputer.summary() if s["fill_value"] is None and s["n_filled"]]
    warnings += inspection.warnings + cleaner.report.warnings + [f"'{c}' is entirely missing and was dropped" for c in empty]
    labelled, _ = encode_target(df, target, task)
    keyed = labelled.select(F.col(f"`{key}`").alias("__key"), F.col("label").alias("__label"), *[F.col(f"`{c}`") for c in raw.columns])
    steps = cleaner.transform(keyed).drop(*empty)
    features = [c for c in steps.columns if c not in ("__key", "__label")]
    finalise(steps.select(*[F.col(f"`{c}`") for c in features]))  # raises on what is no number
    data = steps.select("__key", "__label", *finalise_columns(steps, features))
    data = data.persist()
    try:
        importances = feature_importances(data, features, "__label")
        rankings, folded = [], assign_folds(data, "__key", config.cv, True, config.seed)
        # A matrix within the bound is collected once for all models; a larger table stays where it is.
        large = data.count() * (len(features) + 2) > search_module.MAX_CELLS
        rows = None if large else search_module.matrix(folded, features, "__label", "__key")
        for name, estimator, space in candidates(task, config.fast):
            if name in config.without:
                continue
            try:
                search = Search(estimator, space or {"smoothing": [1e-9]}, metric, config.cv, config.n_iter if space else None, config.time_budget, config.seed, strict=config.strict)
                search = search.fit_frame(folded, features, "__label", "__key") if large else search.fit_arrays(df.sparkSession, rows)
                rankings.append({"model": name, "score": search.best_score_, "params": search.best_params_, "results": [asdict(r) for r in search.results]})
                if search.stopped:
                    warnings.append(f"{name}: stopped after {len(search.results)} candidates by the time budget")
                if failed := [r.error for r in search.results if r.error]:
                    warnings.append(f"{name}: {len(failed)} of {len(search.results)} candidates had errors; the first: {failed[0]}")
            except search_module.ENGINE_ERRORS:
                raise
            except Exception as e:  # one model's failure leaves the others
                if config.strict:
                    raise
                warnings.append(f"{name} failed: {type(e).__name__}: {e}")
                rankings.append({"model": name, "score": float("nan"), "params": {}, "results": [], "error": f"{type(e).__name__}: {e}"})
        if all(math.isnan(r["score"]) for r in rankings):
            raise RuntimeError("no model could be fitted: " + "; ".join(warnings))
        rankings.sort(key=lambda r: (r["score"] != r["score"], -r["score"] if r["score"] == r["score"] else 0))
        best = rankings[0]
        estimator = next(c for n, c, _ in CANDIDATES[task] if n == best["model"])
        if large:  # the winner is fitted again on all rows
            model = search_module.fit_spark(estimator, best["params"], data, features, "__label", "__key")
        else:
            model = estimator(**best["params"])
            model.fit(rows[features].to_numpy(float), rows["__y"].to_numpy(float))
        n_rows = data.count()
    finally:
        data.unpersist()
    return AutoFitReport(task, target, metric, n_rows, len(raw.columns), len(features), best["model"], best["score"], best["params"], rankings, importances, inspection.to_dict(), cleaner.report.to_dict(), warnings, time.time() - began, model)


def finalise_columns(df: DataFrame, features: list[str]) -> list:
    """Double columns of the features, yes / no words as 1 and 0."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [M.as_feature(F.col(f"`{c}`"), kinds[c]).alias(c) for c in features]


def run_csv(spark: SparkSession, text: str, target: str, config: AutoFitConfig | None = None) -> AutoFitReport:
    return autofit(csv_source.read_csv_text(spark, text), target, "_row", config)


def run_file(spark: SparkSession, path: str, target: str, key: str, config: AutoFitConfig | None = None) -> AutoFitReport:
    return autofit(csv_source.read_csv_file(spark, path), target, key, config)


def message_config(n_rows: int, max_rows: int | None = None) -> AutoFitConfig:
    """Settings for a table in a message: above MANY_ROWS fewer folds, draws and seconds, and the fast models.

    All rows are used unless ``max_rows`` asks for a sample.
    """
    if n_rows > MANY_ROWS:
        return AutoFitConfig(cv=2, n_iter=3, time_budget=30.0, drop_ids=True, fast=True, max_rows=max_rows)
    return AutoFitConfig(cv=3, n_iter=8, drop_ids=True, max_rows=max_rows)


def status(target: str, n_rows: int, max_rows: int | None = None) -> str:
    """What is about to be done, for whoever waits for the answer."""
    used = min(n_rows, max_rows) if max_rows else n_rows
    return f"Searching models for **{target}** on {used} rows" + (f" sampled from {n_rows}." if used < n_rows else ".")


def answer(spark: SparkSession, message: str, files: dict[str, str] | None = None, config: AutoFitConfig | None = None, max_rows: int | None = None, say: Callable[[str], None] | None = None) -> str:
    """A Markdown reply to a message that holds or comes with a CSV and names a target; ``say`` hears of progress."""
    text = csv_source.find_csv(message, files)
    if text is None:
        return "Please attach a CSV file or paste its rows."
    df = csv_source.read_csv_text(spark, text)
    columns = [c for c in df.columns if c != "_row"]
    target = csv_source.find_target(message, columns)
    if target is None:
        return "Which column shall be predicted? Columns: " + ", ".join(columns)
    n = df.count()
    say = say or (lambda _: None)
    say(status(target, n, max_rows))
    config = config or message_config(n, max_rows)
    if config.drop_ids and (dropped := id_columns(df.drop("_row"), target)):
        say("Left out as names of rows: " + ", ".join(dropped))
    return reports.markdown(autofit(df, target, "_row", config).to_dict())


def main() -> None:
    """python -m quarry.plans.autofit FILE TARGET [PAGE.html]"""
    import sys

    spark = SparkSession.builder.getOrCreate()
    with open(sys.argv[1], encoding="utf-8") as f:
        report = run_csv(spark, f.read(), sys.argv[2], AutoFitConfig(cv=3, n_iter=8, drop_ids=True))
    print(report.summary())
    if len(sys.argv) > 3:
        with open(sys.argv[3], "w", encoding="utf-8") as f:
            f.write(reports.page(report.to_dict(), sys.argv[1]))


if __name__ == "__main__":
    main()
