"""Estimators fitted by Spark aggregates: ``fit(df, features, label)``, ``transform(df)``.

Nothing but sums, counts and the best split of each node reaches the driver, and KNN's
training set where it is small enough to be sent to every task.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.values import aggregate
from quarry.operators.evaluate import evaluated
from quarry.operators.neighbours import Index, Others, Planes, box_distances, most_frequent
from quarry.streaming.storage import checkpoint


def _dot(features: list[str], weights, bias: float) -> Column:
    out = F.lit(float(bias))
    for f, w in zip(features, weights):
        out = out + F.col(f"`{f}`") * F.lit(float(w))
    return out


def learning_rate(schedule: str, lr: float, decay: float, step: int) -> float:
    """constant, time_decay: lr / (1 + decay t), step_decay: a factor every 100 steps."""
    if schedule == "constant":
        return lr
    if schedule == "time_decay":
        return lr / (1.0 + decay * step)
    if schedule == "step_decay":
        return lr * decay ** ((1 + step) // 100)
    raise ValueError(f"unknown schedule {schedule!r}")


class Estimator:
    task = "classification"

    def score(self, df: DataFrame) -> float:
        """Accuracy, or R2 (0 for a constant target)."""
        p = self.transform(df)
        if self.task == "classification":
            return evaluated(p, self.label, "prediction", "accuracy")
        error = evaluated(p, self.label, "prediction", "neg_mse")
        v = p.agg(F.var_pop(self.label)).first()[0]
        return 1.0 + error / v if v else 0.0


class LinearRegression(Estimator):
    """Full-batch gradient descent from zero.

    All iterates depend on the data through the Gram matrix alone, so the data is
    read once and the descent runs on a few numbers.
    """

    task = "regression"

    def __init__(self, learning_rate: float = 0.01, n_iterations: int = 1000, lr_schedule: str = "constant", decay: float = 0.001):
        self.lr, self.steps, self.schedule, self.decay = learning_rate, n_iterations, lr_schedule, decay

    def fit(self, df: DataFrame, features: list[str], label: str) -> LinearRegression:
        self.features, self.label = features, label
        names = [*features, label]
        named = {"n": F.count(F.lit(1))} | {f"s{i}": F.sum(F.col(f"`{a}`").cast("double")) for i, a in enumerate(names)}
        named |= {f"p{i}_{j}": F.sum(F.col(f"`{names[i]}`").cast("double") * F.col(f"`{names[j]}`")) for i in range(len(names)) for j in range(i, len(names))}
        got = aggregate(df, named)
        n, k = got["n"], len(features)
        gram = np.array([[got[f"p{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
        sums = np.array([got[f"s{i}"] for i in range(k + 1)])
        w, b, self.loss_history = np.zeros(k), 0.0, []
        for t in range(self.steps):
            inner = gram[:k, :k] @ w + sums[:k] * b - gram[:k, k]  # X'e
            total = sums[:k] @ w + n * b - sums[k]  # sum of e
            square = w @ gram[:k, :k] @ w + 2 * b * (sums[:k] @ w) + n * b * b - 2 * (w @ gram[:k, k] + b * sums[k]) + gram[k, k]
            self.loss_history.append(square / n)
            lr = learning_rate(self.schedule, self.lr, self.decay, t)
            w, b = w - lr * 2 / n * inner, b - lr * 2 / n * total
        self.weights, self.bias = w, float(b)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", _dot(self.features, self.weights, self.bias))

    def get_params(self) -> dict:
        return {"weights": self.weights.tolist(), "bias": self.bias}


class LogisticRegression(Estimator):
    """Two classes, full-batch gradient descent; one aggregate a step, with weights as literals."""

    def __init__(self, learning_rate: float = 0.01, n_iterations: int = 1000, lr_schedule: str = "constant", decay: float = 0.001, threshold: float = 0.5):
        self.lr, self.steps, self.schedule, self.decay, self.threshold = learning_rate, n_iterations, lr_schedule, decay, threshold

    def _probability(self) -> Column:
        z = F.least(F.greatest(_dot(self.features, self.weights, self.bias), F.lit(-500.0)), F.lit(500.0))
        return 1.0 / (1.0 + F.exp(-z))

    def fit(self, df: DataFrame, features: list[str], label: str) -> LogisticRegression:
        self.features, self.label, self.loss_history = features, label, []
        data = df.select(*[F.col(f"`{f}`").cast("double").alias(f) for f in features], F.col(f"`{label}`").cast("double").alias("__y")).persist()
        self.weights, self.bias = np.zeros(len(features)), 0.0
        try:
            if data.select("__y").distinct().limit(3).count() > 2:
                raise ValueError("two classes only")
            for t in range(self.steps):
                p, y = self._probability(), F.col("__y")
                q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
                row = data.agg(F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))), F.avg(p - y), *[F.avg((p - y) * F.col(f"`{f}`")) for f in features]).first()
                lr = learning_rate(self.schedule, self.lr, self.decay, t)
                self.loss_history.append(row[0])
                self.bias -= lr * row[1]
                self.weights = self.weights - lr * np.array(row[2:])
        finally:
            data.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("probability", self._probability()).withColumn("prediction", (F.col("probability") >= F.lit(self.threshold)).cast("double"))

    def get_params(self) -> dict:
        return {"weights": self.weights.tolist(), "bias": self.bias}


class GaussianNaiveBayes(Estimator):
    """Priors, means and population variances (plus an absolute smoothing) by class."""

    def __init__(self, smoothing: float = 1e-9):
        self.smoothing = smoothing

    def fit(self, df: DataFrame, features: list[str], label: str) -> GaussianNaiveBayes:
        self.features, self.label = features, label
        stats = [f(F.col(f"`{c}`")).alias(f"{s}{i}") for i, c in enumerate(features) for s, f in (("m", F.avg), ("v", F.var_pop))]
        rows = sorted(df.groupBy(F.col(f"`{label}`").alias("c")).agg(F.count(F.lit(1)).alias("n"), *stats).collect(), key=lambda r: r["c"])
        total = sum(r["n"] for r in rows)
        self.classes = [r["c"] for r in rows]
        self.priors = [r["n"] / total for r in rows]
        self.means = [[r[f"m{i}"] for i in range(len(features))] for r in rows]
        self.variances = [[r[f"v{i}"] + self.smoothing for i in range(len(features))] for r in rows]
        return self

    def _log_likelihood(self, k: int) -> Column:
        out = F.lit(math.log(self.priors[k]))
        for f, m, v in zip(self.features, self.means[k], self.variances[k]):
            d = F.col(f"`{f}`") - F.lit(m)
            out = out - F.lit(0.5 * math.log(2 * math.pi * v)) - d * d / F.lit(2 * v)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """prediction (the smallest class of those that tie) and probabilities, one a class."""
        logs = F.array(*[self._log_likelihood(k) for k in range(len(self.classes))])
        out = df.withColumn("__ll", logs)
        best = F.array_position("__ll", F.array_max("__ll")) - 1
        raised = F.transform("__ll", lambda x: F.exp(x - F.array_max(F.col("__ll"))))
        total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
        return out.withColumn("prediction", F.get(F.array(*[F.lit(c) for c in self.classes]), best.cast("int"))).withColumn("probabilities", F.transform(raised, lambda x: x / total)).drop("__ll")


class KNN(Estimator):
    """k nearest by euclidean or manhattan distance; ties go to the smaller training key.

    Training rows that fit into BROADCAST_BYTES are sent to every task as an index. More
    are dealt, as query points are, into regions of space; a point meets its own region
    first, and then those whose box is no farther than the k-th nearest found there.
    That is exact for any number of rows, near linear where features are few, and all
    pairs where no box can be left out.
    """

    BROADCAST_BYTES, BLOCK_ROWS = 64 << 20, 50_000

    def __init__(self, k: int = 5, task: str = "classification", metric: str = "euclidean"):
        if metric not in ("euclidean", "manhattan"):
            raise ValueError(f"unknown metric {metric!r}")
        self.k, self.task, self.metric = k, task, metric

    def fit(self, df: DataFrame, features: list[str], label: str, key: str) -> KNN:
        self.features, self.label, self.key = features, label, key
        self.train = df.select(F.col(f"`{key}`").alias("__tid"), F.col(f"`{label}`").alias("__label"), self._point().alias("__t"))
        self.n = df.count()
        self.small = self.n * 8 * (len(features) + 4) <= self.BROADCAST_BYTES
        return self

    def _point(self) -> Column:
        return F.array(*[F.col(f"`{f}`").cast("double") + F.lit(0.0) for f in self.features])  # 0 has one sign

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.small:
            queries = df.withColumn("__q", self._point())
            near = self._nearest(self.k, queries.select("__q").distinct())
            return queries.join(near, "__q").withColumn("prediction", self._vote(F.col("__near"))).drop("__q", "__near")
        rows = self.train.orderBy("__tid").toPandas()  # at most BROADCAST_BYTES; in key order ties go to the smaller key
        labels, codes = np.unique(rows["__label"].to_numpy(), return_inverse=True)  # in order, so that tied votes go to the smallest
        number = self.task != "classification"
        x = np.array(rows["__t"].tolist(), float).reshape(len(rows), len(self.features))
        from quarry.operators.local_models import Neighbours

        model = Neighbours(self.k, self.task, self.metric)
        model.fit(x, rows["__label"].to_numpy(float) if number else codes.astype(float))
        shared, width = self.train.sparkSession.sparkContext.broadcast((model, labels)), len(self.features)

        def predict(points: pd.Series) -> pd.Series:
            model, labels = shared.value
            out = model.predict(np.array(points.tolist(), float).reshape(len(points), width))
            return pd.Series(out if number else labels[out.astype(int)])

        kind = T.DoubleType() if number else self.train.schema["__label"].dataType
        return df.withColumn("prediction", F.pandas_udf(predict, kind)(self._point()))

    def leave_one_out(self) -> DataFrame:
        """The key of every training row and its prediction from the k nearest of all others.

        Without another row the prediction is missing. Keys must differ and features
        must be numbers.
        """
        if self.small:
            return self._others()
        bad = F.count_if(F.exists("__t", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
        odd = self.train.agg(bad.alias("bad"), F.count_distinct("__tid").alias("keys")).first()
        if odd["bad"] or odd["keys"] != self.n:
            raise ValueError("a key occurs twice or a feature is no number")
        # A row is one of the k + 1 nearest to its own place, or those hold no fewer than k others.
        near = self._nearest(self.k + 1)
        others = F.slice(F.filter("__near", lambda n: n["__tid"] != F.col("__tid")), 1, self.k)
        found = self.train.join(near, F.col("__t") == F.col("__q"))
        return found.select(F.col("__tid").alias(self.key), self._vote(others).cast("double").alias("prediction"))

    def _others(self) -> DataFrame:
        """``leave_one_out`` where training rows are sent to every task, each of which answers a range of them."""
        spark, kind, number = self.train.sparkSession, self.train.schema["__tid"].dataType, self.task != "classification"
        label, whole = F.col("__label").cast("double") if number else F.col("__label"), isinstance(kind, T.IntegralType)
        rows = self.train.select("__tid", label.alias("__label"), *[F.get("__t", F.lit(i)).alias(f"f{i}") for i in range(len(self.features))])
        rows = (rows if whole else rows.orderBy("__tid")).toArrow()  # at most BROADCAST_BYTES
        if whole and not rows["__tid"].null_count:  # in key order ties go to the smaller key
            rows = rows.take(np.argsort(rows["__tid"].to_numpy(), kind="stable"))
            keys = 1 + np.count_nonzero(np.diff(rows["__tid"].to_numpy())) if len(rows) else 0
        else:
            keys = self.train.agg(F.count_distinct("__tid")).first()[0]
        x = np.array([rows[f"f{i}"].to_numpy() for i in range(len(self.features))]).reshape(len(self.features), len(rows)).T
        if keys != len(rows) or any(c.null_count for c in rows.columns[2:]) or not np.isfinite(x.astype(float)).all():
            raise ValueError("a key occurs twice or a feature is no number")
        ids, labels = (pa.concat_arrays(rows[c].chunks) if len(rows) else pa.array([], rows[c].type) for c in ("__tid", "__label"))
        missing = labels.is_null().to_numpy(zero_copy_only=False)
        if number:
            names, values = None, labels.to_numpy(zero_copy_only=False)
        else:
            labels = pc.add(labels, pa.scalar(0.0, labels.type)) if pa.types.is_floating(labels.type) else labels  # 0 has one sign
            coded = labels.dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            names, values = coded.dictionary.take(pa.array(order)), np.append(np.argsort(order), -1)[coded.indices.fill_null(-1).to_numpy()]
        n, cores = len(rows), spark.sparkContext.defaultParallelism
        parts = max(1, -(-n // self.BLOCK_ROWS), min(4 * cores, n // 5000))
        shared = spark.sparkContext.broadcast((Others(x, self.metric, self.k), ids, values, missing, names))

        def predict(batches):
            found, ids, values, missing, names = shared.value
            for part in (i for batch in batches for i in batch.column(0).to_pylist()):
                if (a := part * n // parts) == (b := (part + 1) * n // parts):
                    continue
                own, near = found.nearest(a, b)
                if number:
                    votes = (~missing[near]).sum(axis=1)
                    total = np.zeros(len(own))
                    for other in near.T:
                        total = total + np.where(missing[other], 0.0, values[other])
                    out = pa.array(total / np.maximum(votes, 1), mask=votes == 0)
                else:
                    codes = most_frequent(values[near])
                    out = names.take(pa.array(codes, mask=codes < 0))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), out], ["__tid", "__label"])

        schema = T.StructType([T.StructField("__tid", kind), T.StructField("__label", T.DoubleType() if number else self.train.schema["__label"].dataType)])
        out = spark.range(0, parts, 1, parts).mapInArrow(predict, schema)
        return out.select(F.col("__tid").alias(self.key), F.col("__label").cast("double").alias("prediction"))

    def _vote(self, near: Column) -> Column:
        """Mean or most frequent label (the smallest of those that tie); missing labels have no vote."""
        labels = F.filter(F.transform(near, lambda n: n["__label"]), lambda v: v.isNotNull())
        if self.task != "classification":
            return F.try_divide(F.aggregate(labels, F.lit(0.0), lambda a, v: a + v.cast("double")), F.size(labels))
        votes = F.transform(F.array_distinct(labels), lambda c: F.struct((-F.size(F.filter(labels, lambda v: v == c))).alias("n"), c.alias("c")))
        return F.array_min(votes)["c"]

    def _nearest(self, want: int, points: DataFrame | None = None) -> DataFrame:
        """__q of different points (None: those of training rows) and __near: the ``want`` nearest (__d, __tid, __label) of each, in order."""
        kinds, width, metric = {f.name: f.dataType for f in self.train.schema.fields}, len(self.features), self.metric
        matrix = lambda v: np.array(v.tolist(), float).reshape(len(v), width)
        # Of equal points only the first few can be among the nearest.
        turn = F.row_number().over(Window.partitionBy("__t").orderBy("__tid"))
        kept = self.train.withColumn("__turn", turn).filter(F.col("__turn") <= want).persist()
        held = [kept]
        try:
            n, cores = kept.count(), kept.sparkSession.sparkContext.defaultParallelism
            blocks = max(1, -(-n // self.BLOCK_ROWS), min(2 * cores, n // 5000))
            some = min(100_000, max(1000, 4_000_000 // max(1, width)))  # only where regions are cut depends on it
            planes = Planes(matrix(kept.select("__t").sample(min(1.0, some / max(1, n)), 1).toPandas()["__t"]), blocks)
            place = F.pandas_udf(lambda p: pd.Series(planes.locate(matrix(p))), "long")
            # Regions are found once; few rows don't go on as many small tasks.
            train = kept.coalesce(max(2 * cores, -(-n // self.BLOCK_ROWS))).withColumn("b", place("__t")).persist()
            held.append(train)
            if points is None:
                points = train.filter("__turn = 1").select(F.col("__t").alias("__q"), F.col("b").alias("b"))
            else:
                points = points.withColumn("b", place("__q")).persist()
                held.append(points)
            train = train.drop("__turn")
            boxes = train.groupBy("b").agg(F.array(*[F.min(F.get("__t", F.lit(i))) for i in range(width)]).alias("low"), F.array(*[F.max(F.get("__t", F.lit(i))) for i in range(width)]).alias("high")).collect()
            own = {r["b"]: i for i, r in enumerate(boxes)}
            lows, highs = (np.array([r[side] for r in boxes], float).reshape(len(boxes), width) for side in ("low", "high"))

            def meet(q: pa.Table, t: pa.Table) -> pa.Table:
                q, t = q.combine_chunks(), t.take(pc.sort_indices(t["__tid"])).combine_chunks()
                x, points = (pc.list_flatten(v).to_numpy().reshape(len(v), width) for v in (t["__t"], q["__q"]))
                d, at = Index(x, metric, want).nearest(points, want)
                ends, at = pa.array(np.arange(len(q) + 1, dtype=np.int32) * d.shape[1], pa.int32()), pa.array(at.ravel())
                values = {"d": pa.array(d.ravel())} | {name: pc.take(t[column].combine_chunks(), at) for name, column in (("tid", "__tid"), ("label", "__label"))}
                return pa.table({"__q": q["__q"], "b": q["b"]} | {name: pa.ListArray.from_arrays(ends, v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v) for name, v in values.items()})

            lists = [T.StructField(name, T.ArrayType(kind)) for name, kind in (("d", T.DoubleType()), ("tid", kinds["__tid"]), ("label", kinds["__label"]))]
            schema = T.StructType([T.StructField("__q", kinds["__t"]), T.StructField("b", T.LongType()), *lists])

            def met(queries: DataFrame) -> DataFrame:
                """Each query with the nearest of its region; many queries of a region are several groups."""
                groups = [(r["b"], -(-r["count"] // self.BLOCK_ROWS)) for r in queries.groupBy("b").count().collect()]
                tasks = min(2 * sum(parts for _, parts in groups) or 1, max(4 * cores, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))))  # rows are few for their work
                groups = F.broadcast(queries.sparkSession.createDataFrame(groups, "b long, parts long"))
                q = queries.join(groups, "b").select("b", "__q", F.pmod(F.xxhash64("__q"), "parts").alias("part")).repartition(tasks, "b", "part")
                t = train.join(groups, "b").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts").repartition(tasks, "b", "part")
                return q.groupBy("b", "part").cogroup(t.groupBy("b", "part")).applyInArrow(meet, schema)

            def reach(points: pd.Series, block: pd.Series, kth: pd.Series) -> pd.Series:
                """Regions other than its own that may hold some of a point's nearest."""
                x, bound, out = matrix(points), kth.fillna(np.inf).to_numpy(), []
                for rows in np.array_split(np.arange(len(x)), len(x) * len(lows) // 2_000_000 + 1):
                    p = x[rows, None]
                    hit = ~(box_distances(p, p, lows[None], highs[None], metric) > bound[rows, None])  # where a number is missing, too
                    for i, b in enumerate(block.to_numpy()[rows]):
                        if b in own:
                            hit[i, own[b]] = False
                    out += [names[h] for h in hit]
                return pd.Series(out)

            names = np.array([r["b"] for r in boxes], np.int64)
            first = checkpoint(met(points))
            kth = F.when(F.size("d") >= want, F.element_at("d", -1))
            away = checkpoint(first.select("__q", F.explode(F.pandas_udf(reach, "array<long>")("__q", "b", kth)).alias("b")))
            near = F.arrays_zip(F.col("d").alias("__d"), F.col("tid").alias("__tid"), F.col("label").alias("__label")).alias("near")
            every = first.unionByName(met(away)).select("__q", near)
            merged = every.groupBy("__q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, want).alias("__near"))
            return checkpoint(merged)
        finally:
            for df in held:
                df.unpersist()


class DecisionTree(Estimator):
    """CART by levels: thresholds are all observed values, a row goes left if value <= threshold.

    A level is one job. Rows carry their node's number. They become (node, feature,
    value) sums; each feature's values are cut into BUCKETS ranges, so running sums run
    within a range and start from the totals of the ranges before, and no node or
    feature is a task of its own. The best split of each node is the only row of it
    that is collected. Classes may be of any number: n x gini changes with each class's
    count by itself. Ties go to the first feature, then the smallest threshold.
    ``max_depth=None`` is unbounded.
    """

    BUCKETS = 64
    #: Nodes up to which a prediction is one expression; a larger tree is walked in batches.
    EXPRESSION_NODES = 255

    def __init__(self, task: str = "classification", max_depth: int | None = 5, min_samples_split: int = 2):
        self.task, self.max_depth, self.min_samples_split = task, max_depth, min_samples_split

    def fit(self, df: DataFrame, features: list[str], label: str, weight: Column | None = None, edges: list[list[float]] | None = None) -> DecisionTree:
        self.features, self.label = features, label
        columns = [f"f{i}" for i in range(len(features))]
        data = df.select(*[F.col(f"`{f}`").cast("double").alias(c) for f, c in zip(features, columns)], F.col(f"`{label}`").cast("double").alias("y"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w")).filter("w > 0")
        data = data.select("y", "w", F.array(*columns).alias("x"), F.lit(1).cast("long").alias("node")).persist()
        self.nodes: dict[int, dict] = {}
        try:
            self.edges = edges or range_edges(df, features, self.BUCKETS)
            level = 0
            while True:
                splits = self._grow(data, level)
                if not splits:
                    break
                level += 1
                moved = self._move(data, splits)
                if level % 8 == 0:
                    moved = checkpoint(moved)  # plans of deep trees stay short
                moved = moved.persist()
                moved.count()
                data.unpersist()
                data = moved
        finally:
            data.unpersist()
        return self

    def _move(self, data: DataFrame, splits: list[tuple[int, int, float]]) -> DataFrame:
        """Rows of split nodes, with the numbers of their new nodes: 2n and 2n + 1."""
        side = data.sparkSession.createDataFrame(splits, "node long, feature int, threshold double")
        side = F.broadcast(side) if len(splits) * 32 <= 16 << 20 else side
        left = F.get("x", F.col("feature")) <= F.col("threshold")
        return data.join(side, "node").select("y", "w", "x", F.when(left, 2 * F.col("node")).otherwise(2 * F.col("node") + 1).alias("node"))

    def _totals(self, data: DataFrame) -> list:
        """node, n, value and impurity x n of every node: one row a node is collected."""
        if self.task == "classification":
            by_class = data.groupBy("node", "y").agg(F.sum("w").alias("w"))
            found = by_class.groupBy("node").agg(F.sum("w").alias("n"), F.min(F.struct((-F.col("w")).alias("w"), "y")).alias("most"), F.sum(F.col("w") * F.col("w")).alias("q"))
            return found.select("node", "n", F.col("most.y").alias("value"), (F.col("n") - F.col("q") / F.col("n")).alias("mass"), F.lit(1.0).alias("scale")).collect()
        w, y = F.col("w"), F.col("y")
        found = data.groupBy("node").agg(F.sum("w").alias("n"), F.sum(w * y).alias("s"), F.sum(w * y * y).alias("q"))
        return found.select("node", "n", (F.col("s") / F.col("n")).alias("value"), (F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("mass"), F.greatest(F.lit(1.0), F.col("q")).alias("scale")).collect()

    def _grow(self, data: DataFrame, level: int) -> list[tuple[int, int, float]]:
        open_ = []
        for r in self._totals(data):
            self.nodes[r["node"]] = {"n": r["n"], "value": r["value"]}
            if r["mass"] > 1e-12 * r["scale"] and r["n"] >= self.min_samples_split and (self.max_depth is None or level < self.max_depth):
                open_.append((r["node"], r["n"]))
        if not open_:
            return []
        some = data.sparkSession.createDataFrame(open_, "node long, t_n double")
        rows = data.join(F.broadcast(some) if len(open_) * 16 <= 16 << 20 else some, "node")
        long = rows.select("node", "t_n", "y", "w", F.posexplode("x").alias("feature", "v")).filter("v IS NOT NULL")
        gains = self._gini(long) if self.task == "classification" else self._variance(long)
        best = gains.filter("l_n < t_n").groupBy("node").agg(F.min(F.struct((-F.round("gain", 12)).alias("g"), "feature", "v")).alias("b")).collect()
        out = []
        for r in best:
            self.nodes[r["node"]] |= {"feature": r["b"]["feature"], "threshold": r["b"]["v"], "gain": -r["b"]["g"]}
            out.append((r["node"], r["b"]["feature"], r["b"]["v"]))
        return out

    def _bucket(self, cells: DataFrame) -> DataFrame:
        """The range of each value: how many of its feature's edges are below it."""
        edges = F.array(*[F.array(*map(F.lit, e)).cast("array<double>") for e in self.edges])
        return cells.withColumn("bucket", F.size(F.filter(F.get(edges, F.col("feature")), lambda e: e < F.col("v"))))

    @staticmethod
    def _running(cells: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
        """l_<sum>: running sums over v within keys, this value included; t_<sum>: those of all values."""
        ranges = cells.groupBy(*keys, "bucket").agg(*[F.sum(c).alias(c) for c in sums])
        before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS + 1 rows
        whole = Window.partitionBy(*keys)
        ranges = ranges.select(*keys, "bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"b_{c}") for c in sums], *[F.sum(c).over(whole).alias(f"t_{c}") for c in sums])
        inside = Window.partitionBy(*keys, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        out = cells.join(ranges, [*keys, "bucket"])
        return out.select(*cells.columns, *[(F.col(f"b_{c}") + F.sum(c).over(inside)).alias(f"l_{c}") for c in sums], *[f"t_{c}" for c in sums])

    def _variance(self, long: DataFrame) -> DataFrame:
        w, y = F.col("w"), F.col("y")
        cells = self._bucket(long.groupBy("node", "feature", "v").agg(F.sum("w").alias("n"), F.sum(w * y).alias("s"), F.sum(w * y * y).alias("q")))
        run = self._running(cells, ["node", "feature"], ["n", "s", "q"])
        mass = lambda n, s, q: q - F.try_divide(s * s, n)
        l, t = ([F.col(f"{side}_{c}") for c in ("n", "s", "q")] for side in "lt")
        gain = mass(*t) - mass(*l) - mass(*[a - b for a, b in zip(t, l)])
        return run.select("node", "feature", "v", "l_n", "t_n", F.try_divide(gain, F.col("t_n")).alias("gain"))

    def _gini(self, long: DataFrame) -> DataFrame:
        """n x gini is n - (sum of squared class counts) / n; a cell changes the sum by its own class alone."""
        cells = self._bucket(long.groupBy("node", "feature", "v", "y").agg(F.sum("w").alias("n")))
        by_class = self._running(cells, ["node", "feature", "y"], ["n"])
        n, left, total = F.col("n"), F.col("l_n"), F.col("t_n")
        # Squares grow on the left by l^2 - (l - n)^2, and shrink on the right by (t - l + n)^2 - (t - l)^2.
        steps = by_class.select("node", "feature", "v", "bucket", "n", (n * (2 * left - n)).alias("up"), (n * (2 * (total - left) + n)).alias("down"))
        steps = steps.groupBy("node", "feature", "v", "bucket").agg(*[F.sum(c).alias(c) for c in ("n", "up", "down")])
        run = self._running(steps, ["node", "feature"], ["n", "up", "down"])
        rest = F.col("t_n") - F.col("l_n")
        squares = F.col("t_down")  # all steps down take the whole away
        gain = F.try_divide(F.col("l_up"), F.col("l_n")) + F.try_divide(squares - F.col("l_down"), rest) - F.try_divide(squares, F.col("t_n"))
        return run.select("node", "feature", "v", "l_n", "t_n", F.try_divide(gain, F.col("t_n")).alias("gain"))

    def prediction(self) -> Column:
        """An expression over the feature columns; of a large tree, a walk over batches."""
        if len(self.nodes) > self.EXPRESSION_NODES:
            return self._walk()

        def at(n: int) -> Column:
            s = self.nodes[n]
            if "feature" not in s:
                return F.lit(float(s["value"]))
            return F.when(F.col(f"`{self.features[s['feature']]}`") <= F.lit(s["threshold"]), at(2 * n)).otherwise(at(2 * n + 1))

        return at(1)

    def _walk(self) -> Column:
        place = {n: i for i, n in enumerate(sorted(self.nodes))}
        order = sorted(self.nodes)
        feature = np.array([self.nodes[n].get("feature", -1) for n in order])
        threshold = np.array([self.nodes[n].get("threshold", 0.0) for n in order])
        left = np.array([place.get(2 * n, 0) for n in order])
        right = np.array([place.get(2 * n + 1, 0) for n in order])
        value = np.array([float(self.nodes[n]["value"]) for n in order])

        def walk(points: pd.Series) -> pd.Series:
            x = np.array(points.tolist(), float).reshape(len(points), -1)
            at = np.zeros(len(x), np.int64)
            while True:
                go = np.flatnonzero(feature[at] >= 0)
                if not len(go):
                    return pd.Series(value[at])
                below = x[go, feature[at[go]]] <= threshold[at[go]]
                at[go] = np.where(below, left[at[go]], right[at[go]])

        return F.pandas_udf(walk, "double")(F.array(*[F.col(f"`{f}`").cast("double") for f in self.features]))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.prediction())


def range_edges(df: DataFrame, features: list[str], buckets: int) -> list[list[float]]:
    """Edges that cut each feature's values into ranges of about equal numbers of rows; they only share out work."""
    at = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    got = aggregate(df, {f"e{i}": F.percentile_approx(F.col(f"`{f}`").cast("double"), at, 1000) for i, f in enumerate(features)})
    return [sorted(set(got[f"e{i}"] or [])) for i in range(len(features))]


class RandomForest(Estimator):
    """Trees on bootstrap weights and one feature subset a tree.

    A row's weight in a tree is Poisson(1) by a hash of its key: what drawing n rows
    of n comes to for large n, without moving rows. Trees are grown side by side.
    """

    #: Trees whose jobs run at the same time.
    PARALLEL = 4

    def __init__(self, n_trees: int = 100, task: str = "classification", max_depth: int | None = 5, min_samples_split: int = 2, seed: int = 42):
        self.n_trees, self.task, self.max_depth, self.min_samples_split, self.seed = n_trees, task, max_depth, min_samples_split, seed

    def weight(self, key: str, tree: int) -> Column:
        """Poisson(1) by inversion of the first 28 bits of a digest."""
        steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
        digest = F.md5(F.concat(F.col(f"`{key}`").cast("string"), F.lit(f":{self.seed}:{tree}")))
        u = F.conv(F.substring(digest, 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))
        out = F.lit(0.0)
        for s in steps:
            out = out + (u >= F.lit(float(s))).cast("double")
        return out

    def subsets(self, features: list[str]) -> list[list[str]]:
        """The features of each tree."""
        rng = np.random.default_rng(self.seed)
        size = max(1, int(math.sqrt(len(features))))
        return [[features[i] for i in sorted(rng.choice(len(features), size, replace=False).tolist())] for _ in range(self.n_trees)]

    def fit(self, df: DataFrame, features: list[str], label: str, key: str) -> RandomForest:
        self.features, self.label = features, label
        edges = dict(zip(features, range_edges(df, features, DecisionTree.BUCKETS)))

        def grow(job: tuple[int, list[str]]) -> DecisionTree:
            t, own = job
            return DecisionTree(self.task, self.max_depth, self.min_samples_split).fit(df, own, label, self.weight(key, t), [edges[f] for f in own])

        with ThreadPoolExecutor(self.PARALLEL) as pool:
            self.trees = list(pool.map(inheritable_thread_target(df.sparkSession)(grow), enumerate(self.subsets(features))))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        votes = F.array(*[t.prediction() for t in self.trees])
        if self.task == "regression":
            return df.withColumn("__votes", votes).withColumn("prediction", F.aggregate("__votes", F.lit(0.0), lambda a, x: a + x) / len(self.trees)).drop("__votes")
        labels = F.array_sort(F.array_distinct("__votes"))
        count = F.transform(labels, lambda c: F.size(F.filter("__votes", lambda v: v == c)))
        return df.withColumn("__votes", votes).withColumn("prediction", F.get(labels, (F.array_position(count, F.array_max(count)) - 1).cast("int"))).drop("__votes")
