"""Folds and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_rows(df: DataFrame, *order: Column | str) -> DataFrame:
    """``row_number`` from 0 in the given order without moving all rows to one task.

    Rows are sorted by range; a row's number is its place in its partition plus
    the rows of the partitions before, of which there is one count each.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    return _numbered(spread, *order)


def _numbered(spread: DataFrame, *order: Column | str) -> DataFrame:
    from quarry.streaming.storage import checkpoint

    spread = checkpoint(spread)  # ranges are sampled: both uses must see the same ones
    counts = {r["__part"]: r["n"] for r in spread.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    if not before:
        return spread.drop("__part", "__at").withColumn("row_number", F.lit(0).cast("long"))
    base = spread.sparkSession.createDataFrame(list(before.items()), "__part int, __base long")
    # monotonically_increasing_id counts from 0 within a partition, below its 33rd bit.
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return spread.join(F.broadcast(base), "__part").withColumn("row_number", F.col("__base") + local).drop("__part", "__at", "__base")


def assign_folds(df: DataFrame, key: str, n_splits: int = 5, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """``fold`` of each row: contiguous blocks in key or digest order, the first n % k one larger."""
    if n_splits < 2:
        raise ValueError("at least two folds")
    n = df.count()
    if n < n_splits:
        raise ValueError(f"{n} rows for {n_splits} folds")
    order = [F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), F.col(key)] if shuffle else [F.col(key)]
    size, extra = divmod(n, n_splits)
    i = F.col("row_number")
    edge = extra * (size + 1)
    fold = F.when(i < edge, F.floor(i / (size + 1))).otherwise(F.lit(extra) + F.floor((i - edge) / size))
    return number_rows(df, *order).withColumn("fold", fold.cast("int")).drop("row_number")


def fold_info(n: int, n_splits: int) -> list[dict]:
    size, extra = divmod(n, n_splits)
    return [{"fold": k, "n_val": size + (k < extra), "n_train": n - size - (k < extra)} for k in range(n_splits)]


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == p).cast("double"))


def precision(y: Column, p: Column, positive: float = 1) -> Column:
    return F.coalesce(F.try_divide(F.count_if((y == positive) & (p == positive)).cast("double"), F.count_if(p == positive)), F.lit(0.0))


def recall(y: Column, p: Column, positive: float = 1) -> Column:
    return F.coalesce(F.try_divide(F.count_if((y == positive) & (p == positive)).cast("double"), F.count_if(y == positive)), F.lit(0.0))


def f1(y: Column, p: Column, positive: float = 1) -> Column:
    a, b = precision(y, p, positive), recall(y, p, positive)
    return F.coalesce(F.try_divide(2.0 * a * b, a + b), F.lit(0.0))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def r2(y: Column, p: Column) -> Column:
    """For a constant target: 1 if there is no error, else 0."""
    residual = F.sum((y - p) * (y - p))
    total = F.var_pop(y) * F.count(y)
    constant = F.min(y) == F.max(y)
    return F.when(constant, F.when(residual == 0, 1.0).otherwise(0.0)).otherwise(1.0 - F.try_divide(residual, total))


#: Name -> metric; higher is better for all of them.
SCORERS = {"accuracy": accuracy, "precision": precision, "recall": recall, "f1": f1, "r2": r2, "neg_mse": lambda y, p: -mse(y, p), "neg_mae": lambda y, p: -mae(y, p)}


def evaluated(df: DataFrame, y: str, p: str, metric: str) -> float:
    """A metric's value, from one aggregate. No rows, or a row without a label or prediction, are an error."""
    if metric not in SCORERS:
        raise ValueError(f"unknown metric {metric!r}; one of {sorted(SCORERS)}")
    a, b = F.col(f"`{y}`"), F.col(f"`{p}`")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(a.isNull() | b.isNull()).alias("odd"), SCORERS[metric](a, b).alias("value")).first()
    if not r["n"]:
        raise ValueError("no rows to evaluate")
    if r["odd"]:
        raise ValueError(f"{r['odd']} rows have no label or no prediction")
    return float(r["value"])


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """true, pred, n for every pair of labels seen on either side, which are a catalogue of the driver's."""
    counts = df.groupBy(F.col(y).alias("true"), F.col(p).alias("pred")).agg(F.count("*").alias("n")).persist()
    try:
        rows = counts.collect()
    finally:
        counts.unpersist()
    labels = sorted({v for r in rows for v in (r["true"], r["pred"])}, key=lambda v: (v is None, v if v is not None else 0))
    n = {(r["true"], r["pred"]): r["n"] for r in rows}
    kind = df.schema[y].dataType.simpleString()
    return df.sparkSession.createDataFrame([(a, b, n.get((a, b), 0)) for a in labels for b in labels], f"true {kind}, pred {kind}, n long")
