"""Column typing, statistics, correlation, outliers and the combined inspection."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field, fields
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import missing as M
from quarry.functions import stats as S
from quarry.functions.values import CHUNK, aggregate, modes, quantiles, value_tables


@dataclass
class ColumnType:
    name: str
    inferred_type: str
    dtype: str
    n_unique: int
    n_missing: int
    sample_values: list = field(default_factory=list)


def _logical(value, literals: set[str]) -> bool:
    """Whether a distinct value reads as yes or no; whole doubles are texts like ``1.0``."""
    return str(value).strip(" ").lower() in literals


def _cells(df: DataFrame) -> dict[str, dict]:
    """Counts of each column's cells and distinct values, read off the table (column, value, count).

    A text is parsed once for each distinct one. ``numeric``: all that is there are numbers.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    none = {"rows": 0, "odd": 0, "gone": 0, "nan": 0, "unique": 0, "low": None, "high": None}
    found: dict[str, dict] = {name: dict(none) for name in kinds}
    for names, kind, table in value_tables(df, {n: F.col(f"`{n}`") for n in kinds}):
        v, n = F.col("v"), F.col("n")
        text = isinstance(kind, T.StringType)
        number = M.to_number(v, kind) if text or M.is_numeric_type(kind) else F.lit(None).cast("double")
        here = ~M.is_missing(v, kind)
        total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
        counts = {"rows": F.sum("n"), "odd": total(v.isNotNull() & ~M.parses(v)) if text else F.max(F.lit(0)), "gone": total(~here), "nan": total(number.isNull()), "unique": F.count_if(here), "low": F.min(F.when(here, v)), "high": F.max(F.when(here, v))}
        found |= {names[r["i"]]: r.asDict() for r in table.groupBy("i").agg(*[c.alias(s) for s, c in counts.items()]).collect()}
    for name, got in found.items():
        got["numeric"] = got["odd"] == 0 and (isinstance(kinds[name], T.StringType) or M.is_numeric_type(kinds[name]))
    return found


def detect_types(df: DataFrame, ratio: float = 0.05, max_unique: int = 20, bool_values: tuple[str, ...] = (), samples: int = 0, order: str | None = None) -> list[ColumnType]:
    """Semantic type of each column: numerical, categorical or boolean.

    ``samples``: the first so many present values of each column, in the order of a
    key column, or as the table is read.
    """
    literals = {*M.TRUE_TOKENS, *M.FALSE_TOKENS, "0.0", "1.0", *bool_values}
    out = []
    for (name, got), field_ in zip(_cells(df).items(), df.schema.fields):
        # Where all that is there are numbers, the present values are the numbers.
        gone = got["nan"] if got["numeric"] else got["gone"]
        unique, valid = got["unique"], got["rows"] - gone
        if unique in (1, 2) and all(_logical(x, literals) for x in (got["low"], got["high"])):
            inferred = "boolean"
        elif got["numeric"]:
            inferred = "categorical" if valid and unique / valid <= ratio and unique <= max_unique else "numerical"
        else:
            inferred = "categorical"
        out.append(ColumnType(name, inferred, field_.dataType.simpleString(), unique, gone))
    if samples and out:
        firsts = first_values(df, df.columns, samples, order)
        for t in out:
            t.sample_values = firsts[t.name]
    return out


def first_values(df: DataFrame, columns: list[str], n: int = 5, order: str | None = None) -> dict[str, list]:
    """The first n present values of each column; a job for each, which stops reading when it has them or keeps n rows a task."""
    kinds, out = {f.name: f.dataType for f in df.schema.fields}, {}
    for name in columns:
        c = F.col(f"`{name}`")
        rows = df.filter(~M.is_missing(c, kinds[name]))
        rows = rows.select(c.alias("v"), F.col(f"`{order}`").alias("k")).orderBy("k") if order else rows.select(c.alias("v"))
        out[name] = [r["v"] for r in rows.limit(n).collect()]
    return out


def numeric_columns(types: list[ColumnType], kinds: tuple[str, ...] = ("numerical",)) -> list[str]:
    return [t.name for t in types if t.inferred_type in kinds]


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles, missing as null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[M.to_number(F.col(f"`{c}`"), kinds[c]).alias(c) for c in columns])


def numeric_by_content(df: DataFrame) -> list[str]:
    """Columns whose cells are all numbers or missing, found without types given."""
    return [name for name, got in _cells(df).items() if got["numeric"]]


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column with its fifteen statistics.

    Moments take one pass, quantiles two (a sketch and what it brackets), modes the
    table of values. Without columns, those that hold numbers.
    """
    columns = numeric_by_content(df) if columns is None else columns
    x = numbers(df, columns)
    c = {name: F.col(f"`{name}`") for name in columns}
    moments = aggregate(x, {f"{s}{i}": f(c[name]) for i, name in enumerate(columns) for s, f in S.MOMENTS.items()}) if columns else {}
    cuts, mode = quantiles(x, columns, [0.25, 0.5, 0.75]), modes(x, c)
    rows = []
    for i, name in enumerate(columns):
        got = {s: moments[f"{s}{i}"] for s in S.MOMENTS}
        q1, median, q3 = cuts[name] or (None,) * 3
        got |= {"median": median, "mode": mode[name], "q1": q1, "q3": q3, "iqr": q3 - q1 if cuts[name] else None, "range": got["max"] - got["min"] if cuts[name] else None}
        rows.append((name, *[got[s] for s in S.PROFILE]))
    kinds = ", ".join(f"{s} {'long' if s in ('count', 'missing') else 'double'}" for s in S.PROFILE)
    return df.sparkSession.createDataFrame(rows, f"name string, {kinds}")


def correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """x, y, i, j, r of every pair (i < j), over rows where both are present. Without columns, those that hold numbers."""
    columns = numeric_by_content(df) if columns is None else columns
    x = numbers(df, columns)
    pairs = list(combinations(range(len(columns)), 2))
    schema = "x string, y string, i int, j int, r double"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    rows = [F.struct(F.lit(columns[i]).alias("x"), F.lit(columns[j]).alias("y"), F.lit(i).alias("i"), F.lit(j).alias("j"), S.pearson(F.col(f"`{columns[i]}`"), F.col(f"`{columns[j]}`")).alias("r")) for i, j in pairs]
    out = None
    for k in range(0, len(rows), CHUNK // 3):
        part = x.agg(F.array(*rows[k : k + CHUNK // 3]).alias("rows")).select(F.inline("rows"))
        out = part if out is None else out.union(part)
    return out


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Both triangles and the diagonal, which is 1 by definition."""
    upper = correlation(df, columns).select("x", "y", "r")
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "x string, y string, r double")
    return upper.union(upper.select("y", "x", "r")).union(diagonal)


def high_correlations(df: DataFrame, columns: list[str], threshold: float = 0.9) -> DataFrame:
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    return correlation(df, columns).filter(F.abs("r") >= threshold).orderBy(F.abs("r").desc(), "i", "j")


def fences(df: DataFrame, columns: list[str], k: float = 1.5) -> dict[str, tuple]:
    """q1, q3, lower and upper fence of each column; None where it is empty."""
    if k <= 0:
        raise ValueError("k is positive")
    x = numbers(df, columns)
    got = quantiles(x, columns, [0.25, 0.75])
    return {c: (q[0], q[1], q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])) if (q := got[c]) else None for c in columns}


def outlier_report(df: DataFrame, columns: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """column, q1, q3, iqr, lower, upper, n_low, n_high, n_total, pct of present values. Without columns, those that hold numbers."""
    columns = numeric_by_content(df) if columns is None else columns
    bounds = fences(df, columns, k)
    x = numbers(df, columns)
    rows = []
    for name in columns:
        c, b = F.col(f"`{name}`"), bounds[name]
        q1, q3, low, high = b or (None,) * 4
        n_low, n_high = (F.count_if(c < F.lit(low)), F.count_if(c > F.lit(high))) if b else (F.max(F.lit(0)), F.max(F.lit(0)))
        total = (n_low + n_high).cast("long")
        number = lambda v: F.lit(v).cast("double")
        pct = F.coalesce(F.try_divide(100.0 * total, F.count(c)), F.lit(0.0))
        rows.append(F.struct(F.lit(name).alias("column"), number(q1).alias("q1"), number(q3).alias("q3"), number(q3 - q1 if b else None).alias("iqr"), number(low).alias("lower"), number(high).alias("upper"), n_low.cast("long").alias("n_low"), n_high.cast("long").alias("n_high"), total.alias("n_total"), pct.alias("pct")))
    return x.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def outlier_rows(df: DataFrame, key: str, columns: list[str], k: float = 1.5) -> DataFrame:
    """column, row key and value of every outlier."""
    bounds = fences(df, columns, k)
    out = None
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for name in columns:
        if not bounds[name]:
            continue
        c = M.to_number(F.col(f"`{name}`"), kinds[name])
        part = df.select(F.lit(name).alias("column"), F.col(f"`{key}`").alias("row_id"), c.alias("value")).filter((F.col("value") < bounds[name][2]) | (F.col("value") > bounds[name][3]))
        out = part if out is None else out.union(part)
    return out


def cap(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """Values beyond the fences become the fence; missing stays missing."""
    bounds, kinds = fences(df, columns, k), {f.name: f.dataType for f in df.schema.fields}
    clipped = {}
    for name in columns:
        c = M.to_number(F.col(f"`{name}`"), kinds[name])
        clipped[name] = F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(bounds[name][2])), F.lit(bounds[name][3]))) if bounds[name] else c
    return df.withColumns(clipped)


@dataclass
class InspectorConfig:
    categorical_ratio: float = 0.05
    max_categorical_unique: int = 20
    correlation_threshold: float = 0.90
    outlier_k: float = 1.5
    cap_outliers: bool = False


@dataclass
class InspectionReport:
    n_rows: int
    n_cols: int
    column_types: list[dict]
    type_summary: dict[str, int]
    statistics: list[dict]
    correlations: list[dict]
    high_correlations: list[dict]
    outliers: list[dict]
    warnings: list[str]
    elapsed_seconds: float
    capped: DataFrame | None = field(default=None, repr=False)  # the table with outliers at their fences, if the config asks for it

    def to_dict(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "capped"}

    def to_json(self, indent: int = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent, default=str)


def inspect(df: DataFrame, config: InspectorConfig | None = None) -> InspectionReport:
    """Typing, statistics, correlations and outliers of a table, with warnings.

    Only reports (a row a column or pair) reach the driver.
    """
    config, began = config or InspectorConfig(), time.time()
    types = detect_types(df, config.categorical_ratio, config.max_categorical_unique, samples=5)
    numeric = numeric_columns(types)
    n_rows = df.count()
    rounded = lambda r: {k: round(v, 6) if isinstance(v, float) else v for k, v in r.asDict().items()}
    statistics = [rounded(r) for r in profile(df, numeric).collect()] if numeric else []
    pairs = [rounded(r) for r in correlation(df, numeric).collect()] if len(numeric) > 1 else []
    high = sorted((p for p in pairs if abs(p["r"]) >= config.correlation_threshold), key=lambda p: (-abs(p["r"]), p["i"], p["j"]))
    outliers = [rounded(r) for r in outlier_report(df, numeric, config.outlier_k).collect()] if numeric else []
    warnings = [f"'{p['x']}' and '{p['y']}' are nearly collinear (r = {p['r']:.4f})" for p in high]
    warnings += [f"'{o['column']}' has {o['pct']:.1f}% outliers" for o in outliers if o["pct"] > 5.0]
    warnings += [f"'{t.name}' has {t.n_missing} missing values ({100.0 * t.n_missing / max(n_rows, 1):.1f}%)" for t in types if t.n_missing]
    summary: dict[str, int] = {}
    for t in types:
        summary[t.inferred_type] = summary.get(t.inferred_type, 0) + 1
    return InspectionReport(n_rows, len(df.columns), [asdict(t) for t in types], summary, statistics, pairs, high, outliers, warnings, time.time() - began, cap(df, numeric, config.outlier_k) if config.cap_outliers else None)
