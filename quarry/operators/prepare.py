"""Imputation, scaling, encoding and the cleaner that chains them.

``fit`` runs one aggregate and returns a model of plain values; ``transform`` is
one projection, so it works on a stream as well.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import missing as M
from quarry.functions import stats as S
from quarry.functions.values import aggregate, modes, quantiles, value_tables
from quarry.operators.profile import ColumnType, detect_types


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _kinds(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


#: A side of a join is broadcast only if its counted rows stay below this.
BROADCAST_BYTES = 16 << 20


class Step:
    """fit / transform / fit_transform; transform before fit is an error."""

    fitted = False

    def fit(self, df: DataFrame, type_map: dict[str, str]) -> Step:
        self._fit(df, type_map)
        self.fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise RuntimeError("fit comes before transform")
        return self._transform(df)

    def fit_transform(self, df: DataFrame, type_map: dict[str, str]) -> DataFrame:
        return self.fit(df, type_map).transform(df)


class SimpleImputer(Step):
    """Fill missing cells with the mean, median, mode or a constant."""

    def __init__(self, strategy: str = "mean", fill_value: Any = None):
        if strategy not in ("mean", "median", "mode", "constant"):
            raise ValueError(f"unknown strategy {strategy!r}")
        self.strategy, self.fill_value = strategy, fill_value

    def _fit(self, df: DataFrame, type_map: dict[str, str]) -> None:
        self.kinds, self.type_map = _kinds(df), dict(type_map)
        values = {}
        for name, kind in self.kinds.items():
            present = F.when(~M.is_missing(_col(name), kind), _col(name))
            values[name] = M.to_number(_col(name), kind) if type_map.get(name) == "numerical" else present
        numeric = [n for n in values if type_map.get(n) == "numerical"]
        averaged = numeric if self.strategy == "mean" else []
        got = aggregate(df, {f"gone{i}": F.count_if(v.isNull()) for i, v in enumerate(values.values())} | {f"mean{n}": S.mean(values[n]) for n in averaged})
        fills = {n: got[f"mean{n}"] for n in averaged}
        if self.strategy == "median":
            x = df.select(*[values[n].alias(n) for n in numeric])
            fills |= {n: q and q[0] for n, q in quantiles(x, numeric, [0.5]).items()}
        if self.strategy != "constant":
            fills |= modes(df, {n: v for n, v in values.items() if n not in fills})
        self.fills = {name: self.fill_value if self.strategy == "constant" else fills[name] for name in self.kinds}
        self.missing = {name: got[f"gone{i}"] for i, name in enumerate(self.kinds)}

    def _transform(self, df: DataFrame) -> DataFrame:
        out = []
        for name in df.columns:
            kind = _kinds(df)[name]
            numeric = self.type_map.get(name) == "numerical"
            value = M.to_number(_col(name), kind) if numeric else F.when(~M.is_missing(_col(name), kind), _col(name))
            fill = self.fills.get(name)
            if fill is not None:
                target = T.DoubleType() if numeric else kind
                value = F.coalesce(value, F.lit(fill).cast(target))
            out.append(value.alias(name))
        return df.select(*out)

    def summary(self) -> list[dict]:
        return [{"column": c, "strategy": self.strategy, "fill_value": self.fills[c], "n_filled": self.missing[c]} for c in self.kinds]


class _Scaler(Step):
    """Numerical columns only; missing stays missing."""

    def _fit(self, df: DataFrame, type_map: dict[str, str]) -> None:
        self.columns = [c for c in df.columns if type_map.get(c) == "numerical"]
        kinds = _kinds(df)
        value = {c: M.to_number(_col(c), kinds[c]) for c in self.columns}
        got = aggregate(df, {f"{s}{i}": f(value[c]) for i, c in enumerate(self.columns) for s, f in self.NEEDS.items()}) if self.columns else {}
        self.params = {c: {s: got[f"{s}{i}"] for s in self.NEEDS} for i, c in enumerate(self.columns)}

    def _transform(self, df: DataFrame) -> DataFrame:
        kinds = _kinds(df)
        return df.select(*[(self._scale(M.to_number(_col(c), kinds[c]), **self.params[c]) if c in self.params else _col(c)).alias(c) for c in df.columns])


class MinMaxScaler(_Scaler):
    """To a range; a constant column becomes its lower end."""

    NEEDS = {"low": F.min, "high": F.max}

    def __init__(self, feature_range: tuple[float, float] = (0.0, 1.0)):
        if feature_range[0] >= feature_range[1]:
            raise ValueError("the range is empty")
        self.range = feature_range

    def _scale(self, c: Column, low: float | None, high: float | None) -> Column:
        a, b = map(float, self.range)
        if low is None:
            return c
        if low == high:
            return F.when(c.isNotNull(), F.lit(a))
        return (c - F.lit(low)) / F.lit(high - low) * F.lit(b - a) + F.lit(a)


class StandardScaler(_Scaler):
    """Mean 0, sample deviation 1; one value or a constant column becomes 0."""

    NEEDS = {"mu": F.avg, "sigma": F.stddev_samp, "low": F.min, "high": F.max}

    def _scale(self, c: Column, mu: float | None, sigma: float | None, low: float | None, high: float | None) -> Column:
        if not sigma or low == high:
            return F.when(c.isNotNull(), F.lit(0.0))
        return (c - F.lit(mu)) / F.lit(sigma)


class _Encoder(Step):
    """Categories are the sorted distinct texts of a column: one table of all columns' distinct texts is read."""

    def __init__(self, target_types: tuple[str, ...] = ("categorical",)):
        self.target_types = set(target_types)

    def _texts(self, df: DataFrame, type_map: dict[str, str]) -> tuple[list[str], DataFrame | None]:
        """The columns to encode, and a table (i, v) of their distinct texts."""
        names = [c for c in df.columns if type_map.get(c) in self.target_types]
        tables = value_tables(df, {c: self._present(df, c) for c in names}) if names else []
        return names, tables[0][2].filter("v IS NOT NULL").select("i", "v") if tables else None

    def _fit(self, df: DataFrame, type_map: dict[str, str]) -> None:
        names, table = self._texts(df, type_map)
        self.categories: dict[str, list[str]] = {c: [] for c in names}
        for r in table.collect() if names else []:
            self.categories[names[r["i"]]].append(r["v"])
        for own in self.categories.values():
            own.sort()

    def _present(self, df: DataFrame, c: str) -> Column:
        kind = _kinds(df)[c]
        return F.when(~M.is_missing(_col(c), kind), M.as_text(_col(c), kind))


class OneHotEncoder(_Encoder):
    """Indicators ``<column>_<category>`` in the column's place; unknown and missing are all 0.

    A column for each category is part of the schema, so categories live on the driver.
    """

    def __init__(self, drop_first: bool = False, target_types: tuple[str, ...] = ("categorical",)):
        super().__init__(target_types)
        self.drop_first = drop_first

    def _transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c not in self.categories:
                out.append(_col(c))
                continue
            text = self._present(df, c)
            out += [F.coalesce(text == F.lit(v), F.lit(False)).cast("byte").alias(f"{c}_{v}") for v in self.categories[c][1 if self.drop_first else 0 :]]
        return df.select(*out)

    def get_feature_names(self) -> list[str]:
        return [f"{c}_{v}" for c, vs in self.categories.items() for v in vs[1 if self.drop_first else 0 :]]


class LabelEncoder(_Encoder):
    """Sorted codes from 0; unknown is -1, missing stays missing.

    Up to LITERALS categories of a column are part of the plan. More stay in a table
    (text, code), numbered by ranges, that ``transform`` joins.
    """

    LITERALS = 1000

    def _fit(self, df: DataFrame, type_map: dict[str, str]) -> None:
        from quarry.operators.evaluate import number_rows
        from quarry.streaming.storage import checkpoint

        names, table = self._texts(df, type_map)
        self.categories, self.tables = {}, {}
        if not names:
            return
        table = checkpoint(table)
        sizes = {names[r["i"]]: r["n"] for r in table.groupBy("i").agg(F.count("*").alias("n")).collect()}
        small = [i for i, c in enumerate(names) if sizes.get(c, 0) <= self.LITERALS]
        self.categories = {names[i]: [] for i in small}
        for r in table.filter(F.col("i").isin(small)).collect() if small else []:
            self.categories[names[r["i"]]].append(r["v"])
        for own in self.categories.values():
            own.sort()
        for i, c in enumerate(names):
            if i not in small:
                codes = number_rows(table.filter(F.col("i") == i).select("v"), "v").select(F.col("v").alias("__text"), F.col("row_number").cast("int").alias("__code"))
                self.tables[c] = (sizes[c], checkpoint(codes))

    def _transform(self, df: DataFrame) -> DataFrame:
        out, columns = df, df.columns
        for k, c in enumerate(columns):
            if c in self.categories:
                text = self._present(df, c)
                known = F.create_map(*[F.lit(x) for i, v in enumerate(self.categories[c]) for x in (v, i)]) if self.categories[c] else None
                code = F.coalesce(F.element_at(known, text), F.lit(-1)) if known is not None else F.lit(-1)
                out = out.withColumn(c, F.when(text.isNotNull(), code).cast("int"))
            elif c in self.tables:
                n, codes = self.tables[c]
                side = codes.select(F.col("__text").alias(f"__text{k}"), F.col("__code").alias(f"__code{k}"))
                side = F.broadcast(side) if n * 64 <= BROADCAST_BYTES else side
                out = out.withColumn(f"__own{k}", self._present(df, c)).join(side, F.col(f"__own{k}") == F.col(f"__text{k}"), "left")
                code = F.when(F.col(f"__own{k}").isNotNull(), F.coalesce(f"__code{k}", F.lit(-1)))
                out = out.withColumn(c, code.cast("int")).drop(f"__own{k}", f"__text{k}", f"__code{k}")
        return out.select(*[_col(c) for c in columns])

    def get_mapping(self) -> dict[str, dict[str, int]]:
        """Text to code of each column; large tables are collected here."""
        out = {c: {v: i for i, v in enumerate(vs)} for c, vs in self.categories.items()}
        return out | {c: {r["__text"]: r["__code"] for r in codes.collect()} for c, (_, codes) in self.tables.items()}


@dataclass
class CleanerConfig:
    impute_strategy: str = "mean"
    fill_value: Any = None
    scaler: str | None = "standard"
    feature_range: tuple[float, float] = (0.0, 1.0)
    encoder: str | None = "onehot"
    drop_first: bool = False
    categorical_ratio: float = 0.05
    max_categorical_unique: int = 20

    def __post_init__(self) -> None:
        if self.scaler not in ("standard", "minmax", None, "none"):
            raise ValueError(f"unknown scaler {self.scaler!r}")
        if self.encoder not in ("onehot", "label", None, "none"):
            raise ValueError(f"unknown encoder {self.encoder!r}")
        SimpleImputer(self.impute_strategy)


@dataclass
class CleaningReport:
    n_rows: int
    columns_in: list[str]
    columns_out: list[str]
    column_types: list[dict]
    imputation: list[dict]
    scaling: dict
    encoding: dict
    warnings: list[str] = field(default_factory=list)
    elapsed_seconds: float = 0.0

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self, indent: int = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent, default=str)


class Cleaner(Step):
    """Impute, scale, encode; ``transform`` chains three projections that Catalyst makes one."""

    def __init__(self, config: CleanerConfig | None = None):
        self.config = config or CleanerConfig()

    def _fit(self, df: DataFrame, type_map: dict[str, str] | None = None) -> None:
        c, began = self.config, time.time()
        self.types: list[ColumnType] = detect_types(df, c.categorical_ratio, c.max_categorical_unique)
        type_map = type_map or {t.name: t.inferred_type for t in self.types}
        self.type_map = type_map
        self.imputer = SimpleImputer(c.impute_strategy, c.fill_value)
        self.scaler = {"standard": StandardScaler, "minmax": lambda: MinMaxScaler(c.feature_range)}.get(c.scaler or "none", lambda: None)()
        self.encoder = {"onehot": lambda: OneHotEncoder(c.drop_first), "label": LabelEncoder}.get(c.encoder or "none", lambda: None)()
        self.steps = [s for s in (self.imputer, self.scaler, self.encoder) if s]
        out = df
        for step in self.steps:
            out = step.fit(out, type_map).transform(out)
        warnings = [f"'{t.name}' has {t.n_missing} missing values; they will be imputed" for t in self.types if t.n_missing]
        warnings += [f"'{s['column']}' is entirely missing and was left as it is" for s in self.imputer.summary() if s["fill_value"] is None and s["n_filled"] and c.impute_strategy != "constant"]
        params = self.scaler.params if self.scaler else {}
        warnings += [f"'{n}' is constant; scaling sets it to one value" for n, p in params.items() if p["low"] is not None and p["low"] == p["high"]]
        self.report = CleaningReport(df.count(), df.columns, out.columns, [asdict(t) for t in self.types], self.imputer.summary(), params, self.encoder.categories | {c: f"{n} categories" for c, (n, _) in getattr(self.encoder, "tables", {}).items()} if self.encoder else {}, warnings, time.time() - began)

    def fit(self, df: DataFrame, type_map: dict[str, str] | None = None) -> Cleaner:
        return super().fit(df, type_map)

    def _transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df

    def run(self, df: DataFrame, type_map: dict[str, str] | None = None) -> tuple[DataFrame, CleaningReport]:
        return self.fit(df, type_map).transform(df), self.report


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    if target not in df.columns:
        raise ValueError(f"no column {target!r}")
    return df.drop(target), df.select(_col(target))


def detect_task(df: DataFrame, target: str, threshold: int = 20) -> str:
    """Regression if all present values are numbers and many differ, else classification."""
    kind = _kinds(df)[target]
    c = _col(target)
    odd = F.count_if(c.isNotNull() & ~M.parses(c)) if isinstance(kind, T.StringType) else F.lit(0) + F.max(F.lit(0))
    if not isinstance(kind, T.StringType) and not M.is_numeric_type(kind):
        return "classification"
    got = df.agg(odd.alias("odd"), F.count(F.lit(1)).alias("n"), F.count_distinct(c).alias("unique")).first()
    return "regression" if got["odd"] == 0 and got["unique"] > min(threshold, max(5, int(0.3 * got["n"]))) else "classification"


def encode_target(df: DataFrame, target: str, task: str) -> tuple[DataFrame, list[str] | None]:
    """``label`` as double: the number itself, or the sorted class code (-1 for missing), and the classes.

    Of more than LabelEncoder.LITERALS classes the names stay in the encoder's table (None here).
    """
    kind = _kinds(df)[target]
    if task == "regression":
        return df.withColumn("label", M.to_number(_col(target), kind)), None
    encoder = LabelEncoder(("target",)).fit(df.select(_col(target)), {target: "target"})
    label = "__label_of_target"
    both = df.withColumn(label, _col(target))
    encoder.categories = {label: v for v in encoder.categories.values()}
    encoder.tables = {label: v for v in encoder.tables.values()}
    out = encoder.transform(both).withColumn("label", F.coalesce(_col(label), F.lit(-1)).cast("double")).drop(label)
    return out, encoder.categories.get(label)


def finalise(df: DataFrame) -> DataFrame:
    """All columns as doubles: numbers, or yes / no words; anything else is an error."""
    kinds, out, odd = _kinds(df), [], {}
    for c in df.columns:
        value = M.as_feature(_col(c), kinds[c])
        if isinstance(kinds[c], T.StringType):
            odd[c] = F.count_if(value.isNull() & ~M.is_missing(_col(c), kinds[c]))
        out.append(value.alias(c))
    bad = [c for c, n in aggregate(df, odd).items() if n] if odd else []
    if bad:
        raise ValueError(f"no numbers: {bad}")
    return df.select(*out)


def id_columns(df: DataFrame, target: str | None = None, ratio: float = 0.9, strict: bool = False) -> list[str]:
    """Columns that name rows: gap-free whole numbers, or text that is nearly always unique.

    ``strict`` also takes numbers that are nearly always unique.
    """
    kinds, got = _kinds(df), {}
    columns = [c for c in df.columns if c != target]
    for names, kind, table in value_tables(df, {c: _col(c) for c in columns}):
        v, n = F.col("v"), F.col("n")
        value = M.to_number(v, kind) if isinstance(kind, T.StringType) or M.is_numeric_type(kind) else F.lit(None).cast("double")
        here = ~M.is_missing(v, kind)
        # Texts that are the same number are one number.
        cells = table.select("i", "n", value.alias("x"), v.isNotNull().cast("int").alias("raw"), F.when(here & value.isNull(), n).alias("odd"))
        cells = cells.groupBy("i", "x").agg(F.sum("n").alias("n"), F.sum("raw").alias("raw"), F.sum("odd").alias("odd"))
        x = F.col("x")
        found = cells.groupBy("i").agg(F.sum("n").alias("rows"), F.sum("raw").alias("u"), F.coalesce(F.sum("odd"), F.lit(0)).alias("odd"), F.coalesce(F.bool_and(x == F.floor(x)), F.lit(False)).alias("whole"), F.min(x).alias("low"), F.max(x).alias("high"), F.coalesce(F.sum(F.when(x.isNotNull(), F.col("n"))), F.lit(0)).alias("n"), F.count(x).alias("v"))
        got |= {names[r["i"]]: r for r in found.collect()}
    out = []
    for c in columns:
        r = got.get(c)
        if r is None:  # an empty table
            continue
        share = r["u"] / max(r["rows"], 1)
        if r["odd"] == 0 and r["n"]:
            dense = r["whole"] and r["v"] == r["n"] and r["high"] - r["low"] + 1 == r["v"]
            if (dense and share > ratio) or (strict and share > ratio):
                out.append(c)
        elif share > ratio:
            out.append(c)
    return out


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), the same in every run: smallest digests of key and seed."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string"))), key).limit(n)
