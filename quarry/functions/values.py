"""Exact order statistics and distinct values of many columns, without a task that holds them all.

Distinct values and modes come from one table (column, value, count), which is
aggregated on both sides of one exchange. Quantiles need no exchange of values at
all: a sketch brackets each of them, and only the values within the brackets are
counted one by one.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accuracy of the sketches, and rows within brackets below which they are counted one by one.
ACCURACY, FEW = 10_000, 200_000
#: Aggregates in one ``agg``: more would pass the limits of generated code.
CHUNK = 120


def aggregate(df: DataFrame, named: dict[str, Column]) -> dict:
    """All expressions in as few passes as CHUNK allows; one row is collected each."""
    out: dict = {}
    names = list(named)
    for k in range(0, len(names), CHUNK):
        out |= df.agg(*[named[n].alias(n) for n in names[k : k + CHUNK]]).first().asDict()
    return out


def _common(kind: T.DataType) -> T.DataType:
    """The type under which columns share a table of values."""
    if isinstance(kind, T.IntegralType):
        return T.LongType()
    if isinstance(kind, T.FloatType):
        return T.DoubleType()
    if isinstance(kind, (T.AtomicType, T.DecimalType)) and not isinstance(kind, T.BinaryType):
        return kind
    return T.StringType()


def value_tables(df: DataFrame, columns: dict[str, Column]) -> list[tuple[list[str], T.DataType, DataFrame]]:
    """(names, type, table (i, v, n)): how often column ``names[i]`` holds v, null included; a table for each type."""
    kinds = {f.name: f.dataType for f in df.select(*[c.alias(n) for n, c in columns.items()]).schema.fields}
    by_type: dict[str, list[str]] = {}
    for name, kind in kinds.items():
        by_type.setdefault(_common(kind).simpleString(), []).append(name)
    out = []
    for names in by_type.values():
        kind = _common(kinds[names[0]])
        cells = [F.struct(F.lit(i).alias("i"), columns[n].cast(kind).alias("v")) for i, n in enumerate(names)]
        out.append((names, kind, df.select(F.inline(F.array(*cells))).groupBy("i", "v").agg(F.count("*").alias("n"))))
    return out


def modes(df: DataFrame, columns: dict[str, Column]) -> dict:
    """Most frequent value of each column, the smallest of those that tie; None where there is none."""
    out: dict = dict.fromkeys(columns)
    for names, _, table in value_tables(df, columns):
        best = table.filter("v IS NOT NULL").groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("b"))
        out |= {names[r["i"]]: r["b"]["v"] for r in best.collect()}
    return out


def quantiles(x: DataFrame, columns: list[str], at: list[float]) -> dict[str, list[float] | None]:
    """Quantiles (0 to 1) of double columns with linear interpolation, exact; None where a column is empty."""
    if not columns:
        return {}
    c = {name: F.col(f"`{name}`") for name in columns}
    near = [min(1.0, max(0.0, q + d)) for q in at for d in (-2 / ACCURACY, 2 / ACCURACY)]
    first = aggregate(x, {f"{s}{i}": e for i, name in enumerate(columns) for s, e in (("n", F.count(c[name])), ("b", F.percentile_approx(c[name], F.array(*map(F.lit, near)), ACCURACY)), ("low", F.min(c[name])), ("high", F.max(c[name])))})
    count = {name: first[f"n{i}"] for i, name in enumerate(columns)}
    ends = {name: (first[f"low{i}"], first[f"high{i}"]) for i, name in enumerate(columns)}
    brackets = {(name, j): tuple(first[f"b{i}"][2 * j : 2 * j + 2]) for i, name in enumerate(columns) for j in range(len(at)) if count[name]}
    most = max((n * 5 // ACCURACY for n in count.values()), default=0)
    while most > FEW:  # narrow the brackets by sketches of what is inside them
        brackets, most = _narrowed(x, c, brackets, count, at, most)
    out: dict[str, list[float] | None] = {name: [0.0] * len(at) if count[name] else None for name in columns}
    open_ = set(brackets)
    while open_:
        found = _counted(x, c, {k: brackets[k] for k in open_})
        for key in list(open_):
            name, j = key
            place = (count[name] - 1) * at[j]
            values = _ranked(found[name], brackets[key], math.floor(place), min(math.floor(place) + 1, count[name] - 1))
            if values is None:  # the sketch was off: look everywhere
                brackets[key] = ends[name]
                continue
            share = place - math.floor(place)
            out[name][j] = values[0] if values[0] == values[1] else values[0] * (1 - share) + values[1] * share
            open_.discard(key)
    return out


def _narrowed(x: DataFrame, c: dict, brackets: dict, count: dict, at: list[float], most: int) -> tuple[dict, int]:
    keys = list(brackets)
    inside = {k: (c[k[0]] >= brackets[k][0]) & (c[k[0]] <= brackets[k][1]) for k in keys}
    below = aggregate(x, {f"{s}{i}": F.count_if(e) for i, k in enumerate(keys) for s, e in (("b", c[k[0]] < brackets[k][0]), ("m", inside[k]))})
    named, wide = {}, {}
    for i, k in enumerate(keys):
        inner = below[f"m{i}"]
        place = ((count[k[0]] - 1) * at[k[1]] - below[f"b{i}"]) / max(1, inner)
        if inner <= FEW or not 0 <= place <= 1:
            wide[k] = brackets[k]
            continue
        near = [min(1.0, max(0.0, place + d)) for d in (-2 / ACCURACY, 2 / ACCURACY)]
        named[f"q{i}"] = F.percentile_approx(F.when(inside[k], c[k[0]]), F.array(*map(F.lit, near)), ACCURACY)
    got = aggregate(x, named) if named else {}
    return {k: tuple(got[f"q{i}"]) if f"q{i}" in got else wide[k] for i, k in enumerate(keys)}, most * 5 // ACCURACY


def _counted(x: DataFrame, c: dict, brackets: dict) -> dict[str, list[tuple]]:
    """(value, rows) of each column in order: values within brackets one by one, the others as regions between edges.

    What is collected is bounded by the brackets; a bracket that many values share
    is counted on the executors first.
    """
    edges: dict[str, list[tuple[float, float]]] = {}
    for (name, _), b in brackets.items():
        edges.setdefault(name, []).append(b)
    names, cells = list(edges), []
    for i, name in enumerate(names):
        merged: list[list[float]] = []
        for low, high in sorted(edges[name]):
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        edges[name] = merged
        v, region, inside = c[name], F.lit(0), F.lit(False)
        for low, high in merged:
            region = region + (v >= F.lit(low)).cast("int") + (v > F.lit(high)).cast("int")
            inside = inside | ((v >= F.lit(low)) & (v <= F.lit(high)))
        cells.append(F.struct(F.lit(i).alias("i"), F.when(v.isNotNull(), region).alias("region"), F.when(inside, v).alias("v")))
    rows = x.select(F.inline(F.array(*cells))).filter("region IS NOT NULL").groupBy("i", "region", "v").agg(F.count("*").alias("n")).collect()
    out: dict[str, list[tuple]] = {name: [] for name in names}
    for r in sorted(rows, key=lambda r: (r["region"], -math.inf if r["v"] is None else r["v"])):
        out[names[r["i"]]].append((r["v"], r["n"]))
    return out


def _ranked(found: list[tuple], bracket: tuple[float, float], a: int, b: int) -> tuple[float, float] | None:
    """The values of ranks a and b (from 0); None if one lies outside the brackets."""
    ends, total = [], 0
    for _, n in found:
        total += n
        ends.append(total)
    values = [found[bisect_right(ends, k)][0] for k in (a, b)]
    return None if None in values else (values[0], values[1])
