"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words. A document's expected number of copies is
target / source size; its whole part is certain, its fraction is rounded. Within a
group of documents, whose fractions are equal, each meets the pool of all that are
shorter, the longest first: words are moved between the two at random, to the
document or to the pool, until the document's fraction is 1 or 0 (or the pool has
none left to give or take). The odds are such that every expectation stays what it
was, and so does the number of words of the pair. The pool's fractions stay equal, so
one meeting is two numbers. The one left open is as a rule among the shortest.

A group so leaves one residual; residuals, whose fractions differ, meet two by two in
groups on the next level of a tree, until each source has one left (small sources get
there sooner), which a coin rounds. In a source of one group no residual can go on: a
document that its pool can balance one way only goes that way, and one that it can
balance neither way goes where the miss is smaller. So words hold there to within the
shortest documents, while expectations hold for all but those documents (long ones in
a source of few documents).

Documents are dealt into groups by a hash of key, size and text, so a source of any
size is spread, and groups hold numbers, not text. Coins are hashes of key, text,
level and seed, so reruns agree whatever the partitioning.

Edge cases: null or blank text has size 0 and is taken 0 words; a null source is a
source of its own, last in order; rows that repeat a key are decided apart, and of
rows with equal key, source and text each has a turn of its own; documents of equal
size meet in hashed order; no source's target is above MOST times its size, which
bounds copies to MOST; a text of any length is one number here; an empty table gives
no rows; extra columns are ignored by the query and kept by ``resample``.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import checkpoint, mix, prepare, small_side, table, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Documents in a group, and residuals that meet in a group of the next level.
GROUP_ROWS, FAN_IN = 2_000, 2_000
#: Sources are a catalogue that the driver plans over; more are an error.
MAX_SOURCES = 1_000_000
_NONE, _TURNS = 1e-12, 4096


def plan_targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Target words of each source: shares by repeating weights, at most ``most`` times its size.

    What sources can't take is shared again, by weight, among those below their
    limit, until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    total = float(sum(n for _, n in order))
    weight = np.array([weights[i % len(weights)] for i in range(len(order))])
    limit = np.array([float(most * n) for _, n in order])
    full = np.zeros(len(order), bool)
    target = np.zeros(len(order))
    while len(order):
        open_ = ~full
        if not open_.any():
            break
        target[full] = limit[full]
        target[open_] = (total - limit[full].sum()) * weight[open_] / weight[open_].sum()
        over = open_ & (target > limit)
        if not over.any():
            break
        full |= over
    return {name: float(t) for (name, _), t in zip(order, np.minimum(target, limit))}


def pool(part: float, size: np.ndarray, coin: np.ndarray, last: bool = False) -> tuple[np.ndarray, int]:
    """Round equal fractions of documents given from long to short; returns them, and the one still open (-1: none).

    ``last``: no document may stay open, even if its pool can't balance it. A document
    without words is 0.
    """
    sizes, coins_ = size.tolist(), coin.tolist()
    out, left, x = [0.0] * len(sizes), float(sum(sizes)), float(part)
    for i, s in enumerate(sizes):
        if s == 0 or not _NONE < x < 1.0 - _NONE:
            out[i] = float(round(x)) if s else 0.0
            continue
        left -= s
        to_own, to_pool, give, take = (1.0 - x) * s, x * s, x * left, (1.0 - x) * left
        lack_up, lack_down = max(0.0, to_own - give), max(0.0, to_pool - take)
        if last:
            up = coins_[i] < x if not lack_up and not lack_down else (lack_up, 1.0 - x) <= (lack_down, x)
            out[i] = float(up)
            moved = min(to_own, give) if up else -min(to_pool, take)
        elif not left:
            out[i] = x
            return np.array(out), i
        else:
            to_own, to_pool = min(to_own, give), min(to_pool, take)
            up = coins_[i] * (to_own + to_pool) < to_pool
            moved = to_own if up else -to_pool
            if lack_up if up else lack_down:  # the pool is used up and the document stays open
                out[i] = x + moved / s
                out[i + 1 :] = [float(not up and n > 0) for n in sizes[i + 1 :]]
                return np.array(out), i
            out[i] = float(up)
        x = x - moved / left if left else 0.0
    return np.array(out), -1


def pivot(part: np.ndarray, size: np.ndarray, coin: np.ndarray) -> tuple[np.ndarray, int]:
    """Round fractions two by two, in order; returns them, and the one still open (-1: none).

    Words stay the same in every meeting: moving w words changes a fraction by
    w / size. A document without words takes no part.
    """
    out, sizes, coins_ = part.tolist(), size.tolist(), coin.tolist()
    held = -1
    for i in range(len(out)):
        if sizes[i] == 0 or not _NONE < out[i] < 1 - _NONE:
            out[i] = float(round(out[i])) if sizes[i] else 0.0
            continue
        if held < 0:
            held = i
            continue
        a, b, x, y = sizes[held], sizes[i], out[held], out[i]
        to_held = min((1 - x) * a, y * b)  # words that can go from i to held, and back
        to_i = min(x * a, (1 - y) * b)
        if coins_[i] * (to_held + to_i) < to_i:
            x, y = x + to_held / a, y - to_held / b
        else:
            x, y = x - to_i / a, y + to_i / b
        x_open, y_open = _NONE < x < 1 - _NONE, _NONE < y < 1 - _NONE
        out[held] = x if x_open else float(round(x))
        out[i] = y if y_open else float(round(y))
        held = held if x_open else i if y_open else -1
    return np.array(out), held


def coins(keys: np.ndarray, salt: int) -> np.ndarray:
    h = mix(mix(keys.view(np.uint64) ^ np.uint64(salt)))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def meeting(salt: int, level: int):
    """The function for a group of one level; on a source's last level none stays open."""

    def meet(group: pa.Table) -> pa.Table:
        unit, size = group.column("unit").to_numpy(), group.column("size").to_numpy()
        turn = np.lexsort((unit, coins(unit, salt ^ 0x5BD1E995), -size))  # neighbours by key are often kin
        part = np.empty(len(unit))
        last = nodes_at(group.column("groups")[0].as_py(), level) == 1
        given, coin = group.column("part").to_numpy()[turn], coins(unit, salt)[turn]
        rounded, held = pool(given[0], size[turn], coin, last) if level == 0 else pivot(given, size[turn], coin)
        if held >= 0 and last:
            rounded[held], held = float(coins(unit[turn[held : held + 1]], salt ^ 0x1B873593)[0] < rounded[held]), -1
        part[turn] = rounded
        left = np.zeros(len(unit), bool)
        if held >= 0:
            left[turn[held]] = True
        return group.set_column(group.schema.get_field_index("part"), "part", pa.array(part)).append_column("open", pa.array(left))

    return meet


def nodes_at(groups: int, level: int) -> int:
    """Groups that a source has on a level of its tree."""
    for _ in range(level):
        groups = -(-groups // FAN_IN)
    return groups


def sizes_of(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """key, source, text_hash and size (words) of each row; the text goes no further."""
    own = F.col(f"`{text}`")
    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), F.xxhash64(own).alias("text_hash"), F.coalesce(F.regexp_count(own, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = 17, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """key, source, text_hash, turn, size, source_size, target and copies of each row.

    Rows with equal key, source and text are one row here until they are dealt:
    ``turn`` counts them from 0.
    """
    spark = docs.sparkSession
    prepare(spark)
    same = ["source", "key", "text_hash", "size"]
    rows = checkpoint(sizes_of(docs, text, key, source).groupBy(*same).agg(F.count("*").alias("n")))
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n"))
    got = totals.limit(MAX_SOURCES + 1).collect()
    if len(got) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    target = plan_targets([(r["source"], r["size"]) for r in got], weights, most)
    order = sorted(got, key=lambda r: (r["source"] is None, r["source"] or ""))
    catalogue = [(i, r["source"], r["size"], target[r["source"]], max(1, -(-r["n"] // GROUP_ROWS))) for i, r in enumerate(order)]
    sources = spark.createDataFrame(catalogue, "s int, name string, source_size long, target double, groups int")
    # Turns of rows that are the same come in two steps, so no array is long.
    rows = rows.withColumn("many", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _TURNS)))).withColumn("turn", F.explode(F.sequence(F.col("many") * _TURNS, F.least(F.col("n") - 1, F.col("many") * _TURNS + _TURNS - 1))))
    open_ = rows.join(small_side(sources, len(catalogue), 128), F.col("source").eqNullSafe(F.col("name")))
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    unit = F.xxhash64("key", "text_hash", "turn", F.lit(seed))
    open_ = open_.select("s", *same, "turn", "source_size", "target", "groups", copies.alias("copies"), unit.alias("unit"), F.pmod(F.xxhash64("key", "text_hash", "turn", F.lit(seed + 1)), F.col("groups")).cast("int").alias("node"))
    open_ = open_.withColumn("whole", F.floor("copies")).withColumn("part", F.col("copies") - F.col("whole")).drop("copies")
    deepest = max((c[4] for c in catalogue), default=1)
    level, done = 0, None
    while True:
        fields = T.StructType([*open_.schema.fields, T.StructField("open", T.BooleanType())])
        met = checkpoint(open_.groupBy("s", "node").applyInArrow(meeting(seed * 1009 + level, level), fields))
        settled = met.filter("NOT open")
        done = settled if done is None else done.union(settled)
        if nodes_at(deepest, level) == 1:
            break
        level += 1
        open_ = met.filter("open").drop("open").withColumn("node", F.floor(F.col("node") / FAN_IN).cast("int"))
    return done.select("key", "source", "text_hash", "turn", "size", "source_size", "target", (F.col("whole") + F.col("part")).cast("long").alias("copies"))


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = 17, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """key, size, source_size, target, copies and taken of each row."""
    out = plan(docs, weights, most, seed, text, key, source)
    return out.select(F.col("key").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def resample(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = 17, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The documents as often as the mix takes them.

    Rows without words stay out. A row is found by key and text; of rows that are the
    same in key, source and text, each is given a turn, in the order of their other
    columns, and gets the copies of its turn. Only those rows are numbered.
    """
    rows = checkpoint(plan(docs, weights, most, seed, text, key, source))
    names, taken = {}, list(docs.columns)
    for c in ("key", "source", "hash", "turn", "copies"):
        names[c] = unused(f"mix_{c}", taken)
        taken.append(names[c])
    same = [names["key"], names["source"], names["hash"]]
    rows = rows.select(F.col("key").alias(names["key"]), F.col("source").alias(names["source"]), F.col("text_hash").alias(names["hash"]), F.col("turn").alias(names["turn"]), F.col("copies").alias(names["copies"]))
    own = docs.withColumns({names["key"]: F.col(f"`{key}`").cast("long"), names["source"]: F.col(f"`{source}`").cast("string"), names["hash"]: F.xxhash64(F.col(f"`{text}`"))})
    equal = lambda a, b, on: functools.reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in on])
    twins = checkpoint(rows.filter(F.col(names["turn"]) == 1).select(*same))
    taken_ = rows.filter(F.col(names["copies"]) > 0)
    once = taken_
    if twins.limit(1).count():
        once = taken_.join(twins, equal(taken_, twins, same), "left_anti")
    out = own.join(once, equal(own, once, same)).select(*[own[c] for c in docs.columns], once[names["copies"]])
    if once is not taken_:
        order = Window.partitionBy(*same).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
        numbered = own.join(twins, equal(own, twins, same), "left_semi").withColumn(names["turn"], (F.row_number().over(order) - 1).cast("long"))
        by = [*same, names["turn"]]
        out = out.union(numbered.join(taken_, equal(numbered, taken_, by)).select(*[numbered[c] for c in docs.columns], taken_[names["copies"]]))
    again = F.explode(F.sequence(F.lit(1), F.col(names["copies"]).cast("int")))
    return out.withColumn(names["turn"], again).select(*[f"`{c}`" for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
