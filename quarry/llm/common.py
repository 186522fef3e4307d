"""Shared plumbing: table access, Arrow batches as byte arrays, word hashing.

A *word* is a maximal run of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``.
The separators are single bytes in UTF-8, so words are found on bytes without
decoding. All hashes are 64-bit with wrap-around arithmetic.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one kernel call handles (a longer text is one call).
SLICE_BYTES = 1 << 20
#: Python workers outlive their tasks: freed arrays must go back to the system, not stay with the worker.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(2 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: A side is broadcast only when its measured size stays below this.
BROADCAST_BYTES = 16 << 20

_M = np.uint64(0x9E3779B97F4A7C15)
_M_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and free memory, and give checkpoints a folder.

    The workers' environment is the session's: workers that start later for other
    queries get the same path and allocator settings. A setting that is there stays.
    """
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parents[2])
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    for name, value in WORKER_MEMORY.items():
        sc.environment.setdefault(name, value)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset only a local master gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or f"{tempfile.gettempdir()}/checkpoints"


def settled(df: DataFrame, rows: int = 50_000) -> tuple[DataFrame, int]:
    """A checkpoint and its number of rows, read back by a task for every so many rows: few rows don't go on as many files."""
    out = checkpoint(df)
    n = out.count()
    return out.coalesce(max(1, -(-n // rows))), n


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores appended until no column has it (whatever the case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark a side for broadcast only if its counted size is within the bound."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def smallest_hashes(rows: DataFrame, hash_: str, wanted: int, groups: str | None = None) -> DataFrame:
    """Rows that hold the ``wanted`` smallest hashes (of each group) and about three times as many more.

    Counts set the share of hashes that is let through, so what is passed on doesn't
    grow with the table. Hashes that many rows share may leave fewer than ``wanted``.
    """
    share = F.least(F.lit(1.0), F.lit(4.0 * wanted + 40.0) / F.col("__n"))
    part = F.pmod(F.col(hash_), F.lit(1 << 40)) / F.lit(float(1 << 40))
    if groups is None:
        n = rows.count()
        return rows.filter(part < min(1.0, (4.0 * wanted + 40.0) / max(n, 1)))
    counts = checkpoint(rows.groupBy(F.col(groups).alias("__g")).agg(F.count("*").alias("__n")))
    return rows.join(small_side(counts, counts.count(), 64), F.col(groups) == F.col("__g")).filter(part < share).drop("__g", "__n")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """M^0 .. M^(n-1) modulo 2^64, or those of the inverse of M."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        size = max(1024, 1 << (max(n, 1) - 1).bit_length())
        have = np.full(size, _M_INV if inverse else _M, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 8 << 20:
            _powers[inverse] = have
    return have[:n]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0])
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = SLICE_BYTES) -> Iterator:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text each."""
    data, offsets = text_bytes(batch.column(column))
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and the first word of each row (n+1 long)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    fresh = np.empty(n + 1, bool)  # a run that touches the byte before ends there
    fresh[1:n] = ~inside[:-1]
    fresh[0] = fresh[n] = True
    fresh[offsets] = True
    starts = np.flatnonzero(inside & fresh[:n])
    stop = np.empty(n, bool)
    stop[:-1] = ~inside[1:]
    stop[-1] = True
    bounds = offsets[offsets > 0]
    stop[bounds - 1] = True
    ends = np.flatnonzero(inside & stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums of byte x power."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(len(data), True)[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def rolling(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of each ``width`` consecutive word hashes (windows may cross rows)."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    seeded = mix(words + np.uint64(salt)) if salt else words
    np.cumsum(seeded * powers(len(words)), out=sums[1:])
    raw = (sums[width:] - sums[:-width]) * powers(len(words), True)[: len(words) - width + 1]
    return mix(raw + np.uint64(width))


def row_of(firsts: np.ndarray) -> np.ndarray:
    """Row of each word, from the first-word index of each row."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def held_out(doc_id="doc_id"):
    """Rows that no model may learn from: crc32 of the id as text divides by 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def schema_of(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    """The fields of some columns, then those of a DDL string."""
    return T.StructType([*df.select(*[F.col(f"`{c}`") for c in columns]).schema.fields, *T.StructType.fromDDL(more).fields])
