"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; a boundary is a position whose hash has
all bits of a mask clear. Chunking is normalised: before the normal size a mask
with more bits applies, after it one with fewer, so lengths gather around the
normal size while boundaries still depend on content alone and survive shifts.
A fingerprint is the set of chunk digests with their lengths; likeness is the
length of the shared chunks over the length of the smaller set (containment).

The gear hash of all positions comes from five doubling steps over the whole
slice (a hash of 32 bits depends on the last 32 bytes only).

Each text needs the one that follows it. Rows are dealt into ranges of (key, text
hash) of about equal numbers of characters; a range is sorted and read as a stream,
with one row of look-ahead, so its size isn't bounded by a task's memory, and the
number of ranges has a fixed bound that keeps their limits small on the driver.

Edge cases: null text counts as empty, has the empty fingerprint and likeness 1
to another empty one, else 0; equal texts have equal fingerprints; documents
with equal ids follow each other in the order of their texts' hashes, so they can
lie in several ranges; a null id counts as smaller than all; a table of one row
follows itself; repeated rows follow each other; a text of any length is chunked
whole in one task; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import mix, powers, prepare, slices, table

MIN_CHUNK, NORMAL_CHUNK, MAX_CHUNK = 32, 64, 256
STRICT, LOOSE = np.uint32(0xFE000000), np.uint32(0xF0000000)  # 7 and 4 bits: the top ones see all 32 bytes
#: Characters of a range, and the least and most number of ranges (beyond it they grow).
RANGE_CHARS, LEAST_RANGES, MOST_RANGES = 8 << 20, 64, 20_000
#: Cells of the key that are counted for each range, so as to cut ranges where characters are.
CELLS = 4
LOWEST = -(1 << 63)


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    return np.random.default_rng(4099).integers(0, 1 << 32, 256, dtype=np.uint32)


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return np.random.default_rng(4111).integers(1, 1 << 63, 256, dtype=np.uint64)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i - j]] << j for j below 32, modulo 2^32."""
    h = gear()[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cuts(strict: list[int], loose: list[int], start: int, end: int, at: list[int]) -> list[int]:
    """Chunk ends within start..end; ``at`` holds how far the boundary lists have been read."""
    s, l = at
    n_strict, n_loose = len(strict), len(loose)
    out = []
    while end - start > MIN_CHUNK:
        low, normal, high = start + MIN_CHUNK, start + NORMAL_CHUNK, min(start + MAX_CHUNK, end)
        while s < n_strict and strict[s] < low:
            s += 1
        if s < n_strict and strict[s] < min(normal, high):
            cut = strict[s]
        else:
            while l < n_loose and loose[l] < normal:
                l += 1
            cut = loose[l] if l < n_loose and loose[l] < high else high
        out.append(cut)
        start = cut
    if start < end:
        out.append(end)
    at[:] = s, l
    return out


def fingerprints(texts: list[bytes]) -> list[dict[int, int]]:
    """Digest -> length of the chunks of each text (each distinct chunk once)."""
    out: list[dict[int, int]] = []
    k = 0
    while k < len(texts):  # slices bound the arrays
        stop, size = k, 0
        while stop < len(texts) and (stop == k or size + len(texts[stop]) <= 1 << 20):
            size += len(texts[stop])
            stop += 1
        data = np.frombuffer(b"".join(texts[k:stop]), np.uint8)
        if not len(data):
            out.extend({} for _ in range(stop - k))
            k = stop
            continue
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts[k:stop]])))
        h = gear_hash(data)
        # Only bytes of the same text count: near its start a text's hash would see the text before; such positions are below MIN_CHUNK.
        loose = np.flatnonzero((h & LOOSE) == 0) + 1
        strict = loose[(h[loose - 1] & STRICT) == 0].tolist()
        loose = loose.tolist()
        at, ends, firsts = [0, 0], [], [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            ends += cuts(strict, loose, a, b, at)
            firsts.append(len(ends))
        ends_ = np.array(ends, np.int64)
        first = np.array(firsts)
        starts = np.concatenate(([0], ends_[:-1]))  # texts lie side by side
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_values()[data] * powers(len(data)), out=sums[1:])
        length = ends_ - starts
        digest = mix((sums[ends_] - sums[starts]) * powers(len(data), True)[starts] + length.astype(np.uint64)).tolist()
        length = length.tolist()
        out.extend(dict(zip(digest[a:b], length[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist()))
        k = stop
    return out


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Length of the shared chunks over that of the smaller set; two empty sets are alike."""
    if not a or not b:
        return float(not a and not b)
    return sum([a[x] for x in a.keys() & b.keys()]) / min(sum(a.values()), sum(b.values()))


def as_text(print_: dict[int, int]) -> str:
    """Base64 of sorted (digest, length) records."""
    rec = np.empty(len(print_), np.dtype([("d", "<u8"), ("n", "<u2")]))
    rec["d"], rec["n"] = list(print_.keys()), list(print_.values())
    rec.sort(order="d")
    return base64.b64encode(rec.tobytes()).decode()


def edited(text: str, following: str) -> str:
    """The last third replaced by as many first code points of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compare(texts: list[str]) -> list[tuple[str, str, str, float, float]]:
    """For each text but the last: digest of the edited text, both fingerprints, likeness to edited and next."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    raw = [t.encode("utf-8", "surrogatepass") for t in changed]
    own = fingerprints([t.encode("utf-8", "surrogatepass") for t in texts])
    other = fingerprints(raw)
    return [(hashlib.sha256(r).hexdigest(), as_text(a), as_text(e), likeness(a, e), likeness(a, b)) for r, a, b, e in zip(raw, own, own[1:], other)]


def limits(cells: list[tuple[int, int, int, int]], wanted: int) -> list[tuple[int, int]]:
    """Lower limits (key, text hash) of ranges after the first, from (lowest key, highest key, rows, characters) of cells in order.

    A cell that is a single key and too large for a range is cut by text hash.
    """
    total = sum(c[3] for c in cells)
    target = max(1, -(-total // max(1, wanted)))
    out, filled = [], 0
    for low, high, _, chars in cells:
        if filled and filled + chars > target:
            out.append((low, LOWEST))
            filled = 0
        if low == high and chars > target:
            parts = -(-chars // target)
            out += [(low, LOWEST + (j << 64) // parts) for j in range(1, parts)]
            chars = chars // parts
        filled += chars
    return out


def range_numbers(keys: np.ndarray, hashes: np.ndarray, at: list[tuple[int, int]]) -> np.ndarray:
    """How many limits are at or below each (key, hash)."""
    key_at = np.array([k for k, _ in at], np.int64)
    hash_at = np.array([h for _, h in at], np.int64)
    out = np.searchsorted(key_at, keys, "left")
    same = np.flatnonzero(np.searchsorted(key_at, keys, "right") > out)  # rows whose key is a limit's
    for k in np.unique(keys[same]).tolist():
        own = same[keys[same] == k]
        out[own] += np.searchsorted(hash_at[key_at == k], hashes[own], "right")
    return out


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text, of its edited form, and the likeness to that and to the next text.

    The next text is that of the next smaller key; after the smallest comes the
    largest. The first row of each range also goes, as a guest, to the range before
    it, so each range finds all its neighbours and the text moves once.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = F.col(f"`{text}`")
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LOWEST)).alias("key"), F.col(f"`{key}`").isNull().alias("none"), F.coalesce(own, F.lit("")).alias("text"), F.xxhash64(F.coalesce(own, F.lit(""))).alias("hash"))
    chars = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    wanted = min(MOST_RANGES, max(LEAST_RANGES, -(-chars // RANGE_CHARS)))
    # Quantiles of rows cut the key into cells; their characters are counted, and ranges made of them.
    count = wanted * CELLS
    cut = sorted(set(map(int, rows.approxQuantile("key", [i / count for i in range(1, count)], max(0.2 / count, 1e-5)))))
    cell = range_of(cut)
    found = rows.groupBy(cell("key").alias("c")).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).orderBy("c").collect()
    at = limits([(r["low"], r["high"], r["n"], r["chars"]) for r in found], wanted)
    home = F.pandas_udf(lambda k, h: pd.Series(range_numbers(k.to_numpy(), h.to_numpy(), at)), "int")
    placed = rows.withColumn("home", home("key", "hash"))
    first = {r["home"]: (r["top"]["key"], r["top"]["hash"]) for r in placed.groupBy("home").agg(F.max(F.struct("key", "hash")).alias("top")).collect()}
    present = sorted(first)
    # After the last row of a range comes the first (largest) of the next lower one; after the lowest range the highest.
    before = {r: present[(i + 1) % len(present)] for i, r in enumerate(present)}
    tops = np.full((len(at) + 1, 2), LOWEST, np.int64)
    host = np.full(len(at) + 1, -1, np.int64)
    for r in present:
        tops[r], host[r] = first[r], before[r]

    def homes(home_: pd.Series, keys: pd.Series, hashes: pd.Series) -> pd.Series:
        h = home_.to_numpy()
        top = (keys.to_numpy() == tops[h, 0]) & (hashes.to_numpy() == tops[h, 1])
        return pd.Series([[a, -1 - b] if t else [a] for a, b, t in zip(h.tolist(), host[h].tolist(), top.tolist())])

    # A guest is marked by a negative range.
    dealt = placed.withColumn("to", F.explode(F.pandas_udf(homes, "array<int>")("home", "key", "hash"))).withColumn("guest", F.expr("to < 0")).withColumn("to", F.expr("IF(to < 0, -1 - to, to)"))
    parts = max(wanted, len(at) + 1)
    dealt = dealt.select("to", "guest", "key", "hash", "none", "text").repartitionById(parts, F.col("to")).sortWithinPartitions("to", "guest", F.col("key").desc(), F.col("hash").desc())
    schema = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(stream, schema).withColumnRenamed("key", key)


def range_of(cut: list[int]):
    """The cell of a key: how many cuts are at or below it. A cut's own key begins a cell, and ends it if it is cut next to."""
    edges = np.unique(np.array([e for c in cut for e in (c, min(c, (1 << 63) - 2) + 1)], np.int64))
    return F.pandas_udf(lambda k: pd.Series(np.searchsorted(edges, k.to_numpy(), "right")), "int")


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of range, hosts before guests; each host is compared with the row after it."""
    held: tuple | None = None  # range, key or None, text of the last host
    for batch in batches:
        for part, _, _ in slices(batch):
            to, guest, key, none, text = (part.column(c).to_pylist() for c in ("to", "guest", "key", "none", "text"))
            runs: list[tuple[list, list]] = []  # ids and texts that follow each other, the last text without an id
            ids, line = ([held[1]], [held[2]]) if held else ([], [])
            now = held[0] if held else None
            for r, g, k, n, t in zip(to, guest, key, none, text):
                if r != now and not g:
                    ids, line, now = [], [], r
                if now is None:  # further guests of a range that is done
                    continue
                line.append(t)
                if g:
                    runs.append((ids, line))
                    ids, line, now = [], [], None
                else:
                    ids.append(None if n else k)
            held = (now, ids[-1], line[-1]) if line else None
            if len(line) > 1:
                runs.append((ids[:-1], line))
            yield from (_compared(ids, line) for ids, line in runs)


def _compared(ids: list, line: list[str]) -> pa.RecordBatch:
    sha, own, other, near_edited, near_next = zip(*compare(line))
    cols = [pa.array(ids, pa.int64()), pa.array([len(t) for t in line[:-1]], pa.int64()), *[pa.array(x, pa.string()) for x in (sha, own, other)], *[pa.array(x, pa.float64()) for x in (near_edited, near_next)]]
    return pa.RecordBatch.from_arrays(cols, names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def op8_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next."""
    return with_next(table(spark, sf_dir, "documents"))
