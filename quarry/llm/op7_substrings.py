"""Removal of long passages that repeat across documents, by fixed-block anchors.

Every document's non-overlapping blocks of ``window // 2`` words form the index;
every rolling window of that width probes it. Any passage of ``window`` words
holds at least one whole reference block of the document it comes from, so no
repeat escapes. A hit is extended to every ``window``-word passage around it;
the owner of a passage is the smallest document that holds it, and adjacent
owned passages fuse into maximal exact repeats, which are removed.

Documents are dealt into groups by a hash of their key, and one exchange of the
text serves all three passes over it. What travels besides is packed: each group
sends every distinct anchor once to the bucket that its hash names, as 32 bits,
so a passage held by any share of all documents costs a group one entry. There is a
bucket for every GROUPS_A_BUCKET groups, which bounds the pieces that a group cuts its
anchors into. Anchor hits may be false, never missed. Owners are found by 128 bits of
a passage; back in its group a passage is known by 64 bits made of them, among the
passages of that group alone.

Edge cases: null text has no words; documents under ``window`` words lose
nothing; a null key counts as larger than all others; rows with equal keys don't
remove from each other, so of tied rows all keep the passage; a text of any length
is in memory of one task; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import find_words, hash_words, mix, prepare, rolling, slices, table

#: Characters of text in a group, and the least number of groups.
GROUP_CHARS, MIN_GROUPS, GROUPS_A_BUCKET = 8 << 20, 64, 8
NEVER = np.int64(0x7FFFFFFFFFFFFFFF)


def _words(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and the first word of each row; arrays as long as the text are only made for a slice."""
    hashes, firsts, n = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for _, data, offsets in slices(group):
        starts, ends, first = find_words(data, offsets)
        hashes.append(hash_words(data, starts, ends))
        firsts.append(first[1:] + n)
        n += len(starts)
    return np.concatenate(hashes), np.concatenate(firsts)


def _keys(group: pa.Table) -> np.ndarray:
    return group.column("key").cast(pa.int64()).fill_null(int(NEVER)).to_numpy()


def _inside(firsts: np.ndarray, width: int) -> np.ndarray:
    """Word indexes at which a window of ``width`` words fits in its row."""
    counts = np.maximum(np.diff(firsts) - width + 1, 0)
    base = np.repeat(firsts[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return base + np.arange(int(counts.sum()))


def _anchors(words: np.ndarray, firsts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each probe, its word index, and whether it is a reference block.

    Documents shorter than the window hold no passage and take no part.
    """
    width = window // 2
    long_ = np.diff(firsts) >= window
    at = _inside(firsts, width)
    row = np.searchsorted(firsts, at, "right") - 1
    keep = long_[row]
    at, row = at[keep], row[keep]
    return rolling(words, width, 29)[at] if len(at) else np.zeros(0, np.uint64), at, (at - firsts[row]) % width == 0


def _cut(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, and where each bucket's part starts (buckets + 1)."""
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _pack_sorted(x: np.ndarray) -> bytes:
    """Ascending 32-bit values as differences, byte by byte: the high bytes, mostly 0, compress away."""
    gaps = np.diff(x, prepend=np.uint32(0)).astype("<u4")
    return gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack_sorted(raw: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.uint32)


def _in_sorted(values: np.ndarray, table_: np.ndarray) -> np.ndarray:
    if not len(table_):
        return np.zeros(len(values), bool)
    return table_[np.minimum(np.searchsorted(table_, values), len(table_) - 1)] == values


def _pair_hash(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return rolling(words, window, 31)[at], rolling(words, window, 37)[at]


def repeats(docs: DataFrame, window: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, n_removed, kept (words joined by one space), removed (word ranges, end exclusive)."""
    prepare(docs.sparkSession)
    width = window // 2
    chars = docs.agg(F.sum(F.length(text)).alias("n")).first()["n"] or 0
    groups = max(MIN_GROUPS, -(-chars // GROUP_CHARS))
    buckets = max(MIN_GROUPS, -(-groups // GROUPS_A_BUCKET))
    dealt = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key), F.length(text)), F.lit(groups)).cast("int").alias("g")).repartition("g")

    def anchors(group: pa.Table) -> pa.Table:
        g = group.column("g")[0].as_py()
        words, firsts = _words(group)
        hashes, _, reference = _anchors(words, firsts, window)
        blocks = np.unique(hashes[reference])
        hashes.sort()
        fresh = np.concatenate(([True], hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        several = np.diff(np.append(first, len(hashes))) > 1
        probes = hashes[first]
        rows = {"bucket": [], "g": [], "probes": [], "several": [], "blocks": []}
        order, cut = _cut(probes, buckets)
        order_b, cut_b = _cut(blocks, buckets)
        for b in np.flatnonzero(np.diff(cut)).tolist():
            own = order[cut[b] : cut[b + 1]]
            rows["bucket"].append(b)
            rows["g"].append(g)
            low = probes[own].astype(np.uint32)
            turn = np.argsort(low, kind="stable")
            rows["probes"].append(_pack_sorted(low[turn]))
            rows["several"].append(_pack(np.packbits(several[own][turn])))
            rows["blocks"].append(_pack(blocks[order_b[cut_b[b] : cut_b[b + 1]]].astype(np.uint32)))
        return pa.table(rows, schema=pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("probes", pa.binary()), ("several", pa.binary()), ("blocks", pa.binary())]))

    def meet(bucket: pa.Table) -> pa.Table:
        """The anchors of a bucket that are a reference block and stand in more than one place."""
        probes = [_unpack_sorted(x) for x in bucket.column("probes").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(p)] for x, p in zip(bucket.column("several").to_pylist(), probes)]
        blocks = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in bucket.column("blocks").to_pylist()]))
        all_, often = np.concatenate(probes), np.concatenate(several)
        hit = _in_sorted(all_, blocks)
        value, back = np.unique(all_[hit], return_inverse=True)
        live = value[np.bincount(back, 1 + often[hit].astype(np.int64), len(value)) > 1]
        b, rows = bucket.column("bucket")[0].as_py(), {"g": [], "bucket": [], "live": []}
        for g, own in zip(bucket.column("g").to_pylist(), probes):
            mine = own[_in_sorted(own, live)]
            if len(mine):
                rows["g"].append(g)
                rows["bucket"].append(b)
                rows["live"].append(_pack(mine))
        return pa.table(rows, schema=pa.schema([("g", pa.int32()), ("bucket", pa.int32()), ("live", pa.binary())]))

    def candidates(words: np.ndarray, firsts: np.ndarray, live: pa.Table) -> np.ndarray:
        """Word indexes of the passages that hold a live anchor."""
        hashes, at, _ = _anchors(words, firsts, window)
        if not len(hashes) or not live.num_rows:
            return np.zeros(0, np.int64)
        # bucket and low bits together name an anchor
        known = np.sort(np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(x, np.uint32).astype(np.uint64) for b, x in zip(live.column("bucket").to_pylist(), live.column("live").to_pylist())]))
        name = (((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
        hit = at[_in_sorted(name, known)]
        mark = np.zeros(len(words) + 1, np.int64)  # passages from hit - (window - width) to hit
        np.add.at(mark, np.maximum(hit - (window - width), 0), 1)
        np.add.at(mark, hit + 1, -1)
        near = np.cumsum(mark)[:-1] > 0
        inside = _inside(firsts, window)
        return inside[near[inside]]

    def passages(group: pa.Table, live: pa.Table) -> pa.Table:
        rows = {"bucket": [], "g": [], "a": [], "b": [], "owner": [], "several": []}
        if group.num_rows and live.num_rows:
            g, keys = group.column("g")[0].as_py(), _keys(group)
            words, firsts = _words(group)
            at = candidates(words, firsts, live)
            a, b = _pair_hash(words, at, window)
            key_ = keys[np.searchsorted(firsts, at, "right") - 1] if len(at) else np.zeros(0, np.int64)
            order = np.lexsort((key_, b, a))  # the smallest key of a passage first
            a, b, key_ = a[order], b[order], key_[order]
            fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
            first = np.flatnonzero(fresh)
            several = (np.diff(np.append(first, len(a))) > 1).astype(np.uint8)
            a, b, key_ = a[fresh], b[fresh], key_[fresh]
            order, cut = _cut(a, buckets)
            for k in np.flatnonzero(np.diff(cut)).tolist():
                own = order[cut[k] : cut[k + 1]]
                for name, x in (("bucket", k), ("g", g), ("a", _pack(a[own])), ("b", _pack(b[own])), ("owner", _pack(key_[own])), ("several", _pack(several[own]))):
                    rows[name].append(x)
        return pa.table(rows, schema=pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("owner", pa.binary()), ("several", pa.binary())]))

    def owners(bucket: pa.Table) -> pa.Table:
        """To each group, the passages whose smallest holder isn't the group's own smallest, or that it holds more than once."""
        parts = {c: [np.frombuffer(x, np.int64 if c == "owner" else np.uint64) for x in bucket.column(c).to_pylist()] for c in ("a", "b", "owner")}
        a, b, owner = (np.concatenate(parts[c]) for c in ("a", "b", "owner"))
        part = np.repeat(np.arange(bucket.num_rows), [len(x) for x in parts["a"]])
        order = np.lexsort((owner, b, a))
        first = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
        lowest = np.empty(len(a), np.int64)
        lowest[order] = owner[order][np.flatnonzero(first)][np.cumsum(first) - 1]
        several = np.concatenate([np.frombuffer(x, np.uint8) for x in bucket.column("several").to_pylist()])
        useful = (lowest < owner) | (several > 0)
        name = mix(a) ^ b
        rows = {"g": [], "name": [], "owner": []}
        cut = np.searchsorted(part, np.arange(bucket.num_rows + 1))
        for k, g in enumerate(bucket.column("g").to_pylist()):
            own = np.flatnonzero(useful[cut[k] : cut[k + 1]]) + cut[k]
            if len(own):
                for column, x in (("g", g), ("name", _pack(name[own])), ("owner", _pack(lowest[own]))):
                    rows[column].append(x)
        return pa.table(rows, schema=pa.schema([("g", pa.int32()), ("name", pa.binary()), ("owner", pa.binary())]))

    def remove(group: pa.Table, owned: pa.Table) -> pa.Table:
        words, firsts = _words(group)
        keys = _keys(group)
        gone = np.zeros(len(words) + 1, np.int64)
        if owned.num_rows and len(words) >= window:
            name = np.concatenate([np.frombuffer(x, np.uint64) for x in owned.column("name").to_pylist()])
            owner = np.concatenate([np.frombuffer(x, np.int64) for x in owned.column("owner").to_pylist()])
            order = np.argsort(name)
            name, owner = name[order], owner[order]
            at = _inside(firsts, window)
            wa, wb = _pair_hash(words, at, window)
            mine = mix(wa) ^ wb
            place = np.minimum(np.searchsorted(name, mine), len(name) - 1)
            row = np.searchsorted(firsts, at, "right") - 1
            hit = at[(name[place] == mine) & (owner[place] < keys[row])] if len(name) else at[:0]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + window, -1)
        gone = np.cumsum(gone)[:-1] > 0
        kept, removed, ranges = [], [], []
        for k, text_ in enumerate(group.column("text")):
            own = (text_.as_py() or "").encode().split()
            drop = gone[firsts[k] : firsts[k + 1]]
            n = int(drop.sum())
            edge = np.flatnonzero(np.diff(np.concatenate(([0], drop.astype(np.int8), [0])))) if n else np.zeros(0, np.int64)
            kept.append(b" ".join([w for w, d in zip(own, drop.tolist()) if not d] if n else own).decode())
            removed.append(n)
            ranges.append([{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())])
        return pa.table({"key": group.column("key"), "n_words": pa.array(np.diff(firsts), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()), "removed": pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    by_g = dealt.groupBy("g")
    live = by_g.applyInArrow(anchors, "bucket int, g int, probes binary, several binary, blocks binary").groupBy("bucket").applyInArrow(meet, "g int, bucket int, live binary")
    held = by_g.cogroup(live.groupBy("g")).applyInArrow(passages, "bucket int, g int, a binary, b binary, owner binary, several binary")
    owned = held.groupBy("bucket").applyInArrow(owners, "g int, name binary, owner binary")
    out = by_g.cogroup(owned.groupBy("g")).applyInArrow(remove, "key long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>")
    return out.withColumnRenamed("key", key)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; windows of 50 words."""
    out = repeats(table(spark, sf_dir, "documents"), 50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same rows in SQL: every window, its smallest holder, the words that others' windows cover.
SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM w, unnest(range(1, len(ws) - 48)) r(i) WHERE len(ws) >= 50
), f AS (
  SELECT h, min(doc_id) AS owner FROM p GROUP BY h
), g AS (
  SELECT DISTINCT p.doc_id, unnest(range(p.i, p.i + 50)) AS i FROM p JOIN f USING (h) WHERE f.owner < p.doc_id
), t AS (
  SELECT w.doc_id, r.i, w.ws[r.i] AS word, g.i IS NOT NULL AS gone FROM w, unnest(range(1, len(ws) + 1)) r(i) LEFT JOIN g ON g.doc_id = w.doc_id AND g.i = r.i
), k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM t GROUP BY doc_id
)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
