"""Near duplicates by one-permutation MinHash, banded buckets and star edges.

A document's set holds the hashes of its distinct runs of ``width`` lower-cased
words (all its words as one run if it has fewer). One pass over the text sorts
each set once: the top bits of a hash name its bin, so the first hash of a bin
is the bin's minimum. Empty bins are filled by optimal densification: a bin
tries other bins in an order that depends on the bin alone until it meets one
that was filled. Bands of consecutive bins are the bucket keys.

Documents with equal sets become one class first, so groups of exact copies of
any size cost one row. A class is a node of its own, named by a number; ids come
in only at the end, so rows that share an id but not a text keep all their links.
Within a bucket every class is compared with one centre only (a star), which
bounds pairs by the number of bucket entries. The centre is the member that
shares most buckets, by that the best connected one. Where the confirmed stars
leave a bucket with several components, its members are compared in blocks, so no
candidate pair that could join two components goes untested; members that are
already joined don't meet again. All links are confirmed on full sets.

Edge cases: null or blank text has the empty set and links with nothing, its
component is its own id; a null id is larger than all others, so a component has a
null id only if all its rows have; rows that repeat an id are documents of their
own, linked by their texts and not by the id; ties between centres can't change
the components; repeated rows get equal rows; a text of any length is one set in
memory of one task; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import checkpoint, find_words, hash_words, lower_ascii, mix, prepare, rolling, row_of, schema_of, settled, slices, small_side, table, unused

BINS, ROWS = 128, 4
#: Members of a bucket compared at once; rows of a group that buckets are dealt into, and the least number of groups.
BLOCK, GROUP_ROWS, MIN_GROUPS = 1500, 10_000, 1021
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each row; their row offsets; words of each row."""
    data = lower_ascii(data)
    starts, ends, firsts = find_words(data, offsets)
    words = hash_words(data, starts, ends)
    n_words = np.diff(firsts)
    grams = rolling(words, width, 11)
    counts = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    out = np.empty(int(counts.sum()), np.uint64)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    size = np.zeros(len(counts), np.int64)
    at = 0
    for k in np.flatnonzero(counts).tolist():
        f, n = firsts[k], n_words[k]
        if n >= width:
            own = np.sort(grams[f : f + n - width + 1])
            fresh = np.concatenate(([True], own[1:] != own[:-1]))
            own = own[fresh]
        else:
            own = rolling(words[f : f + n], int(n), 11)
        out[at : at + len(own)] = own
        at += len(own)
        size[k] = len(own)
    del bounds
    return out[:at], np.concatenate(([0], np.cumsum(size))), n_words


@lru_cache(maxsize=4)
def probe_order(bins: int, tries: int = 64) -> np.ndarray:
    """The bins that an empty bin tries, one row a bin."""
    return np.random.default_rng(97).integers(0, bins, (bins, tries))


def signatures(hashes: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation signatures with optimal densification, a row for each set."""
    n = len(bounds) - 1
    sig = np.full(n * bins, EMPTY, np.uint64)
    if len(hashes):
        cell = row_of(bounds) * bins + (hashes >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64) % bins
        first = np.concatenate(([True], cell[1:] != cell[:-1]))
        sig[cell[first]] = hashes[first]
    sig = sig.reshape(n, bins)
    filled = sig != EMPTY
    some = filled.any(axis=1)
    probes = probe_order(bins)
    row, col = np.nonzero(~filled & some[:, None])
    out = sig.copy()
    for t in range(probes.shape[1]):
        source = probes[col, t]
        ok = filled[row, source]
        out[row[ok], col[ok]] = sig[row[ok], source[ok]]
        row, col = row[~ok], col[~ok]
        if not len(row):
            break
    while len(row):  # a set of few shingles: walk on to the next filled bin
        step = np.zeros(len(row), np.int64)
        source = probes[col, -1]
        open_ = np.arange(len(row))
        while len(open_):
            ok = filled[row[open_], (source[open_] + step[open_]) % bins]
            step[open_[~ok]] += 1
            open_ = open_[~ok]
        out[row, col] = sig[row, (source + step) % bins]
        break
    return out


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A bucket key for each band of ``rows`` bins, as int64."""
    n, bins = sig.shape
    count = bins // rows
    cut = sig[:, : count * rows].reshape(n, count, rows)
    key = np.broadcast_to(mix(np.arange(1, count + 1, dtype=np.uint64)), (n, count)).copy()
    for r in range(rows):
        key = mix(key ^ cut[:, :, r])
    return key.view(np.int64)


def sketch(docs: DataFrame, width: int, bins: int = BINS, band_rows: int = ROWS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc, text_hash, n_shingles, set_a and set_b (digest of the set), bands (null for the empty set)."""
    rows = named(docs, text, key)
    schema = schema_of(rows, ["doc", "text_hash"], "n_shingles long, set_a long, set_b long, bands array<long>")
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch):
                hashes, bounds, _ = shingle_sets(data, offsets, width)
                size = np.diff(bounds)
                keys = bands(signatures(hashes, bounds, bins), band_rows)
                values = pa.array(keys.ravel(), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * keys.shape[1], pa.int32(), mask=np.append(size == 0, False)), values)
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("text_hash"), pa.array(size, pa.int64()), *digests(hashes, bounds), lists], names=["doc", "text_hash", "n_shingles", "set_a", "set_b", "bands"])

    return rows.mapInArrow(run, schema)


def named(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc, text and text_hash: what tells rows with the same id apart."""
    return docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"))


def digests(hashes: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """128 bits of each set: sums of independent mixes, whatever the order of the members."""
    sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64))) for salt in (0x51ED2701, 0xA3C59AC2B7)]
    return [pa.array((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64)) for s in sums]


def sets(rows: DataFrame, width: int) -> DataFrame:
    """set_a, set_b, n_shingles and the set as a sorted array of longs, of rows with ``text``."""
    schema = T.StructType.fromDDL("set_a long, set_b long, n_shingles long, grams array<long>")
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in slices(batch):
                hashes, bounds, _ = shingle_sets(data, offsets, width)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*digests(hashes, bounds), pa.array(np.diff(bounds), pa.int64()), lists], names=["set_a", "set_b", "n_shingles", "grams"])

    return rows.select("text").mapInArrow(run, schema)


def confirm(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) whose sets share enough: 100 x intersection >= percent x union."""
    # The member's set goes to the centre: a row for each pair, so a centre of any number of members is dealt with row by row.
    with_b = pairs.join(grams.select(F.col("node").alias("b"), F.col("grams").alias("grams_b")), "b")
    with_a = with_b.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("grams_a")), "a")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return with_a.select("a", "b", "n_a", "n_b", shared.alias("shared")).filter(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def within_buckets(placed: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """Confirmed pairs (a, b) of bucket members with different roots.

    A bucket's members are cut into chunks: of one root, if it has BLOCK members in
    the bucket, else of several small ones. Chunks meet pairwise, in tasks of their
    own, as blocks of a matrix product. Chunks of the same root don't meet, so a set
    travels once for each chunk that may hold something new to it.
    """
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("g"))
    pool = sizes.groupBy("bucket").agg(F.sum(F.when(F.col("g") < BLOCK, F.col("g"))).alias("pool"))
    large = F.col("g") >= BLOCK
    dealt = placed.join(sizes, ["bucket", "root"]).join(pool, "bucket")
    part = F.when(large, F.pmod(F.xxhash64("node"), F.ceil(F.col("g") / BLOCK))).otherwise(F.pmod(F.xxhash64("root"), F.ceil(F.col("pool") / BLOCK)))
    dealt, _ = settled(dealt.select("bucket", "node", "n", "root", F.when(large, F.col("root")).otherwise(F.lit(-1)).alias("kin"), part.cast("int").alias("part")))
    chunks = dealt.select("bucket", "kin", "part").distinct()
    other = chunks.select("bucket", F.col("kin").alias("kin2"), F.col("part").alias("part2"))
    meets = (F.col("kin") != F.col("kin2")) | (F.col("kin") == -1)
    cells, _ = settled(chunks.join(other, "bucket").filter(meets))  # each pair in both directions
    low, mine = F.struct(F.col("kin2").alias("kin"), F.col("part2").alias("part")), F.struct("kin", "part")
    dealt = dealt.join(cells, ["bucket", "kin", "part"]).select("bucket", "node", "n", "root", F.least(low, mine).alias("i"), F.greatest(low, mine).alias("j"), (mine <= low).alias("mine"))
    groups = max(MIN_GROUPS, -(-dealt.count() // GROUP_ROWS))
    # 64 bits name a cell; cells that share a name only meet more than they need to.
    dealt = dealt.select(F.xxhash64("bucket", "i", "j").alias("cell"), (F.col("i") == F.col("j")).alias("alone"), "mine", "node", "n", "root")
    rows = dealt.join(grams, "node").withColumn("g", F.pmod("cell", F.lit(groups)))

    def compare(group: pa.Table) -> pa.Table:
        cell, alone, mine, node, root, n = (group.column(c).to_numpy() for c in ("cell", "alone", "mine", "node", "root", "n"))
        lists = group.column("grams").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        flat, bounds = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        order = np.argsort(cell, kind="stable")
        cut = np.append(np.flatnonzero(np.concatenate(([True], cell[order][1:] != cell[order][:-1]))), len(order))
        found = set()
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            own = order[lo:hi]
            pairs = _alike(flat, bounds, own, n[own].astype(np.float64), root[own], mine[own], not alone[own[0]], percent)
            found.update((min(a, b), max(a, b)) for a, b in zip(node[own[pairs[0]]].tolist(), node[own[pairs[1]]].tolist()))
        a, b = zip(*sorted(found)) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.select("g", "cell", "alone", "mine", "node", "n", "root", "grams").groupBy("g").applyInArrow(compare, "a long, b long").distinct()


def _alike(flat: np.ndarray, bounds: np.ndarray, own: np.ndarray, n: np.ndarray, root: np.ndarray, mine: np.ndarray, across: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs that share enough, with different roots (and of different chunks)."""
    size = (bounds[own + 1] - bounds[own]).astype(np.int64)
    at = np.repeat(bounds[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
    row = np.repeat(np.arange(len(own)), size)
    word, back, seen = np.unique(flat[at], return_inverse=True, return_counts=True)
    useful = seen[back] > 1  # what one member alone holds is in no intersection
    number = np.cumsum(seen > 1) - 1
    row, back = row[useful], number[back[useful]]
    shared = np.zeros((len(own), len(own)), np.float32)
    step = max(1, (8 << 20) // max(1, len(own)))  # words at once: the matrix stays within 32 MB
    turn = np.argsort(back, kind="stable")
    row, back = row[turn], back[turn]
    for first in range(0, int((seen > 1).sum()), step):
        lo, hi = np.searchsorted(back, (first, first + step))
        x = np.zeros((len(own), int(min(step, (seen > 1).sum() - first))), np.float32)
        x[row[lo:hi], back[lo:hi] - first] = 1
        shared += x @ x.T
    union = n[:, None] + n[None, :] - shared
    good = (100.0 * shared >= percent * union) & (root[:, None] != root[None, :])
    if across:
        good &= mine[:, None] != mine[None, :]
    return np.nonzero(np.triu(good, 1))


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable over edges (a, b), of nodes that have an edge.

    Hash-to-min with shortcuts: each round a node takes the smallest root next
    to it, then its root's root. Labels are broadcast while they are few.
    """
    both, _ = settled(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label, n = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        roots = small_side(label, n, 64)
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        # The smallest label near a node is also offered to the node's present root.
        offers = near.join(roots, "node").select("node", "root", F.least("near", "root").alias("to"))
        moved = offers.select(F.explode(F.array(F.struct("node", "to"), F.struct(F.col("root").alias("node"), "to"))).alias("o")).groupBy(F.col("o.node").alias("node")).agg(F.min("o.to").alias("to"))
        jump = roots.select(F.col("node").alias("to"), F.col("root").alias("next"))
        new, n = settled(moved.join(jump, "to", "left").join(roots, "node").select("node", F.least("to", "next").alias("root"), (F.least("to", "next") != F.col("root")).alias("moved")))
        label = new.select("node", "root")
        if not new.filter("moved").limit(1).count():
            return label


def rooted(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """node and root of all nodes; one without an edge is its own root."""
    return settled(nodes.join(label, "node", "left").select("node", F.coalesce("root", "node").alias("root")))[0]


def fitting(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose sizes allow the similarity."""
    return pairs.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).distinct()


def groups(docs: DataFrame, width: int = 5, percent: int = 80, bins: int = BINS, rows: int = ROWS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc, text_hash, n_shingles and ``best`` of each row: the doc and text_hash of its component's smallest row (null for the empty set)."""
    all_ = checkpoint(sketch(docs, width, bins, rows, text, key))
    full = all_.filter("n_shingles > 0")
    first = F.struct(F.col("doc").isNull().alias("none"), "doc", "text_hash")
    same = ["set_a", "set_b", "n_shingles"]
    # Numbers are unique within the checkpoint, and nothing else is asked of them.
    classes, _ = settled(full.groupBy(*same).agg(F.min(first).alias("first"), F.min_by("bands", first).alias("bands")).withColumn("node", F.monotonically_increasing_id()), 10_000)
    entries = classes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    crowd = entries.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    entries = entries.join(crowd, "bucket")
    popular = entries.groupBy("node").agg(F.sum("members").alias("degree"))
    # Hubs come first; ties go to the smaller number.
    entries = checkpoint(entries.join(popular, "node").select("bucket", "node", "n", (-F.col("degree")).alias("place")))
    centre = entries.groupBy("bucket").agg(F.min(F.struct("place", "node", "n")).alias("c")).select("bucket", F.col("c.node").alias("a"), F.col("c.n").alias("n_a"))
    stars = entries.join(centre, "bucket").filter("node <> a").select("a", "n_a", F.col("node").alias("b"), F.col("n").alias("n_b"))
    stars, _ = settled(fitting(stars, percent))
    members, count = settled(entries.select("node").distinct().join(classes.select("node", *same, F.col("first.doc").alias("rep"), F.col("first.text_hash").alias("rep_hash")), "node"))
    # A row of each class is read again for its set: the rows with the id and text of its first one.
    reps = members.select("rep", "rep_hash").distinct()
    texts = named(docs, text, key)
    chosen = texts.join(small_side(reps, count, 64), texts["doc"].eqNullSafe(reps["rep"]) & (texts["text_hash"] == reps["rep_hash"]), "left_semi")
    grams, _ = settled(sets(chosen, width).join(members.select("node", *same), same).select("node", "grams").dropDuplicates(["node"]), 5_000)
    links = checkpoint(confirm(stars, grams, percent))
    roots = rooted(members.select("node"), components(links))
    # Members of a bucket that the stars left in different components are compared within the bucket.
    placed = entries.select("bucket", "node", "n").join(roots, "node")
    split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    more, found = settled(within_buckets(settled(placed.join(split, "bucket"))[0], grams, percent))
    if found:  # links between components: these are the nodes of a smaller graph
        name = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        between = more.join(name("a"), "a").join(name("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).filter("a <> b")
        higher = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = roots.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    known = classes.select(*same, "first", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Most classes are components of their own; the smallest row of the others travels to their classes.
    several, count = settled(known.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("classes")).filter("classes > 1").select("root", "best"))
    known = known.join(small_side(several, count, 64), "root", "left").select(*same, F.coalesce("best", "first").alias("best"))
    return all_.join(known, same, "left").select("doc", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("best")).alias("best"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bins: int = BINS, rows: int = ROWS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles and component_id (smallest key reachable) of each row."""
    out = groups(docs, width, percent, bins, rows, text, key)
    return out.select(F.col("doc").alias(key), "n_shingles", F.when(F.col("best").isNull(), F.col("doc")).otherwise(F.col("best.doc")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents less all but one row of each component; rows with the empty set stay.

    The row with the smallest key stays (among equal keys: the smallest text hash).
    """
    rows = groups(docs, width, percent, text=text, key=key).filter("best IS NOT NULL")
    stays = F.col("doc").eqNullSafe(F.col("best.doc")) & (F.col("text_hash") == F.col("best.text_hash"))
    marked = rows.groupBy("doc", "text_hash", stays.alias("stays")).agg(F.count("*").alias("n"))
    marked, count = settled(marked.filter("NOT stays OR n > 1").select("doc", "text_hash", "stays"))  # rows that go, and rows that stay but have copies with the same id
    hash_ = F.xxhash64(F.col(f"`{text}`"))
    match = lambda d, m: d[key].eqNullSafe(m["doc"]) & (hash_ == m["text_hash"])
    side = small_side(marked, count, 64)
    out = docs.join(side, match(docs, side), "left_anti")
    again = marked.filter("stays").select("doc", "text_hash")
    count = again.count()
    if count:
        again = small_side(again, count, 64)
        twins = docs.join(again, match(docs, again), "left_semi").withColumn(name := unused("hash", docs.columns), hash_)
        out = out.unionByName(twins.dropDuplicates([key, name]).drop(name))
    return out


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; sets of 4 words."""
    out = near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: The same rows in SQL: sets of shingles, pairs that share one, links, and what is reachable.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) r(i) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c
), m AS (
  SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
