"""Media columns as progressive JPEG, written and read in numpy.

A payload's bytes, less 128, are the quantised DCT coefficients of an image (64
to a block, zigzag order; the format's own unit, so storage is lossless whatever
the samples round to). Blocks fill macroblocks of four Y, one Cb and one Cr (4:2:0);
an application segment holds the payload's length. The file has eleven scans:
DC without its low bit, AC 1-5 without its low bit for each component, AC 6-63
for each, then the low bits of AC 1-5 and of DC (spectral selection and
successive approximation), all with restart markers.

Reading parses the markers of every file of a batch and decodes alike scans
together: each restart interval is a lane, and a step takes the next symbol (or,
in refinement scans, the next coefficient) of all lanes at once. Scans accumulate
into one coefficient array, which a matrix product transforms back by each
component's own quantisation table; chroma is upsampled and converted to RGB tensors
of full resolution. ``tensors`` stores them; the query takes its feature from them.
Files of other writers are read too: any script of scans, tables of any scan and
component, with or without restart markers.

Edge cases: null text counts as empty and gives one unit of padding; equal texts
give equal values, as do repeated rows; a text of any length is one image, wider
above MOST_ROWS rows of macroblocks; an empty table gives no rows; a file with a marker
missing, a baseline file, one cut short, or one of other than three components in 4:2:0
raises ValueError; extra columns are ignored by the query.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import prepare, schema_of, slices, table

UNIT, RESTART, MOST_ROWS, TENSORS = 576, 8, 4095, 64
#: Bytes of payload that are written or read together.
TOGETHER = 2 << 20
TAG = b"PAYLOAD\x00"
#: (components, first and last coefficient, high and low bit position)
SCANS = [((0, 1, 2), 0, 0, 0, 1), *(((c,), 1, 5, 0, 1) for c in range(3)), *(((c,), 6, 63, 0, 0) for c in range(3)), *(((c,), 1, 5, 1, 0) for c in range(3)), ((0, 1, 2), 0, 0, 1, 0)]
SAMPLING = ((2, 2), (1, 1), (1, 1))
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Natural position of each zigzag index."""
    return np.array(sorted(range(64), key=lambda i: (s := i // 8 + i % 8, (i // 8 if s % 2 else i % 8))))


def canonical(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol, from a JPEG table."""
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    value, at = 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            code[s], length[s] = value, bits
            value += 1
        at += n
        value <<= 1
    return code, length


@lru_cache(maxsize=16)
def lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """length << 8 | symbol for each 16 bits that may come next (0: no code)."""
    code, length = canonical(list(counts), list(symbols))
    out = np.zeros(1 << 16, np.int64)
    for s in symbols:
        shift = 16 - int(length[s])
        out[int(code[s]) << shift : (int(code[s]) + 1) << shift] = int(length[s]) << 8 | s
    return out


def _table(lengths: dict[int, int]) -> tuple[list[int], list[int]]:
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return [sum(v == n for v in lengths.values()) for n in range(1, 17)], order


DC_TABLE = _table({s: 4 for s in range(12)})
# Bytes of text rarely are 128: runs of length 0 get short codes.
AC_TABLE = _table({r << 4 | s: 4 if r == 0 else 10 for r in range(16) for s in range(1, 9)} | {0: 5, 0xF0: 8})


def geometry(units: int) -> tuple[int, int]:
    """Macroblocks across and down for a number of units."""
    need = -(-units * (UNIT // 64) // 6)
    wide = -(-need // MOST_ROWS)
    return wide, -(-need // wide)


def component_blocks(wide: int, high: int, size: tuple[int, int] | None = None) -> list[np.ndarray]:
    """Macroblock-order index (6 to a macroblock) of each component's blocks, row by row.

    A scan of one component holds no block that lies wholly beyond the picture's size.
    """
    rows, cols = np.divmod(np.arange(4 * wide * high), 2 * wide)
    luma = ((rows // 2) * wide + cols // 2) * 6 + (rows % 2) * 2 + cols % 2
    if size:
        luma = luma[(8 * rows < size[0]) & (8 * cols < size[1])]
    each = np.arange(wide * high) * 6
    return [luma, each + 4, each + 5]


def _pack(value: np.ndarray, bits: np.ndarray, lane: np.ndarray, lanes: int) -> list[bytes]:
    """Bits of consecutive pieces, each lane filled up with ones to whole bytes."""
    total = np.bincount(lane, bits, lanes).astype(np.int64)
    size = (total + 7) // 8
    start = np.concatenate(([0], np.cumsum(size)))
    before = np.cumsum(bits) - bits
    first = np.concatenate(([0], np.cumsum(total)[:-1]))
    at = before - first[lane] + start[lane] * 8
    fill = size * 8 - total
    at = np.concatenate((at, start[:-1] * 8 + total))
    value = np.concatenate((value, (1 << fill) - 1)).astype(np.uint64)
    bits = np.concatenate((bits, fill))
    word = at >> 5
    placed = value << (64 - (at & 31) - bits).clip(0, 63).astype(np.uint64)
    n = int(start[-1] + 3) // 4 + 2
    words = np.bincount(word, (placed >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    raw = words.astype(np.uint64).astype(">u4").tobytes()
    start = start.tolist()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(start[:-1], start[1:])]


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of magnitude."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of documents: number within the document, and lane (restart interval) of each row."""
    inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    lanes = -(-counts // RESTART)
    return inside, np.repeat(np.cumsum(lanes) - lanes, counts) + inside // RESTART


def _encode_scan(coef: np.ndarray, order: np.ndarray, doc_rows: np.ndarray, scan: tuple) -> tuple[list[bytes], np.ndarray]:
    """Lanes of one scan of all documents, and the number of lanes of each document.

    ``order``: rows of coef in scan order; ``doc_rows``: scan units of each document.
    """
    comps, first, last, high, low = scan
    per = 6 if len(comps) > 1 else 1
    inside, lane_of_unit = _spread(doc_rows)
    lanes = int(lane_of_unit[-1]) + 1
    lane = np.repeat(lane_of_unit, per)
    per_doc = -(-doc_rows // RESTART)
    dc_code, dc_len = canonical(*DC_TABLE)
    ac_code, ac_len = canonical(*AC_TABLE)
    if first == 0:
        v = coef[order, 0].astype(np.int64)
        if high:
            return _pack((v >> low) & 1, np.ones(len(v), np.int64), lane, lanes), per_doc
        v = v >> low
        comp = np.tile([0, 0, 0, 0, 1, 2], len(v) // 6)
        diff = v.copy()
        for c in range(3):
            own = np.flatnonzero(comp == c)
            d = np.diff(v[own], prepend=0)
            fresh = np.concatenate(([True], lane[own][1:] != lane[own][:-1]))
            diff[own] = np.where(fresh, v[own], d)
        size = _size(diff)
        return _pack((dc_code[size] << size) | _extra(diff, size), dc_len[size] + size, lane, lanes), per_doc
    band = coef[order, first : last + 1].astype(np.int64)
    width = last - first + 1
    if not high:
        v = np.sign(band) * (np.abs(band) >> low)
        row, col = np.nonzero(v)
        v = v[row, col]
        fresh = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
        run = col - np.where(fresh, -1, np.concatenate(([0], col[:-1]))) - 1 if len(row) else col
        count = run // 16 + 1
        tail = np.full(len(band), -1)
        tail[row] = col  # the last one of a row stays
        end = tail < width - 1
        ends_before = np.cumsum(end) - end
        cum = np.cumsum(count)
        row_cum = np.concatenate(([0], cum))[np.searchsorted(row, np.arange(len(band)), "right")]
        n = int(cum[-1] if len(cum) else 0) + int(end.sum())
        value, bits, of = np.full(n, ac_code[0xF0]), np.full(n, ac_len[0xF0]), np.zeros(n, np.int64)
        at = cum - 1 + ends_before[row]
        size = _size(v)
        symbol = (run % 16) << 4 | size
        value[at], bits[at] = (ac_code[symbol] << size) | _extra(v, size), ac_len[symbol] + size
        stop = row_cum[end] + ends_before[end]
        value[stop], bits[stop] = ac_code[0], ac_len[0]
        of = np.repeat(np.arange(len(band)), np.bincount(row, count, len(band)).astype(np.int64) + end)
        return _pack(value, bits, lane[of], lanes), per_doc
    # Refinement of a band under 16 wide: each new coefficient, or the end, carries the correction bits before it.
    n = len(band)
    pending, waiting, run = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    parts = []
    for k in range(width):
        c = np.abs(band[:, k])
        old = (c >> high) > 0
        bit = (c >> low) & 1
        new = ~old & (bit == 1)
        pending = np.where(old, pending << 1 | bit, pending)
        waiting += old
        at = np.flatnonzero(new)
        symbol = run[at] << 4 | 1
        value = (((ac_code[symbol] << 1) | (band[at, k] > 0)) << waiting[at]) | pending[at]
        parts.append((at * (width + 1) + k, value, ac_len[symbol] + 1 + waiting[at], at))
        run = np.where(new, 0, np.where(old, run, run + 1))
        pending[at] = waiting[at] = 0
    at = np.flatnonzero((run > 0) | (waiting > 0))
    parts.append((at * (width + 1) + width, (ac_code[0] << waiting[at]) | pending[at], ac_len[0] + waiting[at], at))
    key, value, bits, row = (np.concatenate(x) for x in zip(*parts))
    turn = np.argsort(key, kind="stable")
    return _pack(value[turn], bits[turn], lane[row[turn]], lanes), per_doc


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file of each payload (whole units of UNIT bytes)."""
    shapes = [geometry(len(p) // UNIT) for p in payloads]
    sizes = np.array([w * h for w, h in shapes], np.int64)
    base = np.concatenate(([0], np.cumsum(sizes * 6)))
    coef = np.zeros((int(base[-1]), 64), np.int16)
    for p, b in zip(payloads, base.tolist()):
        coef[b : b + len(p) // 64] = np.frombuffer(p, np.uint8).reshape(-1, 64).astype(np.int16) - 128
    blocks = [component_blocks(w, h) for w, h in shapes]
    order = [np.concatenate([own[c] + b for own, b in zip(blocks, base.tolist())]) for c in range(3)]
    streams = []
    for scan in SCANS:
        comps = scan[0]
        if len(comps) > 1:
            lanes, per_doc = _encode_scan(coef, np.arange(len(coef)), sizes, scan)
        else:
            lanes, per_doc = _encode_scan(coef, order[comps[0]], sizes * (4 if comps[0] == 0 else 1), scan)
        streams.append((lanes, np.concatenate(([0], np.cumsum(per_doc))).tolist()))
    head = _segment(0xDB, b"\x00" + b"\x01" * 64)
    tables = _segment(0xC4, b"\x00" + bytes(DC_TABLE[0]) + bytes(DC_TABLE[1])) + _segment(0xC4, b"\x10" + bytes(AC_TABLE[0]) + bytes(AC_TABLE[1])) + _segment(0xDD, struct.pack(">H", RESTART))
    starts = [_segment(0xDA, bytes([len(c)]) + b"".join(bytes([x + 1, 0]) for x in c) + bytes([first, last, high << 4 | low])) for c, first, last, high, low in SCANS]
    out = []
    for i, (p, (w, h)) in enumerate(zip(payloads, shapes)):
        frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + b"".join(bytes([c + 1, a << 4 | b, 0]) for c, (a, b) in enumerate(SAMPLING))
        parts = [b"\xff\xd8", _segment(0xEB, TAG + struct.pack(">Q", len(p))), head, _segment(0xC2, frame), tables]
        for start, (lanes, cut) in zip(starts, streams):
            parts.append(start)
            own = lanes[cut[i] : cut[i + 1]]
            parts.append(own[0])
            for k, lane in enumerate(own[1:]):
                parts += [bytes((0xFF, 0xD0 + k % 8)), lane]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


@dataclass
class File:
    """What the markers of a file say; scans: (components, band, bits, tables, restart interval, data)."""

    length: int = -1
    wide: int = 0
    high: int = 0
    size: tuple[int, int] = (0, 0)  # pixels down and across
    quant: tuple[bytes, ...] = ()  # of each component
    scans: list = field(default_factory=list)


def parse(raw: bytes) -> File:
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    out, tables, restart, at = File(), {}, 0, 2
    quants: dict[int, bytes] = {}
    frame: list[tuple[int, int]] = []  # id and quantisation table of each component
    while True:
        if at + 2 > len(raw) or raw[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = raw[at + 1]
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", raw, at + 2)
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xEB and body.startswith(TAG):
            (out.length,) = struct.unpack(">Q", body[len(TAG) :])
        elif marker == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("quantisation tables of 16 bits are not read")
                quants[body[0] & 15], body = body[1:65], body[65:]
        elif marker == 0xC2:
            _, y, x, n = struct.unpack_from(">BHHB", body)
            if n != 3 or [(body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15) for c in range(3)] != list(SAMPLING):
                raise ValueError("only three components in 4:2:0 are read")
            out.wide, out.high, out.size = -(-x // 16), -(-y // 16), (y, x)
            frame = [(body[6 + 3 * c], body[8 + 3 * c]) for c in range(3)]
        elif 0xC0 <= marker <= 0xCF and marker != 0xC4:
            raise ValueError("not a progressive file")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            n = body[0]
            order = [i for i, _ in frame]
            if any(body[1 + 2 * k] not in order for k in range(n)):
                raise ValueError("a scan of a component that no frame has")
            comps = tuple(order.index(body[1 + 2 * k]) for k in range(n))
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            end = _MARKER.search(raw, at)
            if not end:
                raise ValueError("a scan doesn't end")
            used = tuple(tables.get(body[2 + 2 * k] >> 4) if first == 0 else tables.get(0x10 | body[2 + 2 * k] & 15) for k in range(n))
            out.scans.append((comps, first, last, bits >> 4, bits & 15, used, restart, raw[at : end.start()]))
            at = end.start()
    if not out.wide or not out.scans or any(q not in quants for _, q in frame):
        raise ValueError("a header is missing")
    out.quant = tuple(quants[q] for _, q in frame)
    return out


class Bits:
    """Bit readers of all lanes over one buffer."""

    def __init__(self, lanes: list[bytes]):
        size = np.fromiter(map(len, lanes), np.int64, len(lanes))
        buffer = b"".join([*lanes, bytes(16)])
        self.windows = np.ndarray((len(buffer) - 8,), ">u8", buffer, strides=(1,))
        ends = np.cumsum(size)
        self.at, self.end = (ends - size) * 8, ends * 8

    def peek(self, at: np.ndarray) -> np.ndarray:
        """64 bits from each position; the last 7 may be missing."""
        return self.windows[np.minimum(at >> 3, len(self.windows) - 1)].astype(np.uint64) << (at & 7).astype(np.uint64)


def _top(window: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The first ``bits`` (0 to 16) bits of windows."""
    return ((window >> np.uint64(1)) >> (63 - bits).astype(np.uint64)).astype(np.int64)


def _signed(extra: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((extra >> np.maximum(size - 1, 0)) & 1, extra, extra - (1 << size) + 1)


def _codes(table_: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = table_[(window >> np.uint64(48)).astype(np.int64)]
    if not found.all():
        raise ValueError("a code that no table has")
    return found >> 8, found & 255


def _decode_scans(coef: np.ndarray, jobs: list[tuple[np.ndarray, bytes]], scan: tuple) -> None:
    """Decode one scan of several files into coef. jobs: rows of coef in scan order, and data."""
    comps, first, last, high, low, used, restart = scan
    if len(comps) not in (1, 3) or (len(comps) == 3 and first):
        raise ValueError("a scan is of one component, or of all three for DC")
    per = 6 if len(comps) > 1 else 1
    lanes, counts = [], []
    for rows, data in jobs:
        units = len(rows) // per
        own = [x.replace(b"\xff\x00", b"\xff") for x in _RESTARTS.split(data)]
        step = restart or units
        if len(own) != -(-units // step):
            raise ValueError("a restart interval is missing")
        lanes += own
        counts += [min(step, units - k) * per for k in range(0, units, step)]
    rows = np.concatenate([r for r, _ in jobs])
    count = np.array(counts, np.int64)
    base = np.cumsum(count) - count
    bits = Bits(lanes)
    at = bits.at.copy()
    if first == 0 and high:
        inside = np.arange(len(rows)) - np.repeat(base, count)
        position = np.repeat(at, count) + inside
        if (position >= np.repeat(bits.end, count)).any():
            raise ValueError("a scan is cut short")
        coef[rows, 0] |= ((bits.peek(position) >> np.uint64(63)).astype(np.int16) << low).astype(np.int16)
        return
    if any(u is None for u in used):
        raise ValueError("a scan without a table")
    tables = [lookup(*u) for u in used]
    table_ = tables[0]
    if first == 0:
        comp = np.array([0, 0, 0, 0, 1, 2]) if per > 1 else np.array([comps[0]])
        before = np.zeros((len(count), 3), np.int64)
        for k in range(int(count.max())):
            live = np.flatnonzero(count > k)
            window = bits.peek(at[live])
            length, size = _codes(tables[comp[k % per] if per > 1 else 0], window)
            diff = _signed(_top(window << length.astype(np.uint64), size), size)
            c = comp[k % per]
            before[live, c] += diff
            coef[rows[base[live] + k], 0] = (before[live, c] << low).astype(np.int16)
            at[live] += length + size
    elif not high:
        lane = np.arange(len(count))
        block, k = base.copy(), np.full(len(count), first)
        stop, at_ = base + count, at
        flat = coef.reshape(-1)
        while len(lane):
            window = bits.peek(at_)
            length, symbol = _codes(table_, window)
            run, size = symbol >> 4, symbol & 15
            end = (size == 0) & (run < 15)
            more = np.where(end, run, size)
            extra = _top(window << length.astype(np.uint64), more)
            at_ = at_ + length + more
            k = k + run + np.where(size > 0, 0, 1) * (run == 15)
            put = np.flatnonzero(size > 0)
            if (k[put] > last).any():
                raise ValueError("a run goes beyond its band")
            flat[rows[block[put]] * 64 + k[put]] = (_signed(extra[put], size[put]) << low).astype(np.int16)
            k = k + (size > 0)
            over = end | (k > last)
            block = block + np.where(end, extra + (1 << np.where(end, run, 0)), over)
            k = np.where(over, first, k)
            go = block < stop
            if not go.all():
                at[lane[~go]] = at_[~go]
                lane, block, k, stop, at_ = lane[go], block[go], k[go], stop[go], at_[go]
    else:
        step = 1 << low
        flat = coef.reshape(-1)
        lane = np.arange(len(count))
        block, k, at_, stop = base.copy(), np.full(len(count), first), at, base + count
        run, value, blank, need = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64), np.zeros(len(count), np.int64), np.ones(len(count), bool)
        while len(lane):
            ask = np.flatnonzero(need & (blank == 0))
            if len(ask):
                window = bits.peek(at_[ask])
                length, symbol = _codes(table_, window)
                r, size = symbol >> 4, symbol & 15
                end = (size == 0) & (r < 15)
                more = np.where(end, r, size)
                extra = _top(window << length.astype(np.uint64), more)
                at_[ask] += length + more
                blank[ask] = np.where(end, extra + (1 << np.where(end, r, 0)), 0)
                run[ask] = r
                value[ask] = np.where(size > 0, np.where(extra == 1, step, -step), 0)
                need[ask] = False
            cell = rows[block] * 64 + k
            now = flat[cell].astype(np.int64)
            old = now != 0
            bit = (bits.peek(at_) >> np.uint64(63)).astype(np.int64)
            grow = old & (bit == 1) & ((np.abs(now) & step) == 0)
            at_ = at_ + old
            place = ~old & (blank == 0) & (run == 0)
            flat[cell] = np.where(grow, now + np.sign(now) * step, np.where(place, value, now)).astype(np.int16)
            run = run - (~old & (blank == 0) & (run > 0))
            need = need | place
            k = k + 1
            over = k > last
            k = np.where(over, first, k)
            block = block + over
            ended = over & (blank > 0)
            blank = blank - ended
            need = need | over
            go = block < stop
            if not go.all():
                at[lane[~go]] = at_[~go]
                lane, block, k, at_, stop, run, value, blank, need = (x[go] for x in (lane, block, k, at_, stop, run, value, blank, need))
    if (at > bits.end).any():
        raise ValueError("a scan is cut short")


def read(files: list[bytes]) -> tuple[list[File], np.ndarray, np.ndarray]:
    """Headers, coefficients (macroblock order, zigzag) and the first block of each file (n+1)."""
    heads = [parse(f) for f in files]
    base = np.concatenate(([0], np.cumsum([h.wide * h.high * 6 for h in heads]))).astype(np.int64)
    coef = np.zeros((int(base[-1]), 64), np.int16)
    blocks: dict[tuple, list[np.ndarray]] = {}
    for turn in range(max((len(h.scans) for h in heads), default=0)):
        alike = defaultdict(list)
        for h, b in zip(heads, base.tolist()):
            if turn < len(h.scans):
                *scan, data = h.scans[turn]
                if len(scan[0]) == 1:
                    shape = (h.wide, h.high, h.size)
                    if shape not in blocks:
                        blocks[shape] = component_blocks(*shape)
                    rows = blocks[shape][scan[0][0]] + b
                else:
                    rows = np.arange(b, b + h.wide * h.high * 6)
                alike[tuple(scan)].append((rows, data))
        for scan, jobs in alike.items():
            _decode_scans(coef, jobs, scan)
    return heads, coef, base


@lru_cache(maxsize=1)
def inverse() -> np.ndarray:
    """64 x 64: zigzag coefficients to samples of a block."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    return np.kron(c, c)[zigzag()].astype(np.float32)


def macroblocks(coef: np.ndarray, quant: tuple[bytes, ...]) -> np.ndarray:
    """RGB of each macroblock, 16 x 16 x 3, from dequantised coefficients."""
    table_ = np.frombuffer(b"".join([quant[0]] * 4 + [quant[1], quant[2]]), np.uint8).astype(np.float32).reshape(6, 64)
    scaled = coef.reshape(-1, 6, 64) * table_
    samples = (scaled.reshape(-1, 64) @ inverse()).reshape(-1, 6, 8, 8) + 128.0
    luma = np.concatenate((np.concatenate((samples[:, 0], samples[:, 1]), 2), np.concatenate((samples[:, 2], samples[:, 3]), 2)), 1)
    up = lambda s: s.repeat(2, axis=1).repeat(2, axis=2) - 128.0
    y, cb, cr = np.clip(np.rint(luma), 0, 255), up(np.clip(np.rint(samples[:, 4]), 0, 255)), up(np.clip(np.rint(samples[:, 5]), 0, 255))
    rgb = np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=3)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def images(heads: list[File], coef: np.ndarray, base: np.ndarray) -> Iterator[np.ndarray]:
    """The tensor of each file, height x width x 3; files with the same tables are transformed together."""
    k = 0
    while k < len(heads):
        stop = k + 1
        while stop < len(heads) and heads[stop].quant == heads[k].quant and base[stop + 1] - base[k] <= 6 * 2048:
            stop += 1
        parts = [macroblocks(coef[a : min(a + 6 * 2048, base[stop])], heads[k].quant) for a in range(base[k], base[stop], 6 * 2048)]
        blocks = parts[0] if len(parts) == 1 else np.concatenate(parts)
        for h, a, b in zip(heads[k:stop], (base[k:stop] - base[k]) // 6, (base[k + 1 : stop + 1] - base[k]) // 6):
            tiles = blocks[a:b].reshape(h.high, h.wide, 16, 16, 3).transpose(0, 2, 1, 3, 4)
            yield tiles.reshape(16 * h.high, 16 * h.wide, 3)[: h.size[0], : h.size[1]]
        k = stop


def mean_colour(image: np.ndarray) -> list[float]:
    """Mean of each channel of a tensor."""
    wide = 48 if image.shape[1] % 16 == 0 else 3  # sums along longer rows are faster
    total = np.add.reduce(image.reshape(-1, wide), axis=0, dtype=np.int64).reshape(-1, 3).sum(axis=0)
    return (total / (image.shape[0] * image.shape[1])).tolist()


def tensor(head: File, coef: np.ndarray) -> np.ndarray:
    """Full-resolution RGB image, height x width x 3."""
    return next(images([head], coef, np.array([0, len(coef)])))


def payload(head: File, coef: np.ndarray) -> bytes:
    if head.length < 0 or head.length > coef.size:
        raise ValueError("the file holds no payload")
    return (coef.reshape(-1)[: head.length] + 128).astype(np.uint8).tobytes()


def pad(raw: bytes) -> bytes:
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and ``media``, the file of each text, with n_bytes."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, text, TOGETHER):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(list(map(len, texts)), pa.int64()), pa.array(encode([pad(t) for t in texts]), pa.binary())], names=[*keep, "n_bytes", "media"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema_of(docs, keep, "n_bytes long, media binary"))


def tensors(media: DataFrame, keep: list[str], column: str = "media") -> DataFrame:
    """The kept columns with height, width, rgb (bytes, row by row) and payload (null in a file without one) of each file."""
    prepare(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TENSORS):
                part = batch.slice(k, TENSORS)
                heads, coef, base = read(part.column(column).to_pylist())
                made = list(images(heads, coef, base))
                back = [payload(h, coef[a:b]) if h.length >= 0 else None for h, a, b in zip(heads, base[:-1], base[1:])]
                cols = [pa.array([i.shape[0] for i in made], pa.int32()), pa.array([i.shape[1] for i in made], pa.int32()), pa.array([i.tobytes() for i in made], pa.binary()), pa.array(back, pa.binary())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *cols], names=[*keep, "height", "width", "rgb", "payload"])

    return media.select(*dict.fromkeys([*keep, column])).mapInArrow(run, schema_of(media, keep, "height int, width int, rgb binary, payload binary"))


def digests(media: DataFrame, keep: list[str]) -> DataFrame:
    """What the stored files read back as: payload digests and mean colours."""
    prepare(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n_bytes").to_numpy()
            cut, k = [0], 0
            while k < len(sizes):  # files of about as much payload are read together
                k = max(k + 1, int(np.searchsorted(np.cumsum(sizes[k:] + UNIT), TOGETHER)) + k)
                cut.append(min(k, len(sizes)))
            for a, b in zip(cut[:-1], cut[1:]):
                part = batch.slice(a, b - a)
                files = part.column("media").to_pylist()
                heads, coef, base = read(files)
                back = [payload(h, coef[i:j]) for h, i, j in zip(heads, base[:-1].tolist(), base[1:].tolist())]
                feature = ["%dx%d:%s" % (*i.shape[:2], ",".join("%.3f" % v for v in mean_colour(i))) for i in images(heads, coef, base)]
                cols = [part.column("n_bytes"), pa.array(list(map(len, back)), pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in back]), pa.array([zlib.crc32(p[-32:]) for p in back], pa.int64()), pa.array(list(map(len, files)), pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array(feature)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *cols], names=[*keep, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, schema_of(media, keep, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    return digests(store(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]), ["doc_id"])
