"""SentencePiece BPE with byte fallback, by vectorised merge rounds.

Texts are normalised as the model's identity rule does (a dummy space in
front, spaces become U+2581), cut into words at places no piece can span, and
the distinct words of a batch are merged together in flat numpy arrays. In
each round every word finds its smallest pair rank (a segmented minimum) and
merges all leftmost non-overlapping occurrences of it at once; arrays are then
compacted. A word falls back to its single leftmost merge in a round in which
a symbol made by the merge could join a neighbour at the same or a better
rank, so the result equals one-merge-at-a-time order.

The model's bytes travel with the job, so executors need no file.

Edge cases: null text counts as empty and gives no ids; pairs of equal rank merge
leftmost first; repeated rows give equal rows; a text without spaces is one word and
needs memory in proportion to its length; an empty table gives no rows; a model of
over a million pieces is refused, as its tables hold 20 bits for a piece; extra
columns are ignored by the query and kept by ``encode``, whose results take other
names where a column has theirs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import prepare, schema_of, slices, table, unused

SPACE = "▁"
#: Words whose ids a task keeps; beyond it the table starts anew.
KNOWN_WORDS = 250_000
#: Words merged at once, so that the arrays stay in the processor's cache.
CHUNK_WORDS = 12_000
NO_PAIR = np.int64(1 << 40)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Tables of a BPE model: characters, pair ranks and what pieces decode to."""

    def __init__(self, raw: bytes):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
        size = lib.get_piece_size()
        if size >= 1 << 20:
            raise ValueError("the model has more pieces than 20 bits can name")
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        self.is_byte = np.array([lib.is_byte(i) for i in range(size)])
        special = np.array([lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) for i in range(size)])
        self.unknown = lib.unk_id()
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_set = set(self.byte_ids)
        if not all(lib.is_byte(i) for i in self.byte_ids):
            raise ValueError("the model has no byte fallback")
        ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece spans two words; words can't be merged apart")
        if any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in ids):
            raise ValueError("a piece joins several spaces to a word")
        self.runs = {len(p): i for p, i in ids.items() if not p.strip(SPACE)}
        scores = {lib.get_score(i) for n, i in self.runs.items() if n > 1}
        if 1 not in self.runs or len(scores) > 1 or any(lib.get_score(i) <= max(scores) for p, i in ids.items() if len(p) > 1 and p.strip(SPACE)):
            raise ValueError("runs of spaces aren't the last merges")
        order = sorted({lib.get_score(i) for p, i in ids.items() if len(p) > 1}, reverse=True)
        rank_of = {s: r for r, s in enumerate(order)}
        # Characters that only occur inside pieces get ids beyond the vocabulary.
        chars = sorted({c for p in ids for c in p if len(p) > 1} | {p for p in ids if len(p) == 1})
        sym = dict(ids)
        for c in chars:
            sym.setdefault(c, size + len(sym) - len(ids))
        self.none = size + len(sym) - len(ids)  # any other character
        self.char = np.full(0x110000, self.none, np.int32)
        for c in chars:
            self.char[ord(c)] = sym[c]
        spans = []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                if p[:cut] in sym and p[cut:] in sym:
                    spans.append((sym[p[:cut]], sym[p[cut:]], rank_of[lib.get_score(i)], i))
        spans_ = np.array(spans, np.int64)
        self._build(spans_[:, 0], spans_[:, 1], spans_[:, 2], spans_[:, 3])
        joined = {c for p in ids if len(p) > 1 for c in p}
        self.lone = "".join(c for c in "\n\t\r" if c not in joined)
        self.text = [("" if special[i] else p.replace(SPACE, " ")) for i, p in enumerate(self.pieces)]
        self.text[self.unknown] = " ⁇ "
        lone = re.escape(self.lone)
        self.split = re.compile(f"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+" + (f"|[{lone}]" if lone else ""))

    def _build(self, left, right, rank, made) -> None:
        """An open-addressed table from pair to (rank, merged piece)."""
        self.bits = max(10, int(len(left) * 4).bit_length())
        size = 1 << self.bits
        keys, value = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.probes = 1
        for l, r, k, m in zip(left.tolist(), right.tolist(), rank.tolist(), made.tolist()):
            key = l << 24 | r
            at = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            step = 1
            while keys[at] not in (-1, key):
                at, step = (at + 1) & (size - 1), step + 1
            keys[at], value[at] = key, k << 20 | m
            self.probes = max(self.probes, step)
        self.keys, self.value = keys, value

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | merged piece of each pair; NO_PAIR where there is none."""
        key = left.astype(np.int64) << 24 | right
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.value[at], NO_PAIR)
        left_over = np.flatnonzero((found != key) & (found != -1))
        for _ in range(self.probes):
            if not len(left_over):
                break
            at[left_over] = (at[left_over] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left_over]]
            hit = found == key[left_over]
            out[left_over[hit]] = self.value[at[left_over[hit]]]
            left_over = left_over[~hit & (found != -1)]
        return out

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge distinct words. Returns symbols, first symbol of each word (n+1), characters."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.char[code].astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        final_sym, final_word, final_at = [], [], []
        at = np.arange(len(sym))  # first character of each symbol
        pair = np.full(len(sym), NO_PAIR)
        if len(sym) > 1:
            inner = np.flatnonzero(word[:-1] == word[1:])
            pair[inner] = self.pair(sym[inner], sym[inner + 1])
        while len(sym):
            n = len(sym)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(pair >> 20, first)
            sizes = np.diff(np.append(first, n))
            live = best < (NO_PAIR >> 20)
            if not live.all():  # finished words leave the arrays
                done = np.repeat(~live, sizes)
                final_sym.append(sym[done])
                final_word.append(word[done])
                final_at.append(at[done])
                keep = ~done
                sym, word, at, pair = sym[keep], word[keep], at[keep], pair[keep]
                if not len(sym):
                    break
                best, sizes = best[live], sizes[live]
                n = len(sym)
            of = np.repeat(np.arange(len(sizes)), sizes)
            hit = np.flatnonzero((pair >> 20) == best[of])
            # Of a chain of overlapping hits take every second, from the left.
            link = np.concatenate(([False], (hit[1:] == hit[:-1] + 1)))
            head = np.maximum.accumulate(np.where(link, 0, np.arange(len(hit))))
            hit = hit[(np.arange(len(hit)) - head) % 2 == 0]
            made = pair[hit] & 0xFFFFF
            several = np.flatnonzero(of[hit[1:]] == of[hit[:-1]])
            if len(several):  # more than one in a word: is order of no matter?
                touched = np.zeros(len(sizes), bool)
                touched[of[hit[several]]] = True
                mine = np.flatnonzero(touched[of[hit]])
                h, m, limit = hit[mine], made[mine], best[of[hit[mine]]]
                clash = np.zeros(len(mine), bool)
                right = h + 2
                ok = np.flatnonzero((right < n) & (of[np.minimum(right, n - 1)] == of[h]))
                clash[ok] |= (self.pair(m[ok], sym[right[ok]]) >> 20) <= limit[ok]
                ok = np.flatnonzero((h > 0) & (of[np.maximum(h - 1, 0)] == of[h]))
                clash[ok] |= (self.pair(sym[h[ok] - 1], m[ok]) >> 20) <= limit[ok]
                near = np.flatnonzero(h[1:] == h[:-1] + 2)  # the symbol before is made too
                near = near[of[h[near]] == of[h[near + 1]]]
                clash[near + 1] |= (self.pair(m[near], m[near + 1]) >> 20) <= limit[near + 1]
                bad = np.zeros(len(sizes), bool)
                bad[of[h[clash]]] = True
                if bad.any():
                    lead = np.concatenate(([True], of[hit[1:]] != of[hit[:-1]]))
                    stay = lead | ~bad[of[hit]]
                    hit, made = hit[stay], made[stay]
            sym[hit] = made
            keep = np.ones(n, bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, at, pair = sym[keep], word[keep], at[keep], pair[keep]
            new = place[hit]
            changed = np.zeros(len(sym) + 1, bool)
            changed[new] = changed[new - 1] = True  # index -1 is the spare last one
            fresh = np.flatnonzero(changed[:-1])
            pair[fresh] = NO_PAIR
            fresh = fresh[fresh + 1 < len(sym)]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            pair[fresh] = self.pair(sym[fresh], sym[fresh + 1])
        sym, word, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (final_sym, final_word, final_at))
        order = np.argsort(at, kind="stable")
        sym, word, at = sym[order], word[order], at[order]
        return sym, np.searchsorted(word, np.arange(len(words) + 1)), code[at] if len(at) else code[:0]

    def spaces(self, n: int) -> list[int]:
        """Ids of n spaces: all their merges tie, so the leftmost possible one is always next."""
        stack = [1]
        for _ in range(n - 1):
            if stack[-1] + 1 in self.runs:
                stack[-1] += 1
            else:
                stack.append(1)
            while len(stack) > 1 and stack[-1] > 1 and stack[-2] + stack[-1] in self.runs:
                stack[-2:] = [stack[-2] + stack[-1]]
        return [self.runs[k] for k in stack] if n else []

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words, each a run of U+2581 (or none) and other characters."""
        return [ids for ids, _ in self.spell(words)]

    def spell(self, words: list[str]) -> Iterator[tuple[list[int], str]]:
        """Ids and decoded text (its leading space still there) of each word."""
        for k in range(0, len(words), CHUNK_WORDS):
            yield from self._spell(words[k : k + CHUNK_WORDS])

    def _spell(self, words: list[str]) -> Iterator[tuple[list[int], str]]:
        # Runs of spaces merge last and from the left, so only the last space can join the word.
        cores = [w[len(w) - len(w.lstrip(SPACE)) - 1 :] if w.startswith(SPACE * 2) else w for w in words]
        sym, first, char = self.merge(cores)
        size, text = len(self.pieces), self.text
        flat, first = sym.tolist(), first.tolist()
        odd = np.searchsorted(first, np.flatnonzero(sym >= size), "right") - 1
        odd = set(odd.tolist())
        for k, w in enumerate(words):
            ids = flat[first[k] : first[k + 1]]
            if k in odd:
                ids = [x for j in range(first[k], first[k + 1]) for x in ([flat[j]] if flat[j] < size else [self.byte_ids[b] for b in chr(char[j]).encode("utf-8", "surrogatepass")])]
            if w.startswith(SPACE * 2):
                run = len(w) - len(w.lstrip(SPACE))
                if ids[:1] == [self.runs[1]]:
                    ids = ids[1:]
                else:
                    run -= 1
                ids = self.spaces(run) + ids
            yield ids, self.raw(ids) if k in odd else "".join([text[i] for i in ids])

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " ":
            return self.split.findall(SPACE + text.replace(" ", SPACE))
        return (SPACE + text.replace(" ", " " + SPACE)).split(" ")  # single spaces only: cut before each

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts; distinct words are merged once."""
        split = [self.words(t) for t in texts]
        known = list(dict.fromkeys(w for ws in split for w in ws))
        ids = dict(zip(known, self.encode_words(known)))
        return [[i for w in ws for i in ids[w]] for ws in split]

    def raw(self, ids: list[int]) -> str:
        """Text of ids with the leading space still there."""
        if self.byte_set.isdisjoint(ids):
            return "".join([self.text[i] for i in ids])
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.is_byte[i]:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            while run:  # like the library: each byte that fits no character is one U+FFFD
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:n]).decode())
                        del run[:n]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    del run[:1]
            if i >= 0:
                out.append(self.text[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids): one space in front belongs to the encoder."""
        raw = self.raw(ids)
        lead = next((self.pieces[i] for i in ids if self.is_byte[i] or self.text[i]), "")
        return raw[1:] if lead.startswith(SPACE) else raw


@lru_cache(maxsize=2)
def built(raw: bytes) -> PieceModel:
    return PieceModel(raw)


def load(path: str) -> PieceModel:
    return built(Path(path).read_bytes())


def encode(docs: DataFrame, model: str | None = None, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The kept columns with ``ids`` (array of int) and ``decoded`` (string) of each text."""
    keep = list(docs.columns if keep is None else keep)
    ids_, decoded_ = unused("ids", keep), unused("decoded", [*keep, unused("ids", keep)])
    source = docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])])
    schema = schema_of(docs, keep, f"`{ids_}` array<int>, `{decoded_}` string")
    shared = _share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = built(shared.value)
        for batch in batches:
            for part, _, _ in slices(batch, text):
                ids = model.encode([t or "" for t in part.column(text).to_pylist()])
                cols = [part.column(c) for c in keep] + [pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, ids_, decoded_])

    return source.mapInArrow(run, schema)


def _share(spark: SparkSession, path: str | None) -> Broadcast:
    """The model file's bytes, read on the driver; a fixed size."""
    prepare(spark)
    return spark.sparkContext.broadcast(Path(path or default_model()).read_bytes())


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Count of ids and digests of ids and decoded text, without moving the ids.

    The same word-level encoding as :func:`encode`; each distinct word's ids are
    written out once and texts are put together from them.
    """
    shared = _share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = built(shared.value)
        digits = [str(i) for i in range(len(model.pieces))]
        known: dict[str, tuple[int, str, str]] = {}
        for batch in batches:
            for part, _, _ in slices(batch):
                split = [model.words(t or "") for t in part.column("text").to_pylist()]
                if len(known) > KNOWN_WORDS:
                    known.clear()
                new = list({w for ws in split for w in ws if w not in known})
                # Words hold whole characters, so byte runs of different words decode apart.
                known.update(zip(new, [(len(x), ",".join([digits[i] for i in x]), plain) for x, plain in model.spell(new)]))
                a, b, c = [], [], []
                for ws in split:
                    found = [known[w] for w in ws]
                    a.append(sum([x[0] for x in found]))
                    b.append(hashlib.sha256(",".join([x[1] for x in found]).encode()).hexdigest())
                    out = "".join([x[2] for x in found])
                    c.append(hashlib.sha256((out[1:] if out.startswith(" ") else out).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(a, pa.int64()), pa.array(b), pa.array(c)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = schema_of(docs, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    return digests(table(spark, sf_dir, "documents"))
