"""Personal data: patterns, and a character BiLSTM with CRF transitions for secrets.

The base kinds follow fixed patterns. Secrets (keys, tokens, passwords) have no
fixed form; a bidirectional LSTM over characters with a CRF on top tags them. It
is trained in numpy, by back-propagation through time, on labelled spans that a
seeded generator plants in invented prose together with look-alikes that are no
secrets (versions, years, prices, dates, names with values, long words).

Every window of every text is read. Windows overlap; their emissions are blended
over the overlap, and Viterbi runs over the whole text, so a span across windows
comes out as one. Where no path could gain by leaving the tag "none" the path is
known beforehand; what lies between such places is decoded in lanes, long
stretches as blocks joined by their transfer scores. Both are exact.

The tagger also knows the base kinds, so as to tell secrets from them, but their
patterns decide: what it tags as email, ip, card or phone beyond the base spans is
dropped, as a pattern refused it. Secrets that touch a base span give way to it.

Edge cases: null text counts as empty and holds nothing; a text of any length is
read whole; secrets have no whitespace, so a tagged stretch with some is several;
of overlapping base spans both stay; repeated rows get equal rows; an empty table
gives no rows; extra columns are ignored by the query and kept by ``redact``,
whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import prepare, schema_of, slices, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
TAGS = ("none", *KINDS)
#: Characters of a window and from one to the next; states a direction; training: windows' length, updates, rows of one.
WINDOW, STRIDE, HIDDEN = 128, 112, 12
TRAIN_WINDOW, UPDATES, BATCH, TRAIN_ROWS = 72, 480, 64, 4000
#: What a secret must gain over no secret, in log-likelihood: prose is many times longer than what was learned from.
CAUTION = 2.0
#: Windows that are read at once, and steps of a block of a long stretch.
LANES, BLOCK = 512, 256

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their @: linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1] in _LOCAL_CHARS):
            start -= 1
        end = None
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, end := m.end()))
            done = end
        elif start < at:
            done = max(done, start)
        at = text.find("@", max(at + 1, end or 0))
    return out


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind, then start."""
    if not _TRIGGER.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def codes(text: str) -> np.ndarray:
    """A symbol of each character: its ASCII code, or one for all others."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128).astype(np.int64)


class Tagger:
    """BiLSTM emissions and CRF transitions; parameters in a dict of arrays."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        h, k = HIDDEN, len(TAGS)
        draw = lambda *shape, s=0.2: rng.normal(0, s, shape).astype(np.float32)
        self.p = {"A": np.zeros((k, k), np.float32), "V": draw(2 * h, k), "c": np.zeros(k, np.float32)}
        for d in "fb":
            self.p |= {f"X{d}": draw(129, 4 * h, s=0.3), f"H{d}": draw(h, 4 * h), f"b{d}": np.concatenate((np.zeros(h), np.ones(h), np.zeros(2 * h))).astype(np.float32)}

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States of all steps (steps, rows, h) and what the way back needs."""
        steps, n = x.shape
        h = HIDDEN
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, tape = np.empty((steps, n, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = self.p["X" + d][x[t]] + state @ self.p["H" + d] + self.p["b" + d]
            gate = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            new = np.tanh(z[:, 3 * h :])
            before, prior = cell, state
            cell = gate[:, h : 2 * h] * cell + gate[:, :h] * new
            squash = np.tanh(cell)
            out[t] = state = gate[:, 2 * h :] * squash
            tape.append((t, gate, new, before, prior, squash))
        return out, tape

    def _back(self, x: np.ndarray, d: str, tape: list, grad_out: np.ndarray, grad: dict) -> None:
        h = HIDDEN
        steps, n = x.shape
        ds, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        dz, prior_ = np.empty((steps, n, 4 * h), np.float32), np.empty((steps, n, h), np.float32)
        for t, gate, new, before, prior, squash in reversed(tape):
            ds = ds + grad_out[t]
            i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
            dc = dc + ds * o * (1 - squash * squash)
            dz[t] = np.concatenate((dc * new * i * (1 - i), dc * before * f * (1 - f), ds * squash * o * (1 - o), dc * i * (1 - new * new)), axis=1)
            prior_[t] = prior
            ds, dc = dz[t] @ self.p["H" + d].T, dc * f
        flat = dz.reshape(-1, 4 * h)
        order = np.argsort(x.reshape(-1), kind="stable")
        used, first = np.unique(x.reshape(-1)[order], return_index=True)
        grad["X" + d][used] = np.add.reduceat(flat[order], first, axis=0)
        grad["H" + d][:] = prior_.reshape(-1, h).T @ flat
        grad["b" + d][:] = flat.sum(axis=0)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tag paths (rows, steps), and its gradient."""
        x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
        (of, tf), (ob, tb) = self._run(x, "f"), self._run(x, "b")
        both = np.concatenate((of, ob), axis=2)
        e, a = (both @ self.p["V"] + self.p["c"]).astype(np.float64), self.p["A"].astype(np.float64)
        steps, n, k = e.shape
        # Forward and backward sums, scaled to 1 at each step; the scales make up the likelihood.
        top = e.max(axis=2, keepdims=True)
        u, m = np.exp(e - top), np.exp(a)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((steps, n, 1))
        for t in range(steps):
            v = u[t] if t == 0 else (alpha[t - 1] @ m) * u[t]
            scale[t] = v.sum(axis=1, keepdims=True)
            alpha[t] = v / scale[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = (u[t + 1] * beta[t + 1]) @ m.T / scale[t + 1]
        rows, at = np.arange(n), np.arange(steps)[:, None]
        gold = e[at, rows, y].sum() + a[y[:-1], y[1:]].sum()
        loss = (np.log(scale) + top).sum() - gold
        grad = {name: np.zeros_like(v) for name, v in self.p.items()}
        de = alpha * beta
        joint = np.einsum("tni,tnj->ij", alpha[:-1], u[1:] * beta[1:] / scale[1:]) * m
        np.add.at(joint, (y[:-1], y[1:]), -1)
        grad["A"] = joint
        de[at, rows, y] -= 1
        de = de.astype(np.float32)
        grad["V"] = both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, k)
        grad["c"] = de.sum(axis=(0, 1))
        dh = de @ self.p["V"].T
        self._back(x, "f", tf, dh[:, :, :HIDDEN], grad)
        self._back(x, "b", tb, dh[:, :, HIDDEN:], grad)
        return float(loss / n), {name: g / n for name, g in grad.items()}

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Emissions (steps, tags, rows) of windows (rows, steps).

        Rows run along the last axis, so that gates are blocks of memory. All gates
        are one exponential: tanh(v) = 2 / (1 + exp(-2 v)) - 1.
        """
        h, (n, steps) = HIDDEN, x.shape
        xt = np.ascontiguousarray(x.T)
        sign = -np.concatenate((np.ones(3 * h), np.full(h, 2))).astype(np.float32)
        out = np.empty((steps, len(TAGS), n), np.float32)
        out[:] = self.p["c"][None, :, None]
        for d, weights in (("f", self.p["V"][:h]), ("b", self.p["V"][h:])):
            table_, recur = (self.p["X" + d] + self.p["b" + d]) * sign, np.ascontiguousarray(self.p["H" + d] * sign)
            steep = float(np.abs(table_).max() + np.abs(recur).sum(axis=0).max()) > 80
            states, cell = np.empty((steps, h, n), np.float32), np.zeros((h, n), np.float32)
            state, z, row, picked, new = np.zeros((h, n), np.float32), np.empty((4 * h, n), np.float32), np.empty((n, 4 * h), np.float32), np.empty((n, 4 * h), np.float32), np.empty((h, n), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                np.matmul(state.T, recur, out=row)
                table_.take(xt[t], axis=0, out=picked, mode="clip")
                row += picked
                z[:] = row.T
                if steep:  # exp must stay finite
                    np.minimum(z, 80, out=z)
                np.exp(z, out=z)
                z += 1
                np.divide(1, z, out=z)
                np.multiply(z[3 * h :], 2, out=new)
                new -= 1
                new *= z[:h]
                cell *= z[h : 2 * h]
                cell += new
                state = states[t]
                np.multiply(cell, -2, out=new)
                np.minimum(new, 80, out=new)
                np.exp(new, out=new)
                new += 1
                np.divide(2, new, out=state)
                state -= 1
                state *= z[2 * h : 3 * h]
            out += weights.T @ states
        return out


#: Parts of invented syllables.
_ONSETS = ["", "", "b", "c", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "t", "v", "w", "z", "qu", "th", "ch", "sh", "sch", "st", "tr", "br", "pr", "gl", "kn", "j"]
_VOWELS = ["a", "e", "i", "o", "u", "e", "a", "ie", "ou", "ai", "au", "ei", "é", "ü", "ä", "ó", "eau"]
_CODAS = ["", "", "", "n", "r", "s", "t", "nd", "ng", "ch", "cht", "tz", "st", "ll", "m", "x", "rt", "ble"]


def invent(rng: np.random.Generator, length: int = 2 * TRAIN_WINDOW + 20) -> tuple[str, list[tuple[str, int, int]]]:
    """A line of invented prose with planted spans and look-alikes, and the spans."""
    pick = lambda s, n: "".join([s[i] for i in rng.integers(0, len(s), int(n))])
    one = lambda s: s[int(rng.integers(len(s)))]
    between = lambda a, b: int(rng.integers(a, b))
    low, num, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    up = low.upper()

    def word() -> str:
        if rng.random() < 0.2:
            w = pick("eeettaaooiinnsshrrddllcumfwypvbgkéèüñ", between(1, 10) if rng.random() < 0.8 else between(10, 26))
        else:
            w = "".join([one(_ONSETS) + one(_VOWELS) + one(_CODAS) for _ in range(1 + min(between(0, 3), between(0, 6)))])
        w = w.upper() if shouting or rng.random() < 0.03 else w.capitalize() if rng.random() < 0.2 else w
        return w + (one([".", ",", ".\n", "!!", " |", ";", ":", "?", 3 * one("*$&#%!?=-~_+@/")]) if rng.random() < 0.3 else "")

    def password() -> str:
        kind = between(0, 7)
        if kind == 0:
            return pick(hexa, between(6, 65))
        if kind == 1:
            return pick(low, between(5, 25))
        if kind == 2:
            return "".join(pick(low, between(3, 8)).capitalize() for _ in range(between(1, 4)))
        if kind == 3:
            return pick(low, between(4, 9)) + pick(num, between(1, 5))
        if kind == 4:
            return pick(low + up + num, between(6, 41))
        if kind == 5:
            return pick(low + up + num + "!@#$%^&*-_", between(6, 25))
        return pick(low + up, between(6, 30))

    def item() -> tuple[str, str, str, str]:
        """Kind, text before the span, span, text after it."""
        kind = between(0, 18)
        name = pick(low, between(3, 9))
        if kind == 0:
            return "email", "", f"{name}.{pick(num, 2)}@{pick(low, 5)}{pick(num, 1)}.{one(['com', 'org', 'example.com'])}", ""
        if kind == 1:
            return "ip", "", ".".join(str(int(v)) for v in rng.integers(0, 256, 4)), ""
        if kind == 2:
            return "card", "", pick(num, 16) if rng.random() < 0.7 else " ".join(pick(num, 4) for _ in range(4)), ""
        if kind == 3:
            return "phone", "", f"+{between(1, 99)} ({pick(num, 3)}) {pick(num, 3)}-{pick(num, 4)}", ""
        if kind == 4:
            return "secret", "", one(["AKIA", "ASIA"]) + pick(up + num, 16), ""
        if kind == 5:
            return "secret", "", one(["ghp_", "sk-", "xoxb-", "glpat-"]) + pick(low + up + num, between(20, 41)), ""
        if kind in (6, 7, 8, 9, 10):
            lead = one(["password", "passwd", "pwd", "passphrase", "secret", "token", "key", "api_key", "access_key", "client_secret"])
            lead = lead.upper() if rng.random() < 0.2 else lead.capitalize() if rng.random() < 0.15 else lead
            quote = one(["", "", '"', '"', "'"])
            return "secret", lead + one(["=", "=", " = ", ": ", ":"]) + quote, password(), quote
        if kind in (11, 12):
            return "secret", one(['token = "', 'key = "', 'secret: "']), pick(hexa, one([32, 40, 40, 64])), '"'
        if kind == 13:
            return "none", one(["version 3.", "Version 2.0.", "CC BY-NC 4.0.", "v2", "chapter 12", "page 7", f"http://{name}.org/{word()}/{word()}", f"{name}_{name}", f"{name}/{name}.txt", f"#{name}"]), "", ""
        if kind == 14:
            return "none", one([str(between(1, 2100)), f"{between(1, 99)}.{pick(num, 2)}", f"20{pick(num, 2)}-0{between(1, 10)}-1{between(0, 10)}", f"1{between(0, 10)}:{pick(num, 2)}", f"({pick(num, 4)})", f"{pick(num, 3)},{pick(num, 3)}"]), "", ""
        if kind == 15:  # names with values that are no secrets
            quote = one(["", "", '"', "'"])
            return "none", one(["name", "size", "title", "lang", "width", "date", "class", "href", "source", "note", "page", name]) + one(["=", " = ", ": ", ":"]) + quote + one([word(), pick(num, between(1, 5)), name]) + quote, "", ""
        if kind == 16:
            return "none", one(["the password is", "a secret of", "the key to", "no token was", "Password and", "key word", "tokens"]), "", ""
        return "none", pick(low, between(12, 30)) + one(["", "", "1", "22", ".", "***"]), "", ""

    shouting = rng.random() < 0.12
    text, spans = "", []
    while len(text) < length:
        if rng.random() < 0.2:
            kind, before, span, after = item()
            text += before
            if kind != "none":
                spans.append((kind, len(text), len(text) + len(span)))
            text += span + after + one([" ", " ", ". ", "\n"])
        else:
            text += word() + " "
    return text, spans


def training_set(rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    x, y = np.zeros((rows, TRAIN_WINDOW), np.int64), np.zeros((rows, TRAIN_WINDOW), np.int64)
    for i in range(rows):
        text, spans = invent(rng)
        tags = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            tags[a:b] = TAGS.index(kind)
        at = int(rng.integers(0, len(text) - TRAIN_WINDOW + 1))
        x[i], y[i] = codes(text)[at : at + TRAIN_WINDOW], tags[at : at + TRAIN_WINDOW]
    return x, y


@lru_cache(maxsize=2)
def train(updates: int = UPDATES, seed: int = 1) -> Tagger:
    """Adam on generated windows; the same model in every run."""
    model = Tagger(seed)
    x, y = training_set(TRAIN_ROWS, seed + 1)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    order = np.random.default_rng(seed + 2)
    for step in range(1, updates + 1):
        rows = order.integers(0, len(x), BATCH)
        _, grad = model.gradient(x[rows], y[rows])
        rate = 0.02 * min(1.0, 2.0 * (1 - step / (updates + 1)))
        for k, g in grad.items():
            g = np.clip(g, -5, 5)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model.p[k] = (model.p[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    model.p["A"][0, TAGS.index("secret")] -= CAUTION
    return model


#: Weight of each place of a window: what lies in two windows blends from one to the other.
_RAMP = np.minimum(1, np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)) / (WINDOW - STRIDE + 1)).astype(np.float32)


def layout(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of each text, and where it starts when each has room for its last window."""
    count = np.where(size > 0, np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1), 0)
    room = np.where(count > 0, (count - 1) * STRIDE + WINDOW, 0)
    return count, np.cumsum(room) - room


def emitted(model: Tagger, texts: list[np.ndarray], count: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Emissions (tags, characters) of texts in their layout, blended over their windows."""
    of = np.repeat(np.arange(len(texts)), count)
    turn = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = base[of] + turn * STRIDE
    total = int(start[-1]) + WINDOW
    flat = np.full(total, 32, np.int64)
    for b, t in zip(base.tolist(), texts):
        flat[b : b + len(t)] = t
    out = np.zeros((len(TAGS), total), np.float32)
    place = np.arange(WINDOW)
    # Equal windows are read once.
    seen: dict[bytes, int] = {}
    same = flat.astype(np.uint8)[start[:, None] + place].tobytes()
    one = np.array([seen.setdefault(same[k : k + WINDOW], len(seen)) for k in range(0, len(same), WINDOW)])
    order = np.argsort(one, kind="stable")
    cut = np.searchsorted(one[order], np.arange(len(seen) + 1))
    for k in range(0, len(seen), LANES):
        stop = min(k + LANES, len(seen))
        e = model.emissions(flat[start[order[cut[k:stop]], None] + place])
        every = order[cut[k] : cut[stop]]
        for parity in (0, 1):  # every second window of a text: none of them overlap
            own = every[turn[every] % 2 == parity]
            at = start[own, None] + place
            weight = np.broadcast_to(_RAMP, at.shape).copy()
            weight[turn[own] == 0, : WINDOW - STRIDE] = 1
            weight[turn[own] == count[of[own]] - 1, STRIDE:] = 1
            for tag in range(len(TAGS)):
                out[tag, at] += e[:, tag, one[own] - k].T * weight
    return out


def _lanes(e: np.ndarray, a: np.ndarray, entry: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best scores by last tag (lanes, tags) and pointers (steps, lanes, tags); ``entry`` is added at the first step."""
    n, steps, k = e.shape
    score, back = entry + e[:, 0], np.zeros((steps, n, k), np.int8)
    for t in range(1, steps):
        options = score[:, :, None] + a
        best = options.argmax(axis=1)
        back[t] = best
        new = np.take_along_axis(options, best[:, None], axis=1)[:, 0] + e[:, t]
        score = np.where((lengths > t)[:, None], new, score)
    return score, back


def _trace(back: np.ndarray, lengths: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Tags (lanes, steps) of the paths that end in ``last``."""
    steps, n, _ = back.shape
    out, tag, rows = np.zeros((n, steps), np.int8), last.astype(np.int64), np.arange(n)
    for t in range(steps - 1, -1, -1):
        live = lengths > t
        out[live, t] = tag[live]
        if t:
            tag = np.where(live, back[t][rows, tag], tag)
    return out


def viterbi(e: np.ndarray, a: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Best tags of texts in a layout: emissions (tags, characters), transitions, first character and end of each text.

    A run of other tags beats ``none`` only if its emissions' lead over those of none
    pays for its transitions. The most that any run around a character could gain
    comes from running sums; where that is below 0 the tag is none on a best path, and
    only what is left is decoded.
    """
    k, n = e.shape
    out = np.zeros(n, np.int8)
    each = float(a[1:, 1:].max() - a[0, 0])  # a step inside a run, a step into it and out of it
    into, out_of = float(a[0, 1:].max() - a[0, 0]), float(a[1:, 0].max() - a[0, 0])
    lead = (e[1:].max(axis=0) - e[0]).astype(np.float64) + each
    lead[first] += max(0.0, -into)  # nothing stands before a text or after it
    lead[end - 1] += max(0.0, -out_of)
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, first, 1)
    np.add.at(inside, end, -1)
    lead[np.cumsum(inside[:n], dtype=np.int8) == 0] = -1e6
    total = np.concatenate(([0.0], np.cumsum(lead)))
    most = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])  # of the runs around each character
    open_ = most + into + out_of - each > -1e-3
    begin = np.zeros(n + 1, bool)
    begin[first] = True
    stop = np.zeros(n + 1, bool)
    stop[end] = True
    low = np.flatnonzero(open_ & (begin[:n] | np.concatenate(([True], ~open_[:-1]))))
    high = np.flatnonzero(open_ & (stop[1:] | np.append(~open_[1:], True))) + 1
    entry = np.where(begin[low][:, None], 0, a[0])  # none stands before, unless the text starts here
    leave = np.where(stop[high][:, None], 0, a[:, 0])
    size = high - low
    for own in _alike(np.flatnonzero(size <= BLOCK), size):
        steps = int(size[own].max())
        at = np.minimum(low[own, None] + np.arange(steps), n - 1)
        score, back = _lanes(e[:, at].transpose(1, 2, 0), a, entry[own], size[own])
        tags = _trace(back, size[own], (score + leave[own]).argmax(axis=1))
        live = np.arange(steps) < size[own, None]
        out[at[live]] = tags[live]
    for i in np.flatnonzero(size > BLOCK).tolist():
        out[low[i] : high[i]] = _blocks(np.ascontiguousarray(e[:, low[i] : high[i]].T), a, entry[i], leave[i])
    return out


def _alike(rows: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of like sizes, so that padding stays below what is used."""
    rows = rows[np.argsort(size[rows], kind="stable")]
    k = 0
    while k < len(rows):
        stop = min(k + 4096, int(np.searchsorted(size[rows], 2 * size[rows[k]] + 8, "right")))
        yield rows[k:stop]
        k = stop


def _blocks(e: np.ndarray, a: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Viterbi of one long stretch: blocks are decoded for each tag that may stand before them, then joined."""
    n, k = e.shape
    count = -(-n // BLOCK)
    size = np.full(count, BLOCK)
    size[-1] = n - (count - 1) * BLOCK
    padded = np.concatenate((e, np.zeros((count * BLOCK - n, k), e.dtype))).reshape(count, BLOCK, k)
    scores, pointers = np.empty((count, k, k), e.dtype), []
    for s in range(k):
        score, back = _lanes(padded, a, np.broadcast_to(a[s], (count, k)), size)
        scores[:, s] = score
        pointers.append(back)
    start, back = _lanes(padded[:1], a, entry[None], size[:1])
    total, origin = start[0], np.zeros((count, k), np.int64)
    for c in range(1, count):
        options = total[:, None] + scores[c]
        origin[c] = options.argmax(axis=0)
        total = options.max(axis=0)
    ends = np.empty(count, np.int64)
    ends[-1] = (total + leave).argmax()
    for c in range(count - 1, 0, -1):
        ends[c - 1] = origin[c][ends[c]]
    out = np.empty((count, BLOCK), np.int8)
    out[:1] = _trace(back, size[:1], ends[:1])
    before = np.concatenate(([-1], ends[:-1]))
    for s in range(k):
        own = np.flatnonzero(before == s)
        if len(own):
            out[own] = _trace(pointers[s][:, own], size[own], ends[own])
    return out.reshape(-1)[:n]


def _clean(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The parts of a tagged stretch without whitespace, quotes and what leads to a value trimmed."""
    for m in _SOLID.finditer(text, a, b):
        x, y = m.span()
        while x < y and text[x] in "\"'=:":
            x += 1
        while x < y and text[y - 1] in "\"'.,;:":
            y -= 1
        if x < y:
            yield x, y


_SOLID = re.compile(r"\S+")


def learned_spans(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Secrets that the tagger finds in each text."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    some = [i for i, t in enumerate(texts) if t]
    if not some:
        return out
    size = np.array([len(texts[i]) for i in some], np.int64)
    count, base = layout(size)
    e = emitted(model, [codes(texts[i]) for i in some], count, base)
    tags = viterbi(e, model.p["A"], base, base + size)
    hit = np.concatenate(([False], tags == TAGS.index("secret"), [False]))
    edge = np.zeros(len(hit), bool)
    edge[base + 1] = True
    start = np.flatnonzero(hit[1:] & (~hit[:-1] | edge[1:]))
    stop = np.flatnonzero(hit[1:-1] & (~hit[2:] | edge[2:])) + 1
    which = np.searchsorted(base, start, "right") - 1
    for i, a, b in zip(which.tolist(), (start - base[which]).tolist(), (stop - base[which]).tolist()):
        out[some[i]] += [("secret", x, y) for x, y in _clean(texts[some[i]], a, b)]
    return out


def apart(spans: list[tuple], base: list[tuple]) -> list[tuple]:
    """The spans that touch no base span; both are walked once, in order."""
    taken = sorted((a, b) for _, a, b in base)
    ends = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    out = []
    for s in spans:
        k = bisect_left(taken, (s[2], 0))  # base spans that start before this one ends
        if not k or ends[k - 1] <= s[1]:
            out.append(s)
    return out


def find(model: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """Base spans and all spans (base first, then secrets that don't touch them) of each text."""
    out = []
    for text, more in zip(texts, learned_spans(model, texts)):
        base = base_spans(text)
        out.append((base, base + apart(more, base)))
    return out


def _model(spark: SparkSession) -> Broadcast:
    prepare(spark)
    return spark.sparkContext.broadcast(train().p)  # parameters, a fixed size


def _load(shared: Broadcast) -> Tagger:
    model = Tagger.__new__(Tagger)
    model.p = shared.value
    return model


def detect(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, and base and spans: arrays of (kind, start, end), in code points."""
    shared = _model(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _load(shared)
        for batch in batches:
            for part, _, _ in slices(batch, text):
                found = find(model, [t or "" for t in part.column(text).to_pylist()])
                lists = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f[k]] for f in found], span) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *lists], names=[*keep, "base", "spans"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema_of(docs, keep, f"base {kind}, spans {kind}"))


def blank(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with [KIND] for each span; overlapping spans become one, named by the first."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with personal data replaced by the names of its kinds; n_chars follows the text."""
    columns, shared = docs.columns, _model(docs.sparkSession)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _load(shared)
        for batch in batches:
            for part, _, _ in slices(batch, text):
                texts = part.column(text).to_pylist()
                found = find(model, [t or "" for t in texts])
                new = pa.array([blank(t, s) if t and s else t for t, (_, s) in zip(texts, found)], pa.string())
                yield pa.RecordBatch.from_arrays([new if c == text else part.column(c) for c in columns], names=columns)

    out = docs.mapInArrow(rewrite, docs.schema)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns and text == "text" else out


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _spell(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_spell("base").cast("binary"), 256).alias("base_sha256"), _spell("spans").alias("spans"))
