"""Language identification with a string kernel.

The kernel of two texts is the blended-spectrum presence kernel: the number of
distinct character n-grams (n = 1..3, lower-cased, hashed to BITS bits) that
both hold, over the geometric mean of their own numbers. A text is described by
its kernel values to a set of landmark texts (Nyström): K(x, L) W^-1/2 with
W = K(L, L). On top, one-versus-rest kernel ridge regression in closed form.
Scoring multiplies a batch's presence matrix with the landmarks' and the result
with the fitted coefficients.

The model learns from at most PER_LANGUAGE texts of each language, those with the
smallest hashes of id and text (a parameter). Whole texts become presence rows, of a
fixed size, on the executors; only these reach the driver. Every text is scored
whole, and by itself: its score doesn't depend on what it is scored with.

Edge cases: a text that is null or has no letter (Unicode category L) is `und` with
score 0; a missing language is not learned from; with no training row at all every
text is `und`; languages that tie are taken in alphabetical order; repeated rows get
equal rows; a text of any length is one presence row; an empty table gives no rows;
extra columns are ignored by the query and kept by ``reject``, whatever their names.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import held_out, prepare, schema_of, slices, smallest_hashes, table, unused

GRAMS, BITS = (1, 2, 3), 13
PER_LANGUAGE, LANDMARKS, RIDGE = 300, 192, 1e-3
#: The pipeline drops a text whose likeness (that of its words without digits, if higher) is below FOREIGN, or below DOUBTFUL where the best score is
#: less than MARGIN of the way from 1/k (k languages) to 1. Set on rows of sf0.1 that were not learned from, whole and cut
#: to 6 to 200 characters.
FOREIGN, DOUBTFUL, MARGIN = 0.15, 0.3, 0.2
#: A model of fewer texts knows too little to drop any for being unlike them.
LEAST = 100
#: A text of fewer n-grams can't be as near to a landmark: its kernel is over sqrt(n-grams / SHORT).
SHORT = 200
_FIGURE = re.compile(r"[\d@=]")


def has_letter(text: str | None) -> bool:
    """Whether a text holds a character of Unicode category L."""
    return text is not None and any(map(str.isalpha, text))


def presence(texts: list[str], grams: tuple[int, ...] = GRAMS, bits: int = BITS) -> np.ndarray:
    """Rows of 0/1: which hashed n-grams a text holds, a block of 2^bits for each n."""
    width = len(grams) << bits
    out = np.zeros(len(texts) * width, np.uint8)
    low = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, low), np.int64, len(low))
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    base = np.repeat(np.arange(len(low)) * width, lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(code))  # characters to the end of the text
    h = np.zeros(len(code), np.uint32)
    for n in range(1, max(grams) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ code[n - 1 :]) * np.uint32(0x01000193)
        if n in grams:
            cell = base[:m] + ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits)) + (grams.index(n) << bits)
            out[cell[left[:m] >= n]] = 1
    return out.reshape(len(texts), width)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared n-grams over the geometric mean of own n-grams."""
    own = lambda x: np.sqrt(np.maximum(x.sum(axis=1, dtype=np.float32), 1))
    return (a.astype(np.float32) @ b.astype(np.float32).T) / own(a)[:, None] / own(b)[None, :]


def _reach(x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Kernel to the nearest landmark, for a short text over what it can reach."""
    return near.max(axis=1) / np.minimum(1, np.sqrt(np.maximum(x.sum(axis=1, dtype=np.float32), 1) / SHORT))


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray
    coefficients: np.ndarray  # landmarks -> languages, W^-1/2 folded in
    offset: np.ndarray
    learned: int = 0  # texts

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ridge outputs, one column a language; near 1 for the right one, 0 for others. They sum to 1 for any text, so how
        like the learned texts it is comes beside them: the kernel to the nearest landmark, for short texts over what they can reach."""
        out, like = [np.zeros((0, len(self.languages)))], [np.zeros(0)]
        for k in range(0, len(texts), 256):
            x = presence(texts[k : k + 256])
            near = kernel(x, self.landmarks)
            # Each row is summed by itself: a matrix product's last digits depend on the rows beside it.
            out.append(np.round((near.astype(np.float64)[:, :, None] * self.coefficients).sum(axis=1) + self.offset, 9))
            like.append(_reach(x, near))
        like = np.concatenate(like)
        low = np.flatnonzero(like < DOUBTFUL)
        for part in np.array_split(low, len(low) // 256 + 1):  # numbers, addresses and keys are of no language
            x = presence([" ".join(w for w in texts[i].split() if not _FIGURE.search(w)) for i in part])
            like[part] = np.maximum(like[part], _reach(x, kernel(x, self.landmarks)))
        return np.concatenate(out), like

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and likeness of each text."""
        lang, score, likeness = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return lang, score, likeness
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        raw, like = self.scores([texts[i] for i in known])
        best = raw.argmax(axis=1) if len(known) else []
        for i, b, r, near in zip(known, best, raw, like):
            lang[i] = self.languages[b]
            score[i] = float(min(1.0, max(0.0, r[b])))
            likeness[i] = float(near)
        return lang, score, likeness


def fit(x: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """From presence rows and their languages. Landmarks are dealt evenly among the languages, in the order given."""
    names = sorted(set(languages))
    if not names:
        return LanguageModel([], np.zeros((0, 0), np.uint8), np.zeros((0, 0)), np.zeros(0))
    label = np.array([names.index(v) for v in languages])
    each = max(1, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(label == c)[:each] for c in range(len(names))])
    marks = x[chosen]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # W^-1/2 on its range
    z = kernel(x, marks) @ root
    y = np.eye(len(names))[label]
    weight = (len(label) / (len(names) * np.bincount(label, minlength=len(names))))[label]  # languages count alike
    zm, ym = np.average(z, axis=0, weights=weight), np.average(y, axis=0, weights=weight)
    zc = z - zm
    a = np.linalg.solve((zc * weight[:, None]).T @ zc + ridge * len(label) * np.eye(z.shape[1]), (zc * weight[:, None]).T @ (y - ym))
    return LanguageModel(names, marks, root @ a, ym - zm @ a, len(label))


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """lang, turn, id and the packed presence row of the texts to learn from, and of some more."""
    able = docs.filter(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    able = able.select(F.col(key).cast("string").alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("turn"))
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch):
                texts = part.column("text").to_pylist()
                for k in range(0, len(texts), 256):
                    piece = part.slice(k, 256)
                    piece = piece.filter(pa.array([has_letter(t) for t in piece.column("text").to_pylist()], pa.bool_()))
                    rows = [r.tobytes() for r in np.packbits(presence(piece.column("text").to_pylist()), axis=1)]
                    yield pa.RecordBatch.from_arrays([piece.column("lang"), piece.column("turn"), piece.column("id"), pa.array(rows, pa.binary())], names=["lang", "turn", "id", "row"])

    few = smallest_hashes(able, "turn", per_language, "lang").dropDuplicates(["id", "lang", "turn"])
    return few.select("lang", "turn", "id", "text").mapInArrow(run, "lang string, turn long, id string, row binary")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, **columns: str) -> LanguageModel:
    """What is collected is a few kilobytes for each of some four times ``per_language`` texts of a language."""
    rows = sorted(training_rows(docs, per_language, **columns).collect(), key=lambda r: (r["lang"], r["turn"] % (1 << 40), r["turn"], r["id"]))
    chosen = [r for _, own in itertools.groupby(rows, key=lambda r: r["lang"]) for r in itertools.islice(own, per_language)]
    width = len(GRAMS) << BITS
    x = np.unpackbits(np.frombuffer(b"".join([r["row"] for r in chosen]), np.uint8)).reshape(len(chosen), width) if chosen else np.zeros((0, width), np.uint8)
    return fit(x, [r["lang"] for r in chosen])


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "likeness")) -> DataFrame:
    """The kept columns, then language, score and likeness under the names of ``out``."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x n-grams bytes, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch, text):
                lang, *measures = shared.value.predict(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(lang, pa.string()), *[pa.array(m, pa.float64()) for m in measures]], names=[*keep, *out])

    columns = list(dict.fromkeys([*keep, text]))
    return docs.select(*[f"`{c}`" for c in columns]).mapInArrow(run, schema_of(docs, keep, "`{}` string, `{}` double, `{}` double".format(*out)))


def reject(docs: DataFrame) -> DataFrame:
    """The documents without those that have no letter or resemble no language learned.

    A language that shares alphabet and many n-grams with a learned one may still
    pass; with one language there is no margin and FOREIGN alone decides; with
    fewer than LEAST texts learned from every text with a letter stays.
    """
    model, keep = train(docs), docs.columns
    if model.learned < LEAST:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    taken = list(keep)
    names = tuple(taken.append(n := unused(c, taken)) or n for c in ("lang_pred", "score", "likeness"))
    lang, score, like = map(F.col, names)
    k = len(model.languages)
    unsure = (score * k - 1 < MARGIN * (k - 1)) if k > 1 else F.lit(False)
    strange = (like < FOREIGN) | (unsure & (like < DOUBTFUL))
    return identify(docs, model, keep, out=names).filter((lang != "und") & ~strange).select(*[f"`{c}`" for c in keep])


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, train(docs), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
