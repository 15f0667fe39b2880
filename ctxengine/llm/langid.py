"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector is the elementwise product
(binding) of its letters' vectors, each rotated by its distance from the end (permutation). A
document is the sum (bundling) of the vectors of its n-grams, a language prototype the sum
over its training documents, and a document gets the language whose prototype has the
greatest cosine with it.

Bundling is linear, so a batch of documents is a matrix of n-gram counts times the matrix of
n-gram vectors. Prototypes are bundled in each task and added up in Spark: the driver gets
one vector for each language.

Defined results: text is lowered, runs of other characters than letters are one blank;
a null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing
was learned; of equal cosines the language that is first in code-point order wins; rows that
repeat are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches

DIMENSIONS = 512
GRAM = 3
SEED = 1009
UNKNOWN = "und"
#: What known_language() asks of a text of so many characters or more. At sf0.1 texts of 100 words and more have 0.23 at least, random letters and
#: languages that were not learned at most 0.12; shorter texts have too few n-grams to tell.
LEAST, SURE_FROM = 0.12, 300
#: Characters handled at once; longer texts are bundled in parts, without loss.
CHUNK = 1 << 19
_CELLS = 1 << 21


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@functools.lru_cache(maxsize=8192)
def _letter_vector(code: int, dimensions: int) -> np.ndarray:
    return (np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, dimensions, np.int8) * 2 - 1).astype(np.int8)


def codes(text: str | None) -> np.ndarray:
    """Code points of the lowered letters, runs of anything else as one 0, a 0 at either end; empty without a letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[c], c, 0)
    c = np.concatenate(([0], c, [0]))
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    return c.astype(np.int64) if len(c) > 1 else c[:0].astype(np.int64)


class Bundler:
    """Adds up the n-gram vectors of rows."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def _vectors(self, alphabet: np.ndarray, grams: np.ndarray) -> np.ndarray:
        letters = np.stack([_letter_vector(int(c), self.dimensions) for c in alphabet])
        n, out = len(alphabet), None
        for back in range(GRAM):  # the last letter is not rotated, the one before it once, ...
            part = np.roll(letters, back, axis=1)[grams // n**back % n]
            out = part if out is None else out * part
        return out.astype(np.float32)

    def bundle(self, parts: list[tuple[int, np.ndarray]], rows: int) -> np.ndarray:
        """A float64 vector for each row; parts are (row, codes)."""
        out = np.zeros((rows, self.dimensions))
        parts = [(r, c) for r, c in parts if len(c) >= GRAM]
        if not parts:
            return out
        flat = np.concatenate([c for _, c in parts])
        alphabet, flat = np.unique(flat, return_inverse=True)
        n = len(alphabet)
        keys = np.zeros(len(flat) - GRAM + 1, np.int64)
        for i in range(GRAM):
            keys = keys * n + flat[i : len(flat) - GRAM + 1 + i]
        lengths = np.array([len(c) for _, c in parts])
        ends = np.cumsum(lengths)
        inside = np.ones(len(keys), bool)
        for back in range(1, GRAM):
            inside[(ends[:-1] - back)] = False  # grams across two parts
        row = np.repeat(np.array([r for r, _ in parts]), lengths)[: len(keys)]
        keys, row = keys[inside], row[inside]
        if n**GRAM <= _CELLS:
            there = np.flatnonzero(np.bincount(keys, minlength=n**GRAM))
            place = np.zeros(n**GRAM, np.int64)
            place[there] = np.arange(len(there))
            at = place[keys]
        else:
            there, at = np.unique(keys, return_inverse=True)
        wide = 16384  # n-gram vectors held at once
        for low in range(0, len(there), wide):
            vectors = self._vectors(alphabet, there[low : low + wide])
            u = len(vectors)
            step = max(1, _CELLS // u)
            mine = (at >= low) & (at < low + u) if len(there) > wide else slice(None)
            r, a = row[mine], at[mine] - low
            for first in range(0, rows, step):
                count = min(step, rows - first)
                if count < rows:
                    here = (r >= first) & (r < first + count)
                    cells = (r[here] - first) * u + a[here]
                else:
                    cells = r * u + a
                if len(cells):
                    out[first : first + count] += np.bincount(cells, minlength=count * u).astype(np.float32).reshape(count, u) @ vectors
        return out


def _pieces(c: np.ndarray) -> Iterator[np.ndarray]:
    """A text's codes in parts that overlap by a gram less one, so that no gram is lost or counted twice."""
    for at in range(0, max(1, len(c) - GRAM + 1), CHUNK):
        yield c[at : at + CHUNK + GRAM - 1]


def _bundled(texts: list[str | None], row_of: list[int], rows: int, bundler: Bundler) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of rows, and which texts have a letter."""
    out, held, size, has = np.zeros((rows, bundler.dimensions)), [], 0, np.zeros(len(texts), bool)
    low = 0
    for i, text in enumerate(texts):
        c = codes(text)
        has[i] = len(c) > 0
        for part in _pieces(c):
            held.append((row_of[i], part))
            size += len(part)
            if size > CHUNK:
                high = row_of[i] + 1 if rows == len(texts) else rows
                out[low:high] += bundler.bundle([(r - low, p) for r, p in held], high - low)
                held, size = [], 0
                low = row_of[i] if rows == len(texts) else 0
    if held:
        out[low:rows] += bundler.bundle([(r - low, p) for r, p in held], rows - low)
    return out, has


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """A vector for each non-null language of docs, bundled over all its texts."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(dimensions), {}
        for b in batches:
            langs = b.column(0).to_pylist()
            names = sorted(set(langs))
            vectors, _ = _bundled(b.column(1).to_pylist(), [names.index(x) for x in langs], len(names), bundler)
            for name, v in zip(names, vectors, strict=True):
                sums[name] = sums.get(name, 0) + v
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.astype(np.int64).tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).transform(in_batches, learn, "lang string, v array<long>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    return {r["lang"]: np.array([float(x["x"]) for x in r["v"]]) for r in sorted(found, key=lambda r: r["lang"])}


def identify(docs: DataFrame, learned: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, lang_pred, score) for every row; more columns of docs are not handed on."""
    return _scored(docs, F.col(id_col), text_col, learned, dimensions).withColumnRenamed("carried", id_col)


def known_language(docs: DataFrame, learned: dict[str, np.ndarray], text_col: str = "text", least: float = LEAST, sure_from: int = SURE_FROM, dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows of docs, all columns, whose language is known: with a score of at least ``least`` if the text has ``sure_from`` characters or more.

    Texts without a letter go; nothing else goes where nothing was learned.
    """
    out = _scored(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)), text_col, learned, dimensions)
    if learned:
        short = F.length(F.col("carried")[text_col]) < sure_from
        return out.where((F.col("lang_pred") != UNKNOWN) & (short | (F.col("score") >= least))).select("carried.*")
    return docs.where(F.col(text_col).rlike(r"\p{L}"))


def _scored(docs: DataFrame, carried: Column, text_col: str, learned: dict[str, np.ndarray], dimensions: int) -> DataFrame:
    """(carried, lang_pred, score)."""
    kept = {k: v / norm for k, v in learned.items() if (norm := np.linalg.norm(v)) > 0}
    names, matrix = list(kept), np.array(list(kept.values())).reshape(len(kept), dimensions)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler(dimensions)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                texts = b.column(1).to_pylist()
                vectors, has = _bundled(texts, list(range(len(texts))), len(texts), bundler)
                norms = np.linalg.norm(vectors, axis=1)
                lang, cos = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if names:
                    every = np.round(vectors @ matrix.T / np.where(norms > 0, norms, 1)[:, None], 12)
                    best = every.argmax(axis=1)
                    lang = [names[i] if h else UNKNOWN for i, h in zip(best, has, strict=True)]
                    cos = np.where(has, np.clip(every[np.arange(len(texts)), best], 0, 1), 0.0)
                yield pa.record_batch([b.column(0), pa.array(lang, pa.string()), pa.array(cos)], names=["carried", "lang_pred", "score"])

    rows = docs.select(carried.alias("carried"), F.col(text_col).alias("text"))
    return rows.transform(in_batches, score, T.StructType([rows.schema["carried"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
