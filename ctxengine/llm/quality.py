"""Quality classification by co-training of a content view and a metadata view.

Two logistic classifiers look at different views of a document: its text (hashed character
shapes and words, and a few ratios) and its metadata (language, source and length). Both start
from labelled documents. In each round both views score every document without a label, and each
hands those that it is surest of to the other view as training data. At the end each view is
calibrated on labelled documents that it hasn't seen, a last small model combines the two
calibrated views, and every document is scored.

The pool is the whole corpus but for the labelled documents: its features are a table in the shared
folder, and each round scores it in tasks. What a view hands over of a class in a round, ``handed``
documents, is dealt in turn over the strata (slots of source and language), the surest of each
first, and at least one of each stratum that has any. Labelled documents are a sample of bounded
size, drawn by a hash of the id: about ``labelled``. Scoring covers every whole text.

Defined results: a null or empty text is scored by its metadata and an all-zero content view; null
metadata is a value of its own; labels with a null id or quality are left out; without labels of
both classes every score is the share of good labels, 0.5 if there is none; rows that repeat
an id are scored alike if equal; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, keep, new_path, small_or
from .words import mix64, word_hashes

LABELLED = 8000
ROUNDS = 4
#: Documents of each class that a view hands over in a round at most, and how sure it must be.
HANDED, SURE = 400, 0.95
SHAPES, WORDS = 512, 256
SOURCES, LANGS, LENGTHS = 64, 16, 24
SEED = 11
_SLICE = 256
#: A stratum is dealt over so many tasks before its surest documents are put together.
_SALTS = 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: A row of content features as the table of features holds it: shares in half precision.
_PACKED = np.dtype([("shares", "<f2", SHAPES + WORDS), ("ratios", "<f4", 8)])


@functools.lru_cache(maxsize=1)
def _shape_of() -> np.ndarray:
    """The shape of each code point: lower, upper or other letter, digit, space, line end, or itself."""
    out = np.arange(16, 0x110000 + 16, dtype=np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            out[i] = 3 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 6
        elif c.isspace():
            out[i] = 5 if c == "\n" else 4
    return out


def content_features(texts: list[str | None]) -> np.ndarray:
    """A row for each text: shape trigrams, words and ratios."""
    out = np.zeros((len(texts), SHAPES + WORDS + 8), np.float32)
    for i, (text, words) in enumerate(zip(texts, word_hashes(texts), strict=True)):
        if not text:
            continue
        shape = _shape_of()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        if len(shape) > 2:
            gram = mix64((shape[:-2] << np.uint64(42)) | (shape[1:-1] << np.uint64(21)) | shape[2:]) % np.uint64(SHAPES)
            v = np.bincount(gram.astype(np.int64), minlength=SHAPES) / len(gram)
            out[i, :SHAPES] = np.sqrt(v)
        if len(words):
            v = np.bincount((mix64(words ^ _GOLD) % np.uint64(WORDS)).astype(np.int64), minlength=WORDS) / len(words)
            out[i, SHAPES : SHAPES + WORDS] = np.sqrt(v)
        n, letters, lines = len(shape), int((shape <= 2).sum()), 1 + int((shape == 5).sum())
        distinct = len(np.unique(words))
        out[i, SHAPES + WORDS :] = (
            (shape == 2).sum() / max(1, letters), letters / n, (shape == 3).sum() / n, (shape >= 16).sum() / n,
            distinct / max(1, len(words)), np.log1p(len(words)) / 10, np.log1p(n / lines) / 10, n / max(1, len(words)) / 20,
        )
    return out


def metadata_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    out = np.zeros((len(lang), SOURCES + LANGS + LENGTHS), np.float32)

    @functools.cache
    def place(value: str | None, n: int) -> int:
        return int(word_hashes([f"{value is None}{value}".replace(" ", "_")])[0][0] % np.uint64(n))

    for i, (a, b, c) in enumerate(zip(lang, source, n_chars, strict=True)):
        out[i, place(b, SOURCES)] = 1
        out[i, SOURCES + place(a, LANGS)] = 1
        out[i, SOURCES + LANGS + (LENGTHS - 1 if c is None else min(LENGTHS - 2, int(max(0, c)).bit_length()))] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Logistic:
    """Logistic regression with an L2 penalty, by accelerated gradient descent on scaled features."""

    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 200) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = ((x - mean) / scale).astype(np.float64)
        w, b = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        last = (w, b)
        rate = 4 / (np.linalg.norm(z, 2) ** 2 / len(z) + 1 + penalty * 4) if len(z) < 50 else 4 / (float(np.linalg.eigvalsh(z.T @ z / len(z))[-1]) + 1 + 4 * penalty)
        for t in range(steps):
            k = t / (t + 3)
            vw, vb = w + k * (w - last[0]), b + k * (b - last[1])
            error = _sigmoid(z @ vw + vb) - y
            last = (w, b)
            w, b = vw - rate * (z.T @ error / len(z) + penalty * vw), vb - rate * float(error.mean())
        return cls(w / scale, b - float((w / scale) @ mean))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


@dataclass
class CoTrained:
    content: Logistic
    metadata: Logistic
    calibration: tuple[Logistic, Logistic]
    combined: Logistic
    constant: float | None = None

    def views(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated logits of both views."""
        a, b = self.content.logit(content)[:, None], self.metadata.logit(metadata)[:, None]
        return self.calibration[0].logit(a), self.calibration[1].logit(b)

    def score(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, content, metadata) probabilities of good quality."""
        if self.constant is not None:
            c = np.full(len(content), self.constant)
            return c, c, c
        a, b = self.views(content, metadata)
        return _sigmoid(self.combined.logit(np.stack([a, b], axis=1))), _sigmoid(a), _sigmoid(b)


def co_train(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, pick: Callable, rounds: int = ROUNDS) -> CoTrained:
    """x: the (content, metadata) rows of labelled documents, in a fixed order.

    pick(views, taken) is given the two views' models with their calibrations and, for each view,
    the keys of the documents that it was handed; it returns for each view (keys, its rows, labels).
    """
    calibrate = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[calibrate])) < 2 or len(np.unique(y[~calibrate])) < 2:
        none = Logistic(np.zeros(1), 0.0)
        return CoTrained(none, none, (none, none), none, float(y.mean()) if len(y) else 0.5)
    held = [v[calibrate] for v in x]
    own_x, own_y = [v[~calibrate] for v in x], [y[~calibrate], y[~calibrate]]
    taken: list[list[int]] = [[], []]

    def fit_view(i: int) -> tuple[Logistic, Logistic]:
        model = Logistic.fit(own_x[i], own_y[i])
        return model, Logistic.fit(model.logit(held[i])[:, None], y[calibrate], penalty=1e-6)

    for _ in range(rounds):
        got = pick([fit_view(i) for i in (0, 1)], taken)
        if not any(len(keys) for keys, _, _ in got):
            break
        for i, (keys, rows, labels) in enumerate(got):
            taken[i] += keys
            own_x[i] = np.concatenate((own_x[i], rows))
            own_y[i] = np.concatenate((own_y[i], labels))
    content, a = fit_view(0)
    metadata, b = fit_view(1)
    out = CoTrained(content, metadata, (a, b), a)
    out.combined = Logistic.fit(np.stack(out.views(*held), axis=1), y[calibrate], penalty=1e-6)
    return out


def _features(docs: DataFrame) -> DataFrame:
    """(key, id, content, metadata) of every row, with packed features, as a table in the shared folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b = whole.slice(at, _SLICE)
                c = content_features(b.column("text").to_pylist())
                m = metadata_features(*(b.column(x).to_pylist() for x in ("lang", "source", "n_chars"))).astype(np.uint8)
                packed = np.empty(len(c), _PACKED)
                packed["shares"], packed["ratios"] = c[:, : SHAPES + WORDS], c[:, SHAPES + WORDS :]
                yield pa.record_batch([b.column("key"), b.column("id"), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array([r.tobytes() for r in m], pa.binary())], names=["key", "id", "content", "metadata"])

    keyed = docs.withColumn("key", F.xxhash64("id", "text", "lang", "source", "n_chars"))
    out = keyed.transform(in_batches, work, "key long, id long, content binary, metadata binary")
    path = new_path(docs.sparkSession, "quality-features")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def _unpack(content: list[bytes], metadata: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    packed = np.frombuffer(b"".join(content), _PACKED)
    return np.concatenate((packed["shares"].astype(np.float32), packed["ratios"]), axis=1), np.frombuffer(b"".join(metadata), np.uint8).reshape(-1, SOURCES + LANGS + LENGTHS).astype(np.float32)


def surest(features: DataFrame, labelled: DataFrame, views: list[tuple[Logistic, Logistic]], taken: list[list[int]], handed: int = HANDED, sure: float = SURE) -> DataFrame:
    """(view, label, key): what each view is to be handed by the other, of all rows of features whose id isn't in labelled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _unpack(b.column("content").to_pylist(), b.column("metadata").to_pylist())
            p = [np.round(_sigmoid(calibration.logit(model.logit(v)[:, None])), 9) for (model, calibration), v in zip(views, x, strict=True)]
            stratum = x[1][:, :SOURCES].argmax(axis=1) * LANGS + x[1][:, SOURCES : SOURCES + LANGS].argmax(axis=1)
            for i in (0, 1):
                for label, confidence in ((1, p[i]), (0, 1 - p[i])):
                    rows = np.flatnonzero(confidence >= sure)
                    n = len(rows)
                    yield pa.record_batch([b.column("key").take(pa.array(rows)), b.column("id").take(pa.array(rows)), pa.array(np.full(n, 1 - i, np.int32)), pa.array(np.full(n, label, np.int32)), pa.array(stratum[rows].astype(np.int32)), pa.array(confidence[rows])], names=["key", "id", "view", "label", "stratum", "sure"])

    out = features.transform(in_batches, work, "key long, id long, view int, label int, stratum int, sure double").join(labelled, "id", "left_anti").drop("id")
    seen = [(i, k) for i in (0, 1) for k in taken[i]]
    if seen:
        out = out.join(F.broadcast(features.sparkSession.createDataFrame(seen, "view int, key long")), ["view", "key"], "left_anti")
    order = [F.desc("sure"), F.xxhash64(F.lit(SEED), "key"), "key"]
    top = lambda df, by: df.withColumn("n", F.dense_rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n") <= handed)
    # equal rows count once; a stratum's surest are found in parts first, so that no task gets all of a large one
    group = ["view", "label", "stratum"]
    out = top(out.withColumn("salt", F.pmod("key", F.lit(_SALTS))), [*group, "salt"]).dropDuplicates([*group, "key"])
    turn = top(out, group)
    last = Window.partitionBy("view", "label").orderBy("n", *order)
    return turn.withColumn("place", F.row_number().over(last)).where((F.col("place") <= handed) | (F.col("n") == 1)).select("view", "label", "key")


def _base(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", labelled: int = LABELLED) -> CoTrained:
    """Trains on about ``labelled`` labelled documents and on all others of the corpus."""
    given = keep(labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y")), "quality-labels")
    features = _features(_base(docs, id_col))
    n = given.count()
    some = given.where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1_000_000)) < F.lit(1_000_000 if n <= labelled else int(1e6 * labelled / n)))
    known = features.join(F.broadcast(some), "id").orderBy("y", "id", "content").collect()  # bounded by the parameter
    # labelled rows in the order of a hash, so that the calibration fold is a fair draw
    known.sort(key=lambda r: (int(mix64(np.array([r["id"]], np.int64).view(np.uint64))[0]), r["y"]))
    matrices = lambda rows: _unpack([r["content"] for r in rows], [r["metadata"] for r in rows])
    ids = small_or(given.select("id"))

    def pick(views: list[tuple[Logistic, Logistic]], taken: list[list[int]]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        chosen = keep(surest(features, ids, views, taken), "quality-handed")
        rows = features.join(F.broadcast(chosen), "key").dropDuplicates(["view", "label", "key"]).orderBy("view", "label", "key").collect()  # a few hundred of a class, one of a stratum at least
        out = []
        for i in (0, 1):
            own = [r for r in rows if r["view"] == i]
            out.append(([r["key"] for r in own], matrices(own)[i], np.array([float(r["label"]) for r in own])))
        return out

    return co_train(matrices(known), np.array([float(r["y"] > 0) for r in known]), pick)


def score(docs: DataFrame, model: CoTrained, id_col: str = "doc_id") -> DataFrame:
    """(id, quality, p_content, p_metadata) for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b = whole.slice(at, _SLICE)
                c = content_features(b.column("text").to_pylist())
                m = metadata_features(*(b.column(x).to_pylist() for x in ("lang", "source", "n_chars")))
                yield pa.record_batch([b.column("id"), *(pa.array(np.round(p, 9)) for p in model.score(c, m))], names=["id", "quality", "p_content", "p_metadata"])

    return _base(docs, id_col).transform(in_batches, work, "id long, quality double, p_content double, p_metadata double").withColumnRenamed("id", id_col)
