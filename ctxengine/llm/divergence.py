"""Source divergence audit: how far apart the term distributions of the sources of a language are.

A language's vocabulary is the terms in at least ``least`` of its documents, cut into chunks by
a hash. The counts of each group (a source in a language) are packed, one vector for each chunk. Groups are
dealt into blocks, and every packed vector is copied to the tiles (pairs of blocks) of its block: a task
holds one tile, reads its vectors chunk after chunk, and adds up the pair submatrix of distances in
exact integers, so memory is bounded by two blocks of one chunk. Chunks in which neither block
has a term need no row: what they add follows from their number of terms.

With count the occurrences of a term in a group, N the group's sum over kept terms and V their number,
p = 1 + floor(10**9 (count + 5) / (N + 5 V)). ``pair`` rows give, for each other source of the
language, the sum of |p - q|; ``term`` rows the ``top`` terms by which a group exceeds its language.

Defined results: null text, lang and source are ''; repeated rows count as often as they occur; a language without a
kept term has pairs at distance 0 and no terms; a language with one source has no pair; further
columns are not read; an empty table gives an empty result. N + 5 V must stay below 9 * 10**15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, join_skewed, keep, small_or

LEAST, TOP = 30, 50
#: Terms in a chunk of the vocabulary, groups in a block.
CHUNK, BLOCK = 4096, 32
#: Distinct terms that a task holds before it hands its counts on.
HELD = 400_000

#: Bytes of a text as its terms are read: letters as they are, A-Z lower-cased, all other ASCII as white space.
_TERM_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): counts of each task, several rows for a term that several tasks have."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, within) in held.items():
                terms = list(n)
                for at in range(0, len(terms), 50_000):
                    some = terms[at : at + 50_000]
                    yield pa.record_batch(
                        [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array([n[t] for t in some], pa.int64()), pa.array([within[t] for t in some], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            held.clear()

        size = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                n, within = held.setdefault((lang, source), (Counter(), Counter()))
                terms = text.as_buffer().to_pybytes().translate(_TERM_BYTES).split()
                size -= len(n)
                n.update(terms)
                within.update(set(terms))
                size += len(n)
                if size > HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    empty = lambda c, kind="string": F.coalesce(F.col(c).cast(kind), F.lit("").cast(kind))
    read = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col, "binary").alias("text"))
    return in_batches(read, work, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))


def _p(count: str, total: str, v: str = "v") -> Column:
    return F.expr(f"1 + (cast(1000000000 as decimal(10, 0)) * cast({count} + 5 as decimal(20, 0))) div cast({total} + 5 * {v} as decimal(20, 0))")


def probabilities(count: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(10**9 (count + 5) / (total + 5 v)), by long division in three digits to the base of 1,000."""
    b = np.asarray(total, np.int64) + 5 * v
    if not v:
        return np.zeros(np.broadcast(count, b).shape, np.int64)
    out, rest = np.divmod(np.asarray(count, np.int64) + 5, b)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, b)
        out = out * 1000 + digit
    return out + 1


class Tile:
    """The distances between the groups of two blocks, chunk by chunk. All groups are named before the first vector."""

    def __init__(self, i: int, j: int, v: int):
        self.i, self.j, self.v, self.seen = i, j, v, 0
        self.names: dict[int, str] = {}
        self.totals: dict[int, int] = {}
        self.vectors: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.chunk, self.terms = None, 0
        self.sums = None

    def _begin(self) -> None:
        self.groups = [sorted(n for n in self.names if n // BLOCK == k) for k in (self.i, self.j)]
        self.none = [probabilities(0, np.array([self.totals[n] for n in b], np.int64), self.v) for b in self.groups]
        self.sums = np.zeros([len(b) for b in self.groups], np.int64)

    def add(self, chunk: int, terms: int, number: int, at: np.ndarray, n: np.ndarray) -> None:
        if self.chunk != chunk:
            self._end_chunk()
            self.chunk, self.terms = chunk, terms
        self.vectors[number] = at, n

    def _end_chunk(self) -> None:
        if self.sums is None:
            self._begin()
        if self.chunk is None:
            return
        dense = []
        for block, none in zip(self.groups, self.none, strict=True):
            p = np.repeat(none[:, None], self.terms, axis=1)
            for k, number in enumerate(block):
                if number in self.vectors:
                    at, n = self.vectors[number]
                    p[k, at] = probabilities(n, self.totals[number], self.v)
            dense.append(p)
        for k, p in enumerate(dense[0]):
            self.sums[k] += np.abs(p - dense[1]).sum(axis=1)
        self.seen += self.terms
        self.chunk, self.vectors = None, {}

    def rows(self) -> Iterator[tuple[str, str, int]]:
        self._end_chunk()
        sums = self.sums + np.abs(self.none[0][:, None] - self.none[1][None, :]) * (self.v - self.seen)
        for a, x in enumerate(self.groups[0]):
            for b, y in enumerate(self.groups[1]):
                if x != y:
                    yield self.names[x], self.names[y], int(sums[a, b])
                    if self.i != self.j:
                        yield self.names[y], self.names[x], int(sums[a, b])


def _submatrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile and chunk; chunk -1 names the groups of a tile."""
    now, tile = None, None

    def done() -> Iterator[pa.RecordBatch]:
        out = list(tile.rows()) if tile else []
        for at in range(0, len(out), 50_000):
            source, item, value = zip(*out[at : at + 50_000], strict=True)
            yield pa.record_batch([pa.array([now[0]] * len(source), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])

    for b in batches:
        plain = zip(*(b.column(c).to_pylist() for c in ("lang", "i", "j", "chunk", "number", "source", "total", "v", "terms")), strict=True)
        for k, (lang, i, j, chunk, number, source, total, v, terms) in enumerate(plain):
            if now != (lang, i, j):
                yield from done()
                now, tile = (lang, i, j), Tile(i, j, v)
            if chunk < 0:
                tile.names[number], tile.totals[number] = source, total
            else:
                tile.add(chunk, terms, number, *(b.column(c)[k].values.to_numpy() for c in ("at", "n")))
    yield from done()


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    counts = keep(term_counts(docs, text_col, lang_col, source_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "div-counts")
    vocabulary = keep(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("n_rows")).where(F.col("docs") >= least).drop("docs"), "div-terms")
    langs = keep(vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total")), "div-langs")
    in_chunk = Window.partitionBy("lang", "chunk")
    indexed = vocabulary.join(small_or(langs), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / CHUNK)).cast("int"))
    indexed = keep(indexed.select("*", (F.row_number().over(in_chunk.orderBy("term")) - 1).alias("at"), F.count(F.lit(1)).over(in_chunk).alias("terms")), "div-index")
    kept = keep(join_skewed(counts.drop("docs"), indexed, ["lang", "term"], "n_rows", F.col("source"), "inner"), "div-kept")

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source")).distinct()
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(small_or(langs.select("lang", "v")), "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("number"), F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("n_groups"))
    groups = keep(groups, "div-groups")
    few_groups = small_or(groups)

    rank = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    above = kept.join(few_groups.select("lang", "source", "total"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (_p("n", "total") - _p("lang_n", "lang_total")).alias("value")).where("value > 0")
    terms = above.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank().alias("rank")).where(F.col("rank") <= top)

    packed = kept.groupBy("lang", "source", "chunk", "terms").agg(F.collect_list(F.struct("at", "n")).alias("pairs"))
    vectors = packed.join(few_groups, ["lang", "source"]).select("lang", "source", "number", "n_groups", "total", "v", "chunk", "terms", F.col("pairs.at").alias("at"), F.col("pairs.n").alias("n"))
    named = groups.select("lang", "source", "number", "n_groups", "total", "v", F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("terms"), F.array().cast("array<int>").alias("at"), F.array().cast("array<bigint>").alias("n"))
    block = F.floor(F.col("number") / BLOCK).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_groups") - 1) / BLOCK).cast("int")))
    tiles = named.unionByName(vectors).select("*", block.alias("block"), other.alias("other")).select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "chunk", "number", "source", "total", "v", "terms", "at", "n")
    tiles = tiles.repartition("lang", "i", "j").sortWithinPartitions("lang", "i", "j", "chunk", "number")
    pairs = in_batches(tiles, _submatrices, "lang string, source string, item string, value long")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank().alias("rank"))
    return pairs.unionByName(terms)
