"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

All documents are tokenised in Spark; only the histogram of piece lengths (at most ``room``
numbers, whatever the corpus) reaches the driver. There the instance is reduced: a set of
pieces that holds a piece j is fixed for good where it dominates every other set that could
hold j. What remains is packed by best fit in decreasing order, bins of equal residual
being handled together. The plan is a table of (length, ranks from, to, sequence, offset),
bounded by the lengths as well, and Spark assigns each piece its place by its rank among the
pieces of its length.

Defined results: a null or empty text is the single end id; only documents longer than the
room are cut; repeated rows are packed as often as they occur; an empty table gives an empty
result.
"""

from __future__ import annotations

import codecs
import functools
import string
import zlib
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, keep

ROOM = 4096
END_ID = 1
#: Chunks whose ids a worker remembers before they become the older ones; as many older ones are kept, and what is met again is taken over.
REMEMBERED = 100_000
#: Marks that may end a word; an apostrophe may be part of a piece.
ENDS = string.punctuation.replace("'", "")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


class WordIds(dict):
    """Ids of a white-space-free chunk of text as little-endian bytes, worked out once for each chunk.

    The tokenizer never joins characters across white space, so the ids of a text are those
    of its chunks; nor does it join letters and the marks behind them, so a word with such an end has the ids of both.
    Chunks in Latin-1 skip the tokenizer's text pipeline: lower case, its
    pre-tokenizer pattern and its byte alphabet are applied here and only its BPE model is called.
    A text with the string of a special token goes to the tokenizer whole, which gives that
    token's id.
    """

    remembered = REMEMBERED

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # The pre-tokenizer's pattern.
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.alphabet = "".join(alphabet[b] for b in range(256))
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # these, and characters that are white space to Python but not to the tokenizer
        self.marks = ["\x1c", "\x1d", "\x1e", "\x1f", *special]

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.get(chunk)
        if out is None:
            word = chunk.rstrip(ENDS)
            out = self[word] + self[chunk[len(word) :]] if word != chunk and word.isalpha() and ord(word[-1]) < 256 else self._ids(chunk)
        if len(self) >= self.remembered:
            self.older = dict(self)
            self.clear()
        self[chunk] = out
        return out

    def _ids(self, chunk: str) -> bytes:
        try:
            chunk.encode("latin-1")
        except UnicodeEncodeError:
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        ids, lower = [], chunk.lower()
        for part in [lower] if lower.isalpha() else self.parts(lower):
            word = part if part.isascii() and part.isprintable() else codecs.charmap_decode(part.encode(), "strict", self.alphabet)[0]
            ids += [t.id for t in self.model.tokenize(word)]
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        if any(mark in text for mark in self.marks):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))


@functools.lru_cache(maxsize=1)
def _words(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, room: int = ROOM, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the end id, cut at the room."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _words(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = memoryview(words.encode(text.as_py() or "") + end)
                for i, at in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[at : at + 4 * room]
                    rows.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(in_batches, cut, PIECES)


def reduce_instance(counts: dict[int, int], room: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """Fixed bins as (lengths, how many such bins), and what is left of the instance.

    For the largest piece j and what still fits beside it, a set is fixed if it dominates all
    sets with j: j alone if nothing fits; j and k if k fills the bin, or if whatever fits
    beside j (no three pieces do) sums to no more than the largest single k that fits.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    fixed: list[tuple[list[int], int]] = []

    def fix(lengths: list[int], n: int) -> None:
        fixed.append((lengths, n))
        for x in lengths:
            left[x] -= n
            if not left[x]:
                del left[x]

    again = True
    while again:
        again = False
        for j in sorted(left, reverse=True):
            if j not in left:
                continue
            gap = room - j
            if gap == 0 or min(left) > gap or (sum(left.values()) == 1):
                fix([j], left[j])
                again = True
                continue
            if gap in left and (gap != j or left[j] > 1):  # fills the bin: whatever else fits beside j fits into k
                fix([j, gap], left[j] // 2 if gap == j else min(left[j], left[gap]))
                again = True
                if j not in left:
                    continue
            others = left if left[j] > 1 or j > gap else {k: v for k, v in left.items() if k != j}
            sizes = sorted(others)
            smallest: list[int] = []
            for s in sizes:
                smallest += [s] * min(3 - len(smallest), others[s])
                if len(smallest) == 3:
                    break
            if len(smallest) == 3 and sum(smallest) <= gap:
                continue
            fitting = [s for s in sizes if s <= gap]
            if not fitting:
                continue
            k = fitting[-1]
            best, lo, hi = 0, 0, len(fitting) - 1
            while lo <= hi:
                pair = fitting[lo] + fitting[hi]
                if pair <= gap:
                    if lo != hi or others[fitting[lo]] > 1:
                        best = max(best, pair)
                    lo += 1
                else:
                    hi -= 1
            if best <= k:
                n = left[j] // 2 if k == j else min(left[j], left[k])
                if n:
                    fix([j, k], n)
                    again = True
    return fixed, left


def best_fit(counts: dict[int, int], room: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit in decreasing order over a histogram: bins as ([(length, how often in a row)], how many such bins)."""
    open_bins: dict[int, list[list]] = defaultdict(list)  # residual -> [contents, how many]
    residuals: list[int] = []

    def put(residual: int, contents: list[tuple[int, int]], n: int) -> None:
        if residual not in open_bins:
            residuals.insert(bisect_left(residuals, residual), residual)
        open_bins[residual].append([contents, n])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(residuals, size)
            if at == len(residuals):
                each = room // size
                whole, rest = divmod(n, each)
                if whole:
                    put(room - each * size, [(size, each)], whole)
                if rest:
                    put(room - rest * size, [(size, rest)], 1)
                break
            residual = residuals[at]
            groups = open_bins[residual]
            contents, have = groups[-1]
            each = residual // size  # a bin just filled further stays the best fit for the next piece
            full = min(n // each, have)
            if full:
                used, took, bins = each * full, each, full
            else:
                used, took, bins = n, n, 1
            groups[-1][1] -= bins
            if not groups[-1][1]:
                groups.pop()
                if not groups:
                    del open_bins[residual]
                    residuals.pop(at)
            put(residual - took * size, [*contents, (size, took)], bins)
            n -= used
    return [(contents, n) for groups in open_bins.values() for contents, n in groups]


def plan(counts: dict[int, int], room: int = ROOM) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, sequence of that rank, offset, how often in a row), and the number of sequences."""
    fixed, left = reduce_instance(counts, room)
    bins = [([(x, 1) for x in lengths], n) for lengths, n in fixed] + best_fit(left, room)
    next_rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for contents, n in bins:
        offset = 0
        for size, times in contents:
            rows.append((size, next_rank[size], sequence, offset, times))
            next_rank[size] += n * times
            offset += size * times
        sequence += n
    if {k: v for k, v in next_rank.items() if v} != {k: v for k, v in counts.items() if v}:
        raise AssertionError("the plan does not hold every piece once")
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def pack(cut: DataFrame, room: int = ROOM) -> DataFrame:
    """pieces() with (sequence_id, offset). cut is read more than once, so it should be a kept table."""
    counts = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # at most room rows
    rows, _ = plan(counts, room)
    starts = rows[:, 0] * (1 << 44) + rows[:, 1] if len(rows) else rows
    total = sum(counts.values())
    # ranks within a length: its pieces are dealt into buckets, ranked there, and shifted by the buckets before
    buckets = max(64, total // 100_000)
    dealt = cut.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = (
        dealt.groupBy("length", "b").count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "b", F.coalesce("before", F.lit(0)).alias("before"))
    )
    order = Window.partitionBy("length", "b").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("rn", F.row_number().over(order) - 1).join(before, ["length", "b"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(starts, size * (1 << 44) + rank, side="right") - 1
            _, first, sequence, offset, times = rows[at].T
            step = rank - first
            columns = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*columns, pa.array(sequence + step // times), pa.array(offset + step % times * size)], names=[*(f.split()[0] for f in PLACED.split(", "))])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rn")).cast("long").alias("rank")).transform(in_batches, place, PLACED)


def pack_documents(docs: DataFrame, tokenizer_path: str, room: int = ROOM, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(keep(pieces(docs, tokenizer_path, room, end_id, id_col, text_col), "pack-pieces"), room)
