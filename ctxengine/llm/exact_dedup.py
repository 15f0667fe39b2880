"""Exact deduplication with counting quotient filters.

Each partition puts the 64-bit fingerprints of its texts into counting quotient filters, one for each
block (a fingerprint's first bits). A filter has 2**q slots: of a fingerprint the next q bits, the quotient,
name its slot, and only the rest, the remainder, is stored. Remainders of one quotient form a run, sorted,
which starts in its slot or behind the run before; a bit for each quotient says whether it has a run, a bit for
each slot whether a run ends there. A count above one stands in the slots behind its remainder, as many as it
needs, told by a third bit. Reading the runs in order gives the fingerprints in order, so filters
of a block merge without loss by two cursors, whatever their sizes. Only fingerprints whose merged
count is above one go on to byte verification, in which the whole normalised texts are compared.

Defined results: a null text counts as empty; texts that differ only in white space are equal, and are
compared whole, however long; rows that repeat a doc_id with the same text share one decision and each count in
group_size; a null doc_id is never kept while another row of its text has an id; further columns, whatever
their names, are carried by drop_copies alone; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, in_batches, join_skewed, keep, small_or

#: Fingerprints that a task holds before it hands its filters on, and that a block of the corpus has, about.
HELD = 1 << 18
#: Bits of a block's name, at least; more where the corpus is larger, so that a merged block stays small.
BLOCK_BITS = 6
LOAD = 0.8
_HEAD = struct.Struct("<BBIQ")
_ONE = np.uint64(1)


def _bits(places: np.ndarray, n: int) -> bytes:
    out = np.zeros(n, bool)
    out[places] = True
    return np.packbits(out, bitorder="little").tobytes()


class QuotientFilter:
    """A counting quotient filter of 64-bit fingerprints that share their first ``prefix`` bits.

    data: header (prefix bits, quotient bits, slots, prefix), a bit for each quotient that has a run, for each slot
    that ends a run, for each slot that is part of a count, and the slots, of as many bytes as a remainder needs.
    """

    def __init__(self, data: bytes):
        self.data = data

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, prefix_bits: int) -> QuotientFilter:
        """From distinct fingerprints in order, with their counts; there is at least one."""
        n = len(fingerprints)
        q = max(3, int(np.ceil(np.log2(n / LOAD))))
        r = 64 - prefix_bits - q
        low = fingerprints & np.uint64((1 << (64 - prefix_bits)) - 1)
        quotient, remainder = (low >> np.uint64(r)).astype(np.int64), low & np.uint64((1 << r) - 1)
        # a count above one is stored less one, in digits of r bits
        over, digits = counts.astype(np.uint64) - _ONE, np.zeros(n, np.int64)
        while (left := over >> np.minimum(np.uint64(r) * digits.astype(np.uint64), np.uint64(63)) > 0).any() and digits.max(initial=0) * r < 63:
            digits += left
        length = 1 + digits
        before = np.cumsum(length) - length
        place = before + np.maximum.accumulate(quotient - before)  # its slot, or the first behind those before it
        slots = max(1 << q, int(place[-1] + length[-1]))
        run_ends = np.flatnonzero(np.append(quotient[1:] != quotient[:-1], True))
        value, extra = np.zeros(slots, np.uint64), []
        value[place] = remainder
        for k in range(int(digits.max(initial=0))):
            some = digits > k
            value[place[some] + 1 + k] = (over[some] >> np.uint64(r * k)) & np.uint64((1 << r) - 1)
            extra.append(place[some] + 1 + k)
        width = -(-r // 8)
        head = _HEAD.pack(prefix_bits, q, slots, int(fingerprints[0]) >> (64 - prefix_bits) if prefix_bits else 0)
        bits = _bits(quotient, 1 << q) + _bits((place + length - 1)[run_ends], slots) + _bits(np.concatenate(extra) if extra else place[:0], slots)
        return cls(head + bits + value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes())

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints in order, counts)."""
        prefix_bits, q, slots, prefix = _HEAD.unpack_from(self.data)
        r, at = 64 - prefix_bits - q, _HEAD.size

        def places(n: int) -> np.ndarray:
            nonlocal at
            raw = np.frombuffer(self.data, np.uint8, -(-n // 8), at)
            at += len(raw)
            return np.unpackbits(raw, count=n, bitorder="little").astype(bool)

        quotient, ends, extra = np.flatnonzero(places(1 << q)), np.flatnonzero(places(slots)), places(slots)
        width = -(-r // 8)
        value = np.zeros((slots, 8), np.uint8)
        value[:, :width] = np.frombuffer(self.data, np.uint8, slots * width, at).reshape(-1, width)
        value = value.view("<u8").reshape(-1)
        starts = np.maximum(quotient, np.append(-1, ends[:-1]) + 1)  # the k-th run belongs to the k-th quotient that has one
        size = ends - starts + 1
        slot = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        of_run = np.repeat(quotient, size)
        first = ~extra[slot]
        item = np.cumsum(first) - 1
        counts = np.ones(int(first.sum()), np.uint64)
        digit = np.arange(len(slot)) - np.flatnonzero(first)[item] - 1
        for k in range(int(digit.max(initial=-1)) + 1):
            some = digit == k
            counts[item[some]] += value[slot[some]] << np.uint64(r * k)
        top = np.uint64(prefix << (64 - prefix_bits)) if prefix_bits else np.uint64(0)
        return top | (of_run[first].astype(np.uint64) << np.uint64(r)) | value[slot[first]], counts

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """The filter of both; nothing is lost, counts add up."""
        return self.of(*merged(self.items(), other.items()), self.data[0])


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two cursors over fingerprints in order: each of b goes to its place among those of a; equal ones add up their counts."""
    place = np.searchsorted(a[0], b[0])
    same = np.zeros(len(b[0]), bool)
    inside = place < len(a[0])
    same[inside] = a[0][place[inside]] == b[0][inside]
    counts = a[1].copy()
    counts[place[same]] += b[1][same]
    return np.insert(a[0], place[~same], b[0][~same]), np.insert(counts, place[~same], b[1][~same])


def _builder(prefix_bits: int):  # noqa: ANN202
    """Filters of a partition, one for each block: (block, filter)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def filters() -> pa.RecordBatch:
            prints, counts = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
            block = (prints >> np.uint64(64 - prefix_bits)).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            made = [QuotientFilter.of(p, c, prefix_bits).data for p, c in zip(np.split(prints, cuts[1:]), np.split(counts, cuts[1:]), strict=True)]
            return pa.record_batch([pa.array(block[cuts]), pa.array(made, pa.binary())], names=["block", "filter"])

        for b in batches:
            if b.num_rows:
                held.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            if sum(map(len, held)) >= HELD:
                yield filters()
                held.clear()
        if held:
            yield filters()

    return build


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, n) of the fingerprints with a count above one, from filters in order of their blocks; similar sizes are merged first."""
    block, stack = None, []

    def repeated() -> pa.RecordBatch:
        while len(stack) > 1:
            stack.append(merged(stack.pop(), stack.pop()))
        prints, counts = stack.pop()
        some = counts > 1
        return pa.record_batch([pa.array(prints[some].view(np.int64)), pa.array(counts[some].astype(np.int64))], names=["fp", "n"])

    for b in batches:
        for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if name != block and stack:
                yield repeated()
            block = name
            stack.append(QuotientFilter(data.as_py()).items())
            while len(stack) > 1 and len(stack[-2][0]) <= 2 * len(stack[-1][0]):
                stack.append(merged(stack.pop(), stack.pop()))
    if stack:
        yield repeated()


def repeated_fingerprints(prints: DataFrame) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once, by merged counting quotient filters; prints must be cheap to count."""
    bits = max(BLOCK_BITS, (prints.count() // HELD).bit_length())
    filters = prints.select("fp").transform(in_batches, _builder(bits), "block long, filter binary")
    return filters.repartition("block").sortWithinPartitions("block").transform(in_batches, _merge, "fp long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of docs.

    Of equal texts the row with the most code points in the original text stays, then the
    one with the smallest id.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE + "+", "")
    base = docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("norm"), F.coalesce(F.length(text_col), F.lit(0)).alias("chars"))
    light = keep(base.select("id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("sha")), "dedup-light")
    repeated = small_or(keep(repeated_fingerprints(light), "dedup-filter").select("fp"))
    routed = base.withColumn("fp", F.xxhash64("norm")).join(repeated, "fp", "left_semi")
    # most code points, then smallest id, as one number: a fixed-width aggregate, pre-aggregated in each task
    step, top = F.expr("20000000000000000000BD"), F.expr("9223372036854775807BD")
    rank = F.col("chars").cast("decimal(11,0)") * step + (top - F.col("id").cast("decimal(20,0)"))
    verified = routed.groupBy("fp", "norm").agg(F.max(rank.cast("decimal(38,0)")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = keep(
        verified.where("group_size > 1").select("fp", F.sha2("norm", 256).alias("sha"), (top - F.col("best") % step).cast("long").alias("keep_id"), "group_size"),
        "dedup-groups",
    )
    out = join_skewed(light, groups, ["fp", "sha"], "group_size", F.col("id"))
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay; of rows that repeat an id and a text one stays."""
    found = keep(exact_groups(docs, id_col, text_col), "dedup-found")
    names = {"_dedup_id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "_dedup_sha": F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE + "+", ""), 256)}
    gone = found.where(~F.col("kept")).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_dedup_id"), F.col("text_sha256").alias("_dedup_sha")).distinct()
    out = docs.withColumns(names).join(small_or(keep(gone, "dedup-gone")), list(names), "left_anti")
    stay = found.where("kept").groupBy(id_col, "text_sha256").count().where("count > 1")
    if stay.limit(1).count():
        out = out.dropDuplicates(list(names))
    return out.drop(*names)
