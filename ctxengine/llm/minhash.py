"""Near-duplicate detection with DartMinHash signatures and exact verification.

Signatures
    Every element of a document owns a region of (weight, rank) space as wide as its weight.
    Hashed darts fall into unit cells of it, Poisson(1) of them in each; a dart in the region of
    a document counts for it, has a rank, and belongs to one of k coordinates. The dart of the
    lowest rank of a coordinate is its minhash. Two documents agree on a coordinate with the
    probability of their weighted Jaccard similarity. The number of darts thrown is about
    k ln k, or one for each unit of weight if that is more, whatever the weights.

Candidates and links
    Coordinates are banded; documents that share a band's hash meet in a bucket. Texts with the
    same shingles are one representative from the start. Within a bucket the exact similarity
    of all pairs of different classes is computed inside a task, from the shingle sets, and only
    links that join classes come out of it. A bucket too large for a task is dealt over many:
    first its members are compared with some leaders, which merges most of it; then what is not
    in its largest class is compared with everything, block by block. So no pair that shares a
    bucket is left out, and no list of all pairs is made.

With 64 bands of 8 coordinates a pair of similarity 0.8 misses all buckets with probability 8e-6.

Defined results: the similarity is the weighted Jaccard similarity of the five-word shingles of the
lower-cased text, the weight of a shingle being how often it occurs (or 1 each: ``weighted=False``); a text of fewer words is one shingle; a null text or one without words links
with nothing; a row with a null id links with nothing; rows that repeat an id share its class; the
class id is the smallest id of the class; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, few, in_batches, join_skewed, keep, small_or
from .words import SHINGLE, mix64, shingle_counts, word_hashes

BANDS, ROWS = 64, 8
SIMILARITY = 0.8
#: Whether a shingle weighs as much as it occurs, rather than 1.
WEIGHTED = True
#: Bands of each round; classes found in one spare comparisons in the next.
ROUNDS = (4, 60)
#: Elements (shingles, and 1,000 for each document) that a task compares at once.
BLOCK = 1_000_000
LEADERS = 8
#: Documents of a batch that are hashed at once.
SLICE = 256

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_GOLD2 = np.uint64(0xC2B2AE3D27D4EB4F)
_EMPTY = np.uint64(2**64 - 1)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])
_CELLS = 1 << 17


def dart_signatures(sets: list[np.ndarray], k: int, weights: list[np.ndarray] | None = None) -> np.ndarray:
    """A row of k minhashes for each non-empty set of 64-bit elements; weights, where given, are positive numbers."""
    out = np.full((len(sets), k), _EMPTY, np.uint64)
    wanted = k * (math.log(k) + 4)
    mass = [float(w.sum()) for w in weights] if weights else [float(len(s)) for s in sets]
    strips = [(0, max(1, math.ceil(wanted / m))) if m else (0, 0) for m in mass]  # ranks to throw at next
    todo = [i for i, m in enumerate(mass) if m]
    while todo:
        at = 0
        while at < len(todo):
            some, cells = [], 0
            while at < len(todo) and (not some or cells < _CELLS):
                cells += int(max(1, math.ceil(mass[todo[at]])) * (strips[todo[at]][1] - strips[todo[at]][0]))
                some.append(todo[at])
                at += 1
            _throw(some, sets, weights, strips, k, out)
        todo = [i for i in todo if (out[i] == _EMPTY).any()]
        for i in todo:
            a, b = strips[i]
            strips[i] = (b, b + max(1, (b - a) // 2))
    return out


def _throw(some: list[int], sets: list, weights: list | None, strips: list, k: int, out: np.ndarray) -> None:
    """Throws the darts of the given documents' next strips of rank."""
    element = np.concatenate([sets[i] for i in some]).astype(np.uint64)
    doc = np.repeat(some, [len(sets[i]) for i in some])
    unit = np.zeros(len(element), np.uint64)  # index of the unit of weight within the element
    width = None
    w = np.concatenate([np.asarray(weights[i], float) for i in some]) if weights else None
    if w is not None and (w != 1).any():  # else every region is one unit wide
        units = np.ceil(w).astype(np.int64)
        element, doc, w = np.repeat(element, units), np.repeat(doc, units), np.repeat(w, units)
        unit = (np.arange(len(element)) - np.repeat(np.cumsum(units) - units, units)).astype(np.uint64)
        width = np.minimum(1.0, w - unit)
    first = np.array([strips[i][0] for i in range(len(sets))])[doc]
    count = np.array([strips[i][1] - strips[i][0] for i in range(len(sets))])[doc]
    cell = np.repeat(np.arange(len(element)), count)
    strip = (np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)).astype(np.uint64)
    h = mix64(element[cell] + unit[cell] * _GOLD2 + (strip + np.uint64(1)) * _GOLD)
    n = np.searchsorted(_POISSON, (h >> np.uint64(11)).astype(np.float64) / (1 << 53), side="right")
    dart = np.repeat(np.arange(len(cell)), n)
    number = (np.arange(len(dart)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
    d = mix64(h[dart] + (number + np.uint64(1)) * _GOLD2)
    owner = cell[dart]
    if width is not None:
        inside = (mix64(d ^ _GOLD) >> np.uint64(11)).astype(np.float64) / (1 << 53) < width[owner]
        d, dart, owner = d[inside], dart[inside], owner[inside]
    # a rank is its strip and 44 bits within it; it is as good as the dart's name
    rank = (np.minimum(strip[dart], np.uint64(0xFFFFE)) << np.uint64(44)) | (mix64(d + _GOLD) >> np.uint64(20))
    np.minimum.at(out.reshape(-1), doc[owner].astype(np.int64) * k + (d % np.uint64(k)).astype(np.int64), rank)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band, with the band's number in it."""
    keys = np.zeros((len(signatures), bands), np.uint64)
    cut = signatures.reshape(len(signatures), bands, rows)
    for i in range(rows):
        keys = mix64(keys + cut[:, :, i] * _GOLD)
    return mix64(keys + np.arange(bands, dtype=np.uint64) * _GOLD2)


def _sets(texts: list[str | None], words: int, weighted: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The shingles of each text and their weights: how often they occur, or 1."""
    both = [shingle_counts(h, words) for h in word_hashes(texts)]
    return [s for s, _ in both], [c if weighted else np.ones(len(c), np.int64) for _, c in both]


def _units(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each unit of weight as an element of its own: sets of these have the weighted Jaccard similarity."""
    number = np.arange(int(weights.sum())) - np.repeat(np.cumsum(weights) - weights, weights)
    again = np.repeat(elements, weights)
    return np.where(number > 0, mix64(again + number.astype(np.uint64) * _GOLD2), again)


def signature_table(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = SHINGLE, weighted: bool = WEIGHTED) -> DataFrame:
    """(id, n, set_hash, bands) of the rows (id, text), n being the weight; set_hash and bands are null without a word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                sets, weights = _sets(b.column(1).to_pylist(), words, weighted)
                keys = band_keys(dart_signatures(sets, bands * rows, weights), bands, rows).view(np.int64)
                digests = [xxhash.xxh3_128_digest(s.tobytes() + w.tobytes()) if len(s) else None for s, w in zip(sets, weights, strict=True)]
                offsets = pa.array(np.arange(0, (len(sets) + 1) * bands, bands, dtype=np.int32))
                yield pa.record_batch(
                    [b.column(0), pa.array([int(w.sum()) for w in weights], pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))],
                    names=["id", "n", "set_hash", "bands"],
                )

    return docs.transform(in_batches, sign, "id long, n long, set_hash binary, bands array<long>")


def _set_table(docs: DataFrame, words: int, weighted: bool) -> DataFrame:
    """(rep, n, elements) of the rows (rep, text); elements are units of weight."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                sets = [_units(e, w) for e, w in zip(*_sets(b.column(1).to_pylist(), words, weighted), strict=True)]
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["rep", "n", "elements"])

    return docs.transform(in_batches, work, "rep long, n long, elements array<long>")


def link_block(rep_class: np.ndarray, sets: list[np.ndarray], leads: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges that join the classes of similar sets; only pairs with a leading set are compared.

    All pairs of different classes are compared by exact Jaccard similarity, unless their
    sizes alone rule it out.
    """
    parent = {int(c): int(c) for c in rep_class}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(i: int, j: int) -> None:
        a, b = find(int(rep_class[i])), find(int(rep_class[j]))
        parent[max(a, b)] = min(a, b)

    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) <= 12:
        for i in range(len(sets)):
            for j in range(i):
                a, b = sizes[i], sizes[j]
                if (leads[i] or leads[j]) and min(a, b) >= similarity * max(a, b) and find(int(rep_class[i])) != find(int(rep_class[j])):
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if common >= similarity * (a + b - common) - 1e-9:
                        join(i, j)
    else:
        row = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(np.concatenate(sets), kind="stable")
        value, row = np.concatenate(sets)[order], row[order]
        new = np.concatenate(([True], value[1:] != value[:-1]))
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1  # an element of one set only adds to no intersection
        row, column = row[shared], column[shared]
        column = np.cumsum(np.concatenate(([1], column[1:] != column[:-1]))) - 1 if len(column) else column
        lead = np.flatnonzero(leads)
        common = np.zeros((len(lead), len(sets)), np.float32)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, (low, low + 4096))
            part = np.zeros((len(sets), 4096), np.float32)
            part[row[a:b], column[a:b] - low] = 1
            common += part[lead] @ part.T
        total = sizes[lead][:, None] + sizes[None, :]
        near = (common >= similarity * (total - common) - 1e-6) & (rep_class[lead][:, None] != rep_class[None, :])
        for i, j in zip(*np.nonzero(near), strict=True):
            join(int(lead[i]), int(j))
    return [(find(c), c) for c in parent if find(c) != c]


def _link(rows: DataFrame, similarity: float) -> DataFrame:
    """(src, dst) edges between classes, from rows (bucket, part, rep, class, lead, elements)."""

    def work(t: pa.Table) -> pa.Table:
        lists = t.column("elements").combine_chunks()
        flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        sets = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        edges = link_block(t.column("class").to_numpy(), sets, t.column("lead").to_numpy(), similarity)
        return pa.table({"src": pa.array([a for a, _ in edges], pa.int64()), "dst": pa.array([b for _, b in edges], pa.int64())})

    return rows.groupBy("bucket", "part").applyInArrow(work, "src long, dst long")


def _relabel(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """classes (rep, n, class) after merging along edges between classes."""
    merged = small_or(components(edges).select(F.col("node").alias("class"), F.col("component").alias("to")))
    return keep(classes.join(merged, "class", "left").select("rep", "n", F.coalesce("to", "class").alias("class")), "near-classes")


def _open_buckets(members: DataFrame) -> DataFrame:
    """(bucket, m, weight, top, top_weight) of the buckets that hold different classes, the same set of members only once."""
    by_class = members.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n") + 1000).alias("w"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("h"))
    by_bucket = by_class.groupBy("bucket").agg(
        F.sum("c").alias("m"), F.sum("w").alias("weight"), F.count(F.lit(1)).alias("classes"), F.sum("h").alias("h"), F.max_by("class", "w").alias("top"), F.max("w").alias("top_weight")
    )
    return by_bucket.where("classes > 1").groupBy("m", "h").agg(*(F.min_by(c, "bucket").alias(c) for c in ("weight", "top", "top_weight")), F.min("bucket").alias("bucket")).drop("h")


def _round(members: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """classes after comparing within the given buckets; members: (bucket, rep)."""

    def dealt(kind: str, now: DataFrame, buckets: DataFrame) -> DataFrame | None:
        large = F.col("weight") - F.col("top_weight") > block
        if kind == "leaders":
            buckets = buckets.where(large)
            if not buckets.limit(1).count():
                return None
        rows = join_skewed(now, buckets, ["bucket"], "m", F.col("rep"), "inner")
        if kind == "leaders":
            parts = F.ceil(F.col("weight") / block).cast("int")
            lead = F.pmod(F.xxhash64("rep", "bucket"), F.col("m")) < LEADERS
            part = F.when(lead, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), parts).cast("int")))
            return rows.select("bucket", F.explode(part.cast("array<string>")).alias("part"), "rep", "class", lead.alias("lead"))
        ones = F.greatest(F.lit(1), F.ceil(F.col("top_weight") * 2 / block)).cast("int")
        others = F.greatest(F.lit(1), F.ceil((F.col("weight") - F.col("top_weight")) * 2 / block)).cast("int")
        my = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
        name = lambda a, b: F.concat(a, F.lit("-"), b)
        with_top = F.transform(F.sequence(F.lit(0), ones - 1), lambda i: name(F.concat(F.lit("t"), i), my(others)))
        with_others = F.transform(F.sequence(F.lit(0), others - 1), lambda j: name(F.least(j, my(others)).cast("string"), F.greatest(j, my(others)).cast("string")))
        of_top = F.transform(F.sequence(F.lit(0), others - 1), lambda j: name(F.concat(F.lit("t"), my(ones)), j))
        part = F.when(F.col("weight") <= block, F.array(F.lit("all"))).when(F.col("class") == F.col("top"), of_top).otherwise(F.concat(with_top, with_others))
        return rows.select("bucket", F.explode(part).alias("part"), "rep", "class", F.lit(True).alias("lead"))

    now = buckets = None
    for kind in ("leaders", "all"):
        if now is None:  # classes have changed
            now = keep(members.join(classes, "rep"), "near-members")
            buckets = keep(few(_open_buckets(now), now.count()), "near-buckets")
        rows = dealt(kind, now, buckets)
        if rows is not None:
            rows = small_or(keep(rows, "near-rows"))
            edges = keep(_link(rows.join(sets.select("rep", "elements"), "rep"), similarity), "near-edges")
            if edges.limit(1).count():
                classes, now = _relabel(classes, edges), None
    return classes


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, rounds: tuple = ROUNDS, block: int = BLOCK, weighted: bool = WEIGHTED
) -> DataFrame:
    """(id, class_id, kept) for every row; class_id is the smallest id of its class of near duplicates."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = keep(signature_table(base, bands, rows, words, weighted).withColumn("row", F.monotonically_increasing_id()), "near-signatures")
    whole = signed.where("id is not null and set_hash is not null")
    reps = whole.groupBy("set_hash").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("copies"))
    reps = keep(few(reps.select("set_hash", F.col("first.id").alias("rep"), F.col("first.row").alias("first"), "copies"), signed.count()), "near-reps")
    # of the rows with the same set only the first one keeps its bands
    firsts = whole.join(small_or(reps.where("copies > 1").select("set_hash", "first")), "set_hash", "left").where("first is null or first = row")
    keys = firsts.select(F.col("id").alias("rep"), "n", F.posexplode("bands").alias("band", "bucket"))
    keys = keep(keys, "near-keys")
    met = keep(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("bucket", "m"), "near-met")
    members = keep(join_skewed(keys, met, ["bucket"], "m", F.col("rep"), "inner").select("bucket", "band", "rep", "n"), "near-meetings")
    classes = keep(members.groupBy("rep").agg(F.max("n").alias("n")).withColumn("class", F.col("rep")), "near-classes")
    active = small_or(classes.select(F.col("rep").alias("id")))
    sets = keep(_set_table(base.join(active, "id", "left_semi").select("id", "text"), words, weighted).where("n > 0"), "near-sets")
    low = 0
    for step in rounds:
        classes = _round(members.where((F.col("band") >= low) & (F.col("band") < low + step)).select("bucket", "rep"), classes, sets, similarity, block)
        low += step
    merged = small_or(keep(classes.where("class <> rep").select("rep", "class"), "near-merged"))
    of_set = keep(reps.join(merged, "rep", "left").select("set_hash", F.coalesce("class", "rep").alias("class_id"), "copies"), "near-of-set")
    out = join_skewed(signed.select("id", "set_hash"), of_set, ["set_hash"], "copies", F.col("id"))
    class_id = F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id"))
    return out.select(F.col("id").alias(id_col), class_id.alias("class_id"), F.col("id").eqNullSafe(class_id).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:  # noqa: ANN003
    """The rows of docs, all columns, without all but the smallest id of each class."""
    found = near_classes(docs, id_col, text_col, **settings)
    gone = keep(found.where(~F.col("kept")).select(F.col(id_col).alias("_near_id")).distinct(), "near-gone")
    return docs.join(small_or(gone), F.col(id_col).cast("long") == F.col("_near_id"), "left_anti")
