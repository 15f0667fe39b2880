"""Near duplicates among embeddings by a forest of random-projection trees.

Vectors of a label are split again and again at the median of a random projection until at
most ``leaf`` of them are together. Those near the median go to both sides (spill), and
several trees are grown, so that a linked pair shares a leaf of some tree. All pairs of a leaf
are compared by cosine in double precision inside a task; a pair is counted in the first leaf
that it shares, so links are exact counts without a list of pairs.

The cuts of six levels are fitted at once, on a sample of some 20,000 vectors of a node, and then all vectors are dealt
to the nodes below them in one pass; larger labels take further rounds.

A cut has a margin of ``spill`` times the distance of a pair at the threshold on either side, in which
vectors go to both sides. A pair at the threshold is parted by a cut with a probability of some 2.5 %
among spread-out vectors, more in a cluster that a cut runs through, closer pairs far less often, and it is lost only if
all trees part it: after 10 cuts in a row that is less than 0.1 %. The recall over all linked pairs is measured in
tests/llm and told in the README. Where a third of a node's vectors or more lie within the margin
(a tight cluster), the node is not cut but tried again with the next projection. What can't be cut at
all is compared block by block, which is exact, as is a label with at most ``leaf`` distinct vectors.

A vector travels once for each leaf that it is in (four trees, and by spill half as many again for each
three levels), with the names of its earlier leaves; the projections that a round has used are dropped.

Defined results: vectors that are null, zero, or hold a null or non-finite component, and
those without a label or id, link with nothing; vectors of different lengths don't link, whatever
their length; equal vectors link, and rows that repeat an id are vectors of their own; a row without an id
has a null component; a cosine within 1e-12 of the threshold is worked out again in extended
precision and rounded to double; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, in_batches, join_skewed, keep, small_or

COSINE = 0.93
TREES = 4
LEAF = 512
#: Half the margin of a cut, as a share of the distance of a pair at the threshold.
SPILL = 0.5
SEED = 7
#: Levels of a tree that are fitted at once, on a sample of about so many vectors of a node; all vectors are dealt.
LEVELS, SAMPLE = 6, 20_000
#: Rows that are compared with a leaf at once.
_CHUNK = 512


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the length and a digest of each usable vector; others have a null digest."""
    import xxhash

    for b in batches:
        lists = b.column("v")
        digests, dims = [], []
        for x in lists:
            v = np.array(x.as_py(), np.float64) if x.is_valid and len(x.as_py()) else None  # a null component becomes nan
            usable = v is not None and np.isfinite(v).all() and v.any()
            digests.append(xxhash.xxh3_128_digest(v.tobytes()) if usable else None)
            dims.append(len(v) if usable else 0)
        yield pa.record_batch([b.column("id"), b.column("label"), lists, pa.array(dims, pa.int32()), pa.array(digests, pa.binary())], names=["id", "label", "v", "dim", "vkey"])


def _projector(trees: int, levels: int):
    """Rows (leafless) for each tree: the projections of a vector's direction, one for each level."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, label, dim = (b.column(c) for c in ("rep", "label", "dim"))
            out = np.zeros((b.num_rows, trees * levels))
            for d in np.unique(dim.to_numpy()):
                at = np.flatnonzero(dim.to_numpy() == d)
                x = _matrix(b.column("v").take(pa.array(at)), int(d))
                out[at] = _directions(x) @ np.random.Generator(np.random.PCG64([SEED, int(d)])).standard_normal((int(d), trees * levels))
            n = b.num_rows
            tree = np.tile(np.arange(trees, dtype=np.int32), n)
            again = pa.array(np.repeat(np.arange(n), trees))
            p = pa.ListArray.from_arrays(pa.array(np.arange(0, n * trees * levels + 1, levels, dtype=np.int32)), pa.array(out.reshape(-1).astype(np.float32)))
            yield pa.record_batch([label.take(again), dim.take(again), rep.take(again), pa.array(tree), p], names=["label", "dim", "rep", "tree", "p"])

    return work


def _leaves(reps: DataFrame, trees: int, leaf: int, margin: float) -> DataFrame:
    """(rep, tree, leaf): the leaves of every representative; small labels are one leaf."""
    kind = dict(reps.dtypes)["label"]
    groups = keep(reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")), "rp-groups")
    most = groups.agg(F.max("n")).first()[0] or 0
    small = small_or(groups.where(F.col("n") <= leaf).select("label", "dim"))
    done = reps.join(small, ["label", "dim"], "left_semi").select("rep", F.lit(0).alias("tree"), F.xxhash64("label", "dim").alias("leaf"))
    if most <= leaf:
        return done
    rounds = math.ceil((math.log(most / leaf) / math.log(1 / 0.6) + 2) / LEVELS)
    large = small_or(groups.where(F.col("n") > leaf).select("label", "dim"))
    now = reps.join(large, ["label", "dim"], "left_semi").select("label", "dim", "rep", "v").transform(in_batches, _projector(trees, rounds * LEVELS), f"label {kind}, dim int, rep long, tree int, p array<float>")
    now = keep(now.select(F.xxhash64("label", "dim").alias("root"), "rep", "tree", F.xxhash64("label", "dim", "tree").alias("leaf"), F.lit(False).alias("cut"), "p"), "rp-round")
    for _ in range(rounds):
        sizes = keep(now.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf), "rp-nodes")
        if not sizes.limit(1).count():
            break
        few = join_skewed(now.select("leaf", "rep", F.slice("p", 1, LEVELS).alias("p")), sizes, ["leaf"], "n", F.col("rep"), "inner").where(F.pmod(F.xxhash64("rep", "leaf"), F.col("n")) < SAMPLE)
        fitted = keep(few.groupBy("leaf", "n").applyInArrow(_fitter(leaf, margin), "leaf long, n long, cuts array<double>, any boolean"), "rp-cuts")
        dealt = join_skewed(now, fitted.where("any"), ["leaf"], "n", F.col("rep"))
        sides = F.when(F.col("any"), _nodes(margin)).otherwise(F.array(F.lit(0)))
        dealt = dealt.withColumn("node", F.explode(sides))
        now = keep(
            dealt.select("root", "rep", "tree", F.when(F.col("any"), F.xxhash64("leaf", "node")).otherwise(F.col("leaf")).alias("leaf"), (F.col("cut") | F.coalesce("any", F.lit(False))).alias("cut"), F.slice("p", LEVELS + 1, rounds * LEVELS).alias("p")),
            "rp-round",
        )
    # a label that one tree has not cut is exact in that tree: no other is needed
    whole = small_or(keep(now.where("not cut").groupBy("root").agg(F.min("tree").alias("only")), "rp-whole"))
    now = now.join(whole, "root", "left").where("only is null or only = tree")
    return done.unionByName(now.select("rep", "tree", "leaf"))


def fit_cuts(p: np.ndarray, n: int, leaf: int, margin: float) -> np.ndarray:
    """Where the nodes of a tree of LEVELS levels are cut, the root being 1 and the sides of x being 2x and 2x + 1; infinite where a node isn't.

    p: projections of a sample of the n vectors, a column for each level. A node is cut at the median, with those in the
    margin on both sides, if it is larger than a leaf and its middle third is wider than the margin.
    """
    cuts, here = np.full(1 << LEVELS, np.inf), {1: np.arange(len(p))}
    for level in range(LEVELS):
        below = {}
        for node, rows in here.items():
            x = p[rows, level]
            low, middle, high = np.quantile(x, [1 / 3, 1 / 2, 2 / 3]) if len(rows) > 2 else (0, 0, 0)
            if len(rows) * n > leaf * len(p) and high - low > 2 * margin:
                cuts[node] = middle
                below[2 * node], below[2 * node + 1] = rows[x <= middle + margin], rows[x >= middle - margin]
            else:
                below[2 * node] = rows
        here = below
    return cuts


def _fitter(leaf: int, margin: float):  # noqa: ANN202
    def fit(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("rep").to_numpy())  # the same cuts however the rows came
        cuts = fit_cuts(_matrix(t.column("p"), LEVELS)[order], t.column("n")[0].as_py(), leaf, margin)
        return pa.table({"leaf": t.column("leaf")[:1], "n": t.column("n")[:1], "cuts": pa.array([cuts.tolist()]), "any": pa.array([bool(np.isfinite(cuts).any())])})

    return fit


def _nodes(margin: float):  # noqa: ANN202
    """The nodes below the cuts that a row with projections p reaches: one, or more where it is within a margin."""

    def step(nodes, level):  # noqa: ANN001, ANN202
        at = F.get("p", level)
        cut = lambda x: F.get("cuts", x)
        return F.flatten(F.transform(nodes, lambda x: F.filter(F.array(F.when(at <= cut(x) + margin, 2 * x), F.when(at >= cut(x) - margin, 2 * x + 1)), lambda y: y.isNotNull())))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), F.array(F.lit(1)), step)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by a power of two first, which loses nothing and lets no square overflow."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows a with the rows b in extended precision, as doubles: the same wherever a pair is met."""
    out = np.empty(len(a))
    y = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]).astype(np.longdouble)
    norms = np.sqrt((y * y).sum(axis=1))
    for at in range(0, len(a), 65536):
        i, j = a[at : at + 65536], b[at : at + 65536]
        out[at : at + 65536] = ((y[i] * y[j]).sum(axis=1) / (norms[i] * norms[j])).astype(np.float64)
    return out


def compare_leaf(rep: np.ndarray, copies: np.ndarray, x: np.ndarray, earlier: list[np.ndarray], side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each vector: links counts the copies of those that it links with here and in no earlier leaf.

    side: the block of a vector; where there are two blocks only pairs across them count.
    """
    n = len(rep)
    unit = _directions(x)
    near = np.zeros((n, n), bool)
    for low in range(0, n, _CHUNK):
        c = unit[low : low + _CHUNK] @ unit.T
        hit = c >= cosine
        i, j = np.nonzero(np.abs(c - cosine) < 1e-12)
        if len(i):
            hit[i, j] = _cosines(x, i + low, j) >= cosine
        near[low : low + _CHUNK] = hit
    near &= rep[:, None] != rep[None, :]
    if len(np.unique(side)) > 1:
        near &= side[:, None] != side[None, :]
    links, root = np.zeros(n, np.int64), rep.copy()
    touched = np.flatnonzero(near.any(axis=1))
    if not len(touched):
        return links, root
    near = near[np.ix_(touched, touched)]
    flat = np.concatenate([earlier[i] for i in touched])
    row = np.repeat(np.arange(len(touched)), [len(earlier[i]) for i in touched])
    order = np.argsort(flat, kind="stable")
    for met in np.split(row[order], np.flatnonzero(np.diff(flat[order])) + 1):
        if len(met) > 1:  # these share an earlier leaf: their pairs are counted there
            near[np.ix_(met, met)] = False
    links[touched] = np.round(near @ copies[touched].astype(np.float64)).astype(np.int64)
    seen = np.zeros(len(touched), bool)
    for i in np.argsort(rep[touched], kind="stable"):  # classes of this leaf, named by their smallest id
        if seen[i]:
            continue
        seen[i] = True
        front = np.array([i])
        while len(front):
            new = np.flatnonzero(near[front].any(axis=0) & ~seen)
            seen[new] = True
            root[touched[new]] = rep[touched[i]]
            front = new
    return links, root


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    kinds = dict(vectors.dtypes)
    read = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).transform(in_batches, _read, f"id long, label {kinds[label_col]}, v {kinds[vector_col]}, dim int, vkey binary"
    )
    base = keep(read.withColumn("vkey", F.when(F.col("id").isNotNull() & F.col("label").isNotNull(), F.col("vkey"))), "rp-read")
    reps = base.where("vkey is not null").groupBy("label", "dim", "vkey").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    # a representative is known by its row, as its smallest id may be another vector's too
    reps = keep(reps.sortWithinPartitions("label", "dim", "vkey").withColumn("rep", F.monotonically_increasing_id()), "rp-reps")
    leaves = keep(_leaves(reps, trees, leaf, spill * math.sqrt(2 * (1 - cosine))), "rp-leaves")
    sizes = keep(leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "rp-sizes")
    # one row for each vector with its leaves in order, then one for each of them with those before it
    lists = leaves.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("tree", "leaf"))).alias("all"))
    in_leaves = reps.join(lists, "rep").select("rep", "copies", "v", "all", F.posexplode("all").alias("pos", "at"))
    before = F.transform(F.slice("all", F.lit(1), F.col("pos")), lambda s: s["leaf"])
    placed = join_skewed(in_leaves.select("rep", "copies", "v", F.col("at.leaf").alias("leaf"), before.alias("before")), sizes, ["leaf"], "n", F.col("rep"), "inner")
    blocks = F.when(F.col("n") <= 4 * leaf, F.lit(1)).otherwise(F.ceil(F.col("n") / (2 * leaf))).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))
    ready = placed.select("rep", "copies", "v", "leaf", "before", mine.alias("side"), F.explode(pairs).alias("block"))

    def work(t: pa.Table) -> pa.Table:
        rep, copies, side = (t.column(c).to_numpy() for c in ("rep", "copies", "side"))
        x = _matrix(t.column("v"), len(t.column("v")[0]))
        lists = t.column("before").combine_chunks()
        flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        earlier = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        links, root = compare_leaf(rep, copies, x, earlier, side, cosine)
        return pa.table({"rep": pa.array(rep), "links": pa.array(links), "root": pa.array(root)})

    found = keep(ready.groupBy("leaf", "block").applyInArrow(work, "rep long, links long, root long").where("links > 0"), "rp-found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    whole = components(found.where("rep <> root").select(F.col("root").alias("src"), F.col("rep").alias("dst"))).withColumnRenamed("node", "rep")
    whole = keep(whole.join(reps.select("rep", "first_id"), "rep"), "rp-classes")
    names = keep(whole.groupBy("component").agg(F.min("first_id").alias("name"), F.count(F.lit(1)).alias("n")), "rp-names")
    named = join_skewed(whole.select("rep", "component"), names, ["component"], "n", F.col("rep")).select("rep", "name")
    result = reps.join(links, "rep", "left").join(named, "rep", "left").select(
        "label", "dim", "vkey", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("name", "first_id").alias("component_id")
    )
    out = join_skewed(base.select("id", "label", "dim", "vkey"), keep(result, "rp-result"), ["label", "dim", "vkey"], "copies", F.col("id"))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
