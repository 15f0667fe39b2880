"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by membership pattern, the set of sources that they belong to. The
flow network has an arc from each pattern to each of its sources; a pattern supplies its words
once at cost 0, once more at cost 1 and so on (convex repetition costs), a source takes its
quota. The cheapest flow says how many words of each pattern are taken; then documents are
selected in seeded order until that many words are reached.

Scale
    Up to NETWORK patterns and sources, which are counted first, go to the driver, a row each, and are
    solved by blocking flows, one layer of cost after the other. Where there are more, a source that is in no
    overlapping pattern is left out: it is a network of one arc, whose flow is a formula that stays in Spark.
    More overlapping patterns than that are an error.
    A pattern of n documents is dealt by hash over about sqrt(n) parts: parts before the one in which
    the quota ends are taken whole, parts after it not, and only that one is looked at document by
    document (items). So what is decided is a row for each pattern and a few items, which are
    joined to the rows of the corpus without moving them.
    After the seeded order a gap remains that is shorter than the next document. It is filled
    by shorter ones: longest first, over the counts of sizes, then by one that overshoots if that
    brings the sum nearer.

Defined results: a null text has size 0 and is never taken; texts are counted whole, however
long; a null source is a source of its own, which comes last; a row of no source is never taken;
whole documents are taken, never parts; rows that repeat id, sources and text are one item, of
which as many rows are taken as the quota says; further columns, whatever their names, are carried
by take_mix alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_skewed, keep, small_or

SEED = 20
WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MOST = 2
#: Sources that are ordered in one task.
RANGE = 1_000_000
#: Patterns, and sources, that the driver solves as one network at most: a row of a name and a number each.
NETWORK = 100_000
#: Copies of a row that are made in one step.
STEP = 1000
ITEM = ["pattern", "id", "size", "h"]


# ------------------------------------------------------------------ targets


def source_rows(totals: DataFrame, weights: tuple | dict, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target, quota) of every source, as a kept table.

    totals: (pattern, words, n). weights: whole numbers for sources by name, or repeating over
    the sources by code point, null last. The target is the weight's part of share * all words;
    none is above most times its source, the excess is shared again by weight: targets are
    least(unit * weight, most * size), and each step below finds the unit for the sources now capped.
    """
    sizes = keep(totals.select(F.explode("pattern").alias("source"), "words").groupBy("source").agg(F.sum("words").cast("long").alias("source_size")), "mix-sources")
    unique = totals.where(F.size("pattern") > 0).agg(F.sum("words")).first()[0] or 0
    if isinstance(weights, dict):
        given = totals.sparkSession.createDataFrame([(k, int(v)) for k, v in weights.items()], "w_source string, weight long")
        rows = sizes.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    else:
        cycle = F.array(*(F.lit(int(w)) for w in weights))
        rows = ranked(sizes, F.col("source").asc_nulls_last()).withColumn("weight", F.get(cycle, F.pmod("rank", F.lit(len(weights))).cast("int")).cast("long")).drop("rank")
    rows = keep(rows, "mix-weights")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    budget = share * int(unique)
    first = rows.agg(F.sum("weight")).first()[0] or 1
    unit, capped = budget / int(first), -1
    while True:
        over = F.lit(Decimal(unit.numerator)) * exact("weight") > F.lit(Decimal(most * unit.denominator)) * exact("source_size")
        r = rows.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)).alias("words"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if r["n"] == capped or not r["weight"]:
            break
        capped, unit = r["n"], (budget - most * int(r["words"])) / int(r["weight"])
    whole = F.floor((F.lit(Decimal(2 * unit.numerator)) * exact("weight") + F.lit(Decimal(unit.denominator))) / F.lit(Decimal(2 * unit.denominator)))
    most_of = most * F.col("source_size")
    return rows.withColumn("target", F.when(over, most_of.cast("double")).otherwise(F.lit(float(unit)) * F.col("weight"))).withColumn("quota", F.when(over, most_of).otherwise(F.least(whole.cast("long"), most_of)))


def ranked(df: DataFrame, order: Column) -> DataFrame:
    """df with its rank from 0 in the order: ranges are numbered in themselves and start at the number of rows before them."""
    parts = -(-max(1, df.count()) // RANGE)
    dealt = keep(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    counts = dealt.groupBy("_part").count()
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # a row for each range
    return dealt.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1).drop("_part", "_before")


# ------------------------------------------------------------------ flow


def min_cost_flow(supply: dict, quota: dict, most: int = MOST) -> dict:
    """Words for each (pattern, source) at the least repetition cost, of the greatest flow.

    supply: words of each pattern (a tuple of sources), usable most times, the r-th time at
    cost r - 1. quota: words that each source wants. The only costs are on the arcs out of the
    start, so a path costs what its first arc does: the layers are opened one after the other, and
    each is filled by blocking flows over the residual network until it has no path to the end.
    """
    patterns = {p: i for i, p in enumerate(sorted(supply, key=repr))}
    place = {s: len(patterns) + i for i, s in enumerate(sorted(quota, key=repr))}
    end, nodes = len(patterns) + len(place), len(patterns) + len(place) + 1
    arcs: list[list[int]] = [[] for _ in range(nodes)]
    head: list[int] = []
    room: list[int] = []  # arc i and its reverse i ^ 1

    def arc(a: int, b: int, capacity: int) -> int:
        arcs[a].append(len(head))
        arcs[b].append(len(head) + 1)
        head.extend((b, a))
        room.extend((capacity, 0))
        return len(head) - 2

    carried = {(p, s): arc(i, place[s], most * supply[p]) for p, i in patterns.items() for s in p if s in quota}
    for s, i in place.items():
        arc(i, end, quota[s])
    left = [0] * nodes  # what the open layers still supply
    for _ in range(most):
        for p, i in patterns.items():
            left[i] += supply[p]
        while True:
            level = [-1] * nodes
            queue = deque(i for i in patterns.values() if left[i])
            for i in queue:
                level[i] = 0
            while queue:
                a = queue.popleft()
                for x in arcs[a]:
                    if room[x] and level[head[x]] < 0:
                        level[head[x]] = level[a] + 1
                        queue.append(head[x])
            if level[end] < 0:
                break
            at = [0] * nodes
            for start in patterns.values():
                while left[start] and level[start] == 0:
                    path, a = [], start
                    while a != end:
                        while at[a] < len(arcs[a]) and not (room[arcs[a][at[a]]] and level[head[arcs[a][at[a]]]] == level[a] + 1):
                            at[a] += 1
                        if at[a] < len(arcs[a]):
                            path.append(arcs[a][at[a]])
                            a = head[path[-1]]
                        elif path:  # a dead end
                            level[a] = -2
                            a = head[path.pop() ^ 1]
                        else:
                            break
                    if a != end:
                        break
                    amount = min(left[start], min(room[x] for x in path))
                    left[start] -= amount
                    for x in path:
                        room[x] -= amount
                        room[x ^ 1] += amount
    return {k: room[x + 1] for k, x in carried.items() if room[x + 1]}


def _wanted(totals: DataFrame, sources: DataFrame, most: int, network: int = NETWORK) -> DataFrame:
    """(pattern, n, parts, base, rest), as a kept table: all rows are taken base times, and ``rest`` words once more."""
    spark = totals.sparkSession
    patterns = totals.where(F.size("pattern") > 0)
    if patterns.count() <= network and sources.count() <= network:
        mine, quotas, formula = patterns, sources, None
    else:  # a source that is in no overlapping pattern is a network of one arc
        overlapping = patterns.where(F.size("pattern") > 1)
        touched = keep(overlapping.select(F.explode("pattern").alias("t")).distinct(), "mix-touched")
        if overlapping.count() > network or touched.count() > network:
            raise ValueError(f"more than {network} overlapping patterns or sources are one network: merge rare patterns before mixing")
        of = lambda df, c, how: df.join(F.broadcast(touched), F.col(c).eqNullSafe(F.col("t")), how)
        single = patterns.where(F.size("pattern") == 1).withColumn("s", F.get("pattern", F.lit(0)))
        mine, quotas = overlapping.unionByName(of(single, "s", "left_semi").drop("s")), of(sources, "source", "left_semi")
        formula = of(single, "s", "left_anti").join(small_or(sources).select("source", "quota"), F.col("s").eqNullSafe(F.col("source")))
        formula = formula.select("pattern", "words", "n", F.least("quota", most * F.col("words")).alias("taken"))
    supply = {tuple(r["pattern"]): int(r["words"]) for r in mine.select("pattern", "words").collect()}
    solved: dict = dict.fromkeys(supply, 0)
    for (p, _), n in min_cost_flow(supply, {r["source"]: int(r["quota"]) for r in quotas.select("source", "quota").collect()}, most).items():
        solved[p] += n
    rows = spark.createDataFrame([(list(p), n) for p, n in solved.items()], "pattern array<string>, taken long")
    taken = totals.join(F.broadcast(rows), "pattern").select("pattern", "words", "n", "taken")
    taken = taken if formula is None else taken.unionByName(formula)
    base = F.when(F.col("words") > 0, F.least(F.floor(F.col("taken") / F.col("words")), F.lit(most))).otherwise(0).cast("long")
    parts = F.ceil(F.sqrt("n")).cast("long")
    return keep(taken.withColumn("base", base).select("pattern", "n", parts.alias("parts"), "base", (F.col("taken") - F.col("base") * F.col("words")).cast("long").alias("rest")), "mix-wanted")


# ------------------------------------------------------------------ selection


def words_in(text_col: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def _keys(memberships: Column, id_col: str, text_col: str, seed: int) -> dict[str, Column]:
    """The columns of an item; memberships is an array of the sources that a row belongs to."""
    none = F.array().cast("array<string>")
    ident = F.col(id_col).cast("long")
    return {"pattern": F.coalesce(F.array_sort(F.array_distinct(memberships.cast("array<string>"))), none), "id": ident, "size": words_in(text_col), "h": F.xxhash64(F.lit(seed), ident, F.col(text_col))}


def sizes_of(docs: DataFrame, memberships: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(pattern, id, size, h) as a kept table; h is the place in the seeded order."""
    return keep(docs.select(*(c.alias(n) for n, c in _keys(memberships, id_col, text_col, seed).items())), "mix-sizes")


def _place(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows of items with their part, and base, rest, edge and done of their pattern; no row moves where patterns are few."""
    return join_skewed(rows, wanted, ["pattern"], "n", F.col("h")).withColumn("part", F.pmod(F.shiftright("h", 20), F.col("parts")))


def decide(sized: DataFrame, weights: tuple | dict, share: Fraction = SHARE, most: int = MOST, network: int = NETWORK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, wanted, special), kept tables that say what is taken.

    wanted (pattern, n, parts, base, rest, edge, done): of a pattern, parts before edge are taken once more
    than base, the others base times, but for the special items (pattern, id, size, h, m, k), of
    whose m rows k are taken once more than base.
    """
    totals = keep(sized.groupBy("pattern").agg(F.sum("size").cast("long").alias("words"), F.count(F.lit(1)).alias("n")), "mix-totals")
    sources = keep(source_rows(totals, weights, share, most), "mix-targets")
    wanted = _wanted(totals, sources, most, network)
    asked = (F.col("rest") > 0) & (F.col("size") > 0)
    sums = _place(sized, wanted).where(asked).groupBy("pattern", "part", "rest").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # sqrt(n) rows of a pattern
    edges = sums.withColumn("before", F.coalesce(upto, F.lit(0))).where("before <= rest").groupBy("pattern").agg(F.max("part").alias("edge"), F.max("before").alias("done"))
    wanted = keep(wanted.join(small_or(keep(edges, "mix-edges")), "pattern", "left"), "mix-wanted")
    placed = _place(sized, wanted).where(asked)
    items = placed.where("part = edge").groupBy(*ITEM).agg(F.count(F.lit(1)).alias("m"), F.first(F.col("rest") - F.col("done")).alias("room"))
    run = F.coalesce(F.sum(F.col("m") * F.col("size")).over(Window.partitionBy("pattern").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = F.least("m", F.greatest(F.lit(0), F.floor((F.col("room") - run) / F.col("size")))).cast("long")
    edge_items = keep(items.withColumn("k", fits), "mix-items")
    gaps = edge_items.groupBy("pattern").agg((F.max("room") - F.sum(F.col("k") * F.col("size"))).alias("gap")).where("gap > 0")
    gaps = small_or(keep(gaps, "mix-gaps"))
    later = placed.where("part > edge").select(*ITEM).join(gaps, "pattern").where("size < 2 * gap")
    spare = edge_items.where("k < m").select(*ITEM, (F.col("m") - F.col("k")).alias("m")).join(gaps, "pattern").where("size < 2 * gap")
    counts = later.groupBy("pattern", "gap", "size").agg(F.count(F.lit(1)).alias("m")).unionByName(spare.groupBy("pattern", "gap", "size").agg(F.sum("m").alias("m")))
    fill = keep(_fill(counts.groupBy("pattern", "gap", "size").agg(F.sum("m").alias("m"))), "mix-fill")
    longest = fill.agg(F.max("take")).first()[0]
    if longest is None:
        return sources, wanted, edge_items.select(*ITEM, "m", "k")
    fill = small_or(fill)
    # the first rows of a size, as many as could be asked for of any: the limit is pre-applied in each task
    order = Window.partitionBy("pattern", "size").orderBy("h", "id")
    first = later.join(fill, ["pattern", "size"]).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= F.lit(int(longest)))
    offered = first.groupBy(*ITEM, "take").agg(F.count(F.lit(1)).alias("m"), F.lit(1).alias("late")).unionByName(spare.join(fill, ["pattern", "size"]).select(*ITEM, "take", "m", F.lit(0).alias("late")))
    ahead = F.coalesce(F.sum("m").over(Window.partitionBy("pattern", "size").orderBy("late", "h", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    filled = keep(offered.withColumn("more", F.least("m", F.greatest(F.lit(0), F.col("take") - ahead))).where("more > 0").select(*ITEM, "more", "late"), "mix-filled")
    late = small_or(filled.where("late = 1").select(*ITEM, "more"))
    same = lambda a, b: (a["pattern"] == b["pattern"]) & a["id"].eqNullSafe(b["id"]) & (a["size"] == b["size"]) & (a["h"] == b["h"])
    found = placed.where("part > edge").select(*ITEM)
    late_items = found.join(late, same(found, late)).select(*(found[c] for c in ITEM), "more").groupBy(*ITEM).agg(F.count(F.lit(1)).alias("m"), F.max("more").alias("k"))
    early = filled.where("late = 0").select(*ITEM, "more")
    edge_now = edge_items.join(early, same(edge_items, early), "left").select(*(edge_items[c] for c in ITEM), "m", (F.col("k") + F.coalesce("more", F.lit(0))).alias("k"))
    return sources, wanted, keep(edge_now.unionByName(late_items), "mix-special")


def _fill(counts: DataFrame) -> DataFrame:
    """(pattern, size, take) that close the gap of counts (pattern, gap, size, m): longest first, then one that overshoots by less than what is missing.

    A gap is shorter than a document, so a pattern has no more sizes here than twice the longest document's words.
    """
    pair = lambda size, take: F.struct(size.cast("long").alias("size"), take.cast("long").alias("take"))
    listed = counts.groupBy("pattern", "gap").agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "m")))).alias("sizes"))
    start = F.struct(F.col("gap").cast("long").alias("gap"), F.array().cast("array<struct<size:bigint,take:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        n = F.least(x["m"], F.floor(acc["gap"] / x["size"])).cast("long")
        return F.struct((acc["gap"] - n * x["size"]).alias("gap"), F.when(n > 0, F.array_append(acc["out"], pair(x["size"], n))).otherwise(acc["out"]).alias("out"))

    folded = listed.select("pattern", "sizes", F.aggregate("sizes", start, step).alias("f"))
    left = F.filter("sizes", lambda x: (x["size"] > F.col("f.gap")) & (x["size"] < 2 * F.col("f.gap")) & ~F.exists("f.out", lambda o: (o["size"] == x["size"]) & (o["take"] >= x["m"])))
    over = F.array_min(F.transform(left, lambda x: x["size"]))
    out = F.when(over.isNull(), F.col("f.out")).otherwise(F.array_append("f.out", pair(over, F.lit(1))))
    return folded.select("pattern", F.explode(out).alias("o")).groupBy("pattern", F.col("o.size").alias("size")).agg(F.sum("o.take").alias("take"))


def _repeated(df: DataFrame, n: Column) -> DataFrame:
    """Each row n times, whatever n: in blocks that are dealt over tasks, then row by row."""
    blocks = df.withColumn("_n", n.cast("long")).where("_n > 0").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / STEP))))
    blocks = blocks.repartition("_b", F.xxhash64("_n"))
    return blocks.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(STEP), F.col("_n") - F.col("_b") * STEP)))).drop("_n", "_b", "_i")


def _split(rows: DataFrame, special: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of no special item with ``copies``, rows of special items with m and k); rows as _place() gives them."""
    some = small_or(special).select(*(F.col(c).alias(f"s_{c}") for c in ITEM), "m", "k")
    same = (F.col("pattern") == F.col("s_pattern")) & F.col("id").eqNullSafe(F.col("s_id")) & (F.col("size") == F.col("s_size")) & (F.col("h") == F.col("s_h"))
    joined = rows.join(some, same, "left")
    base = F.coalesce("base", F.lit(0))
    plain = joined.where("s_h is null").withColumn("copies", base + (F.coalesce(F.col("part") < F.col("edge"), F.lit(False)) & (F.col("rest") > 0)).cast("long"))
    return plain, joined.where("s_h is not null").withColumn("base", base)


def mix_sized(sized: DataFrame, weights: tuple | dict, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """(id, pattern, size, taken) for every row of sizes_of(); taken = copies * size."""
    return _mixed(sized, decide(sized, weights, share, most))


def _mixed(sized: DataFrame, decided: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    _, wanted, special = decided
    rows = _place(sized, wanted)
    plain, _ = _split(rows, special)
    items = _place(special, wanted).select("pattern", "id", "size", F.coalesce("base", F.lit(0)).alias("base"), "m", "k")
    dealt = items.select("pattern", "id", "size", F.explode(F.array(F.struct((F.col("base") + 1).alias("copies"), F.col("k").alias("n")), F.struct(F.col("base").alias("copies"), (F.col("m") - F.col("k")).alias("n")))).alias("x"))
    again = _repeated(dealt.select("pattern", "id", "size", F.col("x.copies").alias("copies"), F.col("x.n").alias("n")), F.col("n"))
    columns = ["id", "pattern", "size", (F.col("copies") * F.col("size")).cast("long").alias("taken")]
    return plain.select(*columns).unionByName(again.select(*columns))


def mix_sources(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: tuple | dict = WEIGHTS, share: Fraction = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(id, size, source_size, target, taken) where each row belongs to its one source and weights repeat over the sources in order."""
    sized = sizes_of(docs, F.array(F.col(source_col)), id_col, text_col, seed)
    decided = decide(sized, weights, share, most)
    goals = decided[0].join(decided[1].where(F.size("pattern") == 1).select(F.get("pattern", F.lit(0)).alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).select(F.array("source").alias("pattern"), "source_size", "target", "n")
    mixed = join_skewed(_mixed(sized, decided), keep(goals, "mix-goals"), ["pattern"], "n", F.col("size"))
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def take_mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: tuple | dict = WEIGHTS, share: Fraction = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them.

    The texts are not shuffled: what is taken is joined to them by pattern and by special item.
    """
    memberships = F.array(F.col(source_col))
    _, wanted, special = decide(sizes_of(docs, memberships, id_col, text_col, seed), weights, share, most)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    rows = _place(docs.select(whole, *(c.alias(n) for n, c in _keys(memberships, id_col, text_col, seed).items())), wanted)
    plain, items = _split(rows, special)
    copies = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int")))
    once = items.where("m = 1").withColumn("copies", F.col("base") + F.col("k"))
    out = plain.select("_doc", "copies").unionByName(once.select("_doc", "copies")).where("copies > 0").withColumn("_i", copies(F.col("copies"))).select("_doc.*")
    if special.where("m > 1").limit(1).count():  # rows that repeat an item: one of them stands for all
        one = items.where("m > 1").groupBy(*ITEM).agg(F.first("_doc").alias("_doc"), F.max(F.col("base") * F.col("m") + F.col("k")).alias("n"))
        out = out.unionByName(_repeated(one.select("_doc", "n"), F.col("n")).select("_doc.*"))
    return out
