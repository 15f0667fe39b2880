"""Filter interaction audit: what each of five filters removes, in every order in which they can run.

Each document gets five failure flags. Documents are counted by part and flags (a few rows for
each part), and CUBE over the flags and the part gives, in the grouping-set rows whose selected
flags are all false, how many documents survive each subset of the filters. A step of an order
leads from one subset to another with one filter more, so its figures are differences of two
such rows, joined by part and subset. There are 80 such pairs of subsets for a part, whatever
the corpus; the 600 steps of the 120 orders read them.

Filters (words: maximal runs of characters other than ``[\\x20\\x09-\\x0D]``): A under 200 words;
B fewer distinct words than half of them; C more than 2 % of the code points in ``[A-Z]``; D any of
``#$%&*|``; E the same text as a smaller doc_id anywhere in the table. Equal texts are told by SHA-256.

Defined results: a null text is empty; a null source is the part ''; a row without an id is no copy and makes
none; rows that repeat an id and text are no copies of each other; a document with several label rows
is good (toxic) if one of them says so; a label without an id counts for none; further columns
are not read; an empty table has no part and gives an empty result.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, join_skewed, keep, small_or

FILTERS = "ABCDE"
#: A subset of the filters is a number with a bit for each, A's being the highest.
BIT = {f: 1 << (len(FILTERS) - 1 - i) for i, f in enumerate(FILTERS)}
ALL = sum(BIT.values())
SUMS = ("n", "good", "toxic")


def failure_flags(text: Column) -> dict[str, Column]:
    """The failures that a text shows by itself, as booleans."""
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, A to E) of each document; only digests and flags leave the scan of the texts."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shown = base.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(f) for f, c in failure_flags(F.col("text")).items()))
    shown = keep(shown, "audit-flags")
    copies = keep(shown.where("id is not null").groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "audit-copies")
    return join_skewed(shown, copies, ["digest"], "n", F.col("id")).select("id", "part", *"ABCD", F.coalesce(F.col("id") > F.col("first_id"), F.lit(False)).alias("E"))


def flag_counts(flags: DataFrame, labels: DataFrame, id_col: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, A to E, n, good, toxic): the documents of each part by flags, at most 32 rows a part."""
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("int")
    told = labels.select(F.col(id_col).cast("long").alias("id"), F.col(good).alias("g"), F.col(toxic).alias("t")).where("id is not null and (g = 1 or t = 1)")
    told = small_or(keep(told.groupBy("id").agg(is_one("g").alias("good"), is_one("t").alias("toxic")), "audit-labels"))
    return flags.join(told, "id", "left").groupBy("part", *FILTERS).agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS[1:]))


def survivors(counts: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): what passes each subset of the filters, by CUBE; a subset that nothing survives has no row."""
    cube = counts.cube(*FILTERS, "part").agg(F.grouping_id().alias("out"), *(F.sum(c).alias(c) for c in SUMS))
    passes = F.lit(True)
    for f in FILTERS:  # null where the flag is not among the grouping set's columns
        passes &= ~F.coalesce(F.col(f), F.lit(False))
    selected = F.shiftright(F.bitwise_not("out"), 1).bitwiseAND(ALL).cast("int")
    return cube.where((F.col("out").bitwiseAND(1) == 0) & passes).select("part", selected.alias("subset"), *SUMS)


def subset_pairs() -> list[tuple[str, int, int, int]]:
    """(filter, subset before, subset after, orders with this step)."""
    out = []
    for f in FILTERS:
        others = [BIT[x] for x in FILTERS if x != f]
        for k in range(len(others) + 1):
            weight = factorial(k) * factorial(len(others) - k)
            out += [(f, sum(c), sum(c) | BIT[f], weight) for c in combinations(others, k)]
    return out


def order_steps() -> list[tuple[str, int, str, int]]:
    """(filter order, step, filter, subset before) of all orders."""
    orders = ("".join(p) for p in permutations(FILTERS))
    return [(o, i + 1, f, sum(BIT[x] for x in o[:i])) for o in orders for i, f in enumerate(o)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step."""
    spark = docs.sparkSession
    passed = keep(survivors(flag_counts(flagged(docs), labels)), "audit-survivors")
    pair = F.explode(F.array(*(F.struct(F.lit(f).alias("filter"), F.lit(a).alias("before"), F.lit(b).alias("after"), F.lit(w).alias("weight")) for f, a, b, w in subset_pairs())))
    pairs = passed.where("subset = 0").select("part", pair.alias("pair")).select("part", "pair.*")
    side = lambda at, mark: passed.select("part", F.col("subset").alias(at), *(F.col(c).alias(mark + c) for c in SUMS))
    joined = pairs.join(side("before", "b_"), ["part", "before"], "left").join(side("after", "a_"), ["part", "after"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    step = joined.select("part", "filter", "before", "after", "weight", count("a_n").alias("kept"), *((count(f"b_{c}") - count(f"a_{c}")).alias(name) for c, name in zip(SUMS, ("removed", "good_lost", "toxic_lost"), strict=True)))
    of_filter = Window.partitionBy("part", "filter")
    step = step.select(
        "*",
        (F.max(F.when(F.col("before") == 0, F.col("removed"))).over(of_filter) - F.col("removed")).alias("redundant"),
        F.max(F.when(F.col("after") == ALL, F.col("removed"))).over(of_filter).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("weight")).over(of_filter).alias("shapley"),
    )
    orders = spark.createDataFrame(order_steps(), "filter_order string, step int, filter string, before int")
    return step.join(F.broadcast(orders), ["filter", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
