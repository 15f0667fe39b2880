"""Recommendations: by link, by name or heading, by directory, by co-change; merged and joined with the base candidates.

A recommendation of one source for one file keeps its best score, and of equal scores the smallest
detail. So for sources whose score is a constant only the smallest recommending file matters:
these are worked out from the first few files of each directory or word (two, as a file doesn't
recommend itself, and one more for each file that must not count because it links the target), and no
list of pairs is made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import MARKDOWN, available_path, parent, resolve_link, stem
from ..functions.text import GENERAL_WORDS, heading_tokens, link_targets, tokens
from ..session import kept

# Sources in their order, and their scores.
SOURCES = ["markdownLink", "headingMatch", "coChange", "directoryProximity"]
LINK_SCORE, HEADING_SCORE, DIRECTORY_SCORE = 0.8, 0.6, 0.5
#: Rows of two paths or a path and a word that are broadcast at most.
BROADCAST_ROWS = 300_000
#: Base files of a word that are kept together, the first by path.
FIRST = 8
#: Base files of a project that all its files are compared with before any others, the first by path; fewer if their words are too many to be broadcast.
HEADS = 16
PROBES = ["", ".md", ".markdown", ".mdx"]


def valid(recs: DataFrame) -> DataFrame:
    """F12"""
    return recs.where(F.col("source").isin(SOURCES) & F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") >= 0) & (F.col("score") < float("inf")))


def smallest(df: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """keys, rank, value: the ``most`` smallest distinct values. Tasks hand on no more than that of each key, so a hot key is cut before the shuffle (where most is below a thousand)."""
    order = Window.partitionBy(*keys).orderBy(value)
    return df.select(*keys, value).withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= most).distinct()


def two_smallest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, lo, lo2: the two smallest distinct values."""
    return smallest(df, keys, value, 2).groupBy(*keys).agg(F.min(value).alias("lo"), F.min(F.when(F.col("rank") == 2, F.col(value))).alias("lo2"))


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has no more than BROADCAST_ROWS rows; df must be cheap to count."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def by_directory(base: DataFrame, files: DataFrame) -> DataFrame:
    """Files in the directory of a base file, other than that file."""
    least = two_smallest(base.select("project_id", parent(F.col("path")).alias("dir"), "path"), ["project_id", "dir"], "path")
    found = files.select("project_id", "path", parent(F.col("path")).alias("dir")).join(least, ["project_id", "dir"])
    by = F.when(F.col("path") == F.col("lo"), F.col("lo2")).otherwise(F.col("lo"))
    return found.select("project_id", "path", F.lit("directoryProximity").alias("source"), F.lit(DIRECTORY_SCORE).alias("score"), F.concat(F.lit("Same directory as "), by).alias("detail")).where("detail is not null")


def link_pairs(base: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, src, path): what each base file (with text) links to; wiki links are also tried with Markdown extensions, the first that exists wins."""
    links = base.select("project_id", F.col("path").alias("src"), F.explode(link_targets(F.col("text"))).alias("l"))
    links = links.select("project_id", "src", resolve_link(F.col("src"), F.col("l.target")).alias("target"), F.col("l.extensionless").alias("wiki")).where("target is not null").distinct()
    probes = F.when(F.col("wiki") & ~F.col("target").rlike(r"[^/.][^/]*\.[^/.]*\z"), F.array(*map(F.lit, PROBES))).otherwise(F.array(F.lit("")))
    tried = links.select("project_id", "src", "target", F.posexplode(probes).alias("rank", "probe")).withColumn("path", F.concat("target", "probe"))
    hits = tried.join(files.select("project_id", "path"), ["project_id", "path"])
    found = hits.groupBy("project_id", "src", "target").agg(F.min_by("path", "rank").alias("path")).where(available_path(F.col("src")) != F.col("path"))
    return found.select("project_id", "src", "path").distinct()


def _best(pairs: DataFrame, source: str, score: float, detail: str) -> DataFrame:
    """Recommendations of pairs (project_id, path, src) with one score: of each file the smallest src."""
    least = pairs.groupBy("project_id", "path").agg(F.min("src").alias("src"))
    return least.select("project_id", "path", F.lit(source).alias("source"), F.lit(score).alias("score"), F.concat(F.lit(detail), "src").alias("detail"))


def by_link(base: DataFrame, files: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """J6"""
    return _best(link_pairs(base, files) if pairs is None else pairs, "markdownLink", LINK_SCORE, "Markdown link from ")


def _in(words: list[str]) -> Callable[[Column], Column]:
    return lambda x: x.isin(words)


def by_name(base: DataFrame, files: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Markdown files that share a word of their name or headings with a base file that doesn't link them.

    A single match by a general word doesn't count; a base file's words count as often as they occur.
    Any word that isn't general is enough by itself. Matches by general words alone depend only on
    how often a base file has each of them and on which of them a file has, so the set that a file has is one more
    word of it, and a base file has each set (of 8) in which it has two words or one twice.
    All files are first compared with the HEADS first base files of their project, whose words are broadcast: a file's matches among them are the bits of
    a number, out of which its own and those of base files that link it are taken; the lowest that is left is the smallest of all, as the numbers
    of base files follow their paths. Only the words of files without such a match (none, mostly) are joined with the words of all base files.
    There, of each word the FIRST first base files are kept as an array, out of which a file takes the first that neither is nor links it:
    a row for each word of a file. Only a file that more than FIRST - 2 base files link may need more than these; its words are
    joined by rank with as many base files of a word as link it, and two more.
    """
    pairs = kept(link_pairs(base, files) if pairs is None else pairs, "pairs")
    words = lambda text: F.concat(tokens(stem(F.col("path"))), heading_tokens(F.coalesce(text, F.lit(""))))
    general = F.array(*map(F.lit, GENERAL_WORDS))
    sets = [[g for i, g in enumerate(GENERAL_WORDS) if n >> i & 1] for n in range(1 << len(GENERAL_WORDS))]
    name = lambda s: F.concat(F.lit("{"), F.array_join(s, ","), F.lit("}"))
    strong = F.array_except("w", general)
    # base files by numbers in the order of their paths, so that the smallest path is the smallest number
    numbers = base.select("project_id", F.col("path").alias("src")).distinct().repartitionByRange("project_id", "src").sortWithinPartitions("project_id", "src")
    numbers = small(kept(numbers.withColumn("no", F.monotonically_increasing_id()), "numbers"))
    src = base.select("project_id", F.col("path").alias("src"), words(F.col("text")).alias("w"))
    enough = [F.when(F.size(F.filter("w", _in(s))) >= 2, name(F.array(*map(F.lit, s)))) for s in sets if s]
    of_src = F.concat(strong, F.filter(F.array(*enough), lambda x: x.isNotNull()))
    src_words = kept(src.select("project_id", "src", F.explode(of_src).alias("word")).join(numbers, ["project_id", "src"]).select("project_id", "word", "no"), "base-words")
    of_dst = F.array_append(strong, name(F.filter(general, lambda g: F.array_contains("w", g))))
    asked_of = lambda rows, *more: rows.select("project_id", "path", *more, words(F.col("text")).alias("w")).select("project_id", "path", *more, F.explode(of_dst).alias("word"))
    dst = files.where(F.col("path").rlike(MARKDOWN))

    heads = kept(smallest(numbers, ["project_id"], "no", HEADS), "heads")
    head_words = kept(src_words.join(small(heads), ["project_id", "no"]).select("project_id", "word", "rank"), "head-words")
    sizes = {r["rank"]: r["count"] for r in head_words.groupBy("rank").count().collect()}
    most = max((k for k in range(1, HEADS + 1) if sum(n for rank, n in sizes.items() if rank <= k) <= BROADCAST_ROWS), default=1)
    heads, head_words = small(heads.where(F.col("rank") <= most)), head_words.where(F.col("rank") <= most)
    bits = F.expr("bit_or(shiftleft(1L, rank - 1))")
    masks = small(kept(head_words.groupBy("project_id", "word").agg(bits.alias("mask")), "masks"))
    matches = asked_of(dst).join(masks, ["project_id", "word"], "left").groupBy("project_id", "path").agg(F.coalesce(F.bit_or("mask"), F.lit(0)).alias("mask"))
    of_heads = numbers.join(heads, ["project_id", "no"]).select("project_id", "src", "rank")
    linked = pairs.join(small(of_heads), ["project_id", "src"]).select("project_id", "path", "rank")
    barred = of_heads.withColumnRenamed("src", "path").unionByName(linked).groupBy("project_id", "path").agg(bits.alias("barred"))
    matches = kept(matches.join(small(kept(barred, "barred")), ["project_id", "path"], "left").select("project_id", "path", F.expr("mask & ~coalesce(barred, 0L)").alias("mask")), "matches")
    sure = matches.where("mask <> 0").withColumn("rank", F.expr("cast(bit_count((mask & -mask) - 1) as int) + 1"))
    found = sure.join(heads, ["project_id", "rank"]).select("project_id", "path", "no")
    rest = matches.where("mask = 0").select("project_id", "path")
    if not rest.isEmpty():
        found = found.unionByName(_by_any_name(src_words, numbers, pairs, dst.join(small(rest), ["project_id", "path"], "left_semi"), asked_of))
    least = found.groupBy("project_id", "path").agg(F.min("no").alias("no")).join(numbers, ["project_id", "no"])
    return least.select("project_id", "path", F.lit("headingMatch").alias("source"), F.lit(HEADING_SCORE).alias("score"), F.concat(F.lit("Filename or heading match from "), "src").alias("detail"))


def _by_any_name(src_words: DataFrame, numbers: DataFrame, pairs: DataFrame, files: DataFrame, asked_of: Callable[..., DataFrame]) -> DataFrame:
    """(project_id, path, no): base files, the smallest among them, that share a word with a file and neither are nor link it."""
    asked_words = kept(asked_of(files).select("project_id", "word").distinct(), "asked")
    src_words = src_words.join(small(asked_words), ["project_id", "word"], "left_semi")
    arrays = smallest(src_words, ["project_id", "word"], "no", FIRST).groupBy("project_id", "word").agg(F.sort_array(F.collect_list("no")).alias("nos"))
    arrays = small(kept(arrays, "words"))

    linking = kept(pairs.join(numbers, ["project_id", "src"]).select("project_id", "path", "no"), "linking")
    linkers = smallest(linking, ["project_id", "path"], "no", FIRST - 1).groupBy("project_id", "path").agg(F.collect_list("no").alias("linkers"))
    linkers = small(kept(linkers, "linkers"))
    dst = files.join(linkers, ["project_id", "path"], "left").join(numbers.withColumnRenamed("src", "path").withColumnRenamed("no", "own"), ["project_id", "path"], "left").withColumn("own", F.coalesce("own", F.lit(-1)))
    asked = asked_of(dst.where("linkers is null or size(linkers) <= " + str(FIRST - 2)), "own", "linkers")
    first = F.when(F.get("nos", F.lit(0)) != F.col("own"), F.get("nos", F.lit(0))).otherwise(F.get("nos", F.lit(1)))
    unlinked = F.get(F.filter("nos", lambda x: (x != F.col("own")) & ~F.array_contains("linkers", x)), F.lit(0))
    picked = F.when(F.col("linkers").isNull(), first).otherwise(unlinked)
    found = asked.join(arrays, ["project_id", "word"]).select("project_id", "path", picked.alias("no")).where("no is not null")

    heavy = linkers.where(F.size("linkers") > FIRST - 2).select("project_id", "path")
    counts = small(kept(linking.join(heavy, ["project_id", "path"], "left_semi").groupBy("project_id", "path").agg(F.count(F.lit(1)).alias("links")), "links"))
    most = counts.agg(F.max("links")).first()[0]
    if most:
        ranks = F.explode(F.sequence(F.lit(1), (F.col("links") + 2).cast("int")))
        many = asked_of(dst.join(counts, ["project_id", "path"]), "own", "links").select("project_id", "path", "own", "word", ranks.alias("rank"))
        ranked = smallest(src_words.join(many.select("project_id", "word").distinct(), ["project_id", "word"], "left_semi"), ["project_id", "word"], "no", most + 2)
        more = many.join(ranked, ["project_id", "word", "rank"]).where("no <> own").join(small(linking), ["project_id", "path", "no"], "left_anti")
        found = found.unionByName(more.select("project_id", "path", "no"))
    return found


def markdown(base: DataFrame, files: DataFrame) -> DataFrame:
    """Links, and name matches with base files that don't link the file."""
    pairs = link_pairs(base, files)
    return by_link(base, files, pairs).unionByName(by_name(base, files, pairs))


def by_co_change(found: DataFrame) -> DataFrame:
    """co_changes() rows with a project as recommendations; the score is the count."""
    return found.select("project_id", "path", F.lit("coChange").alias("source"), F.col("n").cast("double").alias("score"), F.concat(F.lit("Changed with "), "target").alias("detail"))


def collect(sources: dict[str, Callable[[], DataFrame]], candidates: DataFrame, enabled: dict[str, bool] | None = None) -> tuple[DataFrame, DataFrame]:
    """(recommendations of the enabled sources in their order, warnings for each candidate of a source that failed).

    A source is a function without arguments. One that can't be planned (no such table or column, settings that
    don't hold) fails by itself; the others go on.
    """
    spark = candidates.sparkSession
    recs = spark.createDataFrame([], "project_id string, path string, source string, score double, detail string")
    warnings = spark.createDataFrame([], "kind string, project_id string, relative_path string, message string")
    for name in (n for n in SOURCES if n in sources and (enabled or {}).get(n, True)):
        try:
            recs = recs.unionByName(sources[name]().select(*recs.columns))
        except (PySparkException, ValueError, KeyError) as e:
            first = str(e).strip().partition("\n")[0]
            failed = candidates.select(F.lit("recommendationFailure").alias("kind"), "project_id", F.col("path").alias("relative_path"), F.lit(f"Recommendation source {name} failed: {first}").alias("message"))
            warnings = warnings.unionByName(failed)
    return recs, warnings


def merge(recs: DataFrame) -> DataFrame:
    """A3, A5: (project_id, path, reasons, rec_score): for each source the best score, of equal ones the smallest detail; the score is their sum."""
    order = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    path = F.regexp_replace("path", r"\\", "/")
    best = valid(recs).groupBy("project_id", path.alias("path"), "source").agg(F.min(F.struct((-F.col("score")).alias("neg"), "detail")).alias("b"))
    listed = F.array_sort(F.collect_list(F.struct(order.alias("ord"), "source", (-F.col("b.neg")).alias("score"), F.col("b.detail").alias("detail"))))  # at most one for each source
    merged = best.groupBy("project_id", "path").agg(listed.alias("reasons"))
    return merged.withColumn("rec_score", F.aggregate("reasons", F.lit(0.0), lambda a, r: a + r["score"]))


def with_base(base: DataFrame, merged: DataFrame) -> DataFrame:
    """Base candidates (project_id, path, score) as they are, and recommended files that are none of them."""
    new = merged.join(base.select("project_id", "path"), ["project_id", "path"], "left_anti").select("project_id", "path", F.col("rec_score").alias("score"), F.lit(True).alias("recommended"))
    return base.select("project_id", "path", F.col("score").cast("double").alias("score"), F.lit(False).alias("recommended")).unionByName(new)


def reasons_by_key(base: DataFrame, merged: DataFrame) -> DataFrame:
    """The reasons of every base key, if only none, and of every recommended key."""
    none = F.lit(None).cast(merged.schema["reasons"].dataType)
    return base.select("project_id", "path").distinct().join(merged.select("project_id", "path", "reasons"), ["project_id", "path"], "full").withColumn("n_reasons", F.coalesce(F.size(F.coalesce("reasons", none)), F.lit(0)))


def selected_base(selected: DataFrame, base: DataFrame) -> DataFrame:
    """The selected keys that are base candidates, separators folded."""
    return selected.select("project_id", F.translate("path", "\\", "/").alias("path")).join(base.select("project_id", "path"), ["project_id", "path"], "left_semi")


def upsert(state: DataFrame, news: DataFrame) -> DataFrame:
    """(project_id, path, score, reasons, selected): news overwrite the score, add their reason if it is new, and select new keys."""
    joined = state.join(news.select("project_id", "path", F.col("score").alias("n_score"), F.col("reason").alias("n_reason")), ["project_id", "path"], "full")
    none = F.array().cast("array<string>")
    reasons = F.coalesce("reasons", none)
    return joined.select(
        "project_id", "path", F.coalesce("n_score", "score").alias("score"),
        F.when(F.col("n_reason").isNull(), reasons).otherwise(F.array_union(reasons, F.array("n_reason"))).alias("reasons"),
        F.coalesce("selected", F.lit(True)).alias("selected"),
    )


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the greatest by the columns of the order; each task hands on one row of a key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in rest))
