"""Search: line hits with context, excerpts, recipes, path resolution, related files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import any_ends_with, base_name, fold_separators, parse_extensions, resolve_import
from ..functions.text import import_targets, lines
from .signals import REASON_WEIGHTS

MOST_CONTEXT = 50


def file_lines(files: DataFrame) -> DataFrame:
    """(project_id, path, ln, line), numbered from 1."""
    return files.select("project_id", "path", F.posexplode(lines(F.col("text"))).alias("ln", "line")).withColumn("ln", F.col("ln") + 1)


def context_lines(files: DataFrame, pattern: str, context: int = 3) -> DataFrame:
    """The lines that match a pattern and those within ``context`` of one. A file's lines are one window partition."""
    if not 0 <= context <= MOST_CONTEXT:
        raise ValueError("context must be between 0 and 50")
    hits = files.where(F.col("text").rlike(f"(?m){pattern}"))  # files without a hit lose their lines before they are cut
    marked = file_lines(hits).withColumn("hit", F.col("line").rlike(pattern))
    w = Window.partitionBy("project_id", "path").orderBy("ln").rowsBetween(-context, context)
    return marked.withColumn("near", F.max("hit").over(w)).where("near").select("project_id", "path", "ln", "line", "hit")


def merge_excerpts(found: DataFrame, keys: tuple[str, ...] = ("project_id", "path")) -> DataFrame:
    """Consecutive lines as one excerpt (keys, start_line, end_line, content); of a line that repeats one stays."""
    one = found.groupBy(*keys, "ln").agg(F.min("line").alias("line"))
    island = F.col("ln") - F.row_number().over(Window.partitionBy(*keys).orderBy("ln"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n")
    return one.withColumn("island", island).groupBy(*keys, "island").agg(F.min("ln").alias("start_line"), F.max("ln").alias("end_line"), content.alias("content")).drop("island")


def contains_text(files: DataFrame, query: str) -> DataFrame:
    """The files that hold a text in any case."""
    return files.where(F.contains(F.lower("text"), F.lit(query.lower()))).select("project_id", "path").distinct()


def first_paths(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` files in the order of project and path."""
    return found.orderBy("project_id", "path").limit(most)


def recipe(kind: str, value: str, path: Column) -> tuple[Column, str]:
    """(predicate, reason) of a path recipe."""
    if kind == "text":
        return F.contains(F.lower(path), F.lit(value.lower())), "rgMatch"
    if kind == "extension":
        return any_ends_with(path, parse_extensions(value)), "extensionMatch"
    if kind == "directory":
        prefix = value.replace("\\", "/")
        return F.startswith(path, F.lit((prefix[:-1] if prefix.endswith("/") else prefix) + "/")), "directoryMatch"
    raise ValueError(f"no such recipe: {kind}")


def by_recipe(files: DataFrame, kind: str, value: str) -> DataFrame:
    """Candidates of a path recipe."""
    test, reason = recipe(kind, value, F.col("path"))
    return files.where(test).select("project_id", "path", "size", F.lit(reason).alias("reason"))


def ends(df: DataFrame, name: str, other: DataFrame, other_name: str) -> DataFrame:
    """df with ``tail``: the proper ends of its name that are as long as some name of other. The lengths come as one row that is joined, an array of
    distinct numbers, so nothing passes through the driver and the plan does not grow with them."""
    lengths = other.where(F.col(other_name) != "").agg(F.collect_set(F.length(other_name)).alias("_lengths"))
    longer = df.crossJoin(F.broadcast(lengths)).withColumn("_n", F.explode(F.filter("_lengths", lambda n: n < F.length(name))))
    return longer.withColumn("tail", F.right(F.col(name), F.col("_n"))).drop("_lengths", "_n")


def resolve_paths(clips: DataFrame, files: DataFrame) -> DataFrame:
    """(clip_id, clip, path) for each mentioned path; path is null if it is unresolved.

    Tiers: the same path in any case; the only file with a common suffix; the only file with
    the most equal segments at the end, two at least. All tiers need the same last segment or a
    suffix of it, so the join is an equi-join on the last segment, plus a join on all suffixes of
    the file names that a clip's last segment can be part of.
    """
    norm = F.regexp_replace(F.lower(fold_separators(F.col("clip"))), "^/+", "")
    c = clips.select("clip_id", "clip", norm.alias("n")).withColumn("last", base_name(F.col("n"))).withColumn("n_segments", F.size(F.split("n", "/")))
    f = files.select("path").distinct().withColumn("low", F.lower("path")).withColumn("f_last", base_name(F.col("low")))
    same = c.join(f, c["last"] == f["f_last"])
    # a clip without a slash may be the end of a longer file name, and a file name the end of a clip's last segment
    # (only ends of lengths that occur on the other side; a name's length is bounded by its file system)
    single, flat = c.where("n_segments = 1 and length(last) > 0"), f.where(~F.contains("low", F.lit("/")))
    part = ends(f, "f_last", single, "last").join(single, F.col("last") == F.col("tail")).drop("tail").unionByName(ends(c, "last", flat, "f_last").join(flat, F.col("tail") == F.col("f_last")).drop("tail"))
    equal = F.zip_with(F.reverse(F.split("n", "/")), F.reverse(F.split("low", "/")), lambda x, y: F.coalesce(x == y, F.lit(False)))
    trailing = F.when(F.array_position(equal, False) > 0, F.array_position(equal, False) - 1).otherwise(F.size(equal))
    scored = same.unionByName(part).select(
        "clip_id", "clip", "path", "n_segments", (F.col("n") == F.col("low")).alias("exact"), (F.endswith("low", "n") | F.endswith("n", "low")).alias("suffix"), trailing.alias("trailing")
    )
    best = scored.groupBy("clip_id", "clip").agg(
        F.min(F.when(F.col("exact"), F.col("path"))).alias("p1"),
        F.count_if("suffix").alias("n2"), F.min(F.when(F.col("suffix"), F.col("path"))).alias("p2"),
        F.max(F.when((F.col("trailing") >= 2) & (F.col("n_segments") >= 2), F.col("trailing"))).alias("m3"),
        F.max_by("path", F.when((F.col("trailing") >= 2) & (F.col("n_segments") >= 2), F.struct("trailing", "path"))).alias("p3"),
    )
    ties = scored.where("trailing >= 2").groupBy("clip_id", "clip", "trailing").agg(F.count(F.lit(1)).alias("n3")).withColumnRenamed("trailing", "m3")
    best = best.join(ties, ["clip_id", "clip", "m3"], "left")
    path = F.coalesce("p1", F.when(F.col("n2") == 1, F.col("p2")), F.when(F.col("n3") == 1, F.col("p3")))
    return clips.select("clip_id", "clip").distinct().join(best.select("clip_id", "clip", path.alias("path")), ["clip_id", "clip"], "left")


# Names of test files, and where none are looked for.
TEST_FILE, NO_TESTS = r"\.(?:spec|test|Test)\.(?:ts|tsx|js|jsx)\z", r"(?:^|/)node_modules/"


def related_tests(changed: DataFrame, files: DataFrame) -> DataFrame:
    """Test files whose name starts with a changed file's stem, or holds it before an underscore, in any case of letters.

    A test is indexed under all prefixes of its name and all that ends before one of its underscores, so both are
    one equi-join; names are short, which bounds the index.
    """
    name = F.lower(base_name(F.col("path")))
    tests = files.where(F.col("path").rlike(TEST_FILE) & ~F.col("path").rlike(NO_TESTS)).select("project_id", "path", name.alias("name"))
    places = F.sequence(F.lit(1), F.length("name"))
    prefixes = F.concat(F.array(F.lit("")), F.transform(places, lambda n: F.substr("name", F.lit(1), n)))
    underscores = F.filter(places, lambda at: F.substr("name", at, F.lit(1)) == "_")
    before = F.flatten(F.transform(underscores, lambda at: F.transform(F.sequence(F.lit(1), at), lambda i: F.substr("name", i, at - i))))
    indexed = tests.select("project_id", "path", F.explode(F.array_distinct(F.concat(prefixes, before))).alias("stem"))
    stems = changed.select("project_id", F.regexp_replace(F.lower(base_name(F.col("path"))), r"(?<=.)\.[^.]*\z", "").alias("stem")).distinct()
    return indexed.join(stems, ["project_id", "stem"], "left_semi").select("project_id", "path").distinct()


def imports(files: DataFrame) -> DataFrame:
    """(project_id, src, target) of the relative imports of each file."""
    t = F.explode(F.array_distinct(F.transform(import_targets(F.col("text")), lambda x: resolve_import(F.col("path"), x))))
    return files.select("project_id", F.col("path").alias("src"), t.alias("target")).where("target is not null")


# What an import without an extension may stand for, in order.
SOURCE_PROBES = ["", ".ts", ".tsx", ".js", ".jsx", ".d.ts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.d.ts"]
PACK_PROBES = ["", ".ts", ".tsx", ".js", ".jsx", ".json"]


def expand_imports(base: DataFrame, found: DataFrame, files: DataFrame, probes: list[str] = SOURCE_PROBES) -> DataFrame:
    """(project_id, path) of files that base's files import and that are not in base; the first probe that exists wins."""
    tried = found.join(base.select("project_id", F.col("path").alias("src")).distinct(), ["project_id", "src"], "left_semi")
    tried = tried.select("project_id", "src", "target", F.posexplode(F.array(*map(F.lit, probes))).alias("rank", "probe")).withColumn("low", F.lower(F.concat("target", "probe")))
    hits = tried.join(files.select("project_id", "path", F.lower("path").alias("low")), ["project_id", "low"])
    first = hits.groupBy("project_id", "src", "target").agg(F.min_by("path", "rank").alias("path")).select("project_id", "path").distinct()
    return first.join(base.select("project_id", "path"), ["project_id", "path"], "left_anti")


def import_closure(base: DataFrame, found: DataFrame, files: DataFrame, depth: int = 2) -> DataFrame:
    """(project_id, path, depth) of files reached by at most ``depth`` imports; base itself is left out."""
    seen, front, out = base.select("project_id", "path").distinct(), base.select("project_id", "path").distinct(), None
    for d in range(1, depth + 1):
        front = expand_imports(front, found, files, PACK_PROBES).join(seen, ["project_id", "path"], "left_anti")
        seen = seen.unionByName(front)
        level = front.withColumn("depth", F.lit(d))
        out = level if out is None else out.unionByName(level)
    return out


def docgraph(base: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, path, score): files that an edge with a valid confidence leads to from a Markdown file of base."""
    good = edges.where("confidence between 0 and 1 and not isnan(confidence) and trim(reason) <> ''").where(~F.col("dst").rlike(r"^/|^[A-Za-z]:|(?:^|/)\.\.(?:/|\z)"))
    start = base.where(F.endswith("path", F.lit(".md"))).select("project_id", F.lower("path").alias("low")).distinct()
    hit = good.withColumn("low", F.lower("src")).join(start, ["project_id", "low"]).select("project_id", F.lower("dst").alias("low"), "confidence")
    found = hit.groupBy("project_id", "low").agg(F.max("confidence").alias("score")).join(files.select("project_id", "path", F.lower("path").alias("low")), ["project_id", "low"])
    return found.select("project_id", "path", "score").join(base.select("project_id", "path"), ["project_id", "path"], "left_anti")


#: Reasons of the recipes that start from changed files.
CHANGES = {"gitDiff": "gitModified", "gitCommit": "gitCommit"}


def discover(kind: str, changed: DataFrame, files: DataFrame, edges: DataFrame, value: str = "") -> DataFrame:
    """(project_id, path, score) of a recipe.

    A diff or commit gives the changed files (with text), then the files that they import, then those that the graph leads
    to from any of these; other recipes test the paths of files (project_id, path, text).
    """
    weigh = lambda df, reason: df.select("project_id", "path", F.lit(float(REASON_WEIGHTS[reason])).alias("score"))
    if kind not in CHANGES:
        test, reason = recipe(kind, value, F.col("path"))
        return weigh(files.where(test), reason)
    start = changed.select("project_id", "path")
    imported = expand_imports(start, imports(changed), files)
    related = docgraph(start.unionByName(imported), edges, files)
    return weigh(start, CHANGES[kind]).unionByName(weigh(imported, "dependency")).unionByName(weigh(related, "docgraph"))


def diagnostics_of(diagnostics: DataFrame, selected: DataFrame) -> DataFrame:
    """Diagnostics (uri, message) whose URI ends with a selected path: an equi-join on the URI's suffixes at slashes."""
    parts = F.split("uri", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    cut = diagnostics.withColumn("path", F.explode(tails))
    return cut.join(selected.select("path").distinct(), "path", "left_semi").select("uri", "message").distinct()


def co_changes(commits: DataFrame, targets: DataFrame, history: int = 50) -> DataFrame:
    """(project_id, target, path, n): in how many of a project's last ``history`` commits with the target another document changed too.

    commits (project_id, commit_id, ts, path), targets (project_id, path). What is paired is bounded by the history.
    """
    each = commits.groupBy("project_id", "commit_id").agg(F.max("ts").alias("ts"))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("ts"), F.desc("commit_id")))
    last = each.withColumn("rank", rank).where(F.col("rank") <= history).select("project_id", "commit_id")
    changed = commits.join(last, ["project_id", "commit_id"], "left_semi").select("project_id", "commit_id", "path").distinct()
    docs = changed.where(F.col("path").rlike(r"(?i)\.(?:md|markdown|mdx|rst|txt)\z") & ~F.col("path").rlike(r"^/|(?:^|/)\.\.(?:/|\z)"))
    with_target = changed.join(targets.select("project_id", "path"), ["project_id", "path"], "left_semi").select("project_id", "commit_id", F.col("path").alias("target"))
    return docs.join(with_target, ["project_id", "commit_id"]).where("path <> target").groupBy("project_id", "target", "path").agg(F.count(F.lit(1)).alias("n"))


def recent_files(commits: DataFrame, limit: int = 200) -> DataFrame:
    """(path, n) over the last ``limit`` commits, the most frequent first, ties by the latest commit."""
    last = commits.select("commit_id", "ts").distinct().orderBy(F.desc("ts"), F.desc("commit_id")).limit(limit)
    counted = commits.join(F.broadcast(last.select("commit_id")), "commit_id").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
    return counted.orderBy(F.desc("n"), F.desc("last_ts"), "path")


def recent_by_time(files: DataFrame, more: DataFrame, first: int = 50, most: int = 200) -> DataFrame:
    """The last ``first`` files by time, then those of more (path, ord) that are not among them, ``most`` at the most."""
    top = files.orderBy(F.desc("mtime"), "path").limit(first)
    ranked = top.select("path", F.row_number().over(Window.orderBy(F.desc("mtime"), "path")).alias("ord"))
    extra = more.join(F.broadcast(ranked.select("path")), "path", "left_anti").orderBy("ord").limit(most)
    return ranked.unionByName(extra.select("path", (F.col("ord") + first).alias("ord"))).orderBy("ord").limit(most)
