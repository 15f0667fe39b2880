"""Budgeted packing and rendering.

The greedy packs are folds in which a row that doesn't fit takes no room. Room only shrinks, so
a row larger than the room left can never be taken: each round folds the next ``horizon`` rows of
a project that still could fit (narrow rows: sizes, not texts), takes the room that is left, and drops
what no longer fits. The horizon is below the number up to which Spark limits a window's groups in each task
(1,000), so of a hot project each task hands on its first rows only; nothing is folded that grows with
the project. A project with more rows then takes all that fit in a row at once, by running sums over ranges of the order:
the next row is too large for the room that is left, so what is left to fold fits into less than one file's room.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import parent
from ..functions.scripts import script_stub
from ..session import shared_path
from ..functions.text import BYTES_PER_TOKEN, brace_stub, escape_xml, line_skeleton, longest_run, safe_fence, strip_blank_lines, strip_comments

HORIZON = 999


def limit_bytes(tokens: int) -> int:
    return tokens * BYTES_PER_TOKEN


def _kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    path = shared_path(df.sparkSession, "pack")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _run(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The first rows (keys, path, size, _o) of each key that fit into its room one after the other: ranges of the order are summed in themselves
    and start at the sum of those before them, so no task holds a whole key."""
    ranged = _kept(rows.repartitionByRange(*keys, "_o").withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("size").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    near = ranged.join(sums.select(*keys, "_range", before.alias("_before")), [*keys, "_range"]).where(F.col("_before") <= F.col("room"))
    upto = F.sum("size").over(Window.partitionBy(*keys, "_range").orderBy("_o").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return near.withColumn("_upto", F.col("_before") + upto).where(F.col("_upto") <= F.col("room"))


def greedy_pack(sized: DataFrame, room: int, order: list[Column], keys: tuple[str, ...] = ("project_id",), horizon: int = HORIZON) -> DataFrame:
    """(keys, path, mode) of sized (keys, path, size, skeleton_size): full if it fits, else skeleton if that fits, else excluded."""
    narrow = sized.select(*keys, "path", F.col("size").cast("long").alias("size"), F.col("skeleton_size").cast("long").alias("skeleton_size"), F.struct(*order, "path").alias("_o"))
    least = F.least("size", F.coalesce("skeleton_size", "size"))
    rooms = narrow.select(*keys).distinct().withColumn("room", F.lit(room).cast("long"))
    left, taken = narrow, None
    while True:
        open_rows = left.join(rooms, list(keys)).where(least <= F.col("room"))
        first = open_rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("_o"))).where(F.col("_rn") <= horizon)
        listed = first.groupBy(*keys).agg(F.first("room").alias("room"), F.array_sort(F.collect_list(F.struct("_o", "path", "size", "skeleton_size"))).alias("rows"))
        kind = "array<struct<path:string,mode:string>>"
        start = F.struct(F.col("room").alias("room"), F.array().cast(kind).alias("out"))

        def step(acc: Column, r: Column) -> Column:
            full, part = r["size"] <= acc["room"], r["skeleton_size"] <= acc["room"]
            mode = F.when(full, "full").when(part, "skeleton")
            used = F.when(full, r["size"]).when(part, r["skeleton_size"]).otherwise(0)
            out = F.when(mode.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(r["path"].alias("path"), mode.alias("mode"))))
            return F.struct((acc["room"] - used).alias("room"), out.alias("out"))

        folded = _kept(listed.select(*keys, F.aggregate("rows", start, step).alias("f"), F.element_at("rows", -1)["_o"].alias("_last"), (F.size("rows") >= horizon).alias("_more")))
        now = folded.select(*keys, F.explode("f.out").alias("t")).select(*keys, "t.path", "t.mode")
        taken = now if taken is None else taken.unionByName(now)
        if not folded.where("_more").limit(1).count():
            break
        rooms = folded.where("_more").select(*keys, F.col("f.room").alias("room"), "_last")
        left = left.join(rooms, list(keys)).where((F.col("_o") > F.col("_last")) & (least <= F.col("room"))).drop("_last")
        run = _kept(_run(left, keys).select(*keys, "path", "_o", "_upto"))
        used = run.groupBy(*keys).agg(F.max("_upto").alias("used"), F.max("_o").alias("_past"))
        rooms = _kept(rooms.drop("_last").join(used, list(keys), "left").select(*keys, (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"), "_past"))
        taken = taken.unionByName(run.select(*keys, "path", F.lit("full").alias("mode")))
        left = _kept(left.drop("room").join(rooms, list(keys)).where((F.col("_past").isNull() | (F.col("_o") > F.col("_past"))) & (least <= F.col("room"))).drop("room", "_past"))
        rooms = rooms.drop("_past")
    return sized.select(*keys, "path").join(taken, [*keys, "path"], "left").withColumn("mode", F.coalesce("mode", F.lit("excluded")))


def pack_scored(candidates: DataFrame, token_limit: int | None, optimise: bool = True, largest: int | None = None) -> DataFrame:
    """Candidates (project_id, path, score, size, skeleton_size) in order of score; without a limit all are full. Oversized ones are a warning."""
    fits = candidates if largest is None else candidates.where(F.col("size") <= largest)
    over = None if largest is None else candidates.where(F.col("size") > largest).select("project_id", "path", F.lit("oversized").alias("mode"))
    if not optimise or not token_limit:
        out = fits.select("project_id", "path", F.lit("full").alias("mode"))
    else:
        out = greedy_pack(fits, limit_bytes(token_limit), [(-F.col("score")).alias("neg")])
    return out if over is None else out.unionByName(over)


def pack_smallest(candidates: DataFrame, limit: int) -> DataFrame:
    """Active files first, then the smallest first."""
    return greedy_pack(candidates, limit, [(~F.col("active")).alias("later"), F.col("size").alias("by")])


def with_contents(candidates: DataFrame, projects: DataFrame, files: DataFrame, max_kb: int) -> tuple[DataFrame, DataFrame]:
    """(candidates with their text and size, warnings of those without a project or file, or with too large a text)."""
    known = projects.select(F.col("id").alias("project_id")).distinct()
    read = candidates.join(known, "project_id", "left_semi").join(files.select("project_id", "path", "text"), ["project_id", "path"], "left")
    kind = F.when(F.col("text").isNull(), "unreadableFile").when(F.octet_length("text") > max_kb * 1024, "oversizedFile")
    told = read.withColumn("kind", kind)
    lost = candidates.join(known, "project_id", "left_anti").select(F.lit("unreadableFile").alias("kind"), "project_id", "path")
    good = told.where("kind is null").drop("kind", "size").withColumn("size", F.octet_length("text").cast("long"))
    return good, told.where("kind is not null").select("kind", "project_id", "path").unionByName(lost)


# Bundles of settings for a purpose.
SCENARIOS = {
    "initialShare": {"pack_mode": "skeleton", "optimise": True, "dependencies": False, "related_docs": False, "recipe": "text", "ignore_files": True},
    "debugFix": {"pack_mode": "full", "optimise": False, "recipe": "gitDiff"},
    "newFeature": {"pack_mode": "full", "optimise": False, "dependencies": True, "related_docs": True},
}


def scenario(kind: str, settings: dict | None = None) -> dict:
    """Settings with those of a scenario put over them; an unknown scenario changes none."""
    return {**(settings or {}), **SCENARIOS.get(kind, {})}


def modes(candidates: DataFrame, overrides: DataFrame, settings: dict, token_limit: int | None = None) -> DataFrame:
    """(project_id, path, mode): the mode set for the file, else the settings'; where these optimise, what the budget leaves of the rest."""
    keyed = candidates.join(overrides.select("project_id", "path", F.col("mode").alias("forced")), ["project_id", "path"], "left")
    if not settings.get("optimise") or not token_limit:
        return keyed.select("project_id", "path", F.coalesce("forced", F.lit(settings.get("pack_mode", "full"))).alias("mode"))
    free = keyed.where("forced is null").drop("forced")
    size = F.col("skeleton_size") if settings.get("pack_mode") == "skeleton" else F.col("size")
    packed = pack_scored(free.withColumn("size", size), token_limit).select("project_id", "path", "mode")
    named = F.when((F.col("mode") == "full") & F.lit(settings.get("pack_mode") == "skeleton"), "skeleton").otherwise(F.col("mode"))
    return packed.withColumn("mode", named).unionByName(keyed.where("forced is not null").select("project_id", "path", F.col("forced").alias("mode")))


def snippets(candidates: DataFrame, excerpts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a pseudo file path:start-end for each excerpt, warnings for candidates without one)."""
    joined = candidates.select("project_id", "path").join(excerpts, ["project_id", "path"], "left")
    name = F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return joined.where("start_line is not null").select("project_id", name.alias("path"), "content"), joined.where("start_line is null").select("project_id", "path", F.lit("missingExcerpt").alias("kind"))


def manifest(candidates: DataFrame, packed: DataFrame) -> DataFrame:
    """Every candidate with whether it is in the pack."""
    inside = packed.where("mode in ('full', 'skeleton')").select("project_id", "path", F.lit(True).alias("included"))
    return candidates.join(inside, ["project_id", "path"], "left").withColumn("included", F.coalesce("included", F.lit(False)))


def gate(rendered: DataFrame, token_limit: int) -> DataFrame:
    """Estimated tokens of the rendered text; over the limit the preview is empty."""
    n = F.ceil(F.octet_length("text") / BYTES_PER_TOKEN)
    return rendered.withColumn("tokens", n.cast("long")).withColumn("within_limit", n <= token_limit).withColumn("text", F.when(n <= token_limit, F.col("text")).otherwise(""))


#: Compressors by extension; the last is for all others.
COMPRESSORS = {"ts": script_stub, "tsx": script_stub, "js": script_stub, "jsx": script_stub, "*": brace_stub}


def compress(text: Column, path: Column) -> Column:
    """The compressor of the extension."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))
    out = F.when(F.lit(False), text)
    for name, f in COMPRESSORS.items():
        out = out.otherwise(f(text)) if name == "*" else out.when(extension == name, f(text))
    return out


def processed(text: Column, skeleton: Column | None = None, remove_comments: bool = False, keep_blank_lines: bool = False, max_kb: int | None = None) -> Column:
    """F10 and the content filters of a rendered file."""
    out = text if skeleton is None else F.when(skeleton, line_skeleton(text)).otherwise(text)
    out = strip_comments(out) if remove_comments else out
    out = out if keep_blank_lines else strip_blank_lines(out)
    return out if max_kb is None else F.when(F.length(text) > max_kb * 1024, f"[WARNING] File size exceeds {max_kb}KB. Content omitted.").otherwise(out)


def _ordered(value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("ord", "path", value.alias("v")))), lambda x: x["v"])


def tree_text(paths: DataFrame) -> DataFrame:
    """(project_id, tree): the directory tree of packed paths as text.

    A node's line is its ancestors' rails, its connector and its name; whether it is the last among
    its siblings is a window over siblings. Packs are bounded by their budget, and so is a tree.
    """
    parts = F.split("path", r"[\\/]")
    node = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.slice(F.filter(parts, lambda p: p != "."), 1, i)))
    nodes = paths.select("project_id", node.alias("node")).where(F.size("node") > 0).distinct()
    up = nodes.withColumn("up", F.slice("node", 1, F.size("node") - 1))
    last = F.lead("node").over(Window.partitionBy("project_id", "up").orderBy("node")).isNull()
    flagged = up.withColumn("last", last)
    prefixes = flagged.select("project_id", "node", F.explode(F.transform(F.sequence(F.lit(1), F.size("node")), lambda i: F.struct(i.alias("i"), F.slice("node", 1, i).alias("above")))).alias("p"))
    joined = prefixes.select("project_id", "node", F.col("p.i").alias("i"), F.col("p.above").alias("above")).join(flagged.select("project_id", F.col("node").alias("above"), "last"), ["project_id", "above"])
    piece = F.when(F.col("i") < F.size("node"), F.when(F.col("last"), "    ").otherwise("│   ")).otherwise(F.when(F.col("last"), "└── ").otherwise("├── "))
    line = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", piece.alias("s")))), lambda x: x["s"]), ""), F.element_at("node", -1), F.lit("\n"))
    drawn = joined.groupBy("project_id", "node").agg(line.alias("line"))
    return drawn.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "line"))), lambda x: x["line"]), "").alias("tree"))


def render(packed: DataFrame, kind: str = "markdown", prompt: str = "", structure_only: bool = False) -> DataFrame:
    """K1 to K7: (project_id, text) of packed rows (project_id, ord, path, content): one document for each project.

    Rows are what a pack took, so their texts are within its budget. An unknown kind is Markdown.
    """
    drawn = tree_text(packed.select("project_id", parent(F.col("path")).alias("path")).where("path <> ''").distinct() if structure_only else packed)
    if kind == "paths":
        return packed.groupBy("project_id").agg(F.array_join(_ordered(F.col("path")), "\n").alias("text"))
    if kind == "json":
        body = F.transform(F.array_sort(F.collect_list(F.struct("ord", "path", "content"))), lambda x: F.struct(x["path"].alias("path"), x["content"].alias("content")))
        both = packed.groupBy("project_id").agg(body.alias("repository")).join(drawn, "project_id", "left")
        return both.select("project_id", F.to_json(F.struct(F.lit(prompt).alias("prompt"), F.coalesce("tree", F.lit("")).alias("structure"), "repository")).alias("text"))
    if kind == "xml":
        one = F.concat(F.lit('  <file path="'), escape_xml(F.col("path")), F.lit('">\n'), escape_xml(F.col("content")), F.lit("\n  </file>"))
        both = packed.groupBy("project_id").agg(F.array_join(_ordered(one), "\n").alias("body")).join(drawn, "project_id", "left")
        head = F.lit("<repository>\n" + (f"  <instruction>\n{prompt}\n  </instruction>\n" if prompt else ""))
        return both.select("project_id", F.concat(head, F.lit("  <structure>\n"), escape_xml(F.coalesce("tree", F.lit(""))), F.lit("\n  </structure>\n"), "body", F.lit("\n</repository>\n")).alias("text"))
    fence = packed.groupBy("project_id").agg(safe_fence(F.max(longest_run(F.col("content")))).alias("fence"))
    with_fence = packed.join(fence, "project_id")
    one = F.concat(F.lit("## File: "), "path", F.lit("\n"), "fence", F.lit("\n"), "content", F.lit("\n"), "fence", F.lit("\n"))
    body = F.array_join(_ordered(one), "\n")
    both = with_fence.groupBy("project_id").agg(F.first("fence").alias("fence"), *([] if structure_only else [body.alias("body")])).join(drawn, "project_id", "left")
    head = F.concat(F.lit(f"{prompt}\n\n" if prompt else ""), F.lit("## Directory Structure\n"), "fence", F.lit("\n"), F.coalesce("tree", F.lit("")), "fence", F.lit("\n\n"))
    text = F.concat(head, F.lit("") if structure_only else F.col("body"))
    return both.select("project_id", F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit("\n")).alias("text"))
