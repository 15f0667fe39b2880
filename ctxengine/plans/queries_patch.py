"""Queries over replies: fences, patches, targets, healing, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fences, path_hint, path_in_context
from ..operators import patch
from ..session import kept
from ..sources.tables import code, files, replies, table
from .catalog import CODE, FILES, REPLIES, query

N = "chr(10)"
TRIMMED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query("fence_blocks", "P36 P37 W7", "SELECT conv_id, turn, 2::BIGINT AS n_blocks, (2 * length(text) + 2)::BIGINT AS n_chars FROM conversations WHERE role = 'assistant'")
def fence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = replies(spark, sf_dir).select("conv_id", "turn", fences(F.col("text")).alias("b"))
    size = F.aggregate("b", F.lit(0), lambda a, x: a + F.length(x["body"]))
    return b.select("conv_id", "turn", F.size("b").cast("long").alias("n_blocks"), (size + 2).cast("long").alias("n_chars"))


@query("parse_patches", "X11 A11 P28", f"SELECT conv_id, turn, 'src/f' || conv_id || '.ts' AS path, {TRIMMED} || {N} || '// ... existing code ...' || {N} || {TRIMMED} AS code FROM conversations WHERE role = 'assistant'")
def parse_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    # both fences of a reply name the same file: the second by the line above it that names a path
    r = replies(spark, sf_dir).withColumn("text", F.regexp_replace("text", "And more:\n", ""))
    return patch.parse_reply(r, ["conv_id", "turn"])


@query("path_hints", "P28 P29", "SELECT conv_id, turn, 'src/f' || conv_id || '.ts' AS in_context, 'lib/g' || conv_id || '.js' AS by_info, 'x/h.py' AS nearby FROM conversations")
def path_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("conv_id").cast("string")
    none = F.lit("")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", path_in_context(F.concat(F.lit("Some words\n**src/f"), i, F.lit(".ts**:\n\n"))).alias("in_context"), path_hint(F.concat(F.lit("ts ./lib/g"), i, F.lit(".js")), none, none).alias("by_info"),
        path_hint(F.lit("ts"), F.lit("File: `x/h.py`\n"), none).alias("nearby"),
    )


@query(
    "reply_candidates", "X12 P38",
    f"""SELECT conv_id, turn, 0::BIGINT AS i, CASE WHEN conv_id % 3 = 0 THEN 'unifiedDiff' WHEN conv_id % 3 = 1 THEN 'fencedCodeBlock' ELSE 'plainCode' END AS source, CASE conv_id % 3 WHEN 0 THEN 'n.ts' WHEN 1 THEN 'src/q.ts' END AS path_hint FROM conversations WHERE {TRIMMED} <> ''
      UNION ALL SELECT conv_id, turn, 1, 'unifiedDiff', 'm.ts' FROM conversations WHERE conv_id % 3 = 0 AND {TRIMMED} <> ''""",
)
def reply_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("conv_id") % 3).cast("int")
    text = F.get(F.array(F.concat(F.lit("--- a/n.ts\n+++ b/n.ts\n@@ -1,1 +1,1 @@\n+"), F.regexp_replace("text", "\n", " "), F.lit("\n--- a/m.ts\n+++ b/m.ts\n@@\n")), F.concat(F.lit("src/q.ts\n```ts\n"), "text", F.lit("\n```\n")), F.col("text")), k)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    return patch.candidates(c, ["conv_id", "turn"]).select("conv_id", "turn", F.col("i").cast("long").alias("i"), "source", "path_hint")


@query(
    "patch_targets", "J19 W6",
    f"""WITH {FILES}, h AS (SELECT doc_id, path, CASE doc_id % 3 WHEN 0 THEN path WHEN 1 THEN regexp_extract(path, '[^/]*/[^/]*$') ELSE 'no/such.md' END AS hint FROM files),
      hit AS (SELECT h.doc_id, arg_min(f.path, (CASE WHEN f.path = h.hint THEN 0 ELSE 1 END, f.doc_id)) AS p, max(CASE WHEN f.path = h.hint THEN 80 ELSE 60 END) AS c FROM h JOIN files f ON regexp_extract(f.path, '[^/]*$') = regexp_extract(h.hint, '[^/]*$') AND ends_with(f.path, h.hint) GROUP BY 1),
      r AS (SELECT path, row_number() OVER (ORDER BY doc_id DESC) - 1 AS k FROM files ORDER BY doc_id DESC LIMIT 50)
      SELECT h.doc_id AS hint_id, coalesce(hit.p, (SELECT path FROM r WHERE k = 0)) AS target, CASE WHEN hit.p IS NULL THEN 40 ELSE least(100, hit.c + CASE WHEN r.k IS NULL THEN 0 ELSE greatest(20 - 2 * r.k, 5) END) END::BIGINT AS confidence FROM h LEFT JOIN hit USING (doc_id) LEFT JOIN r ON r.path = hit.p""",
)
def patch_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    tail = F.regexp_extract("path", r"[^/]*/[^/]*\z", 0)
    hints = f.select(F.col("doc_id").alias("hint_id"), F.when(F.col("doc_id") % 3 == 0, F.col("path")).when(F.col("doc_id") % 3 == 1, tail).otherwise("no/such.md").alias("path_hint"))
    last = f.orderBy(F.desc("doc_id")).limit(50).select("path", "doc_id")  # the list of recent files
    recent = last.select("path", (F.row_number().over(Window.orderBy(F.desc("doc_id"))) - 1).alias("rank"))
    return patch.resolve_targets(hints, f.select("path", F.col("doc_id").alias("ord")), recent).withColumn("confidence", F.col("confidence").cast("long"))


@query("heal_omissions", "X10 X14 X15", f"WITH {CODE} SELECT code_id, text AS patched, false AS unsafe FROM code")
def heal_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with its lines from the fourth to the eighth left out comes back whole."""
    rows = F.split("text", "\n")
    cut = F.array_join(F.concat(F.slice(rows, 1, 3), F.array(F.lit("  // ... existing code ...")), F.slice(rows, 9, 100)), "\n")
    c = code(spark, sf_dir).select("code_id", F.concat(F.lit("f"), F.col("code_id").cast("string")).alias("path"), "text", cut.alias("code"))
    return patch.legacy_plans(c.select("code_id", "path", "code"), c.select("path", "text")).select("code_id", "patched", "unsafe")


@query(
    "smart_patch_plan", "X13 P21 P30",
    f"""WITH {REPLIES}, t AS (SELECT conv_id, turn, string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\r?\\n') AS l FROM conversations WHERE role = 'assistant')
      SELECT conv_id AS hint_id, turn, 'src/f' || conv_id || '.ts' AS target, 90::BIGINT AS confidence, 'high' AS level, '--- a/src/f' || conv_id || '.ts' || {N} || '+++ b/src/f' || conv_id || '.ts' || {N} || '@@' || {N}
        || array_to_string(list_transform(l, lambda x, i: CASE WHEN x = CASE i WHEN 1 THEN 'old' ELSE '' END THEN ' ' || x WHEN i > 1 THEN '+ ' || x WHEN x = '' THEN '- old' ELSE '- old' || {N} || '+ ' || x END), {N}) AS diff FROM t, (VALUES (0), (1)) v(i)""",
)
def smart_patch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patch.candidates(replies(spark, sf_dir), ["conv_id", "turn"]).withColumn("hint_id", F.concat_ws("-", "conv_id", "turn", "i"))
    found = kept(found.select("hint_id", "conv_id", "content"), "candidates")  # which are read for the targets and for the plans
    known = found.select(F.concat(F.lit("src/f"), F.col("conv_id").cast("string"), F.lit(".ts")).alias("path")).distinct().withColumn("ord", F.lit(0))
    hints = found.select("hint_id", F.concat(F.lit("src/f"), F.col("conv_id").cast("string"), F.lit(".ts")).alias("path_hint"))
    targets = patch.resolve_targets(hints, known, known.limit(0).select("path", F.lit(0).alias("rank")))
    plans = patch.smart_plans(found, targets, known.select("path", F.lit("old").alias("text")))
    at = F.split("hint_id", "-")
    return plans.select(at[0].cast("long").alias("hint_id"), at[1].cast("long").alias("turn"), "target", F.col("confidence").cast("long").alias("confidence"), "level", "diff")


@query(
    "patch_apply", "K14",
    "SELECT 'src/f' || doc_id || '.md' AS path, CASE WHEN quality = 1 THEN 'new' ELSE text END AS text, CASE WHEN quality = 1 THEN 'replaced' ELSE 'kept' END AS action FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'made/f' || doc_id || '.md', 'new', 'created' FROM labels WHERE toxic = 1",
)
def patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    named = lambda folder: F.concat(F.lit(folder), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    new = labels.where("quality = 1").select(named("src/f")).unionByName(labels.where("toxic = 1").select(named("made/f"))).withColumn("code", F.lit("new"))
    return patch.apply_patches(table(spark, sf_dir, "documents").select(named("src/f"), "text"), new)
