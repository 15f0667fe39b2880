"""Queries over single rows: paths, predicates, tokens, labels, strippers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators import search
from ..sources.tables import code, files, scripts, table
from .catalog import CODE, FILES, joined, query

N = "chr(10)"


@query(
    "recipes", "F1 F2 F3 U12",
    f"""WITH {FILES} SELECT project_id, path, size, reason FROM (
      SELECT *, 'rgMatch' AS reason FROM files WHERE contains(lower(path), 'src1') UNION ALL
      SELECT *, 'extensionMatch' FROM files WHERE ends_with(path, '7.md') OR ends_with(path, '.txt') UNION ALL
      SELECT *, 'directoryMatch' FROM files WHERE starts_with(path, 'en/src3/'))""",
)
def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    out = search.by_recipe(f, "text", "SRC1").unionByName(search.by_recipe(f, "extension", ".txt").unionByName(f.where(F.endswith("path", F.lit("7.md"))).select("project_id", "path", "size", F.lit("extensionMatch").alias("reason"))))
    return out.unionByName(search.by_recipe(f, "directory", "en\\src3\\"))


@query(
    "exclusions", "F4 F5 F6 F7 S2",
    f"""WITH {FILES} SELECT path, regexp_matches(path, '(^|/)src1[^/]*(/|$)') AS ignored, regexp_matches(path, '(^|/)doc_[^/]*5\\.md(/|$)') AS literal,
      regexp_matches(path, '(^|/)en/.*src1[^/]*/doc_[^/]*\\.md(/|$)') AS glob, contains(path, 'src2') AS part, path LIKE '%md' AS by_extension FROM files""",
)
def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return files(spark, sf_dir).select(
        p, P.matches(p, P.ignore_pattern(["# no", "", "!kept", "src1*/"])).alias("ignored"), p.rlike(P.exclude_literal("doc_*5.md")).alias("literal"), P.excluded_by(p, "en/**src1*/doc_*.md").alias("glob"),
        P.excluded_by(p, "src2").alias("part"), P.matches(P.extension(p), P.user_pattern("(?i)^MD$")).alias("by_extension"),
    )


@query(
    "path_validity", "F8 F9 F13 F14 P6",
    f"""WITH {FILES}, v AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'a/' || doc_id || '.ts' WHEN 1 THEN 'build/' || doc_id || '.ts' WHEN 2 THEN doc_id || '.5' WHEN 3 THEN 'LICENSE' WHEN 4 THEN 'X_' || doc_id WHEN 5 THEN 'x/f' || doc_id || '.test.js'
       WHEN 6 THEN 'y/f' || doc_id || '.log' WHEN 7 THEN 'noextension' ELSE '../out' || doc_id || '.md' END AS p FROM files)
       SELECT doc_id, p, doc_id % 9 IN (0, 3, 5, 8) AS valid, doc_id % 9 IN (0, 3, 5, 8) AS valid_file, doc_id % 9 <> 8 AS inside, doc_id % 9 = 8 AS document FROM v""",
)
def path_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 9
    shapes = [F.concat(F.lit("a/"), i, F.lit(".ts")), F.concat(F.lit("build/"), i, F.lit(".ts")), F.concat(i, F.lit(".5")), F.lit("LICENSE"), F.concat(F.lit("X_"), i), F.concat(F.lit("x/f"), i, F.lit(".test.js")), F.concat(F.lit("y/f"), i, F.lit(".log")), F.lit("noextension"), F.concat(F.lit("../out"), i, F.lit(".md"))]
    p = F.col("p")
    v = files(spark, sf_dir).select("doc_id", F.get(F.array(*shapes), k.cast("int")).alias("p"))
    return v.select("doc_id", "p", P.valid_path(p).alias("valid"), P.valid_file_path(p).alias("valid_file"), P.inside_root(p).alias("inside"), p.rlike(P.DOCUMENT).alias("document"))


@query(
    "oversize_guard", "F10 F18 S15",
    f"WITH {FILES} SELECT path, size, CASE WHEN size > 2048 THEN 'oversized' WHEN size = 0 THEN 'empty' ELSE 'ok' END AS verdict FROM files",
)
def oversize_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", "size", F.when(F.col("size") > 2 * 1024, "oversized").when(F.col("size") == 0, "empty").otherwise("ok").alias("verdict"))


@query(
    "path_parts", "P1 P2 P3 P4 P5 P8 P41",
    f"""WITH {FILES} SELECT path, 'c:/Ws/' || path AS absolute, path AS relative, substr(path, 1, length(path) - length('/doc_' || doc_id || '.md')) AS parent, 'doc_' || doc_id AS stem, 'md' AS extension,
      CASE WHEN size < 1024 THEN size || ' B' ELSE round(size::DECIMAL(20,4) / 1024, 1)::DECIMAL(20,1) || ' KB' END AS label, length(text) - length(replace(text, {N}, '')) + 1 AS n_lines FROM files""",
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.translate(F.concat(F.lit("C:\\Ws\\"), "path", F.lit("\\")), "/", "\\")
    p = P.available_path(F.concat(F.lit(".\\"), F.translate("path", "/", "\\")))
    return files(spark, sf_dir).select(
        "path", P.absolute_path(back).alias("absolute"), P.relative_to(F.lit("C:\\Ws"), back).alias("relative"), P.parent(p).alias("parent"), P.stem(p).alias("stem"), P.extension(p).alias("extension"),
        X.byte_label(F.col("size")).alias("label"), F.size(X.lines(F.col("text"))).cast("long").alias("n_lines"),
    )


@query(
    "link_resolution", "P6 P7 P11 P12",
    f"""WITH {FILES} SELECT path, 'en/src3/doc ' || doc_id || '.md' AS up, lang || '/' || source || '/x+' || doc_id AS here, 'a/b' AS wiki, 3::BIGINT AS n_links, lang || '/lib/f' || doc_id AS import_target
      FROM files JOIN documents USING (doc_id)""",
)
def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, p = F.col("doc_id").cast("string"), F.col("path")
    text = F.concat(F.lit("[a](../../en/./src3/doc%20"), i, F.lit(".md?q#h 'T') ![i](x+"), i, F.lit(") [[a/b|c]] [e](http://x/y) [r](/r)\nimport x from '../lib/f"), i, F.lit("'\n"))
    f = files(spark, sf_dir).select("path", "doc_id", text.alias("t")).withColumn("l", X.link_targets(F.col("t")))
    return f.select(
        "path", P.resolve_link(p, F.col("l")[0]["target"]).alias("up"), P.resolve_link(p, F.col("l")[1]["target"]).alias("here"), F.element_at("l", -1)["target"].alias("wiki"),
        F.size(F.filter("l", lambda x: F.when(x["extensionless"], True).otherwise(P.resolve_link(p, x["target"]).isNotNull()))).cast("long").alias("n_links"),
        P.resolve_import(p, X.import_targets(F.col("t"))[0]).alias("import_target"),
    )


@query(
    "tokenize_headings", "P9 P10 F20",
    f"""WITH {FILES}, t AS (SELECT doc_id, list_filter(string_split_regex(lower(string_split(text, {N})[1]), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ('the','and','for','from','with','document')) AS w FROM files)
      SELECT doc_id, array_to_string(w, '|') AS tokens, len(w)::BIGINT AS n FROM t""",
)
def tokenize_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.heading_tokens(F.concat(F.lit("## "), "text"))
    return files(spark, sf_dir).select("doc_id", joined(w).alias("tokens"), F.size(w).cast("long").alias("n"))


@query("mentioned_paths", "P13 P14 S13", f"""WITH {FILES} SELECT doc_id, array_to_string(list_distinct_ordered, '|') AS paths, len(list_distinct_ordered)::BIGINT AS n FROM (
      SELECT doc_id, list_filter(found, lambda x, i: list_position(found, x) = i) AS list_distinct_ordered FROM (SELECT doc_id, regexp_extract_all(text, '(?i)(?:[a-z]:\\\\|\\./|/)?[a-z0-9_./\\\\-]+\\.[a-z0-9]+') AS found FROM files)) WHERE n > 0""")
def mentioned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.mentioned_paths(F.col("text"))
    return files(spark, sf_dir).select("doc_id", joined(p).alias("paths"), F.size(p).cast("long").alias("n")).where("n > 0")


@query(
    "token_labels", "P15 P16 P17 P42",
    f"""WITH {FILES}, t AS (SELECT doc_id, ceil(size / 4.0)::BIGINT AS tokens FROM files)
      SELECT doc_id, tokens, CASE WHEN tokens >= 1000 THEN round(tokens::DECIMAL(20,4) / 1000, 1)::DECIMAL(20,1) || 'k' ELSE tokens::VARCHAR END AS label, round(least(tokens / 500.0, 1.0), 6)::DOUBLE AS ratio, tokens > 500 AS over FROM t""",
)
def token_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.estimated_tokens(F.col("size"))
    return files(spark, sf_dir).select("doc_id", n.alias("tokens"), X.token_label(n).alias("label"), F.round(X.budget_ratio(n, F.lit(500)), 6).alias("ratio"), (n > 500).alias("over"))


@query(
    "strip_text", "P18 P19 P20",
    f"""WITH {CODE}, c AS (SELECT code_id, text, 'import {{ a }} from ''./part_' || p_size || '''' || {N} || 'class P' || p_partkey || ' {{' || {N} || '  run(' || p_size || ') {{' || {N} || '    a = ' || p_size || ';' || {N} || '    b = a;' || {N} || '  }}' || {N} || '}}' || {N}
       || 'const x = {{ y: ' || p_size || ' }};' || {N} || 'url = ''http://x/' || p_partkey || ''';' AS bare FROM code JOIN part ON p_partkey = code_id)
      SELECT code_id, replace(bare, ' ', '') AS bare, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&apos;'), '"', '&quot;') AS xml FROM c""",
)
def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return code(spark, sf_dir).select("code_id", F.replace(X.strip_blank_lines(X.strip_comments(t)), F.lit(" "), F.lit("")).alias("bare"), X.escape_xml(t).alias("xml"))


@query(
    "similarity", "P22 P23 P24",
    """SELECT p_partkey, levenshtein(a, b)::BIGINT AS distance, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE (greatest(length(a), length(b)) - levenshtein(a, b)) / greatest(length(a), length(b))::DOUBLE END, 6)::DOUBLE AS similarity
      FROM (SELECT p_partkey, regexp_replace(p_name, '\\s', '', 'g') AS a, regexp_replace(p_type, '\\s', '', 'g') AS b FROM part)""",
)
def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein(X.without_space(a), X.without_space(b)).cast("long").alias("distance"), F.round(X.similarity(a, b), 6).alias("similarity"))


@query(
    "line_diff", "P21",
    f"""SELECT p_partkey, '--- a/p' || {N} || '+++ b/p' || {N} || '@@' || {N} || ' ' || p_name || {N} || CASE WHEN p_type = p_brand THEN ' ' || p_type ELSE '- ' || p_type || {N} || '+ ' || p_brand END || {N} || '+ ' || p_size AS diff FROM part""",
)
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.concat_ws("\n", "p_name", "p_type"), F.concat_ws("\n", "p_name", "p_brand", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", X.positional_diff(F.lit("p"), a, b).alias("diff"))


@query(
    "omission_lines", "P25",
    f"""WITH {CODE}, l AS (SELECT code_id, unnest(string_split(text, {N})) AS line FROM code)
      SELECT code_id, count(*) FILTER ((regexp_matches(trim(line), '^(//|#|--|<!--|/\\*)') OR ends_with(trim(line), '*/') OR ends_with(trim(line), '-->')) AND regexp_matches(line, '(?i)(\\.\\.\\.|existing|rest of)') OR trim(line) = '...')::BIGINT AS n FROM l GROUP BY code_id""",
)
def omission_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).select("code_id", F.explode(X.lines(F.col("text"))).alias("line")).groupBy("code_id").agg(F.count_if(X.is_omission(F.col("line"))).alias("n"))


@query(
    "detect_format", "P26 P27",
    """SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'unifiedDiff' WHEN 1 THEN 'pathCodeBlock' WHEN 2 THEN 'markdownCodeBlock' ELSE CASE WHEN regexp_matches(text, '^###?\\s+|以下のファイル|修正してください') THEN 'chatMixed'
        WHEN regexp_matches(text, '\\b(import|export|function|class|const|let)\\b') THEN 'plainCode' ELSE 'unknown' END END AS format,
      CASE conv_id % 4 WHEN 1 THEN 'typescript' WHEN 2 THEN 'json' ELSE CASE WHEN regexp_matches(text, '(?m)^\\s*\\{') AND regexp_matches(text, '"\\w+"\\s*:') THEN 'json' WHEN regexp_matches(text, 'class\\s+\\w+') THEN 'typescript'
        WHEN regexp_matches(text, 'function\\s+\\w+|console\\.log\\(') THEN 'javascript' END END AS language FROM conversations""",
)
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = (F.col("conv_id") % 4).cast("int"), F.col("text")
    text = F.get(F.array(F.concat(F.lit("--- a/x\n+++ b/x\n"), t), F.concat(F.lit("src/a.ts\n```ts\n"), t, F.lit("\n```")), F.concat(F.lit("Well\n```\n"), t, F.lit("\n```")), t), k)
    info, path = F.get(F.array(F.lit(""), F.lit("zz x"), F.lit("JSON"), F.lit("")), k), F.get(F.array(F.lit("a"), F.lit("src/a.ts"), F.lit("b.ts"), F.lit("c")), k)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.reply_format(text).alias("format"), X.language_of(info, path, t).alias("language"))


@query("confidence_levels", "P30", "SELECT o_orderkey, CASE WHEN s >= 80 THEN 'high' WHEN s >= 60 THEN 'medium' ELSE 'low' END AS level FROM (SELECT o_orderkey, round(greatest(0, least(100, o_totalprice / 2500))) AS s FROM orders)")
def confidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.confidence_level(F.col("o_totalprice") / 2500).alias("level"))


@query(
    "templates", "P31 P32 P33 P34 P40 K12",
    """SELECT conv_id, turn, 'Use en: ' || text || ' {{tree}}' AS filled, CASE WHEN contains(text, 'the') THEN text ELSE text || ' PATCH' END AS suffixed, CASE WHEN length(text) > 50 THEN substr(text, 1, 47) || '...' ELSE text END AS summary,
      conv_id || ' of ' || turn AS message FROM conversations""",
)
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.fill_template(F.lit("Use {{language}}: {{diff}} {{tree}}"), {"language": F.lit("en"), "tree": F.lit(""), "diff": t}).alias("filled"), X.add_unless_marked(t, "the", " PATCH").alias("suffixed"),
        X.summary(t).alias("summary"), X.format_message("{0} of {1}", F.col("conv_id"), F.col("turn")).alias("message"),
    )


@query("branch_names", "P40", "SELECT o_orderkey, 'patch/auto-' || strftime(o_orderdate, '%Y%m%d-%H%M') AS branch FROM orders")
def branch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.branch_name(F.col("o_orderdate")).alias("branch"))


@query(
    "line_skeleton", "X5 W4 W5",
    f"""SELECT p_partkey AS code_id, 'import {{ a }} from ''./part_' || p_size || '''' || {N} || '  // ... implementation omitted' || {N} || 'class P' || p_partkey || ' {{' || {N} || '  run(' || p_size || ') {{' || {N} || '  // ... implementation omitted' || {N} || '  }}' || {N} || '}}' || {N} || 'const x = {{ y: ' || p_size || ' }};'
      || {N} || '  // ... implementation omitted' AS skeleton FROM part""",
)
def line_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).select("code_id", X.line_skeleton(F.col("text")).alias("skeleton"))


@query(
    "ast_compress", "X7",
    f"""WITH p AS (SELECT *, p_partkey % 7 AS k, ' // }} ' || p_name || {N} || ' const s = ''{{'' + "}}" + `{{${{1}}`; /* }} */ return /[{{]/.test(s); ' AS inner_text, '{{' || {N} || '  // ... existing code ...' || {N} || '}}' AS stub FROM part),
      d AS (SELECT doc_id, translate(text, '*`\\$', '') AS clean FROM documents)
      SELECT p_partkey::BIGINT AS code_id, CASE k WHEN 0 THEN 'function f' || p_partkey || '(a = {{ x: 1 }}) ' || stub || {N} || 'call(1);' WHEN 1 THEN 'class C' || p_partkey || ' {{ get g() {{ return 1 }} static async m(b: string): Promise<{{ y: number }}> ' || stub || ' }}'
        WHEN 2 THEN 'const h = (a: string): void => ' || stub || ';' WHEN 3 THEN 'let a = 1' || {N} || 'export default async function () ' || stub WHEN 4 THEN 'const o = {{ a: function() {{ return 2; }}, m' || p_partkey || '() ' || stub || '}};'
        WHEN 5 THEN 'const t = `}} ${{list.map(x => ' || stub || ')}} {{`;' ELSE 'const f = function() {{' || inner_text || 'list.forEach(y => ' || stub || ');}};' END AS skeleton FROM p
      UNION ALL SELECT -1 - doc_id, '/* () => {{ ' || clean || ' */ function d() {{' || {N} || '  // ... existing code ...' || {N} || '}}' || {N} || '// function x() {{ y }}' FROM d""",
)
def ast_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compressor that a script's extension calls for, over nested bodies, strings, templates, comments and whole documents."""
    from ..operators.pack import compress

    return scripts(spark, sf_dir).select("code_id", compress(F.col("text"), F.lit("src/a.ts")).alias("skeleton"))


@query("brace_compress", "X6", f"WITH {CODE} SELECT code_id, regexp_replace(text, '\\{{[^}}\\n]*\\n[^}}\\n]*\\n[^}}]*\\}}', '{{' || {N} || '  // ... existing code ...' || {N} || '}}', 'g') AS stub FROM code")
def brace_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).select("code_id", X.brace_stub(F.col("text")).alias("stub"))


@query("clipboard_paths", "P14", f"WITH {FILES} SELECT doc_id, 'a/' || doc_id || '.ts|' || path AS paths FROM files")
def clipboard_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions go, a path that repeats counts once, files of excluded directories and programs don't."""
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("open a/"), i, F.lit(".ts:3:4 and\n("), "path", F.lit("), then build/"), i, F.lit(".ts, x"), i, F.lit(".exe and a/"), i, F.lit(".ts"))
    return files(spark, sf_dir).select("doc_id", joined(X.clipboard_paths(text)).alias("paths"))


@query("icons", "P39", f"WITH {FILES} SELECT path, CASE WHEN toxic = 1 THEN 'modifiedFile' ELSE 'file' END AS icon FROM files LEFT JOIN labels USING (doc_id) UNION ALL SELECT DISTINCT regexp_extract(path, '^[^/]*'), 'folder' FROM files")
def icons(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    nodes = f.select("path", F.lit(False).alias("dir"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("changed"))
    nodes = nodes.unionByName(f.select(F.regexp_extract("path", "^[^/]*", 0).alias("path"), F.lit(True).alias("dir"), F.lit(True).alias("changed")).distinct())
    return nodes.select("path", P.icon(F.col("dir"), F.col("changed")).alias("icon"))


@query("viewer_lines", "P43", f"""WITH {FILES}, l AS (SELECT doc_id, size, string_split_regex(text, '\\r?\\n') AS l FROM files) SELECT doc_id, len(l)::BIGINT AS n_lines, size, ceil(coalesce(size, 0) / 4.0)::BIGINT AS tokens, len(l) || ': ' || l[len(l)] AS last FROM l""")
def viewer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.lines(F.col("text"))
    numbered = F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))
    return files(spark, sf_dir).select("doc_id", F.size(numbered).cast("long").alias("n_lines"), "size", X.estimated_tokens(F.col("size")).alias("tokens"), F.element_at(numbered, -1).alias("last"))


@query("processed_contents", "F10 P18 P19", f"""WITH {FILES} SELECT doc_id, CASE WHEN length(text) > 2048 THEN '[WARNING] File size exceeds 2KB. Content omitted.' ELSE array_to_string(list_filter(string_split_regex(text, '\\r?\\n'), lambda x: regexp_matches(x, '\\S')), {N}) END AS content FROM files""")
def processed_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pack import processed

    return files(spark, sf_dir).select("doc_id", processed(F.col("text"), max_kb=2).alias("content"))
