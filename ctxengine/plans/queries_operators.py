"""Queries over many rows: signals, search, recommendations, selections, packs, histories, streams in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import brace_stub
from ..operators import pack, recommend, search, selection, signals
from ..sources import connectors
from ..sources.tables import changes, code, commits, edges, file_commits, files, following, table
from ..sources.tables import signals as signal_rows
from ..session import shared_path
from ..streaming.changes import bursts, content_changes, is_modified, refresh_snapshot
from .catalog import BASE, CODE, COMMITS, EDGES, FILES, base_files, joined, query

N = "chr(10)"
SIGNALS = """sig AS (SELECT project_id, path, size, 'rgMatch' AS reason, 0 AS ord, 35 AS w FROM files WHERE contains(lower(text), 'tion')
  UNION SELECT project_id, path, size, 'gitModified', 1, 30 FROM files JOIN labels USING (doc_id) WHERE quality = 1
  UNION SELECT project_id, path, size, 'recentCommit', 2, 20 FROM files JOIN labels USING (doc_id) WHERE toxic = 1),
  ranked AS (SELECT project_id, path, string_agg(reason, '|' ORDER BY ord) AS reasons, max(size) AS size, sum(w)::BIGINT AS score FROM sig GROUP BY project_id, path)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.analyze(signal_rows(spark, sf_dir, "tion"), files(spark, sf_dir).select("project_id", "path"))


@query("x18_analyze", "X18 U1 U2 F15 A1 A2 O1 S3", f"WITH {FILES}, {SIGNALS} SELECT * FROM ranked")
def x18_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.in_order(_candidates(spark, sf_dir).select("project_id", "path", joined("reasons").alias("reasons"), "size", "score"))


@query(
    "context_excerpts", "S3 W1 A4 W2 A12",
    f"""WITH {FILES}, l AS (SELECT project_id, path, unnest(string_split(text, {N})) AS line, generate_subscripts(string_split(text, {N}), 1) AS ln FROM files),
      h AS (SELECT *, max(CASE WHEN regexp_matches(line, 'ing[.,]') THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, path ORDER BY ln ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l),
      i AS (SELECT *, ln - row_number() OVER (PARTITION BY project_id, path ORDER BY ln) AS island FROM h WHERE near = 1)
      SELECT project_id, path, min(ln)::BIGINT AS start_line, max(ln)::BIGINT AS end_line, string_agg(line, {N} ORDER BY ln) AS content FROM i GROUP BY project_id, path, island""",
)
def context_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.merge_excerpts(search.context_lines(files(spark, sf_dir), "ing[.,]", 2))
    return out.select("project_id", "path", F.col("start_line").cast("long"), F.col("end_line").cast("long"), "content")


@query("text_search", "S5", f"WITH {FILES} SELECT DISTINCT project_id, path FROM files WHERE contains(lower(text), 'license')")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.contains_text(files(spark, sf_dir), "LICENSE")


@query(
    "search_events", "S4 A12",
    "SELECT event_id % 50 AS path, count(*)::BIGINT AS n_lines, min(event_id)::BIGINT AS first_line FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
)
def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "match").when(F.col("event_type") == "view", "context").otherwise("begin")
    data = F.struct(F.struct((F.col("event_id") % 50).cast("string").alias("text")).alias("path"), F.col("event_id").cast("int").alias("line_number"), F.struct(F.col("event_type").alias("text")).alias("lines"))
    lines = e.select(F.to_json(F.struct(kind.alias("type"), data.alias("data"))).alias("value")).union(spark.createDataFrame([("{broken",)], "value string"))
    return connectors.search_events(lines).groupBy(F.col("path").cast("long").alias("path")).agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_number").cast("long").alias("first_line"))


@query("status_paths", "S6 S7 P35", "SELECT DISTINCT 'docs/' || p_brand || '.md' AS path FROM part")
def status_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.concat(F.lit("docs/"), "p_brand", F.lit(".md"))
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" M "), new)).otherwise(F.concat(F.lit('R  old.md -> "'), new, F.lit('"')))
    return connectors.status_paths(table(spark, sf_dir, "part").select(line.alias("value")), quoted=True)


@query("recent_commits", "S8 O13", f"WITH {COMMITS} SELECT DISTINCT path FROM commits WHERE commit_id IN (SELECT commit_id FROM (SELECT DISTINCT commit_id, ts FROM commits) ORDER BY ts DESC, commit_id DESC LIMIT 100)")
def recent_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = commits(spark, sf_dir)
    last = c.select("commit_id", "ts").distinct().orderBy(F.desc("ts"), F.desc("commit_id")).limit(100)
    return connectors.log_paths(c.join(F.broadcast(last.select("commit_id")), "commit_id").select(F.concat(F.lit(" "), "path").alias("value")))


@query(
    "file_frequency", "S10 A7 O13",
    f"""WITH {COMMITS}, last AS (SELECT DISTINCT commit_id, ts FROM commits ORDER BY ts DESC, commit_id DESC LIMIT 200)
      SELECT path, count(*)::BIGINT AS n, strftime(max(c.ts), '%Y-%m-%d') AS last_day FROM commits c JOIN last USING (commit_id) GROUP BY path""",
)
def file_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recent_files(commits(spark, sf_dir), 200).select("path", "n", F.date_format("last_ts", "yyyy-MM-dd").alias("last_day"))


@query(
    "recent_by_time", "S18 O11 O12",
    """WITH o AS (SELECT 'o/' || o_orderkey AS path, o_orderdate AS mtime, o_custkey FROM orders), t AS (SELECT path, row_number() OVER (ORDER BY mtime DESC, path) AS ord FROM o QUALIFY ord <= 50),
      m AS (SELECT path, row_number() OVER (ORDER BY o_custkey, path) AS ord FROM o), e AS (SELECT path, ord + 50 AS ord FROM m WHERE path NOT IN (SELECT path FROM t))
      SELECT path, ord::BIGINT AS ord FROM (SELECT * FROM t UNION ALL SELECT * FROM e) ORDER BY ord LIMIT 200""",
)
def recent_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderdate").alias("mtime"), "o_custkey")
    # the history list is a short one: its first 250 rows hold the 200 that can be taken
    ranked = o.orderBy("o_custkey", "path").limit(250).select("path", F.row_number().over(Window.orderBy("o_custkey", "path")).alias("ord"))
    return search.recent_by_time(o, ranked).select("path", F.col("ord").cast("long").alias("ord"))


@query(
    "co_change", "J10 A6 O4 O13",
    f"""WITH {COMMITS}, t AS (SELECT 'docs/part_' || p_partkey || '.md' AS path FROM part WHERE p_size <= 10), last AS (SELECT DISTINCT commit_id, ts FROM commits ORDER BY ts DESC, commit_id DESC LIMIT 50)
      SELECT a.path AS target, b.path, count(*)::BIGINT AS n FROM last JOIN commits a USING (commit_id) JOIN t USING (path) JOIN commits b ON a.commit_id = b.commit_id AND a.path <> b.path GROUP BY 1, 2""",
)
def co_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit("p").alias("project_id")
    targets = table(spark, sf_dir, "part").where("p_size <= 10").select(one, F.concat(F.lit("docs/part_"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"))
    return search.co_changes(commits(spark, sf_dir).select(one, "*"), targets).drop("project_id").orderBy("target", F.desc("n"), "path")


DIRECTORY = "dirs AS (SELECT f.project_id, f.path, 'directoryProximity' AS source, 0.5 AS score, 'Same directory as ' || min(b.path) AS detail FROM files f JOIN base b ON b.project_id = f.project_id AND regexp_replace(b.path, '/[^/]*$', '') = regexp_replace(f.path, '/[^/]*$', '') AND b.path <> f.path GROUP BY ALL)"
WORDS = "list_filter(string_split_regex(lower(regexp_extract(path, '([^/]*)\\.md$', 1) || ' ' || text), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ('the','and','for','from','with','document'))"


@query("directory_proximity", "J11", f"WITH {FILES}, {BASE}, {DIRECTORY} SELECT * FROM dirs")
def directory_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.by_directory(base_files(spark, sf_dir), files(spark, sf_dir)).withColumn("score", F.col("score").cast("double"))


def _headed(df: DataFrame) -> DataFrame:
    """Each line of a text as a heading."""
    return df.withColumn("text", F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# "))))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base files, each line a heading, with a link to the next document of their source (which resolves if that has the same language) and a wiki link without an extension to themselves."""
    nxt = following(files(spark, sf_dir).select("project_id", "path", "doc_id"), ["doc_id"])
    base = _headed(base_files(spark, sf_dir)).join(nxt.select("project_id", "path", "next_doc_id"), ["project_id", "path"])
    link = F.concat(F.lit("\nSee [next](../"), "project_id", F.lit("/./doc_"), F.coalesce(F.col("next_doc_id").cast("string"), F.lit("x")), F.lit(".md#top) [[/"), "path", F.lit("]] [[./doc_1]]"))
    return base.select("project_id", "path", F.concat("text", link).alias("text"))


# (src, path) of links: the next document of the source, if it is in the same language's folder, and the wiki link to doc_1
LINKED = """nxt AS (SELECT project_id, path AS src, doc_id, lead(doc_id) OVER (PARTITION BY project_id ORDER BY doc_id) AS n FROM files),
  pairs AS (SELECT DISTINCT f.project_id, f.path, x.src FROM nxt x JOIN base b ON b.path = x.src AND b.project_id = x.project_id
    JOIN files f ON f.project_id = x.project_id AND f.doc_id IN (x.n, 1) AND f.path <> x.src AND regexp_extract(f.path, '^[^/]*') = regexp_extract(x.src, '^[^/]*')),
  links AS (SELECT project_id, path, 'markdownLink' AS source, 0.8 AS score, 'Markdown link from ' || min(src) AS detail FROM pairs GROUP BY ALL)"""
NAMES = f"""src AS (SELECT project_id, path, unnest({WORDS}) AS w FROM base), dst AS (SELECT DISTINCT project_id, path, unnest({WORDS}) AS w FROM files),
  names AS (SELECT project_id, path, 'headingMatch' AS source, 0.6 AS score, 'Filename or heading match from ' || min(s) AS detail FROM (
    SELECT d.project_id, d.path, s.path AS s FROM dst d JOIN src s ON d.project_id = s.project_id AND d.w = s.w AND d.path <> s.path GROUP BY ALL HAVING count(*) > 1 OR max(d.w) NOT IN ('api', 'design', 'test')) m
    WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.project_id = m.project_id AND p.path = m.path AND p.src = m.s) GROUP BY ALL)"""


@query("name_heading_match", "J7 J8", f"WITH {FILES}, {BASE}, {LINKED}, {NAMES} SELECT * FROM names")
def name_heading_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.by_name(_linked(spark, sf_dir), _headed(files(spark, sf_dir)))


@query("link_recommendations", "J6 P7", f"WITH {FILES}, {BASE}, {LINKED} SELECT * FROM links")
def link_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.by_link(_linked(spark, sf_dir), files(spark, sf_dir))


CO_CHANGED = """fc AS (SELECT project_id, doc_id // 40 AS commit_id, path FROM files), lastc AS (SELECT project_id, commit_id FROM (SELECT DISTINCT project_id, commit_id FROM fc) QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY commit_id DESC) <= 50),
  cop AS (SELECT a.project_id, b.path, a.path AS target, count(*) AS n FROM fc a JOIN lastc USING (project_id, commit_id) JOIN base t ON t.project_id = a.project_id AND t.path = a.path JOIN fc b ON b.project_id = a.project_id AND b.commit_id = a.commit_id AND b.path <> a.path GROUP BY ALL),
  co AS (SELECT project_id, path, 'coChange' AS source, max(n)::DOUBLE AS score, 'Changed with ' || min(target) AS detail FROM cop GROUP BY project_id, path)"""
MERGED = """recs AS (SELECT project_id, path, sum(score)::DOUBLE AS score, string_agg(source || ' ' || round(score * 100)::INT || '%', ', ' ORDER BY CASE source WHEN 'markdownLink' THEN 1 WHEN 'headingMatch' THEN 2 WHEN 'coChange' THEN 3 ELSE 4 END) AS label
  FROM (SELECT * FROM dirs UNION ALL SELECT * FROM names UNION ALL SELECT * FROM links UNION ALL SELECT * FROM co) GROUP BY project_id, path)"""
SOURCES = f"{DIRECTORY}, {LINKED}, {NAMES}, {CO_CHANGED}, {MERGED}"


def _sources_of(spark: SparkSession, sf_dir: str) -> dict:
    base, f = _linked(spark, sf_dir), files(spark, sf_dir)
    pairs = recommend.link_pairs(base, f)
    return {
        "markdownLink": lambda: recommend.by_link(base, f, pairs), "headingMatch": lambda: recommend.by_name(base, _headed(f), pairs), "directoryProximity": lambda: recommend.by_directory(base, f),
        "coChange": lambda: recommend.by_co_change(search.co_changes(file_commits(spark, sf_dir), base.select("project_id", "path"))),
    }


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.merge(recommend.collect(_sources_of(spark, sf_dir), base_files(spark, sf_dir))[0])


@query(
    "merge_recommendations", "A3 A5 J16 U8 X16 X17 O2 F12 J8",
    f"""WITH {FILES}, {BASE}, {SOURCES}, {SIGNALS}
      SELECT project_id, path, round(score, 6)::DOUBLE AS score, recommended FROM (SELECT project_id, path, score::DOUBLE AS score, false AS recommended FROM ranked
      UNION ALL SELECT project_id, path, score, true FROM recs r WHERE NOT EXISTS (SELECT 1 FROM ranked b WHERE b.project_id = r.project_id AND b.path = r.path))""",
)
def merge_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recommend.with_base(_candidates(spark, sf_dir).select("project_id", "path", "score"), _merged(spark, sf_dir))
    return signals.in_order(out.withColumn("score", F.round("score", 6)))


@query(
    "recommendation_failures", "X16 A15",
    f"""WITH {FILES}, {BASE}, {DIRECTORY}, w AS (SELECT project_id, path FROM base) SELECT project_id, (SELECT count(*) FROM dirs d WHERE d.project_id = w.project_id)::BIGINT AS n_recs,
      string_agg('Recommendation source coChange failed: no such history of ' || path, {N} ORDER BY path) AS message FROM w GROUP BY project_id""",
)
def recommendation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source fails; the other's recommendations stay, and each base file has a warning. The messages of a project are joined."""
    base, f = base_files(spark, sf_dir), files(spark, sf_dir)

    def broken() -> DataFrame:
        raise ValueError("no such history")

    recs, warnings = recommend.collect({"coChange": broken, "directoryProximity": lambda: recommend.by_directory(base, f), "headingMatch": broken}, base, {"headingMatch": False})
    told = warnings.withColumn("message", F.concat("message", F.lit(" of "), "relative_path"))
    counted = recs.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_recs"))
    return signals.joined_messages(told, ["project_id"]).join(counted, "project_id", "left").select("project_id", F.coalesce("n_recs", F.lit(0)).alias("n_recs"), "message")


@query("reasons_by_key", "J17 P42", f"WITH {FILES}, {BASE}, {SOURCES}, {SIGNALS} SELECT project_id, path, coalesce(label, '') AS label FROM (SELECT project_id, path FROM ranked) FULL JOIN recs USING (project_id, path)")
def reasons_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import reason_label

    out = recommend.reasons_by_key(_candidates(spark, sf_dir), _merged(spark, sf_dir))
    return out.select("project_id", "path", F.coalesce(reason_label(F.col("reasons")), F.lit("")).alias("label"))


@query("edge_validation", "F11 S12", f"WITH {FILES}, {EDGES} SELECT project_id, src, dst FROM edges WHERE dst IS NOT NULL AND confidence BETWEEN 0 AND 1")
def edge_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return e.where("confidence between 0 and 1 and not isnan(confidence) and trim(reason) <> '' and dst is not null").where(~F.col("dst").rlike(r"^/|(?:^|/)\.\.(?:/|\z)")).select("project_id", "src", "dst")


@query(
    "docgraph_expand", "J14 J15 X20",
    f"""WITH {FILES}, {EDGES}, {BASE} SELECT e.project_id, f.path, max(confidence)::DOUBLE AS score FROM edges e JOIN base b ON b.project_id = e.project_id AND b.path = e.src JOIN files f ON f.project_id = e.project_id AND f.path = e.dst
      WHERE confidence BETWEEN 0 AND 1 AND NOT EXISTS (SELECT 1 FROM base x WHERE x.project_id = e.project_id AND x.path = e.dst) GROUP BY 1, 2""",
)
def docgraph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.docgraph(base_files(spark, sf_dir), edges(spark, sf_dir), files(spark, sf_dir)).withColumn("score", F.col("score").cast("double"))


IMPORTS = """src AS (SELECT 'p' AS project_id, 'src/part_' || p_partkey || '.ts' AS path, p_size, p_partkey FROM part), b AS (SELECT * FROM src WHERE p_size = 7),
  l1 AS (SELECT DISTINCT f.path, f.p_size FROM b JOIN src f ON f.p_partkey = b.p_size WHERE f.path NOT IN (SELECT path FROM b))"""


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.concat(F.lit("src/part_"), F.col("code_id").cast("string"), F.lit(".ts"))
    f = code(spark, sf_dir).select(F.lit("p").alias("project_id"), key.alias("path"), "text")
    return f, f.where(F.startswith("text", F.lit("import { a } from './part_7'")))


@query("dependency_expand", "J12 P12 U13", f"WITH {IMPORTS} SELECT 'p' AS project_id, path FROM l1")
def dependency_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, base = _sources(spark, sf_dir)
    return search.expand_imports(base, search.imports(f), f)


@query("dependency_closure", "J13", f"WITH {IMPORTS}, l2 AS (SELECT DISTINCT f.path FROM l1 JOIN src f ON f.p_partkey = l1.p_size WHERE f.path NOT IN (SELECT path FROM b UNION SELECT path FROM l1)) SELECT 'p' AS project_id, path, 1::BIGINT AS depth FROM l1 UNION ALL SELECT 'p', path, 2 FROM l2")
def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, base = _sources(spark, sf_dir)
    return search.import_closure(base, search.imports(f), f).withColumn("depth", F.col("depth").cast("long"))


@query(
    "fuzzy_paths", "J4 J5",
    f"""WITH {FILES}, n AS (SELECT doc_id, path, count(*) OVER (PARTITION BY regexp_extract(path, '[^/]*/[^/]*$')) AS twins FROM files)
      SELECT doc_id AS clip_id, CASE doc_id % 4 WHEN 3 THEN NULL WHEN 2 THEN CASE WHEN twins = 1 THEN path END ELSE path END AS path FROM n""",
)
def fuzzy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter each by the same path, by a suffix, by two equal segments, and not at all."""
    k, p = (F.col("doc_id") % 4).cast("int"), F.col("path")
    name = F.element_at(F.split(p, "/"), -1)
    shapes = F.array(F.concat(F.lit("/"), F.upper(p)), F.translate(F.concat(F.lit("x:/y/"), p), "/", "\\"), F.concat(F.lit("other/"), F.element_at(F.split(p, "/"), -2), F.lit("/"), name), F.concat(F.lit("none_"), name, F.lit(".x")))
    f = files(spark, sf_dir)
    return search.resolve_paths(f.select(F.col("doc_id").alias("clip_id"), F.get(shapes, k).alias("clip")), f).select("clip_id", "path")


#: Test files: beside the file, in another folder with more around the stem, and where none are looked for.
TESTS = """tests AS (SELECT project_id, CASE doc_id % 3 WHEN 0 THEN regexp_replace(path, '\\.md$', '.Test.ts') WHEN 1 THEN 'tests/My_' || upper(regexp_extract(path, '([^/]*)\\.md$', 1)) || '_more.spec.js' ELSE 'node_modules/' || regexp_replace(path, '\\.md$', '.test.ts') END AS path FROM files),
  stems AS (SELECT DISTINCT project_id, lower(regexp_extract(path, '([^/]*)\\.md$', 1)) AS stem FROM base),
  related AS (SELECT DISTINCT t.project_id, t.path FROM tests t JOIN stems s ON s.project_id = t.project_id AND NOT starts_with(path, 'node_modules') AND (starts_with(lower(regexp_extract(path, '[^/]*$')), stem) OR contains(lower(regexp_extract(path, '[^/]*$')), stem || '_')))"""


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]*)\.md$", 1)
    beside = lambda end: F.regexp_replace("path", r"\.md$", end)
    made = F.when(F.col("doc_id") % 3 == 0, beside(".Test.ts")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("tests/My_"), F.upper(name), F.lit("_more.spec.js"))).otherwise(F.concat(F.lit("node_modules/"), beside(".test.ts")))
    return files(spark, sf_dir).select("project_id", made.alias("path"))


@query("related_tests", "J18", f"WITH {FILES}, {BASE}, {TESTS} SELECT * FROM related")
def related_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.related_tests(base_files(spark, sf_dir), _tests(spark, sf_dir).unionByName(files(spark, sf_dir).select("project_id", "path")))


@query("diagnostics", "J9 S19", f"WITH {FILES} SELECT 'file:///ws/' || path AS uri, 'doc ' || doc_id AS message FROM files JOIN labels USING (doc_id) WHERE toxic = 1")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = files(spark, sf_dir).select(F.concat(F.lit("file:///ws/"), "path").alias("uri"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("message"))
    return search.diagnostics_of(d, base_files(spark, sf_dir))


@query(
    "upsert_candidates", "J20",
    f"""WITH {FILES}, {SIGNALS}, {EDGES}, n AS (SELECT project_id, dst AS path, confidence AS s FROM edges WHERE dst IS NOT NULL)
      SELECT project_id, path, round(coalesce(s, score), 6)::DOUBLE AS score, CASE WHEN s IS NULL THEN reasons WHEN reasons IS NULL THEN 'docgraph' ELSE reasons || '|docgraph' END AS reasons FROM ranked FULL JOIN n USING (project_id, path)""",
)
def upsert_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _candidates(spark, sf_dir).select("project_id", "path", F.col("score").cast("double").alias("score"), "reasons", F.lit(True).alias("selected"))
    news = edges(spark, sf_dir).where("dst is not null").select("project_id", F.col("dst").alias("path"), F.col("confidence").alias("score"), "reason")
    return recommend.upsert(state, news).select("project_id", "path", F.round("score", 6).alias("score"), joined("reasons").alias("reasons"))


@query(
    "projects", "J1 J2 S16 F16",
    f"""WITH {FILES}, p AS (SELECT DISTINCT source AS id FROM documents WHERE source IS NOT NULL)
      SELECT id AS project_id, count(path)::BIGINT AS n, coalesce(sum(size), 0)::BIGINT AS size, NULL::VARCHAR AS warning FROM p LEFT JOIN files ON project_id = id WHERE id NOT LIKE '%3' GROUP BY id UNION ALL SELECT id, 0, 0, 'invalidRoot' FROM p WHERE id LIKE '%3'""",
)
def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of the sources is written and read again; projects without a root are warnings, the others have their files."""
    ids = files(spark, sf_dir).select(F.col("project_id").alias("id")).where("id is not null").distinct()
    rows = ids.select("id", F.col("id").alias("name"), F.when(F.endswith("id", F.lit("3")), " ").otherwise(F.concat(F.lit("/ws/"), "id")).alias("rootPath"), F.array().cast("array<string>").alias("excludePatterns"))
    place = shared_path(spark, "registry")
    connectors.write_registry(rows, place)
    known, _ = connectors.read_projects(spark, place)
    good, warnings = signals.valid_roots(known)
    held = good.select(F.col("id").alias("project_id")).join(files(spark, sf_dir).select("project_id", "path", "size"), "project_id", "left")
    counted = held.groupBy("project_id").agg(F.count("path").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).withColumn("warning", F.lit(None).cast("string"))
    return counted.unionByName(warnings.select("project_id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("size"), F.col("kind").alias("warning")))


@query("directory_scan", "S1 S14 S15 S17", None)
def directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data files below the folder of the tables, without marker files; contents are not read."""
    return connectors.scan_files(spark, sf_dir, ["_SUCCESS", "*.crc"]).where(F.endswith("path", F.lit(".parquet"))).select("path", "size")


@query(
    "single_commit", "S9",
    f"WITH {COMMITS} SELECT DISTINCT path, NULL::VARCHAR AS warning FROM commits WHERE commit_id = 7 UNION ALL SELECT NULL, 'gitFailure -1'",
)
def single_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, none = commits(spark, sf_dir), F.lit(None).cast("string")
    there, nothing = connectors.commit_paths(c, "7"), connectors.commit_paths(c, "-1")
    rows = there[0].unionByName(nothing[0]).select("path", none.alias("warning"))
    return rows.unionByName(there[1].unionByName(nothing[1]).select(none.alias("path"), F.concat_ws(" ", "kind", "message").alias("warning")))


@query(
    "prompt_store", "S20 U14",
    """WITH p AS (SELECT role || conv_id % 50 AS name, max_by(text, (conv_id, turn)) AS text FROM conversations GROUP BY 1), n AS (SELECT name, 'new: ' || text AS text FROM p WHERE starts_with(name, 'user')),
      s AS (SELECT * FROM p WHERE name NOT IN ('user1', 'assistant1')) SELECT name, coalesce(n.text, s.text) AS text FROM s FULL JOIN n USING (name)""",
)
def prompt_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts are saved; some are deleted, others overwritten, and the store is read again."""
    c = table(spark, sf_dir, "conversations")
    name = F.concat("role", (F.col("conv_id") % 50).cast("string"))
    first = recommend.last_per_key(c.select(name.alias("name"), "text", "conv_id", "turn"), ["name"], ["conv_id", "turn"]).select("name", "text")
    place = shared_path(spark, "prompts")
    connectors.save_store(first, place)
    stored = connectors.load_store(spark, place, "text string")
    again = shared_path(spark, "prompts")
    connectors.save_store(connectors.merge_prompts(stored, first.where(F.startswith("name", F.lit("user"))).withColumn("text", F.concat(F.lit("new: "), "text")), ["user1", "assistant1"]), again)
    return connectors.load_store(spark, again, "text string").select("name", "text")


@query(
    "presets", "S21 U15 F17",
    f"""WITH {FILES}, {BASE}, f AS (SELECT project_id, path FROM files WHERE NOT contains(path, '3.md')) SELECT 'toxic' AS name, project_id, path FROM f SEMI JOIN base USING (project_id, path)
      UNION ALL SELECT 'favourites', project_id, path FROM files WHERE ends_with(path, '7.md')""",
)
def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preset of paths, some of which no longer exist, is saved, loaded by its name and cut to what exists and isn't excluded; another one are the favourites."""
    f, base = files(spark, sf_dir).select("project_id", "path"), base_files(spark, sf_dir).select("project_id", "path")
    gone = base.withColumn("path", F.concat(F.lit("gone/"), "path"))
    marked = f.where(F.endswith("path", F.lit("7.md"))).select(F.lit("favourites").alias("name"), "project_id", "path")
    place = shared_path(spark, "presets")
    connectors.save_store(base.unionByName(gone).select(F.lit("toxic").alias("name"), "project_id", "path").unionByName(marked), place)
    load = lambda name: connectors.load_store(spark, place, "project_id string, path string", name)
    one = selection.load_preset(load("toxic"), f, r"3\.md").select(F.lit("toxic").alias("name"), "project_id", "path")
    return one.unionByName(selection.favourites(f, load("favourites")).select(F.lit("favourites").alias("name"), "project_id", "path"))


@query(
    "selection_sets", "U3 U4 U9 U10",
    f"""WITH {FILES}, {BASE}, {TESTS}, m AS (SELECT project_id, path FROM base), t AS (SELECT * FROM related), a AS (SELECT * FROM m UNION SELECT * FROM t UNION SELECT project_id, path FROM files WHERE ends_with(path, '5.md'))
      SELECT 'added' AS step, * FROM a UNION ALL SELECT 'removed', * FROM (SELECT * FROM a EXCEPT SELECT * FROM t) UNION ALL SELECT 'of_base', * FROM m""",
)
def selection_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modified files with their related tests and more; the tests taken out again; and what of all is a base candidate, with other separators."""
    f, base = files(spark, sf_dir).select("project_id", "path"), base_files(spark, sf_dir).select("project_id", "path")
    related = search.related_tests(base, _tests(spark, sf_dir).unionByName(f))
    added = selection.add(selection.add(base, related), f.where(F.endswith("path", F.lit("5.md"))))
    chosen = recommend.selected_base(added.withColumn("path", F.translate("path", "/", "\\")), base)
    steps = {"added": added, "removed": selection.remove(added, related), "of_base": chosen}
    parts = [df.select(F.lit(name).alias("step"), "project_id", "path") for name, df in steps.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("content_counts", "F18", f"WITH {FILES} SELECT project_id, count(*) FILTER (length(text) > 0)::BIGINT AS n_valid FROM files GROUP BY 1")
def content_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.valid_contents(files(spark, sf_dir))


@query(
    "content_pack", "J2 J3 F10 F15 X1",
    f"""WITH {FILES}, r AS (SELECT *, CASE WHEN project_id = 'src4' OR ends_with(path, '9.md') OR text IS NULL THEN 'unreadableFile' WHEN size > 2048 THEN 'oversizedFile' END AS w FROM files WHERE project_id IS NOT NULL AND path IS NOT NULL)
      SELECT project_id, path, coalesce(w, 'full') AS outcome, CASE WHEN w IS NULL THEN size ELSE 0 END AS size FROM r""",
)
def content_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a project that isn't known, or whose file isn't there, or is too large, are warnings; the others are packed."""
    f = files(spark, sf_dir).where("project_id is not null")
    known = f.where("project_id <> 'src4'").select(F.col("project_id").alias("id")).distinct()
    good, warnings = pack.with_contents(f.select("project_id", "path", F.lit(1).alias("score")), known, f.where(~F.endswith("path", F.lit("9.md"))), 2)
    packed = pack.pack_scored(good, None).join(good.select("project_id", "path", "size"), ["project_id", "path"])
    return packed.select("project_id", "path", F.col("mode").alias("outcome"), "size").unionByName(warnings.select("project_id", "path", F.col("kind").alias("outcome"), F.lit(0).cast("long").alias("size")))


@query(
    "scenario_modes", "X21 X22",
    f"""WITH {FILES}, o AS (SELECT project_id, path, 'excluded' AS forced FROM files WHERE ends_with(path, '1.md')), m AS (SELECT s, CASE s WHEN 'initialShare' THEN 'skeleton' ELSE 'full' END AS mode FROM (VALUES ('initialShare'), ('debugFix'), ('newFeature'), ('custom')) v(s))
      SELECT s AS scenario, project_id, path, coalesce(forced, mode) AS mode FROM files CROSS JOIN m LEFT JOIN o USING (project_id, path)""",
)
def scenario_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a limit nothing is left out but what was set for a file."""
    f = files(spark, sf_dir).select("project_id", "path", "size")
    forced = f.where(F.endswith("path", F.lit("1.md"))).select("project_id", "path", F.lit("excluded").alias("mode"))
    out = None
    for name in [*pack.SCENARIOS, "custom"]:
        one = pack.modes(f, forced, pack.scenario(name, {"pack_mode": "full"})).select(F.lit(name).alias("scenario"), "project_id", "path", "mode")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "scenario_pack", "X21 X22 X1",
    f"""WITH RECURSIVE {FILES}, {SIGNALS}, o AS (SELECT * FROM ranked WHERE ends_with(path, '1.md')), sized AS (SELECT project_id, path, size // 2 AS size, score FROM ranked WHERE NOT ends_with(path, '1.md')),
      r AS (SELECT project_id, path, size, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, path) AS rn FROM sized),
      g AS (SELECT project_id, rn, CASE WHEN size <= 4000 THEN 4000 - size ELSE 4000 END AS room, size <= 4000 AS fits FROM r WHERE rn = 1
        UNION ALL SELECT r.project_id, r.rn, CASE WHEN size <= room THEN room - size ELSE room END, size <= room FROM g JOIN r ON r.project_id = g.project_id AND r.rn = g.rn + 1)
      SELECT r.project_id, r.path, CASE WHEN fits THEN 'skeleton' ELSE 'excluded' END AS mode FROM g JOIN r USING (project_id, rn) UNION ALL SELECT project_id, path, 'full' FROM o""",
)
def scenario_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first share: skeletons within the budget, but for the files that were set to be whole."""
    sized = _candidates(spark, sf_dir).withColumn("skeleton_size", F.floor(F.col("size") / 2))
    forced = sized.where(F.endswith("path", F.lit("1.md"))).select("project_id", "path", F.lit("full").alias("mode"))
    return pack.modes(sized, forced, pack.scenario("initialShare"), 1000)


@query(
    "candidate_tree", "X9 A10",
    f"""WITH {FILES}, k AS (SELECT id, 'Project ' || id AS name FROM (SELECT DISTINCT source AS id FROM documents WHERE source LIKE '%1' UNION SELECT 'empty')), f AS (SELECT project_id, path, size FROM files),
      n AS (SELECT project_id, 'file' AS kind, path AS node, size, 1 AS n_files FROM f UNION ALL SELECT project_id, 'directory', unnest([regexp_extract(path, '^[^/]*'), regexp_extract(path, '^[^/]*/[^/]*')]), size, 1 FROM f
        UNION ALL SELECT project_id, 'project', '', size, 1 FROM f UNION ALL SELECT id, 'project', '', 0, 0 FROM k WHERE id NOT IN (SELECT project_id FROM f WHERE project_id IS NOT NULL))
      SELECT project_id, CASE WHEN kind = 'project' THEN coalesce(any_value(name), project_id) ELSE regexp_extract(node, '[^/]*$') END AS name, kind, node, sum(size)::BIGINT AS size, sum(n_files)::BIGINT AS n_files FROM n LEFT JOIN k ON id = project_id GROUP BY project_id, kind, node""",
)
def candidate_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    some = f.where(F.endswith("project_id", F.lit("1"))).select(F.col("project_id").alias("id")).distinct().unionByName(spark.createDataFrame([("empty",)], "id string"))
    return selection.candidate_tree(f.select("project_id", "path", "size"), some.withColumn("name", F.concat(F.lit("Project "), "id")))


@query(
    "structure_pack", "K7 K8",
    f"""WITH {FILES}, d AS (SELECT DISTINCT project_id, regexp_extract(path, '^[^/]*') AS a FROM files WHERE path IS NOT NULL), l AS (SELECT *, a = max(a) OVER (PARTITION BY project_id) AS la FROM d)
      SELECT project_id, '## Directory Structure' || {N} || '```' || {N} || string_agg(CASE WHEN la THEN '└── ' ELSE '├── ' END || a || {N} || CASE WHEN la THEN '    ' ELSE '│   ' END || '└── ' || project_id || {N}, '' ORDER BY a) || '```' || {N} AS text FROM l GROUP BY project_id""",
)
def structure_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories only; no content is read."""
    f = files(spark, sf_dir).select("project_id", F.lit(0).alias("ord"), "path", F.lit("").alias("content"))
    return pack.render(f, "markdown", structure_only=True)


@query("snapshot", "ST5", "SELECT e.user_id AS key, max(ts) = (SELECT max(ts) FROM events WHERE event_type = 'click' AND user_id = e.user_id) AS modified FROM events e GROUP BY 1")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys whose last change was a click replace the snapshot; then each key is looked up in it."""
    last = recommend.last_per_key(changes(spark, sf_dir), ["key"], ["ts", "event_id"])
    modified = refresh_snapshot(last.where("content = 'click'").select("key"), shared_path(spark, "snapshot"))
    return is_modified(last.select("key"), modified, ["key"])


@query("token_stats", "A8 A9 A16", f"WITH {FILES} SELECT count(*)::BIGINT AS n_files, sum(size)::BIGINT AS size, sum(ceil(size / 4.0))::BIGINT AS file_tokens, ceil(sum(size) / 4.0)::BIGINT AS tokens, ceil(sum(size) / 4.0) > 50000 AS over_limit FROM files")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.token_stats(files(spark, sf_dir), 50_000)


TREE = """p AS (SELECT project_id, path, size, s FROM files LEFT JOIN (SELECT doc_id, 1 AS s FROM labels WHERE quality = 1) USING (doc_id)),
  t AS (SELECT project_id, unnest(['', regexp_extract(path, '^[^/]*'), regexp_extract(path, '^[^/]*/[^/]*')]) AS node, size, coalesce(s, 0) AS s FROM p)"""


@query(
    "directory_rollup", "A10 A14 X9 O5 O6 U6",
    f"WITH {FILES}, {TREE} SELECT project_id, node, CASE WHEN node = '' THEN 0 WHEN contains(node, '/') THEN 2 ELSE 1 END::BIGINT AS depth, sum(size)::BIGINT AS size, count(*)::BIGINT AS n_files, CASE WHEN sum(s) = 0 THEN 'none' WHEN sum(s) = count(*) THEN 'all' ELSE 'mixed' END AS state FROM t GROUP BY 1, 2",
)
def directory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    out = selection.tree(files(spark, sf_dir), files(spark, sf_dir).join(good, "doc_id"))
    return selection.tree_order(out.withColumn("kind", F.lit("directory"))).drop("kind").withColumn("depth", F.col("depth").cast("long"))


@query("selection_invert", "U5", f"WITH {FILES}, {BASE} SELECT project_id, path FROM files EXCEPT SELECT project_id, path FROM base")
def selection_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.invert(base_files(spark, sf_dir), files(spark, sf_dir))


@query(
    "ancestor_closure", "U6 U7",
    f"WITH {FILES} SELECT DISTINCT project_id, unnest([regexp_extract(path, '^[^/]*'), regexp_extract(path, '^[^/]*/[^/]*')]) AS path FROM files",
)
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.directories(files(spark, sf_dir))


@query("toggle_subtree", "U11 U12", f"WITH {FILES}, {BASE} SELECT project_id, path FROM base UNION SELECT project_id, path FROM files WHERE starts_with(path, 'en/src3/')")
def toggle_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.toggle(base_files(spark, sf_dir), selection.under(files(spark, sf_dir), "en/src3"))


def _greedy_sql(order: str, room: int) -> str:
    return f"""r AS (SELECT project_id, path, size, row_number() OVER (PARTITION BY project_id ORDER BY {order}) AS rn FROM sized),
      g AS (SELECT project_id, rn, CASE WHEN size <= {room} THEN {room} - size WHEN size // 2 <= {room} THEN {room} - size // 2 ELSE {room} END AS room, CASE WHEN size <= {room} THEN 'full' WHEN size // 2 <= {room} THEN 'skeleton' ELSE 'excluded' END AS mode FROM r WHERE rn = 1
        UNION ALL SELECT r.project_id, r.rn, CASE WHEN size <= room THEN room - size WHEN size // 2 <= room THEN room - size // 2 ELSE room END, CASE WHEN size <= room THEN 'full' WHEN size // 2 <= room THEN 'skeleton' ELSE 'excluded' END
        FROM g JOIN r ON r.project_id = g.project_id AND r.rn = g.rn + 1)
      SELECT r.project_id, r.path, g.mode FROM g JOIN r USING (project_id, rn)"""


@query("budget_pack", "X1 W3 O8 K11 J21", f"WITH RECURSIVE {FILES}, {SIGNALS}, sized AS (SELECT * FROM ranked), {_greedy_sql('score DESC, path', 20000)}")
def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _candidates(spark, sf_dir).withColumn("skeleton_size", F.floor(F.col("size") / 2))
    return pack.pack_scored(sized, 5000).select("project_id", "path", "mode")


@query("budget_pack_smallest", "X2 O7", f"WITH RECURSIVE {FILES}, sized AS (SELECT project_id, path, size, contains(path, '7.md') AS active FROM files), {_greedy_sql('active DESC, size, path', 9000)}")
def budget_pack_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = files(spark, sf_dir).select("project_id", "path", "size", F.floor(F.col("size") / 2).alias("skeleton_size"), F.contains("path", F.lit("7.md")).alias("active"))
    return pack.pack_smallest(sized, 9000).select("project_id", "path", "mode")


@query("manifest", "K11 J21 F10", f"WITH {FILES} SELECT project_id, path, size <= 1024 AS included FROM files")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("project_id", "path", "size", F.lit(0).alias("score"))
    return pack.manifest(f, pack.pack_scored(f, None, largest=1024)).select("project_id", "path", "included")


@query(
    "snippet_pack", "X3",
    f"""WITH {FILES}, l AS (SELECT project_id, path, unnest(string_split(text, {N})) AS line, generate_subscripts(string_split(text, {N}), 1) AS ln FROM files),
      i AS (SELECT *, ln - row_number() OVER (PARTITION BY project_id, path ORDER BY ln) AS island FROM l WHERE regexp_matches(line, 'License'))
      SELECT project_id, path || ':' || min(ln) || '-' || max(ln) AS path, string_agg(line, {N} ORDER BY ln) AS content FROM i GROUP BY project_id, i.path, island""",
)
def snippet_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return pack.snippets(f, search.merge_excerpts(search.context_lines(f, "License", 0)))[0]


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest files of each project that fit, with their texts."""
    f = files(spark, sf_dir)
    sized = f.select("project_id", "path", "size", F.lit(None).cast("long").alias("skeleton_size"), F.lit(False).alias("active"))
    taken = pack.pack_smallest(sized, 4000).where("mode = 'full'")
    return f.join(taken, ["project_id", "path"]).select("project_id", F.col("size").alias("ord"), "path", F.col("text").alias("content"))


PACKED = f"""r AS (SELECT project_id, path, size, text, sum(size) OVER (PARTITION BY project_id ORDER BY size, path) AS run FROM files), packed AS (SELECT * FROM r WHERE run <= 4000),
  nodes AS (SELECT DISTINCT project_id, regexp_extract(path, '^[^/]*') AS a, project_id AS b, regexp_extract(path, '[^/]*$') AS c FROM packed),
  last AS (SELECT *, a = max(a) OVER (PARTITION BY project_id) AS la, c = max(c) OVER (PARTITION BY project_id, a) AS lc, row_number() OVER (PARTITION BY project_id, a ORDER BY c) AS rn FROM nodes),
  tree AS (SELECT project_id, string_agg(CASE WHEN rn = 1 THEN CASE WHEN la THEN '└── ' ELSE '├── ' END || a || {N} || CASE WHEN la THEN '    ' ELSE '│   ' END || '└── ' || b || {N} ELSE '' END
     || CASE WHEN la THEN '    ' ELSE '│   ' END || '    ' || CASE WHEN lc THEN '└── ' ELSE '├── ' END || c || {N}, '' ORDER BY a, c) AS tree FROM last GROUP BY project_id)"""


@query(
    "markdown_pack", "K1 K2 K5 K8 X8 W8 A13",
    f"""WITH {FILES}, {PACKED} SELECT project_id, '## Directory Structure' || {N} || '```' || {N} || any_value(tree) || '```' || {N} || {N} || rtrim(string_agg('## File: ' || path || {N} || '```' || {N} || text || {N} || '```' || {N}, {N} ORDER BY size, path), {N}) || {N} AS text
      FROM packed JOIN tree USING (project_id) GROUP BY project_id""",
)
def markdown_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.render(_packed(spark, sf_dir), "markdown")


@query(
    "xml_pack", "K3 P20",
    f"""WITH {FILES}, {PACKED}, e AS (SELECT *, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&apos;'), '"', '&quot;') AS body FROM packed)
      SELECT project_id, '<repository>' || {N} || '  <structure>' || {N} || any_value(tree) || {N} || '  </structure>' || {N} || string_agg('  <file path="' || path || '">' || {N} || body || {N} || '  </file>', {N} ORDER BY size, path) || {N} || '</repository>' || {N} AS text
      FROM e JOIN tree USING (project_id) GROUP BY project_id""",
)
def xml_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.render(_packed(spark, sf_dir), "xml")


@query("json_pack", "K4", f"WITH {FILES}, {PACKED} SELECT project_id, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars, min(path) AS first FROM packed GROUP BY project_id")
def json_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pack as JSON, read back: serialisers differ in white space."""
    e = pack.render(_packed(spark, sf_dir), "json").select("project_id", F.from_json("text", "prompt string, structure string, repository array<struct<path:string,content:string>>").alias("j"))
    return e.select("project_id", F.size("j.repository").cast("long").alias("n"), F.aggregate("j.repository", F.lit(0).cast("long"), lambda a, x: a + F.length(x["content"])).alias("chars"), F.array_min(F.transform("j.repository", lambda x: x["path"])).alias("first"))


@query("tree_pack", "K6 K7 X4", f"WITH {FILES}, {PACKED} SELECT project_id, string_agg(path, {N} ORDER BY size, path) AS text, ceil(strlen(string_agg(path, {N})) / 4.0)::BIGINT AS tokens, true AS within_limit FROM packed GROUP BY project_id")
def tree_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.gate(pack.render(_packed(spark, sf_dir), "paths"), 50_000)


@query(
    "debounce_sessions", "ST1 ST2",
    """WITH e AS (SELECT user_id AS key, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
      SELECT key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*)::BIGINT AS n FROM s GROUP BY key, sid""",
)
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts(changes(spark, sf_dir), "2 hours").select("key", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query(
    "last_value_changes", "ST4 F19",
    "SELECT key, event_id, content FROM (SELECT user_id AS key, event_id, event_type AS content, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM content",
)
def last_value_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_changes(changes(spark, sf_dir), [F.col("ts"), F.col("event_id")]).select("key", "event_id", "content")


@query("latest_state", "U13 U14", "SELECT user_id AS key, event_id, event_type AS content FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.last_per_key(changes(spark, sf_dir), ["key"], ["ts", "event_id"]).select("key", "event_id", "content")


@query(
    "compressed_sizes", "X6 X7",
    f"""WITH {CODE} SELECT code_id, (strlen(text) - strlen(regexp_extract(text, 'run\\(\\d+\\) (\\{{[^}}]*\\}})', 1)) + 30)::INTEGER AS script, strlen(regexp_replace(text, '\\{{[^}}\\n]*\\n[^}}\\n]*\\n[^}}]*\\}}', '{{' || {N} || '  // ... existing code ...' || {N} || '}}', 'g'))::INTEGER AS other FROM code""",
)
def compressed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).select("code_id", F.octet_length(pack.compress(F.col("text"), F.lit("a.ts"))).alias("script"), F.octet_length(brace_stub(F.col("text"))).alias("other"))


@query(
    "discover", "X19 X20 O3",
    f"""WITH {FILES}, {EDGES}, {BASE}, {SOURCES},
      cand AS (SELECT project_id, path, 30.0 AS score FROM base UNION ALL SELECT DISTINCT e.project_id, f.path, 5.0 FROM edges e JOIN base b ON b.project_id = e.project_id AND b.path = e.src
        JOIN files f ON f.project_id = e.project_id AND f.path = e.dst WHERE confidence BETWEEN 0 AND 1 AND NOT EXISTS (SELECT 1 FROM base x WHERE x.project_id = e.project_id AND x.path = e.dst))
      SELECT project_id, path, round(score::DOUBLE, 6) AS score, recommended FROM (SELECT project_id, path, score::DOUBLE AS score, false AS recommended FROM cand
      UNION ALL SELECT project_id, path, score, true FROM recs r WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.project_id = r.project_id AND c.path = r.path))""",
)
def discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commit recipe: its files, what they import and what the graph leads to from them, and recommendations, in the locale's order of paths."""
    base = base_files(spark, sf_dir)
    found = search.discover("gitCommit", base, files(spark, sf_dir), edges(spark, sf_dir))
    out = recommend.with_base(found, _merged(spark, sf_dir))
    return signals.in_order(out.withColumn("score", F.round("score", 6)), "path")


@query(
    "discover_recipes", "X19 X20 J12 J14",
    f"""WITH {IMPORTS}
      SELECT r AS recipe, path, score FROM (SELECT path, 30.0::DOUBLE AS score FROM b UNION ALL SELECT path, 5 FROM l1), (VALUES ('gitDiff'), ('gitCommit')) v(r) WHERE true
      UNION ALL SELECT 'text', path, 35 FROM src WHERE contains(path, '_1') UNION ALL SELECT 'extension', path, 10 FROM src UNION ALL SELECT 'directory', path, 15 FROM src""",
)
def discover_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recipe over source files with imports; without Markdown files the graph adds none."""
    f, base = _sources(spark, sf_dir)
    none = edges(spark, sf_dir).limit(0)
    out = None
    for kind, value in (("gitDiff", ""), ("gitCommit", ""), ("text", "_1"), ("extension", "ts"), ("directory", "src/")):
        one = search.discover(kind, base, f, none, value).select(F.lit(kind).alias("recipe"), "path", "score")
        out = one if out is None else out.unionByName(one)
    return out


@query("grep_selection", "O9 S5", f"WITH {FILES} SELECT DISTINCT project_id, path FROM files WHERE contains(lower(text), 'tion') ORDER BY project_id, path LIMIT 5000")
def grep_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.first_paths(search.contains_text(files(spark, sf_dir), "tion"), 5000)


@query("token_scan", "O10 A8", f"WITH {FILES} SELECT project_id, path, ceil(coalesce(size, 0) / 4.0)::BIGINT AS tokens FROM files ORDER BY project_id, path LIMIT 10000")
def token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = search.first_paths(files(spark, sf_dir).select("project_id", "path", "size"), 10_000)
    return first.select("project_id", "path", F.ceil(F.coalesce("size", F.lit(0)) / 4).cast("long").alias("tokens"))


@query("read_contents", "S14 S15", f"WITH {FILES} SELECT project_id, path, coalesce(size, 0) AS size, NULL::VARCHAR AS warning FROM files UNION ALL SELECT project_id, '../' || path, 0, 'unreadableFile' FROM files")
def read_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    keys = f.select("project_id", "path")
    return signals.read_contents(keys.unionByName(keys.withColumn("path", F.concat(F.lit("../"), "path"))), f).drop("text")


@query("diff_text", "S11", f"SELECT conv_id AS project_id, coalesce(string_agg(text, {N} ORDER BY turn % 2, turn), '') AS diff FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def diff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    path = F.concat("role", F.lit("/"), F.lpad(F.col("turn").cast("string"), 9, "0"))
    return connectors.changed_diff(c.select(F.col("conv_id").alias("project_id"), path.alias("path"), (F.col("turn") % 2 == 1).alias("staged"), F.col("text").alias("diff")), ["system"])
