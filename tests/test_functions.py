"""Golden cases of functions and operators on small tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ctxengine.functions import paths as P
from ctxengine.functions import text as X
from ctxengine.operators import pack, patch, recommend, search, selection, signals
from ctxengine.sources import connectors


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, v string").select("i", column.alias("o")).orderBy("i").select("o").collect()]


def test_path_validity(spark):
    given = ["src/a.ts", "node_modules/x.ts", "a.exe", "LICENSE", "HOME", "noextension", "1.2.3", "a|b.ts", "x/f.test.js", ".gitignore", "a.log", "docs/d.md"]
    assert values(spark, given, P.valid_path(F.col("v"))) == [True, False, False, True, False, False, False, False, True, True, False, True]


def test_links(spark):
    given = ["../a.md", "b%20c.md?x#y", "#top", "/root.md", "mailto:x", "../../out.md", "./x/../y.md", "a+b.md", "bad%zz.md"]
    assert values(spark, given, P.resolve_link(F.lit("docs/s.md"), F.col("v"))) == ["a.md", "docs/b c.md", None, None, None, None, "docs/y.md", "docs/a+b.md", None]


def test_import_out_of_root(spark):
    assert values(spark, ["./src/Service", "../utils/helper", "../../x"], P.resolve_import(F.lit("index.ts"), F.col("v"))) == ["src/Service", "utils/helper", "x"]


def test_trim_knows_unicode_spaces(spark):
    assert values(spark, [" \t x ﻿", ""], P.js_trim(F.col("v"))) == ["x", ""]


def test_skeleton_and_stub(spark):
    code = "class A {\n  run() {\n    a;\n    b;\n  }\n}\nplain"
    assert values(spark, [code], X.line_skeleton(F.col("v"))) == ["class A {\n  run() {\n" + X.OMITTED + "\n  }\n}"]
    assert values(spark, ["f {\n a\n b\n}\ng { x }", "{\n}"], X.brace_stub(F.col("v"))) == ["f " + X.STUB + "\ng { x }", "{\n}"]


def test_similarity_and_tokens(spark):
    assert values(spark, ["", "a b", "abcd"], X.similarity(F.col("v"), F.lit("ab"))) == [0.0, 1.0, 0.5]
    assert values(spark, ["401", "0", "-3", None], X.estimated_tokens(F.col("v").cast("double"))) == [101, 0, 0, 0]


def test_scores(spark):
    reasons = spark.createDataFrame([(["rgMatch", "gitModified", "pathAffinity"], False), (["pathAffinity"], True), (["rgMatch", "gitModified", "pathAffinity", "excluded"], True), (["pathAffinity", "manualPin"], False)], "r array<string>, pin boolean")
    assert [r[0] for r in reasons.select(signals.score_of(F.col("r"), F.col("pin"))).collect()] == [80, 115, -820, 15]


def test_excerpts(spark):
    rows = spark.createDataFrame([("p", "a", n, t) for n, t in ((4, "d"), (3, "c"), (4, "d"), (10, "j"), (9, "i"))], "project_id string, path string, ln int, line string")
    assert sorted(tuple(r) for r in search.merge_excerpts(rows).select("start_line", "end_line", "content").collect()) == [(3, 4, "c\nd"), (9, 10, "i\nj")]


def test_merge_recommendations(spark):
    recs = spark.createDataFrame([("p", "docs\\auth.md", "markdownLink", 0.8, "b"), ("p", "docs/auth.md", "markdownLink", 0.4, "a"), ("p", "docs/auth.md", "coChange", 0.6, "x"), ("p", "z.md", "coChange", 0.9, "low"), ("p", "z.md", "coChange", 0.9, "high"), ("p", "bad.md", "other", 1.0, "x")], "project_id string, path string, source string, score double, detail string")
    got = {r["path"]: ([(x["source"], x["detail"]) for x in r["reasons"]], round(r["rec_score"], 6)) for r in recommend.merge(recs).collect()}
    assert got == {"docs/auth.md": ([("markdownLink", "b"), ("coChange", "x")], 1.4), "z.md": ([("coChange", "high")], 0.9)}


def greedy(rows, room):
    out = {}
    for path, size, skeleton in rows:
        mode = "full" if size <= room else "skeleton" if skeleton is not None and skeleton <= room else "excluded"
        room -= {"full": size, "skeleton": skeleton, "excluded": 0}[mode]
        out[path] = mode
    return out


def test_greedy_pack_in_rounds(spark):
    import random

    r = random.Random(3)
    rows = [(f"f{i:03}", r.randint(1, 400), r.choice([None, r.randint(1, 60)])) for i in range(300)]
    df = spark.createDataFrame([("p", *x) for x in rows] + [("q", *x) for x in rows[:3]], "project_id string, path string, size long, skeleton_size long")
    got = {(x["project_id"], x["path"]): x["mode"] for x in pack.greedy_pack(df, 2500, [F.lit(0).alias("o")], horizon=7).collect()}
    assert got == {("p", k): v for k, v in greedy(rows, 2500).items()} | {("q", k): v for k, v in greedy(rows[:3], 2500).items()}


def test_pack_without_rows(spark):
    empty = spark.createDataFrame([], "project_id string, path string, size long, skeleton_size long")
    assert pack.greedy_pack(empty, 10, [F.lit(0).alias("o")]).count() == 0


def test_fuzzy_paths(spark):
    files = spark.createDataFrame([("src/auth.ts",), ("src/app.ts",), ("lib/util/x.ts",), ("lib2/util/x.ts",), ("readme",)], "path string")
    clips = spark.createDataFrame(list(enumerate(["SRC/auth.ts", "auth.ts", "y/src/app.ts", "z/util/x.ts", "x.ts", "unknown.ts", "uth.ts", "my-readme"])), "clip_id int, clip string")
    got = [r["path"] for r in search.resolve_paths(clips, files).orderBy("clip_id").collect()]
    assert got == ["src/auth.ts", "src/auth.ts", "src/app.ts", None, None, None, "src/auth.ts", "readme"]


def test_healing():
    old = "a {\n  one\n  two\n  three\n}\nend"
    assert patch.heal_text(old, "a {\n// ...\n}\nend") == (old, 0.0, None)
    assert patch.heal_text(old, "a {\n// ... existing\nthreex")[0] == "a {\n  one\n  two\n  threex"
    assert patch.heal_text(old, "a {\n// ...\nno such line at all\n// ...\n!!")[2] == "Anchor line not found: no such line at all"
    assert patch.heal_text(old, "a {\n// rest of file")[0] == old


def test_fences(spark):
    text = "````md\n```x\n```\n````\nrest ``` none"
    assert values(spark, [text, "no", None, "```\nx"], F.size(X.fences(F.col("v")))) == [1, 0, 0, 0]


def fences_by_hand(text):
    """(before, body) of fences: an opening run of backticks, then the first line start with as many before white space or the end."""
    out, at = [], 0
    while (start := text.find("```", at)) >= 0:
        run = len(text) - start - len(text[start:].lstrip("`"))
        head = text.find("\n", start)
        ends = [k for k in range(max(0, head), len(text)) if head >= 0 and text.startswith("\n" + "`" * run, k) and (text[k + 1 + run : k + 2 + run].strip() == "")]
        if not ends:
            break
        out.append((text[at:start], text[head + 1 : max(head + 1, ends[0])]))
        at = ends[0] + 1 + run
    return out


def test_fences_by_brute_force(spark):
    import random

    r = random.Random(9)
    texts = ["".join(r.choice(["```", "````", "`", "\n", "x", " y", "ts\n", "\n```\n", "\n````"]) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    got = values(spark, texts, X.fences(F.col("v")))
    assert [[(b["before"], b["body"]) for b in row] for row in got] == [fences_by_hand(t) for t in texts]


def test_diff(spark):
    assert values(spark, ["a\nb"], X.positional_diff(F.lit("p"), F.col("v"), F.lit("a\nc\nd"))) == ["--- a/p\n+++ b/p\n@@\n a\n- b\n+ c\n+ d"]


def test_tree(spark):
    paths = spark.createDataFrame([("p", "README"), ("p", "src/a.ts"), ("p", "src/u/b.ts")], "project_id string, path string")
    assert pack.tree_text(paths).first()["tree"] == "├── README\n└── src\n    ├── a.ts\n    └── u\n        └── b.ts\n"


def test_directory_sizes_and_state(spark):
    f = spark.createDataFrame([("p", "a/x", 1), ("p", "a/b/y", 2), ("p", "z", 4)], "project_id string, path string, size long")
    got = {r["node"]: (r["size"], r["state"]) for r in selection.tree(f, f.where("path = 'a/x'")).collect()}
    assert got == {"": (7, "mixed"), "a": (3, "mixed"), "a/b": (2, "none")}


def test_toggle(spark):
    every = spark.createDataFrame([("p", "a/x"), ("p", "a/y"), ("p", "z")], "project_id string, path string")
    under = selection.under(every, "a")
    once = selection.toggle(every.where("path = 'z'"), under)
    assert sorted(r["path"] for r in once.collect()) == ["a/x", "a/y", "z"]
    assert [r["path"] for r in selection.toggle(once, under).collect()] == ["z"]


def test_prompts_presets_and_commits(spark, tmp_path):
    stored = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three")], "name string, text string")
    news = spark.createDataFrame([("b", "new"), ("d", "four")], "name string, text string")
    assert {r["name"]: r["text"] for r in connectors.merge_prompts(stored, news, ["c"]).collect()} == {"a": "one", "b": "new", "d": "four"}
    connectors.save_store(stored, str(tmp_path / "prompts"))
    assert [r["text"] for r in connectors.load_store(spark, str(tmp_path / "prompts"), "text string", "b").collect()] == ["two"]
    commits = spark.createDataFrame([("1", " a.ts "), ("1", "a.ts"), ("2", "b.ts")], "commit_id string, path string")
    paths, warnings = connectors.commit_paths(commits, "1")
    assert [r["path"] for r in paths.collect()] == ["a.ts"] and warnings.count() == 0
    assert connectors.commit_paths(commits, "9")[1].first()["kind"] == "gitFailure"


def test_headings_of_linking_files_do_not_count(spark):
    """Per source: a file that links the target doesn't recommend it by name too, another one does."""
    base = spark.createDataFrame([("p", "docs/a.md", "# login\n[x](auth.md)"), ("p", "docs/b.md", "# login")], "project_id string, path string, text string")
    files = spark.createDataFrame([("p", "docs/auth.md", "# login flow"), ("p", "docs/a.md", ""), ("p", "docs/b.md", "")], "project_id string, path string, text string")
    got = {(r["path"], r["source"], r["detail"]) for r in recommend.markdown(base, files).collect()}
    assert ("docs/auth.md", "markdownLink", "Markdown link from docs/a.md") in got
    assert ("docs/auth.md", "headingMatch", "Filename or heading match from docs/b.md") in got
    alone = {(r["path"], r["source"]) for r in recommend.markdown(base.where("path = 'docs/a.md'"), files).collect()}
    assert ("docs/auth.md", "headingMatch") not in alone


def test_names_by_brute_force(spark):
    import random

    r = random.Random(4)
    vocabulary = ["api", "design", "test", "login", "flow", "queue", "cache", "index"]
    made = [(f"d{r.randint(0, 3)}/f{i}.md", "# " + " ".join(r.choices(vocabulary, k=r.randint(1, 3))) + "".join(f"\n[l](f{r.randint(0, 39)}.md)" for _ in range(r.randint(0, 4)))) for i in range(40)]
    files = spark.createDataFrame([("p", *x) for x in made], "project_id string, path string, text string")
    base = files.where("crc32(path) % 2 = 0")
    links = {(x["src"], x["path"]) for x in recommend.link_pairs(base, files).collect()}
    heads = {p: [w for w in t.split("\n")[0][2:].split()] for p, t in made}
    want = {}
    for s in sorted(x["path"] for x in base.select("path").collect()):
        for p in heads:
            hits = [w for w in heads[s] if w in heads[p]]
            if s != p and (s, p) not in links and hits and (len(hits) > 1 or hits[0] not in ("api", "design", "test")):
                want.setdefault(p, s)
    got = {x["path"]: x["detail"].removeprefix("Filename or heading match from ") for x in recommend.by_name(base, files).collect()}
    assert got == want


def test_failing_sources_warn(spark):
    base = spark.createDataFrame([("p", "a.md"), ("q", "b.md")], "project_id string, path string")
    good = spark.createDataFrame([("p", "z.md", "coChange", 2.0, "x")], "project_id string, path string, source string, score double, detail string")
    recs, warnings = recommend.collect({"coChange": lambda: good, "markdownLink": lambda: base.select("nothing")}, base)
    assert recs.count() == 1
    assert {(r["project_id"], r["kind"]) for r in warnings.collect()} == {("p", "recommendationFailure"), ("q", "recommendationFailure")}
    assert signals.joined_messages(warnings, ["kind"]).first()["message"].count("\n") >= 1


def test_co_change_history(spark):
    rows = [("p", c, c, f"d{k}.md") for c in range(60) for k in (c % 3, 7)] + [("p", 59, 59, "code.ts")]
    got = {r["path"]: r["n"] for r in search.co_changes(spark.createDataFrame(rows, "project_id string, commit_id int, ts int, path string"), spark.createDataFrame([("p", "d7.md"), ("p", "code.ts")], "project_id string, path string")).where("target = 'd7.md'").collect()}
    assert got == {"d0.md": 16, "d1.md": 17, "d2.md": 17}  # the last 50 commits


def test_user_patterns_are_those_of_the_engine(spark):
    assert P.user_pattern("(?P<n>x)") is None and P.user_pattern("(?<n>x)") and P.user_pattern("x" * 501) is None


def test_next_rows_across_ranges(spark):
    from ctxengine.sources.tables import following

    rows = [("p", i, f"f{i}") for i in (1, 5, 6, 90, 91, 300)] + [("q", 7, "g7"), ("q", 299, "g299")]
    got = following(spark.createDataFrame(rows, "project_id string, doc_id long, path string"), ["path"], range_rows=1)
    assert {r["path"]: r["next_path"] for r in got.collect()} == {"f1": "f5", "f5": "f6", "f6": "f90", "f90": "f91", "f91": "f300", "f300": None, "g7": "g299", "g299": None}
    assert following(spark.createDataFrame([], "project_id string, doc_id long, path string"), ["path"]).count() == 0


def test_long_skeletons(spark):
    code = "\n".join(f"class A{i} {{\n  x;\n  y;\n}}" for i in range(700))
    assert values(spark, [code], X.line_skeleton(F.col("v"))) == ["\n".join(f"class A{i} {{\n{X.OMITTED}\n}}" for i in range(700))]


def test_patches_are_written_beside_the_files(spark, tmp_path):
    plans = spark.createDataFrame([("a.ts", "x", 1)], "target string, patched string, more int")
    connectors.write_patched(plans, str(tmp_path / "patched"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "patched")).collect()] == [("a.ts", "x")]


def test_scan_and_registry(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for p in ("src/a.ts", "src/b.log", "node_modules/c.ts"):
        (tmp_path / p).write_text("x")
    assert [r["path"] for r in connectors.scan_files(spark, str(tmp_path), ["*.log"], True).collect()] == ["src/a.ts"]
    (tmp_path / "r.json").write_text('[{"id":"a","name":"A","rootPath":"/a"}]')
    assert connectors.read_projects(spark, str(tmp_path / "r.json"))[0].count() == 1
    (tmp_path / "bad.json").write_text('[{"id":"a","name":"A","rootPath":"/a"},{"id":"b"}]')
    good, warnings = connectors.read_projects(spark, str(tmp_path / "bad.json"))
    assert (good.count(), warnings.count()) == (0, 1)
    assert connectors.read_projects(spark, str(tmp_path / "none.json"))[0].count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_nearest_lines_by_brute_force():
    r = random.Random(1)
    text = lambda letters, n: "".join(r.choice(letters) for _ in range(r.randint(0, n)))
    for _ in range(2000):
        a, b = text("abcé", 12), text("abcé", 12)
        assert patch._edits(patch._masks(a), len(a), b) == edits(a, b)
        lines, line, low = [text("abc d", 11) for _ in range(12)], text("abc d", 11), r.randint(0, 5)
        best = None
        for k in range(low, len(lines)):
            x, y = line.replace(" ", ""), lines[k].replace(" ", "")
            n = max(len(x), len(y))
            score = (n - edits(x, y)) / n if n else 1.0
            if score >= 0.8 and (best is None or score > best[0]):
                best = score, k
        assert patch._Lines("\n".join(lines)).nearest(line, low) == (best and best[1])


def test_healing_of_fuzzy_indented_and_lost_anchors():
    old = "a {\n  first();\n  second();\n    deep(1, 2, 3);\n}\nend"
    assert patch.heal_text(old, "a {\n// ...\ndeep(1, 2, 4);")[0] == "a {\n  first();\n  second();\n    deep(1, 2, 4);"  # like enough, with the original's indent
    assert patch.heal_text(old, "a {\n// ...\n\tdeep(1,2,3);\n}\nend")[0] == old  # the same but for white space
    assert patch.heal_text(old, "a {\n// ...\nxxxxxxxxxxxxxxxxxxx\n// ...\nyyyyyyyyyyyyyyyyyyyyy")[2] == "Anchor line not found: xxxxxxxxxxxxxxxxxxx"
    assert patch.heal_text(old, "a {\n// ...\n  second();\n// ...\nend")[0] == old  # two gaps


def test_greedy_packs_that_take_runs_by_brute_force(spark):
    r = random.Random(2)
    for horizon, room in [(3, 500), (2, 60), (5, 3000)]:
        rows = [(r.choice("ab"), f"p{i}", r.choice([0, 1, 5, 20, 90]), r.choice([None, 1, 3, 10]), r.randint(0, 5)) for i in range(150)]
        df = spark.createDataFrame(rows, "project_id string, path string, size long, skeleton_size long, score int")
        got = {(x["project_id"], x["path"]): x["mode"] for x in pack.greedy_pack(df, room, [(-F.col("score")).alias("neg")], horizon=horizon).collect()}
        want = {}
        for p in "ab":
            left = room
            for q, path, size, part, _ in sorted((x for x in rows if x[0] == p), key=lambda x: (-x[4], x[1])):
                took = next((m for m, n in (("full", size), ("skeleton", part)) if n is not None and n <= left), "excluded")
                left -= {"full": size, "skeleton": part}.get(took, 0)
                want[q, path] = took
        assert got == want


def test_a_project_of_many_files_packs_in_few_rounds(spark):
    files = spark.range(300_000).select(F.lit("p").alias("project_id"), F.format_string("f%07d", "id").alias("path"), (F.col("id") % 97 + 1).alias("size"), F.lit(None).cast("long").alias("skeleton_size"))
    full = pack.greedy_pack(files, 9_000_000, [F.lit(0).alias("o")]).where("mode = 'full'").join(files, ["project_id", "path"]).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    assert full["n"] > 180_000 and full["size"] == 9_000_000


def test_diffs_and_fences_of_long_texts_take_linear_time(spark):
    """Before, the texts were split again for each line, and what stands between the fences was looked for again for each fence."""
    import time

    n = 40_000
    old, new = "\n".join(f"line {i}" for i in range(n)), "\n".join(f"line {i // 2 * 2}" for i in range(n + 1))
    reply = "".join(f"see src/f{i}.ts\n```ts lib/b{i}.ts\nlet x = {i}\n\n```\n" for i in range(2_000))
    df = spark.createDataFrame([(1, old, new, reply)], "k long, old string, new string, reply string")
    start = time.monotonic()
    diff = df.select(X.positional_diff(F.lit("p"), F.col("old"), F.col("new")).alias("d")).first()["d"].split("\n")
    found = patch.candidates(df, ["k"], "reply").orderBy("i").collect()
    assert time.monotonic() - start < 30
    assert diff[:6] == ["--- a/p", "+++ b/p", "@@", " line 0", "- line 1", "+ line 0"] and diff[-1] == f"+ line {n}" and len(diff) == 3 + n + n // 2 + 1
    assert [(r["i"], r["path_hint"], r["content"]) for r in found] == [(i, f"lib/b{i}.ts", f"let x = {i}") for i in range(2_000)]
    nulls = spark.createDataFrame([("a", None), (None, "b"), (None, None)], "x string, y string").select(X.positional_diff(F.lit("p"), F.col("x"), F.col("y")).alias("d")).collect()
    assert [r["d"] for r in nulls] == ["--- a/p\n+++ b/p\n@@\n- a", "--- a/p\n+++ b/p\n@@\n+ b", None]


def test_a_line_of_a_skeleton_is_looked_at_once(spark):
    plan = spark.createDataFrame([("a",)], "v string").select(X.line_skeleton(F.col("v")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and plan.count("regexp_replace(") == 1


def test_texts_made_of_parts_are_dealt_over_tasks(spark):
    from conftest import SF

    from ctxengine.plans import catalog

    for name in ("line_skeleton", "compressed_sizes", "brace_compress", "ast_compress"):
        assert "RepartitionByExpression [p_partkey" in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString(), name


def test_names_over_first_base_files_and_the_rest_by_brute_force(spark, monkeypatch):
    """However many base files come first, and however little may be broadcast."""
    r = random.Random(9)
    vocabulary = ["api", "design", "test", *(f"w{i:02}" for i in range(25))]
    made = [(p, f"d{r.randint(0, 1)}/{i}.md", "# " + " ".join(r.choices(vocabulary, k=r.randint(1, 3))) + "".join(f"\n[l](../d{r.randint(0, 1)}/{r.randint(0, 29)}.md)" for _ in range(r.randint(0, 5)))) for p in "pq" for i in range(30)]
    files = spark.createDataFrame(made, "project_id string, path string, text string").cache()
    base = files.where("crc32(concat(project_id, path)) % 2 = 0").cache()
    links = {(x["project_id"], x["src"], x["path"]) for x in recommend.link_pairs(base, files).collect()}
    heads = {(p, path): t.split("\n")[0][2:].split() for p, path, t in made}
    want = {}
    for project, s in sorted((x["project_id"], x["path"]) for x in base.collect()):
        for p, path in heads:
            hits = [w for w in heads[project, s] if w in heads[p, path]]
            if p == project and s != path and (p, s, path) not in links and hits and (len(hits) > 1 or hits[0] not in ("api", "design", "test")):
                want.setdefault((p, path), s)
    assert len(want) > 30
    for first, rows in ((1, 300_000), (3, 10), (16, 300_000)):
        monkeypatch.setattr(recommend, "HEADS", first)
        monkeypatch.setattr(recommend, "BROADCAST_ROWS", rows)
        got = {(x["project_id"], x["path"]): x["detail"].removeprefix("Filename or heading match from ") for x in recommend.by_name(base, files).collect()}
        assert got == want, (first, rows)


def test_words_of_files_that_match_a_first_base_file_are_not_joined_with_all_words(spark):
    files = spark.createDataFrame([("p", f"d/{i}.md", f"# common own{i}") for i in range(40)], "project_id string, path string, text string")
    found = recommend.by_name(files.where("path < 'd/2'"), files)
    assert found.count() == 40 and "word" not in found._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_shuffled_for_base_files(spark):
    from conftest import SF

    from ctxengine.plans.catalog import base_files

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as if the labels' files were large
    try:
        plan = base_files(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
