"""Text functions as Column expressions: tokens, labels, strippers, similarity, reply heuristics, skeletons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import SPACE, extension, fold_separators, js_trim, valid_file_path, valid_path

# Words that carry no meaning in names and headings.
STOP_WORDS = ["the", "and", "for", "from", "with", "document"]
GENERAL_WORDS = ["api", "design", "test"]
# Language tokens.
LANGUAGES = {"ts": "typescript", "typescript": "typescript", "js": "javascript", "javascript": "javascript", "json": "json", "md": "markdown", "html": "html"}
OMITTED = "  // ... implementation omitted"
STUB = "{\n  // ... existing code ...\n}"
OMISSION_MARK = "\n// ... existing code ...\n"
# Fixed value: how a line starts that is a signature (there is no word boundary).
SIGNATURE = r"^(export\s+)?(public\s+|private\s+|protected\s+|static\s+|abstract\s+|async\s+)?(class|interface|type|enum|function|const|let|var|import|from|get\s+|set\s+|constructor|(\w+\s*\(.*?\)\s*(:|\{)))"
BYTES_PER_TOKEN = 4
#: Lines in a part of a skeleton.
PART = 128

# What headings, links, imports, paths, comments and fences look like.
HEADING = r"(?m)^#{1,6}\s+(.+)$"
INLINE_LINK = r"!?\[[^\]]*\]\(([^)\s]+)(?:\s+['\"][^'\"]*['\"])?\)"
WIKI_LINK = r"!?\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
RELATIVE_IMPORT = r"(?:import|from)\s+['\"](\.[^'\"]+)['\"]"
MENTIONED_PATH = r"(?i)(?:[a-z]:\\|\./|/)?[a-z0-9_./\\-]+\.[a-z0-9]+"
CLIPBOARD_PATH = r"([a-zA-Z0-9._\-/]+\.[a-zA-Z0-9]+)(?::\d+:\d+)?"
COMMENTS = [(r"(?m)/\*[\s\S]*?\*/|([^:]|^)//.*$", "$1"), (r"(?m)^\s*#.*$", "")]
# How a line names a path, the surest way first; then inline code and plain paths, the last of a line first.
PATH_LINES = [r"(?i)##\s*File:\s*([^\s`]+)", r"`([^`]+)`\s*:?\z", r"\*\*([^*]+)\*\*\s*:?\z", r"__([^_]+)__\s*:?\z", r"^[-*+]\s+([^\s`].*?)\s*:?\z", r"^\d+\.\s+([^\s`].*?)\s*:?\z"]
INLINE_CODE, PLAIN_PATH = r"`([^`]+)`", r"(?i)([a-z0-9_./\\@+-]+)"
# What is taken off a hint of a path, what makes it none, and the path in it.
HINT_LABEL = "(?i)^\\s*[`\"]?(?:(?:File|Path|ファイル|対象)[:\\s]+)?|[`\"]\\s*\\z"
HINT_WRAP = "^`?\"?(?:[ab]/)?(?:\\./)?|\"?`?\\z"
NO_HINT = r"(?i:^https?://)|node_modules|dist|^[`\"]{0,2}(?:[ab]/)?(?:\./)?[A-Z]:\\"
HINTED_PATH = r"(?:\b|\W)(?:\./)?([\w./\\-]+\.[a-zA-Z0-9_-]+)(?:\b|\W)"
# Kinds of replies and of code by what they hold, the first that holds.
REPLY_KINDS = {
    "unifiedDiff": [r"(?m)^---\s+a/|^\+\+\+\s+b/|^@@ "], "marked": ["{marker}", "```"], "pathCodeBlock": ["{path line}", "```"], "markdownCodeBlock": [r"```[a-zA-Z0-9]*\n[\s\S]*\n```"],
    "chatMixed": [r"^###?\s+|以下のファイル|修正してください"], "plainCode": [r"\b(?:import|export|function|class|const|let)\b"],
}
PATH_LINE = r"^[\w./-]+\.(?:ts|js|tsx|jsx|json|md)\z"
CONTENT_KINDS = {"json": [r"(?m)^\s*\{", r'"\w+"\s*:'], "typescript": [r"class\s+\w+"], "javascript": [r"function\s+\w+|console\.log\("]}


def lines(c: Column) -> Column:
    return F.split(c, r"\r?\n")


def all_groups(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, three at least, without stop words."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS))


def heading_tokens(c: Column) -> Column:
    """P10"""
    return F.flatten(F.transform(all_groups(c, HEADING, 1), tokens))


def link_targets(c: Column) -> Column:
    """Array of (target, extensionless) of Markdown links, then wiki links, which may leave out the extension."""

    def kind(pattern: str, extensionless: bool) -> Column:
        return F.transform(all_groups(c, pattern, 1), lambda t: F.struct(t.alias("target"), F.lit(extensionless).alias("extensionless")))

    return F.concat(kind(INLINE_LINK, False), kind(WIKI_LINK, True))


def import_targets(c: Column) -> Column:
    """The relative targets of import and from, as they stand."""
    return all_groups(c, RELATIVE_IMPORT, 1)


def mentioned_paths(c: Column) -> Column:
    """Distinct paths with an extension in a free text, in order."""
    found = all_groups(c, MENTIONED_PATH, 0)
    clean = F.transform(found, lambda p: js_trim(fold_separators(F.regexp_replace(p, r":\d+(?::\d+)?\z", ""))))
    return F.array_distinct(F.filter(clean, lambda p: F.contains(p, F.lit("."))))


def clipboard_paths(c: Column) -> Column:
    """The second form, with valid paths only."""
    return F.array_distinct(F.filter(all_groups(c, CLIPBOARD_PATH, 1), lambda p: valid_path(p, 1)))


def estimated_tokens(size: Column) -> Column:
    """P15"""
    n = size.cast("double")
    return F.when(n.isNull() | F.isnan(n) | (n <= 0), 0).otherwise(F.ceil(n / BYTES_PER_TOKEN)).cast("long")


def token_label(n: Column) -> Column:
    """One decimal and k from a thousand, halves away from zero."""
    return F.when(n >= 1000, F.concat(F.round(n.cast("decimal(20,4)") / 1000, 1).cast("decimal(20,1)").cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def byte_label(n: Column) -> Column:
    """P41"""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(F.round(n.cast("decimal(20,4)") / 1024, 1).cast("decimal(20,1)").cast("string"), F.lit(" KB")))


def budget_ratio(selected: Column, limit: Column) -> Column:
    """min(selected / limit, 1); 0 for a limit that is no positive number."""
    return F.when(limit > 0, F.least(selected / limit, F.lit(1.0))).otherwise(F.lit(0.0))


def strip_comments(c: Column) -> Column:
    """Block comments; // not after a colon; lines that start with #."""
    for pattern, by in COMMENTS:
        c = F.regexp_replace(c, pattern, by)
    return c


def strip_blank_lines(c: Column) -> Column:
    """P19"""
    return F.array_join(F.filter(lines(c), lambda x: js_trim(x) != ""), "\n")


def escape_xml(c: Column) -> Column:
    """P20"""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def positional_diff(path: Column, original: Column, patched: Column) -> Column:
    """Lines compared by position (no alignment)."""
    of = lambda c: F.coalesce(lines(c), F.array().cast("array<string>"))

    def one(z: Column) -> Column:  # the shorter text ends in nulls
        x, y = F.coalesce(z["x"], F.lit("")), F.coalesce(z["y"], F.lit(""))
        gone = F.when(x != "", F.array(F.concat(F.lit("- "), x))).otherwise(F.array().cast("array<string>"))
        new = F.when(y != "", F.array(F.concat(F.lit("+ "), y))).otherwise(F.array().cast("array<string>"))
        return F.when(x == y, F.array(F.concat(F.lit(" "), x))).otherwise(F.concat(gone, new))

    # each text is split once, not for each line of it
    body = F.flatten(F.transform(F.arrays_zip(of(original).alias("x"), of(patched).alias("y")), one))
    diff = F.array_join(F.concat(F.array(F.concat(F.lit("--- a/"), path), F.concat(F.lit("+++ b/"), path), F.lit("@@")), body), "\n")
    return F.when(original.isNotNull() | patched.isNotNull(), diff)


def without_space(c: Column) -> Column:
    """P22"""
    return F.regexp_replace(c, SPACE, "")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, without white space; two empty texts are equal."""
    x, y = without_space(a), without_space(b)
    n = F.greatest(F.length(x), F.length(y))
    return F.when(n == 0, F.lit(1.0)).otherwise((n - F.levenshtein(x, y)) / n)


def is_omission(c: Column) -> Column:
    """P25: a comment that says that something was left out, or three dots alone."""
    t = js_trim(c)
    comment = t.rlike(r"^(?://|#|--|<!--|/\*)") | F.endswith(t, F.lit("*/")) | F.endswith(t, F.lit("-->"))
    return (comment & t.rlike("(?i)(?:\\.\\.\\.|existing|既存|省略|rest of)")) | (t == "...")


def _mapped(token: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[token]


def _kind(rules: dict[str, Column]) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*(F.when(test, name) for name, test in rules.items()))


def _holds(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (c.rlike(p) for p in patterns))


def language_of(info: Column, path: Column, content: Column) -> Column:
    """The first of the fence's word, the path's extension and the kind of content that is known."""
    named = F.transform(F.array(F.substring_index(F.regexp_replace(info, r"\s+", " "), " ", 1), extension(path)), lambda t: _mapped(F.lower(t)))
    return F.coalesce(F.get(F.filter(named, lambda x: x.isNotNull()), F.lit(0)), _kind({k: _holds(content, p) for k, p in CONTENT_KINDS.items()}))


def reply_format(c: Column, marker: str = "ctxengine") -> Column:
    """The kind of a reply; a line that is a path counts among the first six."""
    named = F.exists(F.slice(lines(c), 1, 6), lambda x: js_trim(x).rlike(PATH_LINE))
    special = {"{marker}": F.contains(c, F.lit(marker)), "{path line}": named}
    rules = {k: reduce(lambda a, b: a & b, (special.get(p, c.rlike(p)) for p in patterns)) for k, patterns in REPLY_KINDS.items()}
    return F.when(js_trim(c) != "", F.coalesce(_kind(rules), F.lit("unknown"))).otherwise("unknown")


def path_in_line(line: Column) -> Column:
    """Of all that a line may name as a path, the surest that is one; null if none."""
    t = js_trim(line)
    every = lambda pattern: F.reverse(all_groups(t, pattern, 1))
    offered = F.concat(F.array(*(F.regexp_extract(t, p, 1) for p in PATH_LINES)), every(INLINE_CODE), every(PLAIN_PATH))
    return F.get(F.filter(F.transform(offered, js_trim), lambda p: (p != "") & valid_file_path(p)), F.lit(0))


def path_in_context(c: Column) -> Column:
    """The path that the lowest line with one names."""
    return F.try_element_at(F.filter(F.transform(lines(c), path_in_line), lambda p: p.isNotNull()), F.lit(-1))


def path_hint(info: Column, before: Column, after: Column) -> Column:
    """The first hint among the words of the fence's info, the three lines above it from below, and the last three of what follows."""
    text = lambda c: F.coalesce(c, F.lit(""))
    lowest = lambda c: F.transform(F.slice(F.reverse(lines(text(c))), 1, 3), lambda x: F.regexp_replace(js_trim(x), HINT_LABEL, ""))
    offered = F.filter(F.concat(F.split(js_trim(text(info)), r"\s+"), lowest(before), lowest(after)), lambda x: ~x.rlike(NO_HINT))
    found = F.transform(offered, lambda x: F.regexp_extract(F.concat(F.regexp_replace(x, HINT_WRAP, ""), F.lit(" ")), HINTED_PATH, 1))
    return F.get(F.filter(found, lambda p: p != ""), F.lit(0))


#: A fence: three backticks or more, a line of information, the body, and as many backticks at the start of a line before white space or the end. One that never closes takes the rest.
FENCE = r"(?<!`)(`{3,}+)(?:[^\n]*(?:\n([\s\S]*?))??(\n\1)(?=\s|\z)|[\s\S]*\z)"


def fences(c: Column) -> Column:
    """Array of (before, body) of the closed fences; before is the text since the fence above."""
    t = F.coalesce(c, F.lit(""))
    both = F.arrays_zip(all_groups(t, FENCE, 2).alias("body"), all_groups(t, FENCE, 3).alias("close"), F.split(t, FENCE).alias("before"))
    return F.transform(F.filter(both, lambda x: x["close"] != ""), lambda x: F.struct(x["before"].alias("before"), x["body"].alias("body")))


def confidence_level(score: Column) -> Column:
    """Clamped to 0..100 and rounded: high from 80, medium from 60, else low."""
    s = F.round(F.greatest(F.lit(0), F.least(F.lit(100), score)))
    return F.when(s >= 80, "high").when(s >= 60, "medium").otherwise("low")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """{{name}} by its value; an empty value leaves it."""
    for name, value in values.items():
        template = F.when(F.coalesce(value, F.lit("")) == "", template).otherwise(F.replace(template, F.lit("{{" + name + "}}"), value))
    return template


def add_unless_marked(text: Column, marker: str, more: str) -> Column:
    """P32"""
    return F.when(F.contains(text, F.lit(marker)), text).otherwise(F.concat(text, F.lit(more)))


def summary(c: Column) -> Column:
    """47 characters and three dots of what is longer than 50."""
    return F.when(F.length(c) > 50, F.concat(F.substring(c, 1, 47), F.lit("..."))).otherwise(c)


def format_message(template: str, *args: Column) -> Column:
    """{0}, {1}, ... by the arguments."""
    out = F.lit(template)
    for i, a in enumerate(args):
        out = F.replace(out, F.lit("{%d}" % i), a.cast("string"))
    return out


def branch_name(ts: Column) -> Column:
    """P40"""
    return F.concat(F.lit("patch/auto-"), F.date_format(ts, "yyyyMMdd-HHmm"))


def reason_label(reasons: Column) -> Column:
    """P42: "source NN%" of an array of (source, score), joined by commas."""
    return F.array_join(F.transform(reasons, lambda r: F.concat(r["source"], F.lit(" "), F.round(r["score"] * 100).cast("int").cast("string"), F.lit("%"))), ", ")


def longest_run(c: Column, char: str = "`") -> Column:
    """Length of the longest run of a character, 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(all_groups(c, f"{char}+", 0), F.length)), F.lit(0))


def safe_fence(longest: Column) -> Column:
    """K2: a fence longer than any run of backticks."""
    return F.when(longest > 0, F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))).otherwise(F.lit("```"))


def line_skeleton(c: Column) -> Column:
    """Signature lines and closing braces; runs of anything else inside a block become one marker.

    The fold carries (depth, last line was a marker, lines) over the lines of one text. Lines are put on in parts of
    a bounded size, as an array is copied whenever something is put on it.
    """
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("marked"), none.alias("part"), F.array().cast("array<array<string>>").alias("parts"))

    def kind(z: Column) -> Column:
        return F.struct(z["line"].alias("line"), (z["t"] == "}").alias("closes"), (z["t"].rlike(SIGNATURE) | (z["t"] == "}")).alias("kept"), F.contains(z["line"], F.lit("{")).alias("opens"))

    def step(acc: Column, z: Column) -> Column:
        depth = acc["depth"] + (z["kept"] & z["opens"]).cast("int") - z["closes"].cast("int")
        mark = ~z["kept"] & (acc["depth"] > 0) & ~acc["marked"]
        full = F.size(acc["part"]) >= PART
        part = F.when(full, none).otherwise(acc["part"])
        part = F.when(z["kept"], F.array_append(part, z["line"])).when(mark, F.array_append(part, F.lit(OMITTED))).otherwise(part)
        marked = F.when(z["kept"], z["line"] == OMITTED).when(mark, True).otherwise(acc["marked"])
        return F.struct(depth.alias("depth"), marked.alias("marked"), part.alias("part"), F.when(full, F.array_append(acc["parts"], acc["part"])).otherwise(acc["parts"]).alias("parts"))

    # what a line is, is worked out once, not wherever the fold asks for it
    trimmed = F.transform(lines(c), lambda line: F.struct(line.alias("line"), js_trim(line).alias("t")))
    return F.aggregate(F.transform(trimmed, kind), start, step, lambda acc: F.array_join(F.flatten(F.array_append(acc["parts"], acc["part"])), "\n"))


def brace_stub(c: Column) -> Column:
    """Braces over three lines or more become a stub."""
    return F.regexp_replace(c, r"\{[^}\n]*\n[^}\n]*\n[^}]*\}", STUB)
