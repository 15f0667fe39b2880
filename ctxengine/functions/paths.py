"""Path functions and predicates as Column expressions; all stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: White space as text editors trim it, in a class that Java and RE2 read alike.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# Directories, extensions and file names with a meaning of their own.
EXCLUDED_DIRS = ["node_modules", ".git", "dist", "out", "build", "coverage", ".idea", ".vscode"]
EXCLUDED_EXTENSIONS = ["exe", "dll", "so", "dylib", "obj", "o", "a", "lib", "pyc", "class", "jar", "war", "ear", "log", "tmp", "temp", "swp", "swo", "bak", "old", "js.map", "d.ts.map"]
SPECIAL_FILES = ["dockerfile", "makefile", "license", "readme", "package.json", "package-lock.json", "tsconfig.json", "jsconfig.json", "vitest.config.ts", "jest.config.js", "vite.config.ts", ".env", ".gitignore", ".eslintrc", ".prettierrc"]
TEST_SUFFIXES = ["_test.py", "_spec.py", "_test.go", ".rs", "test.rs", "test.java", "test.kt", "test.scala", "test.groovy", "_test.cc", "_test.cpp", "_test.rb", "_spec.rb", "test.php", "tests.swift", ".tests.cs", "_test.exs"]
TEST_FILE = r"(?i)\.(?:test|spec)\.[a-z]+\z"
DOCUMENT = r"(?i)\.(?:md|markdown|mdx|rst|txt)\z"
MARKDOWN = r"(?i)\.(?:md|markdown|mdx)\z"
LONGEST_PATTERN = 500


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+\\z", "")


def fold_separators(c: Column) -> Column:
    """P1"""
    return F.translate(c, "\\", "/")


def available_path(c: Column) -> Column:
    """P2"""
    return F.regexp_replace(fold_separators(c), r"^\./", "")


def absolute_path(c: Column) -> Column:
    """Forward slashes, a lower-case drive letter, no slash at the end beyond three characters."""
    p = fold_separators(c)
    p = F.when(p.rlike(r"^[A-Za-z]:"), F.concat(F.lower(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))).otherwise(p)
    return F.when((F.length(p) > 3) & F.endswith(p, F.lit("/")), F.substr(p, F.lit(1), F.length(p) - 1)).otherwise(p)


def parent(c: Column) -> Column:
    """P5: what stands before the last slash, else empty."""
    return F.regexp_replace(c, r"/?[^/]*\z", "")


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    """P8"""
    return F.regexp_replace(base_name(c), r"\.[^.]+\z", "")


def extension(c: Column) -> Column:
    return F.lower(F.element_at(F.split(c, r"\."), -1))


def fold_dots(c: Column) -> Column:
    """A relative path without "." and "..", but for ".." that leave the root."""
    none = F.array().cast("array<string>")
    return F.array_join(
        F.aggregate(
            F.split(c, "/"),
            none,
            lambda acc, x: F.when((x == "") | (x == "."), acc)
            .when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, 1, F.size(acc) - 1))
            .otherwise(F.array_append(acc, x)),
        ),
        "/",
    )


def inside_root(c: Column) -> Column:
    """a folded relative path that stays inside its root."""
    return (c != "..") & ~F.startswith(c, F.lit("../")) & ~F.startswith(c, F.lit("/")) & ~c.rlike(r"^[A-Za-z]:")


def relative_to(root: Column, target: Column) -> Column:
    """Target below root, else target as it is."""
    a, b = absolute_path(root), absolute_path(target)
    return F.when(a == b, "").when(F.startswith(b, F.concat(a, F.lit("/"))), F.substr(b, F.length(a) + 2)).otherwise(b)


def resolve_link(source: Column, target: Column) -> Column:
    """The path that a link in source points to; null for anchors, rooted and external targets, bad escapes and paths out of the root."""
    outside = F.startswith(target, F.lit("#")) | F.startswith(target, F.lit("/")) | target.rlike(r"^[A-Za-z][A-Za-z\d+.-]*:")
    bare = F.replace(F.regexp_replace(target, r"(?s)[?#].*\z", ""), F.lit("+"), F.lit("%2B"))
    folded = fold_dots(F.concat_ws("/", parent(fold_separators(source)), fold_separators(F.try_url_decode(bare))))
    return F.when(~outside & (target != "") & F.try_url_decode(bare).isNotNull() & inside_root(folded), folded)


def resolve_import(source: Column, target: Column) -> Column:
    """A relative import of source; ".." that would leave the root are dropped."""
    folded = fold_dots(F.concat_ws("/", parent(source), target))
    return F.nullif(F.regexp_replace(folded, r"^(?:\.\./)+|^\.\.\z", ""), F.lit(""))


def any_ends_with(c: Column, endings: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.endswith(c, F.lit(e)) for e in endings), F.lit(False))


def parse_extensions(text: str) -> list[str]:
    """"ts, .md" as [".ts", ".md"]."""
    parts = (p.strip() for p in text.split(","))
    return list(dict.fromkeys(p if p.startswith(".") else f".{p}" for p in parts if p))


def ignore_pattern(lines: list[str]) -> str | None:
    """One alternation for the lines of an ignore file; blank lines, comments and negations are left out."""
    kept = [x.strip() for x in lines]
    kept = [x.strip("/") for x in kept if x and x[0] not in "#!"]
    one = ["".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in x) for x in kept]
    return f"(?:^|/)(?:{'|'.join(one)})(?:/|\\z)" if one else None


def exclude_literal(pattern: str) -> str:
    """a literal with * for anything inside a segment, bounded by slashes."""
    return f"(?:^|/){'[^/]*'.join(map(re.escape, pattern.split('*')))}(?:/|\\z)"


def user_pattern(pattern: str) -> str | None:
    """the user's own expression; None (never matches) if it is too long or not valid."""
    if len(pattern) > LONGEST_PATTERN:
        return None
    try:  # by the engine that will run it
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return None
    return pattern


def matches(c: Column, pattern: str | None) -> Column:
    return c.rlike(pattern) if pattern else F.lit(False)


def excluded_by(c: Column, pattern: str) -> Column:
    """with ** a glob over segments, else a part of the path."""
    p = fold_separators(c)
    if "**" not in pattern:
        return F.contains(p, F.lit(pattern))
    body = re.sub(r"\\\*\\\*|\\\*", lambda m: ".*" if len(m[0]) == 4 else "[^/]*", re.escape(pattern.replace("**/", "")))
    return p.rlike(f"(?:^|/){body}(?:/|\\z)")


def is_special(name: Column) -> Column:
    return F.lower(name).isin(SPECIAL_FILES) | F.contains(F.lower(name), F.lit(".config."))


def is_test_file(name: Column) -> Column:
    return name.rlike(TEST_FILE) | any_ends_with(F.lower(name), TEST_SUFFIXES)


def valid_path(c: Column, least: int = 2, dirs: list[str] = EXCLUDED_DIRS, extensions: list[str] = EXCLUDED_EXTENSIONS, special: bool = True) -> Column:
    """F8: whether a string looks like the path of a file worth reading."""
    given = F.element_at(F.split(c, r"[\\/]"), -1)
    basic = (F.length(c) >= max(1, least)) & ~c.rlike(r"^[\d.]+\z") & ~c.rlike(r"[<>|&;()]") & (~given.rlike(r"^[A-Z0-9_]+\z") | is_special(given))
    low = F.lower(fold_separators(c))
    name = base_name(low)
    banned = F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, dirs)))
    bad_extension = F.contains(name, F.lit(".")) & ~F.startswith(name, F.lit(".")) & extension(name).isin(extensions)
    allowed = name.rlike(r"\.[a-z0-9]+\z") | F.startswith(name, F.lit("."))
    return basic & ~banned & (is_test_file(name) | (~bad_extension & ((is_special(name) | allowed) if special else allowed)))


def valid_file_path(c: Column) -> Column:
    """F9"""
    dotted = F.contains(c, F.lit("."))
    return F.when(F.contains(F.lower(c), F.lit("node_modules/@types")), dotted).otherwise(valid_path(c, 1) & (dotted | is_special(c)))


def ancestors(c: Column) -> Column:
    """All proper prefixes of a path, with "" for the root, as an array."""
    parts = F.split(c, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def icon(is_directory: Column, is_modified: Column) -> Column:
    """P39"""
    return F.when(is_directory, "folder").when(is_modified, "modifiedFile").otherwise("file")
