"""Replies to patches: fence blocks, candidates, targets, healing of omissions, plans."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import base_name
from ..functions.text import OMISSION_MARK, all_groups, confidence_level, fences, js_trim, language_of, path_hint, path_in_context, positional_diff
from .search import ends

RESTORED = T.StructType([T.StructField("code", T.StringType()), T.StructField("diff_ratio", T.DoubleType()), T.StructField("error", T.StringType())])
FUZZY = 0.8


def parse_reply(replies: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, path, code): blocks by the path named between them; blocks of one path are joined by an omission mark."""
    one = replies.select(*keys, F.posexplode(fences(F.col(text_col))).alias("i", "b"))
    named = one.select(*keys, "i", path_in_context(F.col("b.before")).alias("path"), js_trim(F.col("b.body")).alias("code"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "code"))), lambda x: x["code"]), OMISSION_MARK)
    return named.where("path is not null").groupBy(*keys, "path").agg(joined.alias("code"))


def candidates(replies: DataFrame, keys: list[str], text_col: str = "text", around: int = 200) -> DataFrame:
    """(keys, i, source, path_hint, language, content): a row for each file of a diff, else for each fence, else the whole text."""
    t = F.col(text_col)
    is_diff = t.rlike(r"(?m)^---\s+a/|^\+\+\+\s+b/|^@@\s+-\d+,\d+")
    # the fences of a text and what stands between them are columns, so that they are looked for once and not for each fence
    fence = r"```[^\n]*\n[\s\S]*?\n```"
    found = replies.where(t.isNotNull() & (js_trim(t) != "")).select(*keys, t.alias("_text"), is_diff.alias("_is_diff"))
    t = F.col("_text")
    found = found.select("*", F.when(~F.col("_is_diff"), all_groups(t, fence, 0)).alias("_fences"), F.when(~F.col("_is_diff"), F.split(t, fence)).alias("_between"))

    def fenced(f: Column, i: Column) -> Column:
        info = F.substring_index(F.substr(f, F.lit(4)), "\n", 1)
        body = F.substr(f, F.length(info) + 5, F.length(f) - F.length(info) - 8)
        hint = path_hint(js_trim(info), F.right(F.get("_between", i), F.lit(around)), F.left(F.get("_between", i + 1), F.lit(around)))
        return F.struct(F.lit("fencedCodeBlock").alias("source"), hint.alias("path_hint"), js_trim(info).alias("info"), js_trim(body).alias("content"))

    cut = F.filter(F.split(t, r"(?m)(?=^---\s+a/[^\n]+\n\+\+\+\s+b/)"), lambda c: c.rlike(r"^---\s+a/[^\n]+\n\+\+\+\s+b/"))
    files = F.transform(cut, lambda c: F.struct(F.lit("unifiedDiff").alias("source"), F.regexp_replace(F.regexp_extract(c, r"^---[^\n]*\n\+\+\+\s+b/([^\n]+)", 1), "^[ab]/", "").alias("path_hint"), F.lit(None).cast("string").alias("info"), js_trim(c).alias("content")))
    whole = lambda s: F.array(F.struct(F.lit(s).alias("source"), F.lit(None).cast("string").alias("path_hint"), F.lit(None).cast("string").alias("info"), js_trim(t).alias("content")))
    chosen = F.when(F.col("_is_diff"), F.when(F.size(files) > 0, files).otherwise(whole("unifiedDiff"))).when(F.size("_fences") > 0, F.transform("_fences", fenced)).otherwise(whole("plainCode"))
    rows = found.select(*keys, F.posexplode(chosen).alias("i", "c")).select(*keys, "i", "c.*")
    return rows.withColumn("language", F.when(F.col("source") == "fencedCodeBlock", language_of(F.col("info"), F.col("path_hint"), F.col("content")))).drop("info")


def resolve_targets(hints: DataFrame, files: DataFrame, recent: DataFrame) -> DataFrame:
    """(hint_id, target, confidence): the same path 80, the first path that ends with the hint 60, with up to 20 more if it is recent; else the most recent file 40.

    hints (hint_id, path_hint), files (path, ord), recent (path, rank from 0, a short list). A suffix has the hint's
    last segment at the end of its own last segment, so the join is on that segment's suffixes.
    """
    h = hints.where("path_hint is not null and path_hint <> ''").select("hint_id", "path_hint", base_name(F.col("path_hint")).alias("last"), F.contains("path_hint", F.lit("/")).alias("deep"))
    f = files.select("path", "ord", base_name(F.col("path")).alias("name"))
    whole = h.join(f, F.col("last") == F.col("name"))
    tails = ends(f, "name", h.where("not deep"), "last")
    part = h.where("not deep").join(tails, F.col("last") == F.col("tail")).drop("tail")
    hits = whole.unionByName(part).where(F.endswith("path", "path_hint")).withColumn("base", F.when(F.col("path") == F.col("path_hint"), 80).otherwise(60))
    best = hits.groupBy("hint_id").agg(F.min(F.struct((-F.col("base")).alias("neg"), "ord", "path")).alias("b")).select("hint_id", F.col("b.path").alias("path"), (-F.col("b.neg")).alias("base"))
    scored = best.join(recent.select("path", "rank"), "path", "left").select("hint_id", "path", (F.col("base") + F.when(F.col("rank").isNotNull(), F.greatest(20 - 2 * F.col("rank"), F.lit(5))).otherwise(0)).alias("confidence"))
    fallback = F.broadcast(recent.where("rank = 0").select(F.col("path").alias("first")))
    out = hints.select("hint_id").join(scored, "hint_id", "left").join(fallback, how="left")
    target = F.coalesce("path", "first")
    return out.select("hint_id", target.alias("target"), F.least(F.lit(100), F.when(F.col("path").isNotNull(), F.col("confidence")).when(target.isNotNull(), 40).otherwise(0)).cast("int").alias("confidence"))


class _Lines:
    """A text's lines, their forms without white space in lower case, where each form stands, and which lines are omission marks."""

    def __init__(self, text: str):
        self.lines = text.replace("\r\n", "\n").split("\n")
        self.forms = ["".join(x.split()).lower() for x in self.lines]
        self.places: dict[str, list[int]] = {}
        for k, form in enumerate(self.forms):
            self.places.setdefault(form, []).append(k)
        self.marks = [_MARK.search(x.strip().lower()) is not None for x in self.lines]
        self._exact: list[tuple[str, int]] | None = None

    @property
    def exact(self) -> list[tuple[str, int]]:
        """The lines without white space, with the letters that each has."""
        if self._exact is None:
            self._exact = [(x, _letters(x)) for x in ("".join(line.split()) for line in self.lines)]
        return self._exact

    def first(self, form: str, low: int, past: int | None = None) -> int | None:
        """The first place of a form from low on, before past."""
        found = self.places.get(form, [])
        i = bisect_left(found, low)
        return found[i] if i < len(found) and (past is None or found[i] < past) else None

    def nearest(self, line: str, low: int) -> int | None:
        """The place from low on whose line is most like a line, the first of equals, if it is like enough.

        A line whose length, or whose kinds of letters, differ by more than the edits allowed is no candidate; nor is one that could only equal the best so far.
        """
        want = "".join(line.split())
        letters, masks, best, place = _letters(want), _masks(want), 0.0, None
        for k in range(low, len(self.lines)):
            text, mine = self.exact[k]
            n = max(len(want), len(text))
            most = n - math.ceil(FUZZY * n - 1e-9)
            if abs(len(want) - len(text)) > most or (letters & ~mine).bit_count() > most or (mine & ~letters).bit_count() > most:
                continue
            if best and (n - abs(len(want) - len(text))) / n <= best:
                continue
            score = (n - _edits(masks, len(want), text)) / n if n else 1.0
            if score >= FUZZY and score > best:
                best, place = score, k
                if score == 1:
                    break
        return place


# A comment that says that something was left out, or three dots alone.
_MARK = re.compile(r"^\.\.\.$|^(?=//|#|--|<!--|/\*|.*(?:\*/|-->)$).*(?:\.\.\.|existing|既存|省略|rest of)")
#: How far a line may stand behind the last one that was found, outside gaps.
REACH = 5
#: Letters that a line needs to be found by likeness.
LEAST = 4


def _letters(text: str) -> int:
    """The kinds of letters of a text, in 64 classes, as bits: a class that only one of two texts has takes an edit."""
    out = 0
    for c in set(text):
        out |= 1 << (ord(c) & 63)
    return out


def _masks(text: str) -> dict[str, int]:
    """Where each letter of a text stands, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _edits(masks: dict[str, int], length: int, other: str) -> int:
    """The edit distance of a text, given by its masks, to another: a column of the table of distances is two numbers, whose bits say
    where it rises and falls, so a letter of the other text takes a few operations on whole columns."""
    if not length:
        return len(other)
    every, last = (1 << length) - 1, 1 << (length - 1)
    up, down, distance = every, 0, length
    for c in other:
        here = masks.get(c, 0)
        turn = (((here & up) + up) ^ up) | here | down
        right, left = down | ~(turn | up) & every, up & turn
        if right & last:
            distance += 1
        elif left & last:
            distance -= 1
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(turn | right)) & every, right & turn & every
    return distance


def _anchor(old: _Lines, new: _Lines, mark: int, at: int) -> tuple[int, int] | None:
    """(line of new, its place in old) at which a gap that starts with a mark ends.

    Each later line is a row of a table: whether it stands in old as it is, which line it is, and where. The
    first row of the best kind is taken; a place that leaves something to restore is better than none.
    """
    lines = [j for j in range(mark + 1, len(new.lines)) if new.forms[j] and not new.marks[j]]
    same = ((j, next((k for k in (old.first(new.forms[j], at + 1), old.first(new.forms[j], at, at + 1)) if k is not None), None)) for j in lines)
    like = ((j, old.nearest(new.lines[j], at)) for j in lines if len(new.forms[j]) >= LEAST)
    return next(((j, k) for table in (same, like) for j, k in table if k is not None), None)


def heal_text(original: str, patched: str) -> tuple[str | None, float | None, str | None]:
    """(code, diff ratio, error): the patched text with what its omission marks stand for put back from the original.

    The marks cut the patched text into stretches. A stretch keeps its lines, in the original's form where
    one stands close behind; between two stretches comes what the original has up to the anchor.
    """
    old, new = _Lines(original), _Lines(patched)
    out: list[str] = []
    at = done = 0  # what is used of old, and of new

    def stretch(past: int) -> None:
        nonlocal at
        for j in range(done, past):
            k = old.first(new.forms[j], at, at + REACH) if new.forms[j] else None
            out.append(new.lines[j] if k is None else old.lines[k])
            at = at if k is None else k + 1

    marks = [m for m, is_mark in enumerate(new.marks) if is_mark]
    for m in marks:
        if m < done:  # inside a gap that an earlier mark opened
            continue
        stretch(m)
        done = m + 1
        anchor = _anchor(old, new, m, at)
        if anchor is None and m == marks[-1]:
            out += old.lines[at:]
            at = len(old.lines)
        elif anchor is None:
            named = [x for x, is_mark in zip(new.lines[m + 1 :], new.marks[m + 1 :], strict=True) if not is_mark]
            return None, None, f"Anchor line not found: {named[0] if named and named[0] else 'End of file'}"
        else:
            j, k = anchor
            out += old.lines[at:k]
            for x in (x for x, is_mark in zip(new.lines[m + 1 : j], new.marks[m + 1 : j], strict=True) if not is_mark):
                if x.strip() or not out or out[-1].strip():  # no second blank line
                    out.append(x)
            found = old.lines[k]
            out.append(found if old.forms[k] == new.forms[j] else found[: len(found) - len(found.lstrip())] + new.lines[j].lstrip())
            at, done = k + 1, j + 1
    stretch(len(new.lines))
    return "\n".join(out), abs(len(old.lines) - len(out)) / len(old.lines), None


@F.pandas_udf(RESTORED)
def _heal(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for original, patched in batches:
        rows = [heal_text(a or "", b or "") for a, b in zip(original, patched, strict=True)]
        yield pd.DataFrame(rows, columns=["code", "diff_ratio", "error"])


def heal(original: Column, patched: Column) -> Column:
    """Struct (code, diff_ratio, error). The alignment of a text is sequential, so it is a vectorised function of one row."""
    return _heal(original, patched)


def legacy_plans(patches: DataFrame, originals: DataFrame, unsafe: float = 0.3) -> DataFrame:
    """Patches (path, code) healed against originals (path, text), the code as it is where that fails; with diff and a warning."""
    joined = patches.join(originals.select("path", F.coalesce("text", F.lit("")).alias("original")), "path", "left").withColumn("original", F.coalesce("original", F.lit("")))
    healed = joined.withColumn("h", heal(F.col("original"), F.col("code")))
    patched = F.coalesce(F.col("h.code"), F.col("code"))
    return healed.select(*patches.columns, patched.alias("patched"), F.col("h.diff_ratio").alias("diff_ratio"), (F.coalesce(F.col("h.diff_ratio"), F.lit(0.0)) >= unsafe).alias("unsafe"), positional_diff(F.col("path"), F.col("original"), patched).alias("diff"))


def smart_plans(found: DataFrame, targets: DataFrame, originals: DataFrame) -> DataFrame:
    """candidates() with hint_id, their targets, and the originals (path, text): (hint_id, target, confidence, level, diff)."""
    joined = found.join(targets, "hint_id").join(originals.select(F.col("path").alias("target"), F.col("text").alias("original")), "target", "left")
    score = F.least(F.lit(100), F.col("confidence") + F.when(F.col("target").isNotNull(), 10).otherwise(0))
    return joined.select("hint_id", "target", score.alias("confidence"), confidence_level(score).alias("level"), positional_diff(F.coalesce("target", F.lit("")), F.coalesce("original", F.lit("")), F.col("content")).alias("diff"))


def apply_patches(files: DataFrame, patches: DataFrame) -> DataFrame:
    """Files (path, text) after patches (path, code): a document is replaced as a whole, or created; with what happened to it."""
    joined = files.select("path", "text", F.lit(True).alias("_there")).join(patches.select("path", "code"), "path", "full")
    action = F.when(F.col("code").isNull(), "kept").when(F.col("_there"), "replaced").otherwise("created")
    return joined.select("path", F.coalesce("code", "text").alias("text"), action.alias("action"))
