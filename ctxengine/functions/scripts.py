"""Skeletons of scripts by their syntax.

A small lexer runs over each text in the workers, in Arrow batches: strings, template literals with
the expressions nested in them, comments and regular expressions are told apart, and a stack of open brackets
knows what each brace opens. The block bodies of function declarations, methods and arrow functions become a stub; function expressions,
constructors and accessors keep theirs, with the bodies inside them replaced. Of nested bodies the outermost is replaced.

Defined results: a null text is null, one of white space only is empty, a text without such a body is as it was; a body that is never closed
stays. Time is linear in the text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from .text import STUB

_TOKEN = re.compile(r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>'(?:\\[\s\S]|[^'\\\n])*'?|"(?:\\[\s\S]|[^"\\\n])*"?)|(?P<word>[@#]?[\w$]+)|(?P<arrow>=>)|(?P<mark>[\s\S])""")
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_TEMPLATE_TEXT = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*")
#: Words after which an expression begins, so that a brace is an object and a slash a regular expression.
_BEFORE_VALUE = frozenset("return typeof case in of new delete void throw await yield instanceof default extends".split())
#: Words before parentheses that name no method of an object.
_NO_NAME = frozenset("if for while switch catch with return function typeof await super new do else".split())
_OPERATORS = frozenset("=([,:?&|+-*%!~^<>") | {"=>"}
#: A return type goes on behind these, so a brace opens a type and no body.
_IN_TYPE = frozenset(":|&<,")


class _Level:
    """An open bracket and what has been read inside it since the last statement or member began."""

    __slots__ = ("kind", "start", "cut", "whose", "params", "prev", "before", "is_class", "function", "assigned", "typed", "words")

    def __init__(self, kind: str, start: int = 0, cut: bool = False, whose: str | None = None):
        self.kind, self.start, self.cut, self.whose = kind, start, cut, whose  # whose parameters a parenthesis holds
        self.prev: str | None = None
        self.before: str | None = None  # the token before prev
        self.fresh()

    def fresh(self) -> None:
        self.is_class, self.function, self.assigned, self.typed = False, None, False, False
        self.words: list[str] = []
        self.params: str | None = None  # whose parameters have just been closed here


def _whose(level: _Level) -> str | None:
    """Whose parameters a parenthesis holds: those of a declaration, method or another function, or none's."""
    if level.function:
        return level.function
    prev, words = level.prev, level.words
    if level.kind not in ("class", "object") or level.assigned or level.typed or not prev or prev.startswith("@"):
        return None
    if not (prev[-1].isalnum() or prev[-1] in "_$'\"]>?") or (level.kind == "object" and prev in _NO_NAME):
        return None
    if level.kind == "class" and prev == "constructor" or len(words) > 1 and words[-2] in ("get", "set"):
        return "other"
    return "method"


def _opens(level: _Level) -> tuple[str, bool]:
    """What a brace opens inside level: its kind, and whether it is a body that is replaced."""
    prev = level.prev
    if prev == "=>":
        is_type = "type" in level.words[:2] or (level.kind == "class" and level.typed and not level.assigned)
        return ("object", False) if is_type else ("block", True)
    if level.params and prev not in _IN_TYPE:
        return "block", level.params in ("declaration", "method")
    if level.is_class:
        return "class", False
    if prev and (prev in _OPERATORS or prev in _BEFORE_VALUE):
        return "object", False
    return "block", False


def body_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the outermost bodies that are replaced."""
    spans: list[tuple[int, int]] = []
    stack = [_Level("block")]
    at, n, line_broken, inside = 0, len(text), False, 0
    while at < n:
        level = stack[-1]
        if level.kind == "`":
            at = _TEMPLATE_TEXT.match(text, at).end()
            if at >= n:
                break
            if text[at] == "`":
                stack.pop()
                stack[-1].prev = "'"  # a value
                at += 1
            else:
                stack.append(_Level("${"))
                at += 2
            continue
        m = _TOKEN.match(text, at)
        kind, token, begin, at = m.lastgroup, m.group(), at, m.end()
        if kind in ("space", "comment"):
            line_broken |= "\n" in token
            continue
        prev = level.prev
        if token == "/" and (prev is None or prev in _OPERATORS or prev in ("{", "}", ";") or prev in _BEFORE_VALUE):
            regex = _REGEX.match(text, begin)
            if regex:
                at, token = regex.end(), "'"
        if kind == "word":
            if line_broken and level.kind == "class" and prev and prev not in _OPERATORS:
                level.fresh()  # a field without a semicolon ends with its line
            if token == "class" and prev != ".":
                level.is_class = True
            elif token == "function" and prev != ".":
                left = level.before if prev == "async" else prev
                value = left is not None and (left in _OPERATORS or left in _BEFORE_VALUE - {"default"})
                level.function = "other" if value or level.kind != "block" else "declaration"
            level.words.append(token)
        elif token == "(":
            stack.append(_Level("(", begin, whose=_whose(level)))
        elif token == "[":
            stack.append(_Level("["))
        elif token == "{":
            opened, cut = _opens(level)
            stack.append(_Level(opened, begin, cut))
            inside += cut
        elif token == "`":
            stack.append(_Level("`"))
        elif token in ")]}" and len(stack) > 1:
            closed = stack.pop()
            level = stack[-1]
            if closed.kind == "(":
                level.params, level.function = closed.whose, None
            elif closed.cut:
                inside -= 1
                if not inside:
                    spans.append((closed.start, at))
            if token == "}" and closed.kind in ("block", "class") and level.prev != "=>":
                level.fresh()
            if closed.kind == "${":
                line_broken = False
                continue
        elif token == ";" or (token == "," and level.kind == "object"):
            level.fresh()
        elif token == "=":
            level.assigned = True
        elif token == ":":
            level.typed = True
        level.before, level.prev, line_broken = prev, token, False
    return sorted(spans)


def skeleton(text: str) -> str:
    if not text.strip():
        return ""
    for start, end in reversed(body_spans(text)):  # from the end, so that what lies before keeps its place
        text = text[:start] + STUB + text[end:]
    return text


def script_stub(c: Column) -> Column:
    """Block bodies of function declarations, methods and arrow functions as stubs."""

    @pandas_udf("string")
    def stubs(texts: pd.Series) -> pd.Series:
        return texts.map(skeleton, na_action="ignore")

    return stubs(c)
