"""Arrow-batched helper that blanks comments and string bodies and finds where blocks end.

Catalyst has no running state inside a row, so this one scan over the characters of a file is done
in Python; everything that uses its result is built from column expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.functions.languages import COMMENT_LINE

_HASH = re.compile(r"(?P<c>\#[^\n]*)|(?P<t>'''[\s\S]*?'''|\"\"\"[\s\S]*?\"\"\")|(?P<s>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")")
_SLASH = re.compile(r"(?P<c>//[^\n]*|/\*[\s\S]*?\*/)|(?P<t>`(?:\\.|[^`\\])*`)|(?P<s>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")")
_COMMENT = re.compile(COMMENT_LINE)
_NOT_NL = re.compile(r"[^\n]")
_OPEN_END = re.compile(r"^\s*(?:local\s+)?(?:def|defp|class|module|defmodule|function|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$")
_CLOSE_END = re.compile(r"^\s*end\b")
_HASH_LANGS = {"python", "ruby", "elixir", "bash"}


def mask(text: str, lang: str) -> str:
    """Same length and lines; comments become blanks, strings keep only their quotes."""

    def blank(m: re.Match) -> str:
        s = m.group(0)
        if m.lastgroup == "c":
            return _NOT_NL.sub(" ", s)
        return s[0] + _NOT_NL.sub(" ", s[1:-1]) + s[-1]

    return (_HASH if lang in _HASH_LANGS else _SLASH).sub(blank, text)


def _brace_ends(code: str) -> list[int]:
    """End line of the first block, or of the plain statement, that begins on each line.

    A brace inside brackets that open on the line, as in a destructured parameter, gives way to a later one outside them.
    """
    events: list[tuple[int, int, int]] = []  # (line, open brackets, closing line)
    stack: list[int] = []
    depth, row, before = 0, 1, [0, 0]  # before: open brackets at the start of each line
    for m in re.finditer(r"[\n{}();]", code):
        ch = m.group(0)
        if ch == "\n":
            row += 1
            before.append(depth)
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth = max(depth - 1, 0)
        elif ch == "{":
            stack.append(len(events))
            events.append((row, depth, row))
        elif ch == "}" and stack:
            i = stack.pop()
            events[i] = (*events[i][:2], row)
        elif ch == ";" and depth == 0:
            events.append((row, 0, row))
    ends, i = [], 0
    for line in range(1, row + 1):
        while i < len(events) and events[i][0] < line:
            i += 1
        j = i
        while j < len(events) and events[j][0] == line and events[j][1] > before[line]:
            j += 1
        best = j if j < len(events) and events[j][0] == line else i
        ends.append(events[best][2] if best < len(events) else line)
    return ends


def _nested_ends(levels: list[int | None]) -> list[int]:
    """Last line of the deeper-indented run after each line; None marks blank lines."""
    n = len(levels)
    ends = list(range(1, n + 1))
    stack: list[int] = []
    last = 0
    for i, level in enumerate(levels):
        if level is None:
            continue
        while stack and levels[stack[-1]] >= level:
            ends[stack.pop()] = last + 1
        stack.append(i)
        last = i
    for i in stack:
        ends[i] = last + 1
    return ends


def _keyword_ends(lines: list[str]) -> list[int]:
    ends, stack = list(range(1, len(lines) + 1)), []
    for i, line in enumerate(lines):
        if _CLOSE_END.match(line):
            if stack:
                ends[stack.pop()] = i + 1
        elif _OPEN_END.search(line) and not line.rstrip().endswith(" end"):
            stack.append(i)
    return ends


def block_ends(code: str, style: str) -> list[int]:
    if style == "brace":
        return _brace_ends(code)
    lines = code.split("\n")
    if style == "indent":
        return _nested_ends([len(s) - len(s.lstrip()) if s.strip() else None for s in lines])
    return _keyword_ends(lines)


def comments_above(text: str) -> list[int]:
    """For each line, how many comment lines stand directly above it."""
    counts, run = [], 0
    for line in text.split("\n"):
        counts.append(run)
        run = run + 1 if _COMMENT.search(line) else 0
    return counts


_RESULT = T.StructType([T.StructField("code", T.StringType()), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("above", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_RESULT)
def code_blocks(text: pd.Series, lang: pd.Series, style: pd.Series) -> pd.DataFrame:
    code = [mask(t, g) for t, g in zip(text, lang)]
    return pd.DataFrame({"code": code, "ends": [block_ends(c, s) for c, s in zip(code, style)], "above": [comments_above(t) for t in text]})


_NAME = re.compile(r"[A-Za-z_$][\w$]*\Z")
_RECEIVER = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\Z")
_STRING = re.compile(r"\"[^\"]*\"|'[^']*'|`[^`]*`")


def _brackets(text: str) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Closing place of each bracket, and the commas directly inside it, in one scan."""
    closing, commas, stack = {}, {}, []
    for i, ch in enumerate(text):
        if ch in "([{":
            stack.append(i)
            commas[i] = []
        elif ch in ")]}" and stack:
            closing[stack.pop()] = i
        elif ch == "," and stack:
            commas[stack[-1]].append(i)
    return closing, commas


def _parts(text: str, at: int, closing: dict[int, int], commas: dict[int, list[int]]) -> list[str]:
    """Trimmed pieces between the commas of the bracket at a place."""
    cuts = [at, *commas[at], closing[at]]
    return [" ".join(text[a + 1 : b].split()) for a, b in zip(cuts, cuts[1:])]


def _blanked(text: str) -> str:
    """Same length, without the contents of strings."""
    return _STRING.sub(lambda m: m[0][0] + "_" * (len(m[0]) - 2) + m[0][-1], text)


def calls(text: str) -> list[dict]:
    """Every call of a statement, nested ones included, with its receiver and arguments; brackets may nest to any depth."""
    plain = _blanked(text)
    closing, commas = _brackets(plain)
    out = []
    for at in sorted(closing):
        start = at
        while start and (plain[start - 1].isalnum() or plain[start - 1] in "_$.?"):
            start -= 1
        receiver, _, name = plain[start:at].rpartition(".")
        receiver = receiver.replace("?", "").removeprefix("this.")
        if plain[at] == "(" and _NAME.match(name):
            args = _parts(text, at, closing, commas)
            out.append({"receiver": receiver if _RECEIVER.match(receiver) else "", "name": name, "args": args if args != [""] else []})
    return out


_LAST_CALL = re.compile(r"\.(\w+)\Z")
_NOT_SUM = re.compile(r"=>|^await\b|^['\"]")


def operation(raw: str, methods: dict[str, str]) -> dict | None:
    """The outermost arithmetic of an expression: operator, both sides, and the guard of a choice."""
    plain = _blanked(raw)
    closing, commas = _brackets(plain)
    last = max((o for o, c in closing.items() if c == len(plain) - 1), default=-1)
    m = _LAST_CALL.search(plain, 0, last) if last > 0 and plain[last] == "(" else None
    if m and m[1] in methods and raw[: m.start()] not in ("", "BigDecimal"):
        return {"op": methods[m[1]], "left": raw[: m.start()], "right": _parts(raw, last, closing, commas)[0], "guard": None}
    if "=>" in plain:
        return None
    top, i = [], 0  # operators outside brackets
    while i < len(plain):
        if i in closing:
            i = closing[i]
        elif plain[i] in "?:+-*/%":
            top.append(i)
        i += 1
    ask = next((i for i in top if plain[i] == "?" and plain[i + 1 : i + 2] not in (".", "?") and plain[i - 1 : i] != "?"), None)
    other = next((i for i in top if ask is not None and i > ask and plain[i] == ":"), None)
    if ask and other:
        return {"op": "?:", "left": raw[ask + 1 : other].strip(), "right": raw[other + 1 :].strip(), "guard": " ".join(raw[:ask].split())}
    if _NOT_SUM.search(plain):
        return None
    for signs, before in (("+-", ")]\"'_$"), ("*/%", ")]_$")):
        for i in reversed(top):
            left = plain[:i].rstrip()
            if plain[i] in signs and left and (left[-1].isalnum() or left[-1] in before) and plain[i + 1 :].strip():
                return {"op": "×" if plain[i] == "*" else plain[i], "left": raw[:i].strip(), "right": raw[i + 1 :].strip(), "guard": None}
    return None


_OPERATION = T.StructType([T.StructField(n, T.StringType()) for n in ("op", "left", "right", "guard")])


def operation_udf(methods: dict[str, str]):
    @F.pandas_udf(_OPERATION)
    def run(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([operation(r, methods) or {} if r else {} for r in raw], columns=["op", "left", "right", "guard"], dtype=object)

    return run


_CALLS = T.ArrayType(T.StructType([T.StructField("receiver", T.StringType()), T.StructField("name", T.StringType()), T.StructField("args", T.ArrayType(T.StringType()))]))


@F.pandas_udf(_CALLS)
def call_list(text: pd.Series) -> pd.Series:
    return text.map(lambda t: calls(t) if t else [])


_IF = re.compile(r"(?:\}\s*)?(else\s+)?if\s*\(", re.S)
_ELSE = re.compile(r"else\b")
_ALONE = re.compile(r"import|export|const|let|var")
_LEADS = re.compile(r"(?:const|let|var|return|await|import|export|[\w.]+\s*[+\-*/]?=[^=]|[\w.]+\()")
#: Characters at the end of an open statement that tell whether it goes on.
_TAIL = 16
_OPEN_TAIL = re.compile(r"(?:=>|[=+\-*/%&|<>?:,(\[.]|\breturn)\s*$")
_CONTINUES = re.compile(r"\s*(?:[.?:+*/%&|)\]=]|-(?!-))")


def _condition(head: str) -> tuple[str | None, str]:
    """Split 'if (cond) rest' into its condition and the rest."""
    i = head.index("(")
    depth = 0
    for j in range(i, len(head)):
        depth += {"(": 1, ")": -1}.get(head[j], 0)
        if depth == 0:
            return " ".join(head[i + 1 : j].split()), head[j + 1 :].strip()
    return None, ""


def statements(text: str, code: str) -> list[tuple[int, str, str | None]]:
    """(line, statement, innermost if condition) of a brace-style file, blocks flattened.

    An open statement is not read again at each line end or brace: its first and last solid characters are carried along.
    """
    out: list[tuple[int, str, str | None]] = []
    conds: list[str | None] = []
    start, depth, last_if = 0, 0, None
    line, counted = 1, 0  # the line of the place up to which line breaks were counted
    braces: list[bool] = []  # True for a block, False for an object literal
    first, last, seen = -1, 0, 0  # first solid character of the open statement, end of the last one, place up to which was looked

    def look(end: int) -> None:
        """Move on to `end`."""
        nonlocal first, last, seen
        piece = code[seen:end]
        solid = piece.strip()
        if solid:
            last = seen + len(piece.rstrip())
            if first < 0:
                first = seen + len(piece) - len(piece.lstrip())
        seen = end

    def begin(at: int) -> None:
        nonlocal start, first, last, seen
        start = seen = last = at
        first = -1

    def emit(end: int) -> None:
        nonlocal last_if, line, counted
        raw, place = text[start:end].strip(), first if first >= 0 else end
        line, counted = line + code.count("\n", counted, place), place
        cond = conds[-1] if conds else None
        if first < 0:
            return
        if _IF.match(code, first, end):
            c, rest = _condition(raw)
            last_if = c
            if rest:
                out.append((line, rest, c))
        elif _ELSE.match(code, first, end):
            rest = raw[4:].strip()
            if rest:
                out.append((line, rest, f"!({last_if})" if last_if else cond))
        else:
            out.append((line, raw, cond))

    for m in re.finditer(r"[\n{}();\[\]]", code):
        ch, i = m.group(0), m.start()
        look(i)
        if ch in "([":
            depth += 1
        elif ch in ")]":
            depth = max(depth - 1, 0)
        elif ch == "{":
            tail = code[max(first, last - _TAIL) : last] if first >= 0 else ""
            literal = depth > 0 or bool(_OPEN_TAIL.search(tail) and not tail.endswith("=>")) or (first >= 0 and last - first <= 6 and bool(_ALONE.fullmatch(code, first, last)))
            braces.append(not literal)
            if literal:
                depth += 1
                continue
            inner = conds[-1] if conds else None
            if first >= 0 and _IF.match(code, first, i):
                last_if, _ = _condition(text[start:i].strip())
                inner = last_if
            elif first >= 0 and _ELSE.match(code, first, i):
                inner = f"!({last_if})" if last_if else inner
            conds.append(inner)
            begin(i + 1)
        elif ch == "}":
            if braces and braces.pop():
                if first >= 0:
                    emit(i)
                if conds:
                    closed = conds.pop()
                    last_if = closed if closed and not closed.startswith("!(") else last_if
                begin(i + 1)
            else:
                depth = max(depth - 1, 0)
        elif ch == ";" and depth == 0:
            emit(i)
            begin(i + 1)
        elif ch == "\n" and depth == 0 and first >= 0:
            # Without semicolons a complete line is a statement; annotations wait for what they mark.
            if not _OPEN_TAIL.search(code[max(first, last - _TAIL) : last]) and not _CONTINUES.match(code, i) and _LEADS.match(code, first, last):
                emit(i)
                begin(i + 1)
    return out


_STATEMENTS = T.ArrayType(
    T.StructType([T.StructField("line", T.LongType()), T.StructField("text", T.StringType()), T.StructField("condition", T.StringType())])
)


@F.pandas_udf(_STATEMENTS)
def statement_list(text: pd.Series, code: pd.Series) -> pd.Series:
    return pd.Series([[{"line": a, "text": b, "condition": c} for a, b, c in statements(t, k)] for t, k in zip(text, code)])
