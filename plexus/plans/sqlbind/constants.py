"""Constant text for dynamic SQL: literals, joins and format() of known variables, within limits."""

from __future__ import annotations

import re

from .tokens import SqlError, Token, tokenize

MAX_TEXT, MAX_DEPTH, MAX_ARGS, MAX_VARIABLES = 64 * 1024, 32, 64, 4096


def evaluate(tokens: list[Token], variables: dict[str, str] | None = None, dialect: str = "", source: str | None = None) -> str | None:
    """The text of a constant expression, or None if any part of it is not known."""
    try:
        value, rest = _join(tokens, variables or {}, dialect, source, 0)
    except SqlError:
        return None
    return value if value is not None and not rest and len(value.encode()) <= MAX_TEXT else None


def _join(t: list[Token], known: dict[str, str], dialect: str, source: str | None, depth: int) -> tuple[str | None, list[Token]]:
    if depth > MAX_DEPTH:
        return None, []
    value, t = _one(t, known, dialect, source, depth)
    while value is not None and t and t[0].is_("||", "+"):
        if t[0].is_("+") and dialect != "sqlserver":
            return None, []
        more, t = _one(t[1:], known, dialect, source, depth)
        value = None if more is None else value + more
    return value, t


def _one(t: list[Token], known: dict[str, str], dialect: str, source: str | None, depth: int) -> tuple[str | None, list[Token]]:
    if not t:
        return None, []
    head = t[0]
    if head.kind == "string":
        national = source is None or source[head.start : head.start + 1] in "Nn"
        return (None if dialect == "sqlserver" and not national else head.value), t[1:]
    if head.is_("("):
        value, rest = _join(t[1:], known, dialect, source, depth + 1)
        return (value, rest[1:]) if rest and rest[0].is_(")") else (None, [])
    if head.kind == "word" and head.value.lower() == "format" and dialect == "postgres" and len(t) > 1 and t[1].is_("("):
        args, rest = [], t[2:]
        while rest and len(args) <= MAX_ARGS:
            value, rest = _join(rest, known, dialect, source, depth + 1)
            args.append(value)
            if rest and rest[0].is_(","):
                rest = rest[1:]
                continue
            break
        if not rest or not rest[0].is_(")") or None in args:
            return None, []
        return format_template(args[0], args[1:]), rest[1:]
    if head.kind in ("word", "variable") and head.value.lower() in known:
        return known[head.value.lower()], t[1:]
    return None, []


def format_template(template: str, args: list[str]) -> str | None:
    """PostgreSQL's format() with %s, %I, %L, %% and positions."""
    used, bad = 0, False

    def put(m: re.Match) -> str:
        nonlocal used, bad
        if m[0] == "%%":
            return "%"
        if m[1]:
            at = int(m[1]) - 1
        else:
            at, used = used, used + 1
        if not 0 <= at < len(args):
            bad = True
            return ""
        x = args[at]
        if m[2] == "I":
            return x if re.fullmatch(r"[a-z_][a-z0-9_]*", x) else '"' + x.replace('"', '""') + '"'
        return "'" + x.replace("'", "''") + "'" if m[2] == "L" else x

    out = re.sub(r"%(?:(\d+)\$)?([sIL%])", put, template)
    return None if bad or re.search(r"%(?![sIL\d])", template.replace("%%", "")) else out


def literal(sql: str, dialect: str = "") -> str | None:
    return evaluate(tokenize(sql, dialect), {}, dialect, sql)
