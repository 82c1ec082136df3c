"""SQL tokens."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    """kind: word, quoted, string, number, op, variable. ``value`` is the name or text without its quotes."""

    kind: str
    value: str
    line: int
    col: int
    start: int
    end: int

    def is_(self, *words: str) -> bool:
        return (self.kind == "word" and self.value.upper() in words) or (self.kind == "op" and self.value in words)


class SqlError(ValueError):
    """The text is not SQL that this parser reads."""


_PATTERN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)
    |(?P<dollar>\$(?P<tag>[A-Za-z_]*)\$(?:.*?)\$(?P=tag)\$)
    |(?P<string>[EeNnBbXx]?'(?:[^']|'')*')
    |(?P<dquote>"(?:[^"]|"")*")
    |(?P<back>`(?:[^`]|``)*`)
    |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    |(?P<variable>[@:$](?=[A-Za-z_0-9@])[@A-Za-z_0-9]+|\?)
    |(?P<word>[^\W\d][\w$#]*|\#{1,2}\w+)
    |(?P<op>::|\|\||:=|<=|>=|<>|!=|->>|->|=>|[-+*/%^=<>(),.;\[\]{}!~&|:@#])""",
    re.S | re.X,
)


def tokenize(sql: str, dialect: str = "") -> list[Token]:
    """Tokens with their places; ``"x"`` is a name except in MySQL, ``[x]`` is a name in SQL Server and SQLite."""
    out: list[Token] = []
    at, line, begin = 0, 1, 0
    brackets = dialect in ("sqlserver", "sqlite")
    while at < len(sql):
        if brackets and sql[at] == "[" and (close := sql.find("]", at)) > 0:
            kind, value, end = "quoted", sql[at + 1 : close], close + 1
        else:
            m = _PATTERN.match(sql, at)
            if not m:
                raise SqlError(f"line {line}: unexpected {sql[at]!r}")
            kind, text, end = m.lastgroup or "", m[0], m.end()
            kind = "dollar" if kind == "tag" else kind
            if kind == "string":
                kind, value = "string", text[text.index("'") + 1 : -1].replace("''", "'")
            elif kind == "dollar":
                kind, value = "string", text[len(m["tag"]) + 2 : -len(m["tag"]) - 2]
            elif kind == "dquote":
                kind, value = ("string" if dialect == "mysql" else "quoted"), text[1:-1].replace('""', '"')
            elif kind == "back":
                kind, value = "quoted", text[1:-1].replace("``", "`")
            else:
                value = text
        if kind != "space":
            out.append(Token(kind, value, line, at - begin + 1, at, end))
        if (n := sql.count("\n", at, end)):
            line, begin = line + n, sql.rindex("\n", at, end) + 1
        at = end
    return out


def statements(tokens: list[Token]) -> list[list[Token]]:
    """Split at semicolons outside parentheses."""
    out, now, depth = [], [], 0
    for t in tokens:
        depth += t.is_("(") - t.is_(")")
        if depth <= 0 and t.is_(";"):
            out.append(now)
            now = []
        else:
            now.append(t)
    return [s for s in [*out, now] if s]
