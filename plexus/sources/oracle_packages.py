"""Oracle PACKAGE BODY texts, cut into their members. A member whose header is not clear is left out and noted."""

from __future__ import annotations

from dataclasses import dataclass

from ..plans.sqlbind.tokens import SqlError, Token, tokenize


@dataclass
class Member:
    name: str
    kind: str
    signature: str
    body: str


def members(source: str) -> tuple[list[Member], list[str]]:
    """(members, notes) of one package body."""
    try:
        t = tokenize(source, "oracle")
    except SqlError as e:
        return [], [f"package body was not read: {e}"]
    start = next((k for k, x in enumerate(t) if x.is_("AS", "IS")), len(t))
    out: list[Member] = []
    notes: list[str] = []
    k = start + 1
    while k < len(t):
        if not t[k].is_("PROCEDURE", "FUNCTION"):
            k += 1
            continue
        head = k
        if k + 1 >= len(t) or t[k + 1].kind not in ("word", "quoted"):
            notes.append(f"line {t[k].line}: a member without a name")
            k += 1
            continue
        name = t[k + 1].value
        at = k + 2
        types: list[str] = []
        if at < len(t) and t[at].is_("("):
            close = _closing(t, at)
            types = _types(t[at + 1 : close])
            at = close + 1
        while at < len(t) and not t[at].is_("AS", "IS", ";"):
            at += 1
        if at >= len(t) or t[at].is_(";"):
            k = at + 1  # a forward declaration
            continue
        end = _end(t, at + 1)
        if end is None:
            notes.append(f"line {t[head].line}: the end of {name} is not clear")
            k = at + 1
            continue
        out.append(Member(name, t[head].value.lower(), ",".join(types), source[t[head].start : t[end].end]))
        k = end + 1
    return out, notes


def _closing(t: list[Token], k: int) -> int:
    depth = 0
    for j in range(k, len(t)):
        depth += t[j].is_("(") - t[j].is_(")")
        if depth == 0:
            return j
    return len(t) - 1


def _types(t: list[Token]) -> list[str]:
    out, now, depth = [], [], 0
    for x in [*t, Token("op", ",", 0, 0, 0, 0)]:
        depth += x.is_("(") - x.is_(")")
        if x.is_(",") and depth == 0:
            rest = [y.value for y in now[1:] if not y.is_("IN", "OUT", "NOCOPY")]
            cut = next((j for j, y in enumerate(rest) if y.upper() in ("DEFAULT", ":=")), len(rest))
            if rest:
                out.append("".join(rest[:cut]).lower())
            now = []
        else:
            now.append(x)
    return out


def _end(t: list[Token], k: int) -> int | None:
    """The semicolon behind the END of the block that begins after ``k``; declarations may hold members of their own."""
    while k < len(t) and not t[k].is_("BEGIN"):
        if t[k].is_("PROCEDURE", "FUNCTION"):
            inner = k
            while inner < len(t) and not t[inner].is_("AS", "IS", ";"):
                inner = _closing(t, inner) + 1 if t[inner].is_("(") else inner + 1
            if inner < len(t) and not t[inner].is_(";"):
                last = _end(t, inner + 1)
                if last is None:
                    return None
                k = last
        k += 1
    depth = 0
    while k < len(t):
        if t[k].is_("BEGIN", "CASE", "LOOP") or (t[k].is_("IF") and not t[k - 1].is_("END")):
            if not t[k - 1].is_("END"):
                depth += 1
        elif t[k].is_("END"):
            depth -= 1
            if depth == 0:
                while k < len(t) and not t[k].is_(";"):
                    k += 1
                return k if k < len(t) else None
        k += 1
    return None
