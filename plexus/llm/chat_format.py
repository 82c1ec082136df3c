"""Chat formatting with a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and the tree becomes Python
closures. A rendering is a stream of (text, under the loss mask) pieces, so memory follows one turn and not one
conversation; ``read_turns`` reads turns and loss text back from such a stream.

The language: ``{{ expr }}``, ``{% for x in xs %}``, ``{% if %}``/``{% elif %}``/``{% else %}``, ``{% set x = expr %}``,
``{% generation %}`` (its output is under the loss mask), ``{# comment #}``; expressions have literals, names, ``a.b`` and
``a['b']`` (keys of mappings only, never attributes of objects), ``loop.first``/``last``/``index``, ``~`` (joins text),
``== != in``, ``and or not``, ``x if c else y`` and the filters of FILTERS. There are no calls and no Python names.

Control strings inside texts are escaped reversibly: every ``<``, n backslashes, ``|`` gets one backslash more.

Defined results: a null text or role counts as empty; rows without a conv_id form one conversation with a null id; turns go
by (turn, role, text) with nulls first, so ties and repeated rows have one order; a conversation without rows does not exist,
so an empty table gives an empty result; extra columns are left behind.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: The template that the query uses. Fixed text.
CHATML = (
    "{% for m in messages %}{{ '<|im_start|>' ~ (m.role | escape_role) ~ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '<|im_end|>' ~ '\\n' }}{% endfor %}"
)
START, END = "<|im_start|>", "<|im_end|>\n"

Piece = tuple[str, bool]


class TemplateError(ValueError):
    """The template is not in the language, or asks for something outside the sandbox."""


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """As ``escape``; a line end becomes a control string of its own, so that a role stays on one line."""
    return escape(role).replace("\n", "<|nl|>")


def unescape_role(role: str) -> str:
    return unescape(role.replace("<|nl|>", "\n"))


FILTERS: dict[str, Callable[[object], object]] = {
    "escape": lambda x: escape(_text(x)),
    "escape_role": lambda x: escape_role(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": len,
}


def _text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


# -- parsing ---------------------------------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[|~.\[\]()]))""")


def parse(source: str) -> tuple:
    """The syntax tree: nested tuples whose first item names the node."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        parts += [("text", source[at : m.start()])] if m.start() > at else []
        parts += [("expr", m[1])] if m[1] is not None else [("tag", m[2].strip())] if m[2] is not None else []
        at = m.end()
    parts += [("text", source[at:])] if at < len(source) else []
    body, rest, stop = _block(parts, ())
    if stop:
        raise TemplateError(f"{stop!r} closes nothing")
    return body


def _block(parts: list, until: tuple[str, ...]) -> tuple[tuple, list, str]:
    out: list[tuple] = []
    while parts:
        (kind, value), parts = parts[0], parts[1:]
        if kind == "text":
            out.append(("emit", ("const", value)))
        elif kind == "expr":
            out.append(("emit", _expression(value)))
        else:
            word, _, rest = value.partition(" ")
            if word in until:
                return ("seq", *out), parts, value
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*) in (.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"for what: {value!r}")
                body, parts, _ = _closed(parts, ("endfor",), value)
                out.append(("for", m[1], _expression(m[2]), body))
            elif word == "if":
                out.append(_branches(rest, parts))
                parts = out[-1][-1]
                out[-1] = out[-1][:-1]
            elif word == "set":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"set what: {value!r}")
                out.append(("set", m[1], _expression(m[2])))
            elif word == "generation":
                body, parts, _ = _closed(parts, ("endgeneration",), value)
                out.append(("generation", body))
            else:
                raise TemplateError(f"no such tag: {value!r}")
    return ("seq", *out), parts, ""


def _closed(parts: list, until: tuple[str, ...], opened: str) -> tuple[tuple, list, str]:
    body, parts, stop = _block(parts, until)
    if not stop:
        raise TemplateError(f"{opened!r} is never closed")
    return body, parts, stop


def _branches(condition: str, parts: list) -> tuple:
    body, parts, stop = _closed(parts, ("elif", "else", "endif"), f"if {condition}")
    word, _, rest = stop.partition(" ")
    other: tuple = ("seq",)
    if word == "elif":
        node = _branches(rest, parts)
        other, parts = ("seq", node[:-1]), node[-1]
    elif word == "else":
        other, parts, _ = _closed(parts, ("endif",), "else")
    return ("if", _expression(condition), body, other, parts)


class _Tokens:
    def __init__(self, source: str) -> None:
        self.items: list[tuple[str, object]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"not in the language: {source[at : at + 20]!r}")
            string, number, name, mark = m.groups()
            self.items.append(("const", ast.literal_eval(string)) if string else ("const", int(number)) if number else ("name", name) if name else ("mark", mark))
            at = m.end()

    def take(self, *values: str) -> str | None:
        if self.items and self.items[0][0] != "const" and self.items[0][1] in values:
            return self.items.pop(0)[1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if not self.items or self.items[0][0] != "name":
            raise TemplateError("a name is missing")
        return self.items.pop(0)[1]


def _expression(source: str) -> tuple:
    t = _Tokens(source)
    node = _choice(t)
    if t.items:
        raise TemplateError(f"unexpected {t.items[0][1]!r} in {source!r}")
    return node


def _choice(t: _Tokens) -> tuple:
    node = _either(t)
    if t.take("if"):
        condition = _either(t)
        t.need("else")
        return ("choice", condition, node, _choice(t))
    return node


def _either(t: _Tokens) -> tuple:
    node = _both(t)
    while t.take("or"):
        node = ("or", node, _both(t))
    return node


def _both(t: _Tokens) -> tuple:
    node = _negated(t)
    while t.take("and"):
        node = ("and", node, _negated(t))
    return node


def _negated(t: _Tokens) -> tuple:
    return ("not", _negated(t)) if t.take("not") else _compared(t)


def _compared(t: _Tokens) -> tuple:
    node = _joined(t)
    if op := t.take("==", "!=", "in"):
        node = (op, node, _joined(t))
    return node


def _joined(t: _Tokens) -> tuple:
    node = _filtered(t)
    while t.take("~"):
        node = ("~", node, _filtered(t))
    return node


def _filtered(t: _Tokens) -> tuple:
    if t.take("("):
        node = _choice(t)
        t.need(")")
    elif t.items and t.items[0][0] == "const":
        node = t.items.pop(0)
    else:
        name = t.name()
        node = ("const", {"true": True, "false": False, "none": None}[name]) if name in ("true", "false", "none") else ("name", name)
    while True:
        if t.take("."):
            node = ("item", node, ("const", t.name()))
        elif t.take("["):
            node = ("item", node, _choice(t))
            t.need("]")
        elif t.take("|"):
            name = t.name()
            if name not in FILTERS:
                raise TemplateError(f"no such filter: {name}")
            node = ("filter", name, node)
        else:
            return node


# -- constant folding ------------------------------------------------------------------------------------------------


def fold(node: tuple) -> tuple:
    """Constant expressions become constants, constant branches are taken, neighbouring constant output is joined."""
    kind = node[0]
    if kind == "seq":
        out: list[tuple] = []
        for child in map(fold, node[1:]):
            for x in child[1:] if child[0] == "seq" else (child,):
                if x[0] == "emit" and x[1][0] == "const":
                    text = _text(x[1][1])
                    if not text:
                        continue
                    if out and out[-1][0] == "emit" and out[-1][1][0] == "const":
                        out[-1] = ("emit", ("const", out[-1][1][1] + text))
                    else:
                        out.append(("emit", ("const", text)))
                else:
                    out.append(x)
        return ("seq", *out)
    if kind == "emit":
        inner = fold(node[1])
        # a ~ b prints as a, then b: constants at either end then join their neighbours
        return ("seq", *(fold(("emit", x)) for x in inner[1:])) if inner[0] == "~" else ("emit", inner)
    if kind == "if":
        condition = fold(node[1])
        if condition[0] == "const":
            return fold(node[2] if condition[1] else node[3])
        return ("if", condition, fold(node[2]), fold(node[3]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind in ("const", "name"):
        return node
    children = tuple(fold(x) if isinstance(x, tuple) else x for x in node[1:])
    if all(x[0] == "const" for x in children if isinstance(x, tuple)):
        return ("const", _value((kind, *children))({}))
    return (kind, *children)


# -- closures --------------------------------------------------------------------------------------------------------


def _value(node: tuple) -> Callable[[dict], object]:
    kind, *a = node
    if kind == "const":
        x = a[0]
        return lambda names: x
    if kind == "name":
        return lambda names: names.get(a[0])
    if kind == "filter":
        f, inner = FILTERS[a[0]], _value(a[1])
        return lambda names: f(inner(names))
    parts = [_value(x) for x in a]
    if kind == "item":

        def item(names: dict) -> object:
            of, key = parts[0](names), parts[1](names)
            if isinstance(of, dict):
                return of.get(key)
            if isinstance(of, list | str) and isinstance(key, int):
                return of[key] if -len(of) <= key < len(of) else None
            return None

        return item
    if kind == "~":
        return lambda names: _text(parts[0](names)) + _text(parts[1](names))
    if kind == "==":
        return lambda names: parts[0](names) == parts[1](names)
    if kind == "!=":
        return lambda names: parts[0](names) != parts[1](names)
    if kind == "in":
        return lambda names: parts[0](names) in (parts[1](names) or ())
    if kind == "and":
        return lambda names: parts[0](names) and parts[1](names)
    if kind == "or":
        return lambda names: parts[0](names) or parts[1](names)
    if kind == "not":
        return lambda names: not parts[0](names)
    if kind == "choice":
        return lambda names: parts[1](names) if parts[0](names) else parts[2](names)
    raise TemplateError(f"no such expression: {kind}")


def _writer(node: tuple, masked: bool = False) -> Callable[[dict], Iterator[Piece]]:
    kind, *a = node
    if kind == "emit":
        value = _value(a[0])

        def emit(names: dict) -> Iterator[Piece]:
            yield _text(value(names)), masked

        return emit
    if kind == "seq":
        children = [_writer(x, masked) for x in a]

        def seq(names: dict) -> Iterator[Piece]:
            for child in children:
                yield from child(names)

        return seq
    if kind == "if":
        condition, yes, no = _value(a[0]), _writer(a[1], masked), _writer(a[2], masked)
        return lambda names: yes(names) if condition(names) else no(names)
    if kind == "set":
        value = _value(a[1])

        def put(names: dict) -> Iterator[Piece]:
            names[a[0]] = value(names)
            yield from ()

        return put
    if kind == "generation":
        return _writer(a[0], True)
    if kind == "for":
        items, body = _value(a[1]), _writer(a[2], masked)

        def loop(names: dict) -> Iterator[Piece]:
            source = iter(items(names) or ())
            now = next(source, source)
            index = 0
            while now is not source:  # one item ahead: loop.last is known without the rest
                after = next(source, source)
                index += 1
                yield from body(names | {a[0]: now, "loop": {"index": index, "first": index == 1, "last": after is source}})
                now = after

        return loop
    raise TemplateError(f"no such node: {kind}")


def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    """A function from names (``messages``: any iterable of mappings) to pieces."""
    return _writer(fold(parse(source)))


# -- reading back ----------------------------------------------------------------------------------------------------


def read_turns(pieces: Iterable[Piece]) -> Iterator[tuple[str, str, str]]:
    """(role, text, loss text) of each turn, from a rendering of CHATML; both texts are unescaped."""
    buffer, spans = "", []
    for text, masked in pieces:
        if masked and text:
            spans.append((len(buffer), len(buffer) + len(text)))
        buffer += text
        while (end := buffer.find(END)) >= 0:
            head, _, body = buffer[:end].partition("\n")
            if not head.startswith(START):
                raise ValueError("a turn must begin with its marker")
            loss = "".join(buffer[a:b] for a, b in spans if b <= end)
            yield unescape_role(head[len(START) :]), unescape(body), unescape(loss)
            cut = end + len(END)
            buffer, spans = buffer[cut:], [(a - cut, b - cut) for a, b in spans if b > end]
    if buffer:
        raise ValueError("the last turn has no end")


# -- the operator ----------------------------------------------------------------------------------------------------

DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _in_order(conversations: DataFrame) -> DataFrame:
    """All rows of a conversation in one partition, in order. Sorting spills; nothing is gathered."""
    ship(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def format_conversations(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """conv_id, seq, piece, masked: the rendering of each conversation as numbered pieces (one string: join them by seq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for conv, rows in groupby(_messages(batches), key=lambda r: r[0]):
            held: list[tuple] = []
            for k, (text, masked) in enumerate(render({"messages": ({"role": r, "text": t} for _, r, t in rows)})):
                held.append((conv, k, text, masked))
                if len(held) >= 512:
                    yield _pieces(held)
                    held = []
            if held:
                yield _pieces(held)

    return _in_order(conversations).mapInArrow(run, "conv_id long, seq long, piece string, masked boolean")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "seq", "piece", "masked"])


def digests(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """Per conversation, what ``read_turns`` reads back from its rendering, as counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        out: list[tuple] = []
        for conv, rows in groupby(_messages(batches), key=lambda r: r[0]):
            chars = [0]

            def counted(pieces: Iterator[Piece], chars: list[int] = chars) -> Iterator[Piece]:
                for text, masked in pieces:
                    chars[0] += len(text)
                    yield text, masked

            turns, loss, n, n_loss = hashlib.sha256(), hashlib.sha256(), 0, 0
            for role, text, learned in read_turns(counted(render({"messages": ({"role": r, "text": t} for _, r, t in rows)}))):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                loss.update(learned.encode("utf-8", "surrogatepass"))
                n, n_loss = n + 1, n_loss + len(learned)
            out.append((conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), chars[0]))
            if len(out) >= 2048:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return _in_order(conversations).mapInArrow(run, DIGEST)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])
