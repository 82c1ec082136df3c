"""Names and orders of the graph model: kinds, levels, ids, and the tables of a bundle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wire names, in the order in which results sort.
EDGE_KINDS = ("references", "reads", "writes", "calls", "fires", "uses-sequence", "uses-type", "contains", "inferred", "derives-from", "depends-on")
VERTEX_KINDS = ("schema", "table", "view", "materialized-view", "sequence", "type", "synonym", "column", "index", "constraint", "trigger", "function", "procedure", "package", "query")
MEMBER_KINDS = ("column", "index", "constraint", "trigger")
CONSUMER_KINDS = ("view", "materialized-view", "function", "procedure", "package")
LAYERS = ("catalog", "body-parse", "stats", "inferred")
STATES = ("complete", "partial", "unsupported")
LEVELS = ("schema", "object", "member")
NOT_DEPENDENCIES = ("contains", "inferred")
ESCAPED = ("%", ".", "@", ":", "(", ")")

#: The tables of a bundle and their columns.
SCHEMAS = {
    "vertices": "id string, kind string, name string, schema string",
    "edges": "src string, dst string, kind string",
    "evidence": "src string, dst string, kind string, layer string, detail string",
    "origins": "src string, dst string, kind string, body_hash string, role string, line int, col int",
    "usage": "id string, since string, reads long, writes long, scans long, total_ms double, self_ms double",
    "analysis": "id string, state string, scope string, body_hash string",
    "diagnostics": "id string, code string, message string, line int, col int, candidates array<string>",
    "columns": "table_id string, column_id string, name string, data_type string, nullable boolean, has_default boolean, ordinal int, pk_position int",
    "indexes": "index_id string, table_id string, name string, is_unique boolean, columns array<string>, complete boolean, filtered boolean",
    "fks": "fk_id string, table_id string, name string, columns array<string>, target_table_id string, target_columns array<string>, complete boolean",
    "limitations": "note string",
}


def kind_order(kind: Column) -> Column:
    """Place of an edge kind in the order of results, which is not the alphabet's."""
    return F.array_position(F.array(*map(F.lit, EDGE_KINDS)), kind).cast("int")


def is_dependency(kind: Column) -> Column:
    return ~kind.isin(*NOT_DEPENDENCIES)


def level_of(kind: Column) -> Column:
    return F.when(kind == "schema", "schema").when(kind.isin(*MEMBER_KINDS), "member").otherwise("object")


def escape(part: Column) -> Column:
    """A component of an id with its special characters percent-escaped; the percent sign first."""
    for c in ESCAPED:
        part = F.replace(part, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return part


def escape_text(part: str) -> str:
    for c in ESCAPED:
        part = part.replace(c, f"%{ord(c):02X}")
    return part


def parent_of(id_: Column) -> Column:
    """The id up to its last dot; null without one."""
    return F.when(id_.contains("."), F.regexp_extract(id_, r"(?s)^(.*)\.[^.]*$", 1))


def sorted_kinds(kinds: Column) -> Column:
    """Distinct edge kinds in their order, from an array."""
    return F.filter(F.array(*map(F.lit, EDGE_KINDS)), lambda k: F.array_contains(kinds, k))


def joined_kinds(kinds: Column) -> Column:
    return F.array_join(sorted_kinds(kinds), "|")


def glob_regex(pattern: Column) -> Column:
    """A glob as an anchored regex: * is any run, dots and line ends too, ? is one character, all else is itself."""
    quoted = F.regexp_replace(pattern, r"([\\^$.|+(){}\[\]])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def glob_match(pattern: Column, text: Column) -> Column:
    return F.rlike(text, glob_regex(pattern))


def glob_to_regex(pattern: str) -> str:
    import re

    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"
