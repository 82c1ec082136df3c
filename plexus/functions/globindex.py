"""Globs against ids by an index: a literal piece of a glob is a key that an id must have, so only ids with that key meet its regex.

The key is the longest literal piece at the glob's start, at its end, or else the first three characters of the longest one inside,
cut to one of a few lengths. An id has one key for each kind and length in use, so the globs are joined by equality, as a small table sent
along. Globs without a literal piece match nearly everything; they are kept beside the index and tried on each id where it stands.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTHS = (32, 24, 16, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
INSIDE = 3


def key_of(glob: str) -> tuple[str, int, str] | None:
    """(start, end or inside; length; key) of a glob; None if it has no literal piece that is long enough."""
    pieces = re.split(r"[*?]+", glob)
    cut = lambda n: next((x for x in LENGTHS if x <= n), 0)
    start, end = cut(len(pieces[0])), cut(len(pieces[-1]))
    if start and start >= end:
        return "start", start, pieces[0][:start]
    if end:
        return "end", end, pieces[-1][-end:]
    longest = max(pieces, key=len)
    return ("inside", INSIDE, longest[:INSIDE]) if len(longest) >= INSIDE else None


def keys(text: Column, used: set[tuple[str, int]]) -> Column:
    """The keys of a text for the kinds and lengths in ``used``: an array of "kind|length|key"."""
    parts = []
    for kind, n in sorted(used):
        tag = f"{kind}|{n}|"
        if kind == "inside":
            at = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
            pieces = F.transform(at, lambda k: F.substring(text, k, F.lit(INSIDE)))
            parts.append(F.array_distinct(tagged(tag, pieces)))
        else:
            piece = F.substring(text, 1, n) if kind == "start" else F.right(text, F.lit(n))
            parts.append(F.array(F.concat(F.lit(tag), piece)))
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def tagged(tag: str, texts: Column) -> Column:
    return F.transform(texts, lambda x: F.concat(F.lit(tag), x))


def told(key: tuple[str, int, str]) -> str:
    return f"{key[0]}|{key[1]}|{key[2]}"
