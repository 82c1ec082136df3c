"""Strict dates and times."""

from __future__ import annotations

import re
from datetime import date, datetime

_RFC3339 = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(\.\d{1,9})?Z")


def valid_rfc3339(text: object) -> bool:
    """An RFC 3339 time in UTC, written with T and Z, that exists."""
    m = _RFC3339.fullmatch(text) if isinstance(text, str) else None
    if not m:
        return False
    try:
        datetime(*map(int, m.groups()[:6]))
    except ValueError:
        return False
    return True


def iso_date(text: str) -> date:
    """A date written YYYY-MM-DD, or ValueError."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\d", text):
        raise ValueError(f"not a date: {text!r}")
    return date.fromisoformat(text)
