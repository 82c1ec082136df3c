"""Rule, retention and review policy files (TOML or JSON), read strictly: an unknown key is an error."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

from .functions.timestamps import iso_date
from .model import EDGE_KINDS
from .operators.change import Policy
from .operators.structure import Retention


def load(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    return json.loads(text) if path.endswith(".json") else tomllib.loads(text)


def _only(d: dict, *keys: str) -> dict:
    unknown = sorted(set(d) - set(keys))
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    return d


def rules(path: str) -> list[tuple[str, str, str, list[str] | None]]:
    """[[rules]] with name, from, to and, if wanted, kinds."""
    out = []
    for r in _only(load(path), "rules").get("rules", []):
        _only(r, "name", "from", "to", "kinds")
        kinds = r.get("kinds")
        bad = sorted(set(kinds or ()) - set(EDGE_KINDS))
        if bad:
            raise ValueError(f"unknown edge kinds: {', '.join(bad)}")
        out.append((r["name"], r["from"], r["to"], kinds))
    return out


def retention(path: str, as_of: str | None = None) -> Retention:
    """[[roots]] with pattern and reason; [[suppressions]] with pattern, reason and, if wanted, until."""
    d = _only(load(path), "roots", "suppressions")
    if as_of:
        iso_date(as_of)
    for s in d.get("suppressions", []):
        _only(s, "pattern", "reason", "until")
        if "until" in s:
            iso_date(str(s["until"]))
    return Retention(
        tuple((r["pattern"], r.get("reason", "")) for r in d.get("roots", [])),
        tuple((s["pattern"], s.get("reason", ""), str(s["until"]) if "until" in s else None) for s in d.get("suppressions", [])),
        as_of,
    )


def review(path: str, baseline: str | None = None, as_of: str | None = None) -> Policy:
    """fail_threshold, [severity] by change kind, [[waivers]] with fingerprint, reason and, if wanted, until."""
    d = _only(load(path), "version", "fail_threshold", "severity", "waivers")
    if d.get("version") != 1:
        raise ValueError("a review policy has version 1")
    waivers = {}
    for w in d.get("waivers", []):
        _only(w, "fingerprint", "reason", "until")
        if "until" in w:
            iso_date(str(w["until"]))
        waivers[w["fingerprint"]] = (w.get("reason", ""), str(w["until"]) if "until" in w else None)
    known = frozenset(load(baseline)["fingerprints"]) if baseline else None
    return Policy(d.get("fail_threshold", "critical"), d.get("severity", {}), waivers, known, as_of)
