"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule;
a policy is a versioned set of rules, so its verdict is ``fail_bits & mask = 0`` and a change of policy, or an ablation,
reads the ledger and never the texts again.

Defined results: a null text counts as empty (no words, so the ``short`` bit is set); a null id stays null; repeated rows
each get their own row; an empty table gives an empty ledger; extra columns of the input are left behind.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, map_texts

#: Characters that count as symbols, and white space. Fixed values.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words")
LEDGER = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)


class Rule(NamedTuple):
    """``fails`` is SQL over the measurements, in whole numbers so that every engine decides alike."""

    bit: int
    name: str
    fails: str


#: A rule keeps its bit for ever; a changed rule gets a new bit.
RULES = (
    Rule(0, "short", "n_words < 10"),
    Rule(1, "repeats", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 30 * n_words"),
    Rule(3, "dup_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "upper", "100 * n_upper_words > 40 * n_words"),
    Rule(5, "word_length", "word_chars > 20 * n_words OR word_chars < 2 * n_words"),
)

#: Policies by version. Fixed once published.
POLICIES = {
    "base": ("short", "repeats"),
    "v1": ("short", "repeats", "symbols", "dup_lines"),
    "v2": ("short", "repeats", "symbols", "dup_lines", "upper", "word_length"),
}


def mask_of(policy: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 6:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            seen, end = Counter(windows), 0
            for k, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += k + 5 - max(k, end)
                    end = k + 5
    upper = sum(map(bytes.isupper, words))
    return n, len(text or "") - spaces, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper


def _measurer():
    def work(ids: list, texts: list) -> dict:
        columns = list(zip(*map(measure, texts), strict=True))
        return {"doc_id": _long(ids)} | {m: _long(c) for m, c in zip(MEASURES, columns, strict=True)}

    import pyarrow as pa

    def _long(x):
        return pa.array(x, pa.int64())

    return work


def fail_bits() -> Column:
    """One long with bit b set where rule b fails."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``fail_bits``: one row per input row, no shuffle."""
    return map_texts(ids_and_texts(docs, id_col, text_col), _measurer, LEDGER).withColumn("fail_bits", fail_bits())


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that are kept without it.

    The ledger is first folded to one row per distinct combination of bits (2^rules at most), whatever its size.
    """
    mask = mask_of(policy)
    folded = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    stacked = ", ".join(f"'{r.name}', {1 << r.bit}L" for r in rules)
    return (
        folded.selectExpr("bits", "n", f"stack({len(rules)}, {stacked}) AS (rule, bit)")
        .groupBy("rule")
        .agg(
            F.sum(F.expr("CASE WHEN bits & bit <> 0 THEN n ELSE 0 END")).alias("n_failed"),
            F.sum(F.expr("CASE WHEN bits = bit THEN n ELSE 0 END")).alias("n_failed_alone"),
            F.sum(F.expr(f"CASE WHEN bits & ({mask}L ^ bit) = 0 THEN n ELSE 0 END")).alias("n_kept_without"),
        )
    )
