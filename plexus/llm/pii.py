"""Personal data: identifier patterns, and information-theoretic sanitisation of terms that give identifiers away.

Built from DataFrame and SQL functions only.

Identifiers (email, ip, card, phone) are found by pattern, leftmost and non-overlapping per kind; so are secrets (runs of 32 or more
ASCII letters, digits and underscores with at least four letters and four digits, as keys and digests are). The protected entities are each distinct value,
and each kind as a whole (that there is a card number at all is worth protecting). The context of a mention are the words of its line within ``REACH``
code points. Over the whole corpus, in lines,

    disclosure(term; entity) = PMI(term; entity) / IC(entity),  PMI = log2(p(term, entity) / (p(term) p(entity))),  IC = -log2 p(entity)

is the share of the entity's information that the term gives away: 1 means that whoever reads the term knows the entity. A term
that stands in the entity's context on at least ``support`` different lines, and discloses at least ``generalise`` of it, is generalised to its
shape ([NAME], [CODE], [WORD]); from ``remove`` on it is removed. This is done throughout the documents that hold the term in the entity's
context, and in no others: a document without an identifier is never changed.

Spans are in code points, end exclusive. Those of the method have the kinds ``secret``, ``term`` (generalised) and ``drop`` (removed), and
stand beside the identifiers' spans, which they never replace; inside another span a term is not looked for.

Defined results: a null text counts as empty (no spans; sanitised text stays null); repeated rows each get their row; an empty
table gives an empty result; extra columns are left behind by ``find`` and kept by ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialise, ship

#: Patterns by kind, in the order of the output. Possessive repeats and the guards in front only spare backtracking: every
#: class ends where its follower cannot match, so the matches are those of the plain patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"[A-Za-z0-9_]{32,}+",
}
#: The kinds whose spans make up the digest, and all that are protected.
KINDS, PROTECTED = ("email", "ip", "card", "phone"), tuple(PATTERNS)
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]", "drop": ""}

SUPPORT, GENERALISE, REMOVE, REACH = 3, 0.7, 0.9, 200
#: Terms that are sent to every worker to be counted; more are picked from the counts of all words by a join. The result is the same.
SENT = 200_000
_SPACES = r"[\x20\x09-\x0D]+"

_SPANS = "array<struct<s:int,e:int>>"


def _luhn(digits: Column) -> Column:
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for k in range(19):
        d = F.substring(padded, 19 - k, 1).cast("int")
        total = total + (d if k % 2 == 0 else 2 * d - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "secret":
        return (F.length(digits) >= 4) & (F.length(F.regexp_replace(match, "[0-9_]", "")) >= 4)
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    return F.length(digits).between(9, 15)


def _spans(text: Column, pattern: Column, valid) -> Column:
    """Positions of the matches: the pieces between them, from split, give each one's start by running sum."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(s.alias("s"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(x["m"].isNotNull() & valid(x["m"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


#: What a text must hold for a kind to be worth looking for.
_HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "secret": r"[A-Za-z0-9_]{32}"}


def identifiers(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with a column ``__pii_<kind>`` per kind: an array of (s, e). A generator makes them, so that filters on them do not make them twice."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast(_SPANS)
    spans = [F.when(text.rlike(_HINT[k]), _spans(text, F.lit(p), lambda m, k=k: _valid(k, m))).otherwise(none).alias(f"__pii_{k}") for k, p in PATTERNS.items()]
    return docs.drop(*(f"__pii_{k}" for k in PATTERNS)).select("*", F.inline_outer(F.array(F.struct(*spans))))


def _hinted(text: Column) -> Column:
    """Whether a text holds what every identifier or secret holds; the others need no further look."""
    return text.rlike("|".join(f"(?:{h})" for h in _HINT.values()))


# -- corpus statistics -----------------------------------------------------------------------------------------------


def _clear_of(spans: Column):
    """Whether a span overlaps none of ``spans``."""
    return lambda x: ~F.exists(spans, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))


def _all_spans() -> Column:
    return F.concat(*(F.col(f"__pii_{k}") for k in PROTECTED))


def _mentions(lines: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose ``line`` holds something protected, with ``found``: array of (entity, s, e), values and kinds; and ``taken``: all spans."""
    marked = identifiers(lines.where(_hinted(F.col("line"))), "line")

    def named(k: str) -> Column:
        value = lambda x: F.concat(F.lit(f"{k}:"), _normal(k, F.substring(F.col("line"), x["s"] + 1, x["e"] - x["s"])))
        one = lambda entity, x: F.struct(entity.alias("entity"), x["s"].alias("s"), x["e"].alias("e"))
        return F.flatten(F.transform(f"__pii_{k}", lambda x: F.array(one(value(x), x), one(F.lit(f"{k}:*"), x))))

    return marked.select(*lines.columns, F.concat(*map(named, PROTECTED)).alias("found"), _all_spans().alias("taken")).where(F.size("taken") > 0)


def _in_context(rows: DataFrame, able: DataFrame, reach: int, *keep: str) -> DataFrame:
    """(*keep, entity, term): each distinct word in the context of each entity of a line that ``able`` has, once a row of ``rows`` (from ``_mentions``)."""
    entities = F.array_distinct(F.transform("found", lambda f: f["entity"]))
    rows = rows.select(*keep, "line", "found", "taken", F.explode(entities).alias("entity")).join(able.select("entity"), "entity", "left_semi")
    own = F.filter("found", lambda f: f["entity"] == F.col("entity"))
    near = lambda x: F.exists(own, lambda f: (x["e"] >= f["s"] - reach) & (x["s"] <= f["e"] + reach))
    words = _spans(F.col("line"), F.lit(WORD), lambda m: F.lit(True))
    free = F.filter(F.filter(words, near), _clear_of(F.col("taken")))
    terms = F.array_distinct(F.transform(free, lambda x: F.substring(F.col("line"), x["s"] + 1, x["e"] - x["s"])))
    return rows.select(*keep, "entity", F.explode(terms).alias("term"))


def _lines(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    return docs.select(*keep, F.explode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")).alias("line"))


def disclosures(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, reach: int = REACH) -> DataFrame:
    """(entity, term, disclosure) of the pairs at or above ``generalise``.

    Everything is counted by line over the whole corpus and combined on the map side first; equal lines are one
    context with a weight, so copies of a document add weight but no support.
    """
    ship(docs.sparkSession)
    lines = _lines(docs, text_col)
    mentions = materialise(_mentions(lines).groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.first("found").alias("found"), F.first("taken").alias("taken")), "mentions")
    entities = mentions.select("n", F.explode(F.array_distinct(F.transform("found", lambda f: f["entity"]))).alias("entity"))
    # An entity on fewer lines than the support has no term to find; this spares pairing its words.
    able = materialise(entities.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("lines")).where(F.col("lines") >= support), "entities")
    pairs = materialise(
        _in_context(mentions, able, reach, "n").groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("support")).where(F.col("support") >= support),
        "pairs",
    )
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"))
    n_lines = float(lines.count())
    words = lines.select(F.explode(F.array_distinct(F.split("line", _SPACES))).alias("term"))
    terms = materialise(pairs.select("term").distinct(), "pair-terms")
    if terms.count() <= SENT:  # then other words need not be counted
        of_term = words.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    else:
        of_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).join(terms, "term")
    of_term = materialise(of_term, "terms")
    ic = F.log2(F.lit(n_lines) / F.col("n_entity"))
    pmi = F.log2(F.col("n_both") / F.col("n_term") * (F.lit(n_lines) / F.col("n_entity")))
    scored = pairs.join(able, "entity").join(of_term, "term").select("entity", "term", F.when(ic > 0, pmi / ic).otherwise(0.0).alias("disclosure"))
    return materialise(scored.where(F.col("disclosure") >= generalise), "disclosures")


def _normal(kind: str, value: Column) -> Column:
    """One spelling per entity: mails in lower case, numbers without their spacing."""
    return F.lower(value) if kind == "email" else F.regexp_replace(value, "[^0-9]", "") if kind in ("card", "phone") else value


# -- spans and texts -------------------------------------------------------------------------------------------------


def find(docs: DataFrame, terms: DataFrame, text_col: str = "text", remove: float = REMOVE, reach: int = REACH) -> DataFrame:
    """The input with ``__pii_<kind>`` for each protected kind and for ``term`` and ``drop``: arrays of (s, e). ``terms`` from ``disclosures``.

    Only texts with something protected can hold a term to treat; those that may (by a cheap look) meet their terms by the hash of the
    text and its length, so neither row ids nor their uniqueness matter. The others go through no shuffle.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    nothing = F.array().cast(_SPANS)
    if terms.isEmpty():
        return identifiers(docs, text_col).withColumns({"__pii_term": nothing, "__pii_drop": nothing})
    key = F.struct(F.xxhash64(text), F.hash(text), F.length(text))
    context = _mentions(_lines(docs.withColumn("__pii_key", key), text_col, "__pii_key"))
    held = materialise(
        _in_context(context, terms.select("entity").distinct(), reach, "__pii_key")
        .join(terms, ["entity", "term"])
        .groupBy("__pii_key")
        .agg(*(F.collect_set(F.when((F.col("disclosure") >= remove) == r, F.col("term"))).alias(f"__pii_held_{k}") for k, r in (("term", False), ("drop", True)))),  # words of one text
        "held-terms",
    )
    out = identifiers(docs.where(_hinted(text)), text_col).withColumn("__pii_key", key).join(held, "__pii_key", "left")
    spans = {}
    for k in ("term", "drop"):
        have = F.coalesce(F.col(f"__pii_held_{k}"), F.array().cast("array<string>"))
        words = lambda have: F.filter(_spans(text, F.lit(WORD), lambda m: F.array_contains(have, m)), _clear_of(_all_spans()))
        spans[f"__pii_{k}"] = F.when(F.size(have) > 0, words(have)).otherwise(nothing)
    out = out.withColumns(spans).withColumn("__pii_term", F.array_except("__pii_term", "__pii_drop")).drop("__pii_key", "__pii_held_term", "__pii_held_drop")
    rest = docs.where(~_hinted(text)).withColumns({f"__pii_{k}": nothing for k in (*PROTECTED, "term", "drop")})
    return out.unionByName(rest)


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind, then start, joined by commas."""
    one = lambda k: lambda x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.concat(*(F.transform(f"__pii_{k}", one(k)) for k in kinds)), ",")


def report(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, the digest of the identifiers' spans and all spans."""
    found = find(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), terms)
    kinds = (*PROTECTED, "term", "drop")
    counts = [F.size(f"__pii_{k}").cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(listed(KINDS), 256).alias("base_sha256"), listed(kinds).alias("spans"))


def sanitise(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with personal data in ``text_col`` replaced: identifiers by their kind, terms by their shape or nothing.

    Overlapping spans are replaced once, by the first's placeholder.
    """
    found = find(docs, terms, text_col)
    text = F.col(text_col)
    tag = lambda k: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k"))
    tagged = [F.transform(f"__pii_{k}", tag(k)) for k in (*PROTECTED, "term", "drop")]
    spans = F.array_sort(F.concat(*tagged))

    def mark(x: Column) -> Column:
        word = F.substring(text, x["s"] + 1, x["e"] - x["s"])
        shape = F.when(word.rlike(r"[0-9]"), "[CODE]").when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
        out = shape
        for k, v in PLACEHOLDERS.items():
            out = F.when(x["k"] == k, v).otherwise(out)
        return out

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), mark(x))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn("__pii_clean", F.when(F.size(spans) > 0, clean).otherwise(text)).select(*(F.col("__pii_clean").alias(c) if c == text_col else F.col(c) for c in docs.columns))
