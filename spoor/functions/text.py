"""Text scalars: tokens, entities, fingerprints, snippets, query classes. All are built-in expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words no token or entity may be (fixed values).
STOPWORDS = (
    "a an the and or but if then else of to in on at by for with from into over "
    "is are was were be been being this that these those it its as not no yes "
    "do does did done have has had can could should would may might must will "
    "i you he she we they me him her us them my your his our their what when "
    "where why how which who whom there here about up down out so than very "
    "just also only more most some any all each both few other such own same "
    "get make use using used run runs running file code like need want one two"
).split()

#: Entity patterns in the order in which they contribute (fixed values). Java's word
#: boundary knows Unicode, so ASCII borders are spelled out.
_W = "[A-Za-z0-9_]"
ENTITY_PATTERNS = (
    # a path begins where its run of signs does and is read once from left to right, so that long words cost no more than their length
    (r"(?i)((?<![A-Za-z0-9_.\\/-])[A-Za-z0-9_-]*+[.\\/][A-Za-z0-9_-]*+[.\\/][A-Za-z0-9_.\\/-]*+)"
     r"|((?<![A-Za-z0-9_-])[A-Za-z0-9_-]++\.(?:ts|js|tsx|jsx|py|rs|go|java|c|cpp|cc|h|hpp|md|json|yaml|yml|toml|sh|css|html|sql))"
     r"|((?<![A-Za-z0-9_.-])(?:[A-Za-z0-9_.-]++\\)+[A-Za-z0-9_.-]++)", 0),
    (r"`([^`\n]{2,40})`", 1),
    (r'"([A-Za-z][A-Za-z0-9 _.\-/]{2,40})"', 1),
    (rf"(?<!{_W})[A-Z][a-z]+(?:[A-Z][a-z]+)+(?!{_W})", 0),
    (rf"(?<!{_W})[a-z]+(?:_[a-z]+)+(?!{_W})", 0),
    (rf"(?<!{_W})[A-Z][A-Z0-9][A-Z0-9]+(?!{_W})", 0),
)
#: Signs kept of arguments that are no string.
ARGUMENTS = 200
#: Entities kept for one text.
MAX_ENTITIES = 16


def _literal_array(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def _stopped(x: Column) -> Column:
    return x.isin(*STOPWORDS)


def tokens(text: Column) -> Column:
    """Lower-case ASCII words of two signs or more, stop words dropped; order and repeats stay. Null gives none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9][a-z0-9_]+"), F.lit(0))
    return F.filter(found, lambda x: ~_stopped(x))


def entities(text: Column, extra: Column | None = None) -> Column:
    """The first 16 distinct entities by pattern order; ``extra`` is an array of names found elsewhere."""
    text = F.coalesce(text, F.lit(""))
    parts = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in ENTITY_PATTERNS]
    if extra is not None:
        parts.append(extra)
    clean = F.transform(F.concat(*parts), lambda x: F.lower(F.trim(x)))
    kept = F.filter(clean, lambda x: F.length(x).between(2, 40) & ~_stopped(x) & ~x.rlike("^[0-9]+$"))
    return F.slice(F.array_distinct(kept), 1, MAX_ENTITIES)


def fingerprint(text: Column) -> Column:
    """Base-36 hash of the first 500 signs of the lower-case words; equal for texts that differ in case or marks."""
    norm = F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), 1, 500)
    codes = F.transform(F.filter(F.split(norm, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(codes, F.lit(5381).cast("bigint"), lambda a, c: ((a * 33).bitwiseAND(F.lit(4294967295))).bitwiseXOR(c))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def pair(a: Column, b: Column) -> tuple[Column, Column]:
    """An unordered pair, smaller first."""
    return F.least(a, b), F.greatest(a, b)


def rel_time(ts_ms: Column, now_ms: Column) -> Column:
    """'12s ago' to '6d ago', from a week on the date."""
    s = F.greatest(F.lit(1), F.floor((now_ms - ts_ms) / 1000)).cast("bigint")
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(s < 60, part(1, "s"))
        .when(s < 3600, part(60, "m"))
        .when(s < 86400, part(3600, "h"))
        .when(s < 604800, part(86400, "d"))
        .otherwise(F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM-dd"))
    )


def snippet(text: Column, n: int) -> Column:
    """Text on one line without fences, headings and list marks, cut at n signs."""
    s = F.regexp_replace(text, "```", "'''")
    s = F.regexp_replace(s, r"(?m)^#{1,6}\s+", "")
    s = F.regexp_replace(s, r"(?m)^\s*[-*+>]\s+", "")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(F.length(s) > n, F.concat(F.rtrim(F.substring(s, 1, n)), F.lit("…"))).otherwise(s)


def strip_fences(text: Column) -> Column:
    """The body of a fenced answer."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z0-9]*\n?", ""), r"\n?```$", "")


def flatten_value(value) -> str:
    """Text of message content as parsed from JSON: a string, or a list of blocks, of which results hold content again."""
    if isinstance(value, str):
        return value
    parts = []
    for block in value if isinstance(value, list) else []:
        if isinstance(block, str):
            parts.append(block)
        elif isinstance(block, dict):
            kind, text = block.get("type"), block.get("text")
            if kind == "toolCall":
                given = block.get("arguments")
                # only what is written out here is cut
                parts.append(f"[tool:{block.get('name')}] " + (given if isinstance(given, str) else "" if given is None else json.dumps(given, separators=(",", ":"), ensure_ascii=False)[:ARGUMENTS]))
            elif kind == "toolResult":
                parts.append("[result] " + flatten_value(block.get("content")))
            elif isinstance(text, str):
                parts.append(text)
    return "\n".join(parts)


@F.pandas_udf(StringType())
def flatten_json(content: pd.Series) -> pd.Series:
    """Text of message content given as JSON, to any depth; what is no JSON is text itself, null gives ''."""

    def one(raw):
        if raw is None or not raw[:1] in ("[", '"'):
            return raw or ""
        try:
            return flatten_value(json.loads(raw))
        except ValueError:
            return raw

    return content.map(one)


def flatten_blocks(blocks: Column) -> Column:
    """Text of an array of structs (type, text, name, arguments as a string, content as text), one block a line."""

    def one(b: Column) -> Column:
        return (
            F.when(b["type"] == "text", b["text"])
            .when(b["type"] == "toolCall", F.concat(F.lit("[tool:"), b["name"], F.lit("] "), b["arguments"]))
            .when(b["type"] == "toolResult", F.concat(F.lit("[result] "), F.coalesce(b["content"], F.lit(""))))
            .otherwise(b["text"])
        )

    return F.array_join(F.filter(F.transform(F.filter(blocks, lambda b: b.isNotNull()), one), lambda t: t.isNotNull()), "\n")


_B, _E = r"(?<![a-z0-9_])", r"(?![a-z0-9_])"


# The word lists of the query classes below are fixed values.


def is_temporal(query: Column) -> Column:
    return F.lower(query).rlike(rf"{_B}(earlier|before|last|previous|yesterday|ago|used to|recently|back when){_E}")


def asks_type(query: Column) -> Column:
    """'when' if the query asks for a time, 'many' if for a quantity, else null."""
    q = F.lower(query)
    when = q.rlike(rf"{_B}(when|what (time|date|day)|how long ago|how old){_E}")
    many = q.rlike(rf"{_B}(how many|how much|number of|count|total){_E}")
    return F.when(when, "when").when(many, "many")


def names_date(text: Column) -> Column:
    return F.lower(text).rlike(
        rf"{_B}([0-9]{{1,2}}\s*(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?|[0-9]{{4}}|yesterday|today|tomorrow|last (week|month|year|night)){_E}"
    )


def names_number(text: Column) -> Column:
    return F.lower(text).rlike(rf"{_B}[0-9]+{_E}")


def type_compat(query: Column, text: Column) -> Column:
    """1 if the query asks for a time or a quantity and the text names one, else 0."""
    asked = asks_type(query)
    return F.when(asked == "when", names_date(text).cast("int")).when(asked == "many", names_number(text).cast("int")).otherwise(F.lit(0))


def is_identity_query(query: Column) -> Column:
    return F.lower(query).rlike(
        rf"{_B}(my name|your name|you name|ur name|who am i|who are you|what should i call you|what did i say|you (are|'re|re) called|i (am|'m|m) called"
        r"|do you remember me|do you know (me|who i am|who)|what are you called|who am i talking to|introduce yourself|remember my name"
        rf"|what'?s (the|your) assistant'?s name){_E}"
    )


def mmr_lambda(query: Column, n_entities: Column, n_tokens: Column) -> Column:
    """Weight of diversity by the shape of a query."""
    wide = F.lower(query).rlike(
        rf"{_B}(summari[sz]e|overview|recap|round-?up|status|catch up|list|enumerate|everything|all (the|our)|what (do|did) we|tl;?dr){_E}"
    )
    density = F.when(n_tokens > 0, n_entities / n_tokens).otherwise(F.lit(0.0))
    return (
        F.when(wide, 0.7)
        .when((n_tokens > 0) & (n_tokens <= 6) & (density >= 0.15), 0.25)
        .when(n_tokens >= 12, 0.6)
        .otherwise(F.least(F.lit(0.55), F.greatest(F.lit(0.4), 0.5 - density)))
    )


def min_max(v: Column, lo: Column, hi: Column) -> Column:
    """(v - lo) / (hi - lo), not clamped; with hi = lo 1 for positive v, else 0."""
    return F.when(hi > lo, (v - lo) / (hi - lo)).when(v > 0, 1.0).otherwise(0.0)
