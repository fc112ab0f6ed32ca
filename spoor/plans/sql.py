"""Pieces of DuckDB SQL that the twins of the registered queries share."""

from spoor.functions.text import STOPWORDS

STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"

UNITS = """u AS (
  SELECT unit_id, any_value(session_id) AS session_id, any_value(session_name) AS session_name, any_value(cwd) AS cwd,
    any_value(CASE WHEN lower(trim(role)) = 'toolresult' THEN 'tool' ELSE lower(trim(role)) END) AS role,
    any_value(text) AS text, any_value(CASE WHEN abs(ts_ms) < 100000000000 THEN ts_ms * 1000 ELSE ts_ms END) AS ts,
    any_value(seq) AS seq, any_value(entities) AS entities, any_value(embedding) AS embedding
  FROM trace_units GROUP BY unit_id
)"""
POSTINGS = """ue AS (
  SELECT DISTINCT unit_id, lower(trim(e)) AS entity FROM (SELECT unit_id, unnest(entities) AS e FROM u) WHERE e IS NOT NULL AND trim(e) <> ''
)"""
FACT_QUERIES = "fq AS (SELECT id, id || ':' || i AS query_id, queries[i] AS text FROM eval_facts, unnest(generate_series(1, len(queries))) t(i) WHERE queries[i] IS NOT NULL)"


def tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9][a-z0-9_]+'), lambda x: NOT list_contains({STOP}, x))"


def entities(text: str) -> str:
    t = f"coalesce({text}, '')"
    parts = [
        rf"regexp_extract_all({t}, '(?i)([a-z0-9_.\\/-]*[.\\/][a-z0-9_.\\/-]*[.\\/][a-z0-9_.\\/-]*)|([a-z0-9_-]+\.(?:ts|js|tsx|jsx|py|rs|go|java|c|cpp|cc|h|hpp|md|json|yaml|yml|toml|sh|css|html|sql))|((?:[a-z0-9_.-]+\\)+[a-z0-9_.-]+)', 0)",
        rf"regexp_extract_all({t}, '`([^`\n]{{2,40}})`', 1)",
        rf"""regexp_extract_all({t}, '"([A-Za-z][A-Za-z0-9 _.\-/]{{2,40}})"', 1)""",
        rf"regexp_extract_all({t}, '\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b', 0)",
        rf"regexp_extract_all({t}, '\b[a-z]+(?:_[a-z]+)+\b', 0)",
        rf"regexp_extract_all({t}, '\b[A-Z][A-Z0-9][A-Z0-9]+\b', 0)",
    ]
    joined = parts[0]
    for p in parts[1:]:
        joined = f"list_concat({joined}, {p})"
    kept = f"list_filter(list_transform({joined}, lambda x: lower(trim(x))), lambda x: length(x) BETWEEN 2 AND 40 AND NOT list_contains({STOP}, x) AND NOT regexp_matches(x, '^[0-9]+$'))"
    return f"({kept})"


def first_distinct(listed: str, n: int) -> str:
    """The first n distinct elements in order."""
    return f"list_filter({listed}, lambda x, i: list_position({listed}, x) = i)[1:{n}]"


def fingerprint(text: str) -> str:
    norm = f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'))[1:500]"
    chars = f"list_transform(list_filter(string_split({norm}, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)"
    return f"lower(to_base(list_reduce({chars}, lambda h, c: xor((h * 33) % 4294967296, c), 5381::BIGINT), 36))"


def bm25(units: str, text: str, queries: str) -> str:
    """CTEs qt, tok, post, st, dfq, bm from frames units(unit_id, text) and queries(query_id, text)."""
    return f"""
qt AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest({tokens('text')}) AS term FROM {queries}) GROUP BY 1, 2),
tok AS (SELECT unit_id, {tokens(text)} AS toks FROM {units}),
st AS (SELECT count(*) AS n_units, avg(len(toks)) AS avgdl FROM tok),
post AS (SELECT unit_id, any_value(l) AS l, term, count(*) AS tf FROM (SELECT unit_id, len(toks) AS l, unnest(toks) AS term FROM tok) GROUP BY unit_id, term),
dfq AS (SELECT term, count(*) AS n FROM post GROUP BY term),
bm AS (
  SELECT query_id, unit_id, sum(qn * ln(1 + (n_units - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / avgdl))) AS bm
  FROM qt JOIN dfq USING (term) JOIN post USING (term), st GROUP BY 1, 2
),
cov AS (SELECT query_id, sum(CASE WHEN n IS NOT NULL THEN qn ELSE 0 END) / sum(qn) AS cov FROM qt LEFT JOIN dfq USING (term) GROUP BY 1)"""


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


TEMPORAL = r"regexp_matches(lower(text), '\b(earlier|before|last|previous|yesterday|ago|used to|recently|back when)\b')"
IDENTITY = (
    r"regexp_matches(lower(text), '\b(my name|your name|you name|ur name|who am i|who are you|what should i call you|what did i say|you (are|''re|re) called|i (am|''m|m) called"
    r"|do you remember me|do you know (me|who i am|who)|what are you called|who am i talking to|introduce yourself|remember my name|what''?s (the|your) assistant''?s name)\b')"
)


def compat(q: str, t: str) -> str:
    return (
        rf"CASE WHEN regexp_matches(lower({q}), '\b(when|what (time|date|day)|how long ago|how old)\b') THEN "
        rf"regexp_matches(lower({t}), '\b([0-9]{{1,2}}\s*(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?|[0-9]{{4}}|yesterday|today|tomorrow|last (week|month|year|night))\b')::INT "
        rf"WHEN regexp_matches(lower({q}), '\b(how many|how much|number of|count|total)\b') THEN regexp_matches(lower({t}), '\b[0-9]+\b')::INT ELSE 0 END"
    )


def snippet(text: str, n: int) -> str:
    s = f"replace({text}, '```', '''''''')"
    s = rf"regexp_replace({s}, '(?m)^#{{1,6}}\s+', '', 'g')"
    s = rf"regexp_replace({s}, '(?m)^\s*[-*+>]\s+', '', 'g')"
    s = rf"trim(regexp_replace({s}, '\s+', ' ', 'g'))"
    return f"CASE WHEN length({s}) > {n} THEN rtrim({s}[1:{n}]) || '…' ELSE {s} END"


def rel_time(ts: str, now: int) -> str:
    s = f"greatest(1, floor(({now} - {ts}) / 1000.0))::BIGINT"
    return (
        f"CASE WHEN {s} < 60 THEN {s} || 's ago' WHEN {s} < 3600 THEN {s} // 60 || 'm ago' WHEN {s} < 86400 THEN {s} // 3600 || 'h ago' "
        f"WHEN {s} < 604800 THEN {s} // 86400 || 'd ago' ELSE strftime(epoch_ms({ts}), '%Y-%m-%d') END"
    )
