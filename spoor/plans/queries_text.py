"""Registered queries: units, text scalars, lexical search, stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.functions import text as T
from spoor.operators.answers import calibrate, evidence_block
from spoor.operators.lexical import bm25, bm25_index, bm25_topk, coverage, query_terms
from spoor.operators.ranking import rrf, top_k
from spoor.plans import sql as S
from spoor.plans.registry import register
from spoor.runtime import load
from spoor.sources.units import adjacent, enrich, merge_foreign, retain, store_stats, units

#: The time at which the registered queries are asked.
NOW_MS = 1_743_500_000_000
PROJECT = "/home/dev/work/offset-jiomor"


def fact_queries(spark, sf_dir):
    """(id, query_id, text): the questions of the evaluation facts."""
    facts = load(spark, sf_dir, "eval_facts").select("id", F.posexplode("queries").alias("i", "text"))
    return facts.where("text is not null").select("id", F.concat_ws(":", "id", (F.col("i") + 1).cast("string")).alias("query_id"), "text")


def fact_units(spark, sf_dir):
    """The evaluation facts as units."""
    return load(spark, sf_dir, "eval_facts").select(F.col("id").alias("unit_id"), "text")


@register("units_normal", f"WITH {S.UNITS} SELECT unit_id, session_id, cwd, role, ts, seq FROM u")
def units_normal(spark, sf_dir):
    return units(spark, sf_dir).select("unit_id", "session_id", "cwd", "role", "ts", "seq")


_CUT = "text[1:CASE WHEN role = 'tool' THEN 500 ELSE 4000 END]"


@register(
    "unit_enrich",
    f"WITH {S.UNITS}, k AS (SELECT unit_id, role, {S.fingerprint('text')} AS fp, {_CUT} AS cut FROM u WHERE role IN ('user', 'assistant', 'tool') AND length(trim(text)) >= 3 "
    f"AND regexp_matches(text, '[A-Za-z0-9]')) SELECT unit_id, role, fp, length(cut) AS n_chars, len({S.tokens('cut')}) AS n_tokens, array_to_string({S.tokens('cut')}, ' ') AS tokens FROM k",
)
def unit_enrich(spark, sf_dir):
    e = enrich(units(spark, sf_dir))
    return e.select("unit_id", "role", "fp", F.length("text").cast("bigint").alias("n_chars"), F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@register(
    "entity_extract",
    f"WITH {S.UNITS}, e AS (SELECT unit_id, {S.entities('text')} AS l FROM u), d AS (SELECT unit_id, {S.first_distinct('l', 16)} AS ents FROM e) SELECT unit_id, unnest(ents) AS entity FROM d",
)
def entity_extract(spark, sf_dir):
    return units(spark, sf_dir).select("unit_id", F.explode(T.entities(F.col("text"))).alias("entity"))


@register(
    "token_stats",
    f"WITH {S.UNITS}, t AS (SELECT unit_id, unnest({S.tokens('text')}) AS term FROM u) SELECT term, count(*) AS n_occurrences, count(DISTINCT unit_id) AS n_units FROM t GROUP BY 1",
)
def token_stats(spark, sf_dir):
    t = units(spark, sf_dir).select("unit_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    per_unit = t.groupBy("term", "unit_id").agg(F.count("*").alias("tf"))
    return per_unit.groupBy("term").agg(F.sum("tf").alias("n_occurrences"), F.count("*").alias("n_units"))


@register(
    "fingerprint_dups",
    f"WITH {S.UNITS}, f AS (SELECT unit_id, {S.fingerprint('text')} AS fp FROM u WHERE text IS NOT NULL) SELECT fp, count(*) AS n, min(unit_id) AS first_id FROM f GROUP BY fp HAVING count(*) > 1",
)
def fingerprint_dups(spark, sf_dir):
    f = units(spark, sf_dir).where("text is not null").select("unit_id", T.fingerprint(F.col("text")).alias("fp"))
    return f.groupBy("fp").agg(F.count("*").alias("n"), F.min("unit_id").alias("first_id")).where("n > 1")


@register(
    "bm25_topk",
    f"WITH {S.UNITS}, {S.FACT_QUERIES}, {S.bm25('u', 'text', 'fq')} SELECT query_id, unit_id, rank, bm25 FROM (SELECT query_id, unit_id, round(bm, 6) AS bm25, "
    "row_number() OVER (PARTITION BY query_id ORDER BY round(bm, 6) DESC, unit_id)::INT AS rank FROM bm) WHERE rank <= 5",
)
def bm25_first(spark, sf_dir):
    best = bm25_topk(query_terms(fact_queries(spark, sf_dir)), units(spark, sf_dir), 5)
    return best.select("query_id", "unit_id", F.col("bm").alias("bm25"), "rank")


@register("coverage_router", f"WITH {S.UNITS}, {S.FACT_QUERIES}, {S.bm25('u', 'text', 'fq')} SELECT query_id, round(cov, 6) AS cov FROM cov")
def coverage_router(spark, sf_dir):
    q = query_terms(fact_queries(spark, sf_dir))
    return coverage(q, bm25_index(units(spark, sf_dir), q)).withColumn("cov", F.round("cov", 6))


_LAMBDA = (
    r"CASE WHEN regexp_matches(lower(text), '\b(summari[sz]e|overview|recap|round-?up|status|catch up|list|enumerate|everything|all (the|our)|what (do|did) we|tl;?dr)\b') THEN 0.7::DOUBLE "
    "WHEN n_toks > 0 AND n_toks <= 6 AND n_ents / n_toks >= 0.15 THEN 0.25 WHEN n_toks >= 12 THEN 0.6 "
    "ELSE least(0.55, greatest(0.4, 0.5 - CASE WHEN n_toks > 0 THEN n_ents / n_toks ELSE 0 END)) END"
)


@register(
    "query_classes",
    f"WITH {S.FACT_QUERIES}, e AS (SELECT query_id, text, len({S.tokens('text')})::DOUBLE AS n_toks, {S.entities('text')} AS l FROM fq), "
    f"c AS (SELECT query_id, text, n_toks, len({S.first_distinct('l', 16)})::DOUBLE AS n_ents FROM e) SELECT query_id, {S.TEMPORAL} AS temporal, {S.IDENTITY} AS identity, "
    f"(n_ents > 0 AND NOT {S.TEMPORAL}) AS relational, round({_LAMBDA}, 6) AS lam FROM c",
)
def query_classes(spark, sf_dir):
    q = fact_queries(spark, sf_dir)
    text, n_ents = F.col("text"), F.size(T.entities(F.col("text")))
    return q.select(
        "query_id",
        T.is_temporal(text).alias("temporal"),
        T.is_identity_query(text).alias("identity"),
        ((n_ents > 0) & ~T.is_temporal(text)).alias("relational"),
        F.round(T.mmr_lambda(text, n_ents, F.size(T.tokens(text))), 6).alias("lam"),
    )


@register("type_calibrated", f"WITH {S.FACT_QUERIES} SELECT query_id, {S.compat('fq.text', 'f.text')} AS compat FROM fq JOIN eval_facts f USING (id)")
def type_calibrated(spark, sf_dir):
    facts = load(spark, sf_dir, "eval_facts").select("id", F.col("text").alias("fact"))
    return fact_queries(spark, sf_dir).join(facts, "id").select("query_id", T.type_compat(F.col("text"), F.col("fact")).alias("compat"))


@register("snippets", f"SELECT doc_id, {S.snippet('text', 120)} AS snippet FROM documents WHERE text IS NOT NULL")
def snippets(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", T.snippet(F.col("text"), 120).alias("snippet"))


@register("relative_times", f"WITH {S.UNITS} SELECT unit_id, {S.rel_time('ts', NOW_MS)} AS age FROM u WHERE ts IS NOT NULL")
def relative_times(spark, sf_dir):
    return units(spark, sf_dir).where("ts is not null").select("unit_id", T.rel_time(F.col("ts"), F.lit(NOW_MS)).alias("age"))


@register(
    "session_adjacent",
    f"WITH {S.UNITS} SELECT unit_id, lag(unit_id) OVER w AS prev_id, lead(unit_id) OVER w AS next_id FROM u WHERE session_id IS NOT NULL AND session_id <> 'unknown' "
    "WINDOW w AS (PARTITION BY session_id ORDER BY ts NULLS FIRST, seq NULLS FIRST, unit_id)",
)
def session_adjacent(spark, sf_dir):
    return adjacent(units(spark, sf_dir))


@register(
    "first_turns",
    f"WITH {S.UNITS} SELECT session_id, arg_min(unit_id, (ts, seq)) AS unit_id FROM u WHERE session_id IS NOT NULL AND session_id <> 'unknown' GROUP BY 1",
)
def first_turns(spark, sf_dir):
    known = units(spark, sf_dir).where("session_id is not null and session_id <> 'unknown'")
    return known.groupBy("session_id").agg(F.min_by("unit_id", F.struct("ts", "seq")).alias("unit_id"))


@register(
    "retention",
    f"WITH {S.UNITS} SELECT unit_id, ts FROM u WHERE ts >= {NOW_MS - 60 * 86_400_000} ORDER BY ts DESC, seq DESC, unit_id DESC LIMIT 2000",
)
def retention(spark, sf_dir):
    return retain(units(spark, sf_dir), NOW_MS, max_age_ms=60 * 86_400_000).select("unit_id", "ts")


@register(
    "merge_foreign",
    f"WITH {S.UNITS}, m AS (SELECT unit_id, 'mine' AS origin FROM u WHERE role = 'user') SELECT * FROM m UNION ALL SELECT unit_id, 'foreign' FROM u WHERE cwd = '{PROJECT}' AND unit_id NOT IN (SELECT unit_id FROM m)",
)
def merged(spark, sf_dir):
    u = units(spark, sf_dir)
    mine = u.where("role = 'user'").select("unit_id", F.lit("mine").alias("origin"))
    return merge_foreign(mine, u.where(F.col("cwd") == PROJECT).select("unit_id", F.lit("foreign").alias("origin")))


@register(
    "active_context_anti",
    f"WITH {S.UNITS}, f AS (SELECT unit_id, cwd, {S.fingerprint('text')} AS fp FROM u WHERE text IS NOT NULL) SELECT unit_id, fp FROM f WHERE fp NOT IN (SELECT fp FROM f WHERE cwd = '{PROJECT}')",
)
def active_context_anti(spark, sf_dir):
    f = units(spark, sf_dir).where("text is not null").select("unit_id", "cwd", T.fingerprint(F.col("text")).alias("fp"))
    seen = f.where(F.col("cwd") == PROJECT).select("fp").distinct()
    return f.join(seen, "fp", "left_anti").select("unit_id", "fp")


@register(
    "store_stats",
    f"WITH {S.UNITS}, {S.POSTINGS} SELECT count(*) AS units, count(*) FILTER (WHERE cwd = '{PROJECT}') AS in_project, count(*) FILTER (WHERE len(embedding) > 0) AS embedded, "
    "(SELECT count(DISTINCT entity) FROM ue) AS entities FROM u",
)
def stats(spark, sf_dir):
    return store_stats(units(spark, sf_dir, "embedding"), PROJECT)


@register(
    "answer_calibration",
    f"WITH {S.UNITS}, a AS (SELECT unit_id AS answer_id, (length(text) - length(replace(text, '```', ''))) // 3 AS fences FROM u WHERE text IS NOT NULL AND role = 'assistant') "
    "SELECT answer_id, fences::INT AS fences, fences % 2 = 0 AS ok FROM a",
)
def answer_calibration(spark, sf_dir):
    a = units(spark, sf_dir).where("text is not null and role = 'assistant'")
    a = a.select(F.col("unit_id").alias("answer_id"), F.col("text").alias("response"), F.lit("").alias("query"), F.lit("text").alias("expects"))
    return calibrate(a).select("answer_id", "fences", "ok")


@register(
    "evidence_block",
    f"WITH {S.UNITS}, {S.FACT_QUERIES}, {S.bm25('u', 'text', 'fq')}, r AS (SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm, 6) DESC, unit_id) AS rank FROM bm), "
    f"l AS (SELECT query_id, rank, '- [' || {S.rel_time('ts', NOW_MS)} || CASE WHEN coalesce(session_name, '') <> '' THEN ' • \"' || session_name || '\"' ELSE '' END || ' • lexical] ' || {S.snippet('text', 120)} AS line "
    "FROM r JOIN u USING (unit_id) WHERE rank <= 3) "
    "SELECT query_id, '## Earlier evidence (use only if relevant; not authoritative)' || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS block FROM l GROUP BY 1",
)
def evidence_blocks(spark, sf_dir):
    u = units(spark, sf_dir)
    best = bm25_topk(query_terms(fact_queries(spark, sf_dir)), u, 3)
    hits = best.join(u.select("unit_id", "ts", "session_name", "text"), "unit_id")
    return evidence_block(hits.withColumn("reason", F.lit("lexical")), NOW_MS, 120)


@register(
    "rrf_fusion",
    f"WITH f AS (SELECT id AS unit_id, text FROM eval_facts), {S.FACT_QUERIES}, {S.bm25('f', 'text', 'fq')}, "
    "a AS (SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm, 6) DESC, unit_id) AS rank FROM bm), "
    "c AS (SELECT query_id, unit_id, count(*) AS n FROM qt JOIN post USING (term) GROUP BY 1, 2), "
    "b AS (SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, unit_id) AS rank FROM c), "
    "x AS (SELECT * FROM a WHERE rank <= 10 UNION ALL SELECT * FROM b WHERE rank <= 10) SELECT query_id, unit_id, round(sum(1.0::DOUBLE / (59 + rank)), 6) AS rrf FROM x GROUP BY 1, 2",
)
def rrf_fusion(spark, sf_dir):
    q = query_terms(fact_queries(spark, sf_dir))
    index = bm25_index(fact_units(spark, sf_dir), q)
    a = top_k(bm25(q, index).withColumn("bm", F.round("bm", 6)), 10, F.desc("bm"), "unit_id")
    shared = q.join(index.terms, "term").groupBy("query_id", "unit_id").agg(F.count("*").alias("n"))
    return rrf(a, top_k(shared, 10, F.desc("n"), "unit_id")).withColumn("rrf", F.round("rrf", 6))
