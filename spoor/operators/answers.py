"""Checks on answers: fences, JSON, mention of entities, verbatim evidence; and the evidence block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.functions.text import entities, rel_time, snippet, strip_fences

HEADER = "## Earlier evidence (use only if relevant; not authoritative)"


def calibrate(answers: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(answer_id, ok, warnings, fences, json_parses, entity_coverage, verbatim) of answers.

    ``answers`` has answer_id, response, query and expects; ``hits`` has
    answer_id, unit_id and text of the evidence given, in rank order.
    """
    lower = F.lower("response")
    ents = entities(F.col("query"))
    found = F.size(F.filter(ents, lambda e: F.contains(lower, e)))
    base = answers.select(
        "*",
        F.regexp_count("response", F.lit("```")).alias("fences"),
        F.when(F.col("expects") == "json", F.try_parse_json(strip_fences(F.col("response"))).isNotNull()).alias("json_parses"),
        F.when(F.size(ents) > 0, found / F.size(ents)).otherwise(F.lit(1.0)).alias("entity_coverage"),
    )
    if hits is None:
        base = base.withColumn("verbatim", F.lit(False))
    else:
        snip = F.lower(F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 80))
        shown = hits.select("answer_id", snip.alias("snip")).where(F.length("snip") > 30).groupBy("answer_id").agg(F.collect_list("snip").alias("snips"))
        base = base.join(shown, "answer_id", "left").withColumn(
            "verbatim", F.coalesce(F.exists("snips", lambda s: F.contains(F.lower(F.col("response")), s)), F.lit(False))
        )
    warnings = F.filter(
        F.array(
            F.when(F.col("fences") % 2 != 0, "unbalanced code fence"),
            F.when(~F.col("json_parses"), "no valid JSON"),
            F.when(F.col("entity_coverage") == 0, "mentions no entity of the query"),
            F.when(F.col("verbatim"), "repeats evidence word for word"),
        ),
        lambda w: w.isNotNull(),
    )
    return base.select("answer_id", (F.size(warnings) == 0).alias("ok"), warnings.alias("warnings"), "fences", "json_parses", "entity_coverage", "verbatim")


def evidence_lines(hits: DataFrame, now_ms: int, n: int = 220) -> DataFrame:
    """(query_id, lines): a line for each hit of a query, best first. Hits are a few rows a query."""
    session = F.when(F.col("session_name").isNotNull() & (F.col("session_name") != ""), F.concat(F.lit(' • "'), F.col("session_name"), F.lit('"'))).otherwise(F.lit(""))
    line = F.concat(F.lit("- ["), rel_time(F.col("ts"), F.lit(now_ms)), session, F.lit(" • "), F.col("reason"), F.lit("] "), snippet(F.col("text"), n))
    lines = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return lines.select("query_id", F.transform("lines", lambda s: s["line"]).alias("lines"))


def evidence_block(hits: DataFrame, now_ms: int, n: int = 220, header: str = HEADER) -> DataFrame:
    """(query_id, block): the hits of each query as one text, best first."""
    return evidence_lines(hits, now_ms, n).select("query_id", F.concat_ws("\n", F.lit(header), F.array_join("lines", "\n")).alias("block"))
