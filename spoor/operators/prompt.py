"""What a host program shows its model: evidence with the names told so far, and the answer of a recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.functions.text import is_identity_query, rel_time
from spoor.operators.answers import HEADER, evidence_lines
from spoor.operators.identity import identity_facts, identity_line, sticky_identity
from spoor.operators.retrieval import Options, retrieve

#: What a recall says that finds nothing (fixed value).
NOTHING = "No matching memory."
#: Hits that a recall returns.
RECALL_K = 8


def _hits(queries: DataFrame, units: DataFrame, options: Options, now_ms: int, n: int, **found) -> DataFrame:
    hits = retrieve(queries, units, options, **found).join(units.select("unit_id", "ts", "session_name", "text"), "unit_id")
    return evidence_lines(hits, now_ms, n)


def compose(queries: DataFrame, units: DataFrame, now_ms: int, options: Options | None = None, n: int = 120, saved: DataFrame | None = None, **found) -> DataFrame:
    """(query_id, block, hits): the block put before each query (query_id, text, cwd, session_id, now, first_turn).

    On the first turn of a session and for questions about names the line that
    tells the names comes first; ``saved`` (one row as of ``identity_facts``) fills in names that no unit tells any more. Queries
    with neither a hit nor a line have no row. ``found`` goes on to ``retrieve`` (context, dense, entity_vectors).
    """
    names = identity_facts(units.where("text IS NOT NULL"))
    if saved is not None:
        names = sticky_identity(names, saved)
    line = names.select(identity_line(rel_time(F.col("agent_name_ts"), F.lit(now_ms))).alias("line"))
    lines = _hits(queries, units, options or Options(), now_ms, n, **found)
    asks = F.coalesce("first_turn", F.lit(False)) | is_identity_query(F.col("text"))
    # the names are one row
    all_ = queries.select("query_id", asks.alias("asks")).crossJoin(F.broadcast(line)).join(lines, "query_id", "left")
    told = F.when(F.col("asks"), F.col("line"))
    block = F.concat_ws("\n", F.lit(HEADER), told, F.array_join("lines", "\n"))
    return all_.where(F.col("lines").isNotNull() | told.isNotNull()).select("query_id", block.alias("block"), F.coalesce(F.size("lines"), F.lit(0)).alias("hits"))


def recall(queries: DataFrame, units: DataFrame, now_ms: int, options: Options | None = None, n: int = 220, **found) -> DataFrame:
    """(query_id, text, hits): the answer to each asked recall, and how many units it shows; every query has a row."""
    lines = _hits(queries, units, options or Options(top_k=RECALL_K), now_ms, n, **found)
    text = F.when(F.col("lines").isNotNull(), F.concat_ws("\n", F.lit(HEADER), F.array_join("lines", "\n"))).otherwise(F.lit(NOTHING))
    return queries.select("query_id").join(lines, "query_id", "left").select("query_id", text.alias("text"), F.coalesce(F.size("lines"), F.lit(0)).alias("hits"))
