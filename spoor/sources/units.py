"""The unit table: one row per unit, with normal roles and times; retention, merging, statistics, sidecars."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoor.functions.text import entities, fingerprint, tokens
from spoor.runtime import load

DAY_MS = 86_400_000
#: Longest texts kept of any unit, and of a tool.
TEXT_CAP, TOOL_CAP = 4_000, 500


def normal_role(role: Column) -> Column:
    clean = F.lower(F.trim(role))
    return F.when(clean == "toolresult", "tool").otherwise(clean)


def normal_ts(ts_ms: Column) -> Column:
    """Milliseconds, where some writers gave seconds."""
    return F.when(F.abs(ts_ms) < 100_000_000_000, ts_ms * 1000).otherwise(ts_ms)


def normal_entities(found: Column) -> Column:
    clean = F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != "")))


def units(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """(unit_id, session_id, cwd, role, text, ts, seq, ents, extra...) of the trace units, each once."""
    columns = ["unit_id", "session_id", "session_name", "cwd", "role", "text", "ts_ms", "entities", "seq", *extra]
    return (
        load(spark, sf_dir, "trace_units")
        .select(*columns)
        .dropDuplicates(["unit_id"])
        .select(
            "unit_id",
            "session_id",
            "session_name",
            "cwd",
            normal_role(F.col("role")).alias("role"),
            "text",
            normal_ts(F.col("ts_ms")).alias("ts"),
            "seq",
            normal_entities(F.col("entities")).alias("ents"),
            *extra,
        )
    )


def enrich(raw: DataFrame, full_text: str = "text", extractor=None) -> DataFrame:
    """What is derived at capture: cut text, fingerprint of the full text, tokens and entities of the cut one.

    ``extractor`` (a column of texts to a column of arrays of names) adds what a language model finds to the patterns.
    Rows of other roles, of fewer than three signs or of marks alone are no units.
    """
    kept = raw.where(
        F.col("role").isin("user", "assistant", "tool") & (F.length(F.trim(full_text)) >= 3) & F.col(full_text).rlike("[A-Za-z0-9]")
    )
    return (
        kept.withColumn("fp", fingerprint(F.col(full_text)))
        .withColumn("text", F.expr(f"left({full_text}, case when role = 'tool' then {TOOL_CAP} else {TEXT_CAP} end)"))
        .withColumn("tokens", tokens(F.col("text")))
        .withColumn("ents", entities(F.col("text"), extractor(F.col("text")) if extractor else None))
    )


def retain(df: DataFrame, now_ms: int, max_age_ms: int = 90 * DAY_MS, max_units: int = 2_000, id_col: str = "unit_id") -> DataFrame:
    """Units young enough, and of these the newest; limits of 0 or less are none. Ties keep the later arrival."""
    kept = df.where(F.col("ts") >= now_ms - max_age_ms) if max_age_ms > 0 else df
    if max_units <= 0:
        return kept
    # a top-n sort, not a window over one partition
    return kept.orderBy(F.desc("ts"), F.desc("seq"), F.desc(id_col)).limit(max_units)


def merge_foreign(mine: DataFrame, foreign: DataFrame, id_col: str = "unit_id") -> DataFrame:
    """Mine, and those of another writer whose ids are new."""
    return mine.unionByName(foreign.join(mine.select(id_col), id_col, "left_anti"))


def store_stats(df: DataFrame, cwd: str) -> DataFrame:
    """One row: units, units of the project, distinct entities, embedded units."""
    ents = df.select(F.explode("ents").alias("e")).agg(F.count_distinct("e").alias("entities"))
    counts = df.agg(
        F.count("*").alias("units"),
        F.count_if(F.col("cwd") == cwd).alias("in_project"),
        F.count_if(F.size("embedding") > 0).alias("embedded"),
    )
    return counts.crossJoin(ents)


# --- the binary sidecar -----------------------------------------------------------

#: The head of a sidecar file (fixed value of the format).
_MAGIC = b"ZMEM1"


def encode_sidecar(rows: list[tuple[str, float, list[int]]]) -> bytes:
    """Records (id, scale, bytes) of equal length in the sidecar's layout; others are left out."""
    dim = len(rows[0][2]) if rows else 0
    kept = [r for r in rows if len(r[2]) == dim]
    out = bytearray(_MAGIC + struct.pack("<BII", 1, len(kept), dim))
    for unit, scale, q in kept:
        name = unit.encode()
        out += struct.pack("<H", len(name)) + name + struct.pack(f"<f{dim}b", scale, *q)
    return bytes(out)


def decode_sidecar(raw: bytes) -> list[tuple[str, float, list[int]]]:
    """Records of a sidecar; a wrong head gives none, a torn end the whole ones before it."""
    if raw[:5] != _MAGIC or len(raw) < 14:
        return []
    _, count, dim = struct.unpack_from("<BII", raw, 5)
    rows, at = [], 14
    for _ in range(count):
        if at + 2 > len(raw):
            break
        (n,) = struct.unpack_from("<H", raw, at)
        if at + 2 + n + 4 + dim > len(raw):
            break
        unit = raw[at + 2 : at + 2 + n].decode()
        scale, *q = struct.unpack_from(f"<f{dim}b", raw, at + 2 + n)
        rows.append((unit, scale, q))
        at += 2 + n + 4 + dim
    return rows


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(unit_id, scale, q) of all sidecar files below a path."""

    def rows(batches):
        for batch in batches:
            found = [r for raw in batch.column(0).to_pylist() for r in decode_sidecar(raw)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.float32()), pa.array([r[2] for r in found], pa.list_(pa.int8()))],
                names=["unit_id", "scale", "q"],
            )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(rows, "unit_id string, scale float, q array<tinyint>")


def adjacent(df: DataFrame) -> DataFrame:
    """(unit_id, prev_id, next_id) within each session, by time and arrival. Units of no session have none.

    The session ``unknown`` stands for no session; leaving it out also keeps the
    largest key out of the window.
    """
    w = Window.partitionBy("session_id").orderBy("ts", "seq", "unit_id")
    known = df.where(F.col("session_id").isNotNull() & (F.col("session_id") != "unknown"))
    return known.select("unit_id", F.lag("unit_id").over(w).alias("prev_id"), F.lead("unit_id").over(w).alias("next_id"))
