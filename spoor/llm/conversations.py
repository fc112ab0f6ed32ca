"""Problem 6: rebuilding conversations from message rows.

Method: a stateful stream. Messages are keyed by a bucket of sessions and a
slice of event time; the keyed state buffers what arrives, in whatever order,
under an event-time watermark. When the watermark passes a slice by the
allowed lateness the slice times out: the messages of each of its sessions are
put in order and emitted with a summary. Slices bound the state and spread a
session that holds a third of all rows over many tasks; summaries of
neighbouring slices combine, so the verdict on a session needs only them.
Buckets hold a few sessions each, as a call of the state function costs far
more than a message.

``conversation_stream`` builds the running stream: what arrives later than the
lateness it allows, after its slice has closed, is dropped, and
``dropped_late`` counts it. A finite table is replayed by ``rebuild``: its files in
several micro-batches, so that slices meet their state again, under a watermark that
waits for all of them, as no order of files is promised; only after the last of
them an end marker arrives, whose event time carries the watermark past everything:
every slice closes, nothing is dropped as late. A slice's state is written anew in each batch that
brings it messages; slices of hours keep it small.

Defined results
* null and ``unknown`` session ids are no sessions;
* rows with the same unit id are one message;
* null or blank texts are no messages, but their session exists: one without
  any message is dropped as empty;
* roles are trimmed and lowered, ``toolresult`` is tool; other or null roles
  are messages of no speaker (they neither ask nor answer);
* times below 10^11 are seconds; null times come first; ties in time are
  ordered by seq (null first), then by unit id;
* a session is broken if its first message is not by the user or if a user
  message has no assistant message after it before the next user message;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from spoor.runtime import fresh_path, load

#: Width of a slice of event time.
SLICE_MS = 6 * 3600 * 1000
#: Rows of the table for each bucket of sessions, where their number is not given.
ROWS_PER_BUCKET = 65_536
#: Lateness a running stream allows before a slice closes.
LATENESS_MS = 7 * 24 * 3600 * 1000
#: Micro-batches in which a table is replayed, at most (it has no more than files).
BATCHES = 4
#: Values below are seconds, not milliseconds.
SECONDS_BELOW = 100_000_000_000
#: Event times are held between 1970 and this, the year 2112 (the order of messages keeps the true time): twice as much still fits a timestamp of nanoseconds.
LAST_MS = 4_500_000_000_000
_END = -1
_USER, _ASSISTANT, _OTHER, _BLANK = 0, 1, 2, 3

EMITTED = (
    "session_id string, slice long, unit_id string, place int, messages int, starts_with_user boolean, "
    "answer_first boolean, asks boolean, open boolean, broken boolean"
)


def _source_path(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """A folder to stream from, and the name of the one file in it that counts."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(hadoop).isFile():
        head, _, name = path.rpartition("/")
        return head, name
    return path, None


def messages(df: DataFrame, buckets: int, slice_ms: int = SLICE_MS) -> DataFrame:
    """Rows as keyed, timed, slim messages: (bucket, slice, session_id, event_time, at, seq, who, unit_id)."""
    ts = F.when(F.abs("ts_ms") < SECONDS_BELOW, F.col("ts_ms") * 1000).otherwise(F.col("ts_ms"))
    at = F.coalesce(ts, F.lit(0)).cast("bigint")
    # a stream drops what is not later than its first watermark, the year 1970
    event = F.greatest(F.lit(1), F.least(F.lit(LAST_MS), at)).cast("bigint")
    role = F.lower(F.trim("role"))
    blank = F.col("text").isNull() | F.btrim("text", F.lit(" \t\r\n\x0b\x0c ")).eqNullSafe("")
    who = (
        F.when(blank, _BLANK).when(role == "user", _USER).when(role == "assistant", _ASSISTANT).otherwise(_OTHER).cast("int")
    )
    return df.where(F.col("session_id").isNotNull() & (F.col("session_id") != "unknown")).select(
        F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("bigint").alias("bucket"),
        F.floor(event / slice_ms).cast("bigint").alias("slice"),
        "session_id",
        F.timestamp_millis(event).alias("event_time"),
        at.alias("at"),
        F.coalesce("seq", F.lit(-1)).cast("bigint").alias("seq"),
        who.alias("who"),
        F.coalesce("unit_id", F.lit("")).alias("unit_id"),
    )


_ROW = struct.Struct("<qqBII")


def _pack(rows) -> bytes:
    out = bytearray()
    for at, seq, who, unit, session in rows:
        name, group = unit.encode(), session.encode()
        out += _ROW.pack(at, seq, who, len(name), len(group)) + name + group
    return bytes(out)


def _unpack(raw: bytes) -> dict[str, list[tuple]]:
    """The messages (at, seq, who, unit) by session."""
    rows, i = {}, 0
    while i < len(raw):
        at, seq, who, n, m = _ROW.unpack_from(raw, i)
        i += _ROW.size
        unit, session = raw[i : i + n].decode(), raw[i + n : i + n + m].decode()
        i += n + m
        rows.setdefault(session, []).append((at, seq, who, unit))
    return rows


def summary(roles: list[int]) -> tuple[int, bool, bool, bool, bool, bool]:
    """(messages, starts with user, answer before any question, asks, ends open, broken) of ordered roles."""
    answer_first = asks = open_ = broken = False
    for who in roles:
        if who == _USER:
            broken |= open_
            asks = open_ = True
        elif who == _ASSISTANT:
            answer_first |= not asks
            open_ = False
    return len(roles), bool(roles) and roles[0] == _USER, answer_first, asks, open_, broken


def _close(slice_ms: int, with_messages: bool):
    names = [f.split()[0] for f in EMITTED.split(", ")]

    def close(key, frames, state):
        bucket, number = key
        if bucket == _END:
            for _ in frames:
                pass
            return
        if state.hasTimedOut:
            (raw,) = state.get
            state.remove()
            out = []
            for session, rows in _unpack(raw).items():
                once = sorted({r[3]: r for r in rows}.values())
                said = [r for r in once if r[2] != _BLANK]
                told = summary([r[2] for r in said])
                out.append((session, number, None, 0, *told))
                if with_messages:
                    out += [(session, number, r[3], i, *told) for i, r in enumerate(said, 1)]
            yield pd.DataFrame(out, columns=names)
            return
        held = bytearray(state.get[0] if state.exists else b"")
        for frame in frames:
            held += _pack(zip(*(frame[c].tolist() for c in ("at", "seq", "who", "unit_id", "session_id"))))
        state.update((bytes(held),))
        state.setTimeoutTimestamp(max((int(number) + 1) * slice_ms, state.getCurrentWatermarkMs() + 1))

    return close


def conversation_stream(slim: DataFrame, lateness_ms: int = LATENESS_MS, slice_ms: int = SLICE_MS, with_messages: bool = False) -> DataFrame:
    """The closed slices of a stream of ``messages``, emitted as the watermark passes them by ``lateness_ms``."""
    return (
        slim.withWatermark("event_time", f"{lateness_ms} milliseconds")
        .groupBy("bucket", "slice")
        .applyInPandasWithState(
            _close(slice_ms, with_messages), EMITTED, "rows binary", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def dropped_late(progress: list) -> int:
    """How many messages the batches of a query (its ``recentProgress``) have dropped as too late."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def rebuild(
    spark: SparkSession,
    path: str,
    with_messages: bool = False,
    buckets: int | None = None,
    slice_ms: int = SLICE_MS,
    batches: int = BATCHES,
) -> DataFrame:
    """Run the stream over the table at ``path`` to its end; the emitted rows, one per closed slice (and message)."""
    folder, only = _source_path(spark, path)
    table = spark.read.parquet(path)
    schema = table.schema
    buckets = buckets or max(1, table.count() // ROWS_PER_BUCKET)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-len(table.inputFiles()) // batches)))
    if only:
        reader = reader.option("pathGlobFilter", only)
    slim = messages(reader.parquet(folder), buckets, slice_ms)
    marker, out, state = (fresh_path(spark, name) for name in ("p6-end", "p6-closed", "p6-state"))
    # no message can be later than the whole span of event times
    lateness_ms = LAST_MS
    spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in slim.schema)).write.parquet(marker)
    end = spark.readStream.schema(slim.schema).parquet(marker)

    def run() -> None:
        """All that has come since the last run of this query."""
        closed = conversation_stream(slim.unionByName(end), lateness_ms, slice_ms, with_messages)
        query = closed.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out)
        query.awaitTermination()

    run()
    spark.range(1).select(
        F.lit(_END).cast("bigint").alias("bucket"),
        F.lit(0).cast("bigint").alias("slice"),
        F.lit("").alias("session_id"),
        F.timestamp_millis(F.lit(LAST_MS + lateness_ms + 2 * slice_ms)).alias("event_time"),
        F.lit(0).cast("bigint").alias("at"),
        F.lit(0).cast("bigint").alias("seq"),
        F.lit(_OTHER).alias("who"),
        F.lit("").alias("unit_id"),
    ).write.mode("append").parquet(marker)
    run()
    return spark.read.schema(EMITTED).parquet(out)


def verdicts(closed: DataFrame) -> DataFrame:
    """(session_id, messages, reason): reason is null for sound conversations.

    A slice that ends with an open question is answered by the next slice that
    holds a message of a user or an assistant, if an assistant's comes first.
    """
    slices = closed.where("place = 0")
    spoken = slices.where("messages > 0")
    w = Window.partitionBy("session_id").orderBy("slice")
    talk = spoken.where("asks OR answer_first").withColumn("next_answers", F.lead("answer_first").over(w))
    unanswered = talk.groupBy("session_id").agg(
        F.max(F.col("broken") | (F.col("open") & ~F.coalesce("next_answers", F.lit(False)))).alias("unanswered")
    )
    heads = slices.groupBy("session_id").agg(
        F.sum("messages").alias("messages"),
        F.min_by("starts_with_user", F.when(F.col("messages") > 0, F.col("slice"))).alias("starts_with_user"),
    )
    reason = (
        F.when(F.col("messages") == 0, "empty")
        .when(~F.col("starts_with_user"), "no opening")
        .when(F.coalesce("unanswered", F.lit(False)), "no reply")
    )
    return heads.join(unanswered, "session_id", "left").select("session_id", "messages", reason.alias("reason"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions to drop: empty, broken or missing replies."""
    return verdicts(rebuild(spark, f"{sf_dir}/trace_units.parquet")).where(F.col("reason").isNotNull()).select("session_id")


def p6_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of all sound conversations in order, with speaker and text."""
    closed = rebuild(spark, f"{sf_dir}/trace_units.parquet", with_messages=True)
    sound = verdicts(closed).where(F.col("reason").isNull()).select("session_id")
    w = Window.partitionBy("session_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = closed.where("place = 0").select(
        "session_id", "slice", F.coalesce(F.sum("messages").over(w), F.lit(0)).alias("before")
    )
    placed = (
        closed.where("place > 0")
        .join(sound, "session_id")
        .join(offsets, ["session_id", "slice"])
        .select("session_id", (F.col("before") + F.col("place")).cast("bigint").alias("turn"), "unit_id")
    )
    role = F.lower(F.trim("role"))
    texts = (
        load(spark, sf_dir, "trace_units")
        .select("unit_id", F.when(role == "toolresult", "tool").otherwise(role).alias("role"), "text")
        .dropDuplicates(["unit_id"])
    )
    return placed.join(texts, "unit_id").select("session_id", "turn", "unit_id", "role", "text")


QUERIES = {"p6_found": p6_found, "p6_conversations": p6_conversations}

_SQL = """
WITH m AS (
  SELECT DISTINCT unit_id, session_id, seq, lower(trim(role)) AS r,
    coalesce(CASE WHEN abs(ts_ms) < 100000000000 THEN ts_ms * 1000 ELSE ts_ms END, 0) AS t,
    text IS NULL OR trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) = '' AS blank
  FROM trace_units WHERE session_id IS NOT NULL AND session_id <> 'unknown'
), o AS (
  SELECT *, row_number() OVER w AS turn,
    lead(CASE WHEN r IN ('user', 'assistant') THEN r END IGNORE NULLS) OVER w AS next_talk
  FROM m WHERE NOT blank WINDOW w AS (PARTITION BY session_id ORDER BY t, coalesce(seq, -1), unit_id)
), bad AS (
  SELECT session_id FROM o GROUP BY 1
  HAVING bool_or(turn = 1 AND coalesce(r, '') <> 'user') OR bool_or(r = 'user' AND coalesce(next_talk, 'user') = 'user')
  UNION SELECT session_id FROM m GROUP BY 1 HAVING bool_and(blank)
)
"""
ORACLE = {
    "p6_found": _SQL + "SELECT session_id FROM bad",
    "p6_conversations": _SQL
    + """SELECT session_id, turn, unit_id, CASE WHEN r = 'toolresult' THEN 'tool' ELSE r END AS role, u.text AS text
FROM o JOIN (SELECT unit_id, any_value(text) AS text FROM trace_units GROUP BY 1) u USING (unit_id)
WHERE session_id NOT IN (SELECT session_id FROM bad)""",
}
