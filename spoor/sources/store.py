"""A store of units on disk: load, append, merge, retain, clear; legacy imports; run files."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.functions.text import entities, fingerprint, tokens
from spoor.functions.vectors import dequantize, quantize
from spoor.operators.identity import sticky_identity
from spoor.operators.vector import embed
from spoor.sources.units import DAY_MS, enrich, merge_foreign, retain

UNIT_SCHEMA = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("unit_id", "session_id", "session_name", "cwd", "role", "text")),
        T.StructField("ts", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("fp", T.StringType()),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("ents", T.ArrayType(T.StringType())),
    ]
)
VECTOR_SCHEMA = "unit_id string, model string, scale float, q array<tinyint>"


@dataclass
class UnitStore:
    """Units in ``path/units`` by project, compact vectors in ``path/vectors``.

    Writers only append; a reader takes each id once, the first by arrival,
    so two writers at once lose nothing.
    """

    spark: SparkSession
    path: str
    max_units: int = 2_000
    max_age_ms: int = 90 * DAY_MS

    def _table(self, name: str, schema) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return self.spark.createDataFrame([], schema)

    def load(self, now_ms: int | None = None, model: str | None = None) -> DataFrame:
        """The units, retained as of ``now_ms``, with the vectors of ``model``; those of other models are left out."""
        units = self._table("units", UNIT_SCHEMA)
        once = units.groupBy("unit_id").agg(F.min_by(F.struct(*units.columns), "seq").alias("u")).select("u.*")
        kept = once if now_ms is None else retain(once, now_ms, self.max_age_ms, self.max_units)
        vectors = self._table("vectors", VECTOR_SCHEMA).where(F.col("model").eqNullSafe(model) if model else F.lit(True))
        last = vectors.groupBy("unit_id").agg(F.first("scale").alias("scale"), F.first("q").alias("q"))
        return kept.join(last.select("unit_id", dequantize(F.col("scale").cast("double"), F.col("q")).alias("embedding")), "unit_id", "left")

    def append(self, raw: DataFrame) -> None:
        """Capture raw messages: cut, filter, derive, append."""
        enrich(raw).select(*UNIT_SCHEMA.names).write.mode("append").partitionBy("cwd").parquet(f"{self.path}/units")

    def merge(self, foreign: DataFrame) -> None:
        """Append the units of another store whose ids are new here."""
        mine = self._table("units", UNIT_SCHEMA).select(*UNIT_SCHEMA.names)
        new = foreign.select(*UNIT_SCHEMA.names).join(mine.select("unit_id"), "unit_id", "left_anti")
        new.write.mode("append").partitionBy("cwd").parquet(f"{self.path}/units")

    def mint(self, raw: DataFrame, now_ms: int) -> DataFrame:
        """Raw messages with new ids: the time and a number, both in base 36, distinct within the batch."""
        number = F.lower(F.conv(F.monotonically_increasing_id().cast("string"), 10, 36))
        return raw.withColumn("unit_id", F.concat(F.lit("u"), F.lower(F.conv(F.lit(str(now_ms)), 10, 36)), F.lit("_"), number))

    def identity(self, fresh: DataFrame) -> DataFrame:
        """Fresh names (one row of ``identity_facts``), filled in from the newest saved ones, and saved if any is known."""
        saved = self._table("identity", f"{', '.join(f'{n} {t}' for n, t in fresh.dtypes)}, saved_at timestamp")
        newest = saved.orderBy(F.desc("saved_at")).limit(1).drop("saved_at")
        blank = self.spark.range(1).select(*(F.lit(None).cast(t).alias(c) for c, t in fresh.dtypes))
        names = sticky_identity(fresh, newest if newest.count() else blank).collect()
        now = self.spark.createDataFrame(names, fresh.schema)
        if names and (names[0]["agent_name"] or names[0]["user_name"]):
            now.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/identity")
        return now

    def embed(self, encoder, model: str, limit: int | None = None) -> None:
        """Give units without a vector of ``model`` one by ``encoder`` (a column of texts to a column of vectors), at most ``limit`` in order of arrival."""
        self.save_vectors(embed(self.load(model=model), encoder, limit), model)

    def save_vectors(self, vectors: DataFrame, model: str) -> None:
        """Append vectors (unit_id, embedding) in 8 bits an element."""
        packed = vectors.where(F.size("embedding") > 0).withColumn("c", quantize(F.col("embedding")))
        packed.select("unit_id", F.lit(model).alias("model"), "c.scale", "c.q").write.mode("append").parquet(f"{self.path}/vectors")

    def missing_vectors(self, limit: int | None = None, model: str | None = None) -> DataFrame:
        """Units without a vector, in order of arrival."""
        rows = self.load(model=model).where(F.col("embedding").isNull()).orderBy("seq", "unit_id").select("unit_id", "text")
        return rows if limit is None else rows.limit(limit)

    def clear(self) -> None:
        for name, schema in (("units", UNIT_SCHEMA), ("vectors", VECTOR_SCHEMA)):
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/{name}")


LEGACY = T.StructType(
    [
        T.StructField(
            "units",
            T.ArrayType(
                T.StructType(
                    [
                        *(T.StructField(n, T.StringType()) for n in ("id", "sessionId", "sessionName", "cwd", "role", "text")),
                        T.StructField("timestamp", T.LongType()),
                        T.StructField("entities", T.ArrayType(T.StringType())),
                        T.StructField("embedding", T.ArrayType(T.DoubleType())),
                        T.StructField("fp", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("embedder", T.StringType()),
    ]
)


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """Units of JSON stores of the old layout, vectors inline; tokens are made again. A torn file gives none."""
    files = spark.read.schema(LEGACY).option("mode", "DROPMALFORMED").json(path, multiLine=True)
    rows = files.select("embedder", F.posexplode("units").alias("seq", "u")).where("u.id is not null")
    return rows.select(
        F.col("u.id").alias("unit_id"),
        F.col("u.sessionId").alias("session_id"),
        F.col("u.sessionName").alias("session_name"),
        "u.cwd",
        "u.role",
        "u.text",
        F.col("u.timestamp").alias("ts"),
        F.col("seq").cast("bigint").alias("seq"),
        F.coalesce("u.fp", fingerprint(F.col("u.text"))).alias("fp"),
        tokens(F.col("u.text")).alias("tokens"),
        F.coalesce("u.entities", entities(F.col("u.text"))).alias("ents"),
        "u.embedding",
        F.col("embedder").alias("model"),
    )


class TornStore(ValueError):
    """A store file that cannot be read; nothing is written over it."""


def torn_files(spark: SparkSession, path: str) -> list[str]:
    """The files at ``path`` that are no store of the old layout."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("content"))
    return [r["path"] for r in raw.where(F.from_json("content", LEGACY)["units"].isNull()).select("path").collect()]


def migrate(spark: SparkSession, legacy: str, store: UnitStore, backup: str | None = None) -> DataFrame:
    """Move a legacy store into a new one: (units, vectors, bytes_before, bytes_after).

    A torn file stops the move before anything is written. The files are copied
    to ``backup`` first, if given.
    """
    if torn := torn_files(spark, legacy):
        raise TornStore(f"cannot read {torn}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()

    def size(path: str) -> int:
        at = hadoop.Path(path)
        fs = at.getFileSystem(conf)
        return fs.getContentSummary(at).getLength() if fs.exists(at) else 0

    if backup is not None:
        a, b = hadoop.Path(legacy), hadoop.Path(backup)
        hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
    rows = read_legacy(spark, legacy)
    store.merge(rows)
    vectors = rows.where(F.size("embedding") > 0)
    model = (vectors.select("model").first() or [None])[0]
    store.save_vectors(vectors.select("unit_id", "embedding"), model or "unknown")
    moved = rows.agg(F.count("*").alias("units"), F.count_if(F.size("embedding") > 0).alias("vectors"))
    return moved.withColumn("bytes_before", F.lit(size(legacy)).cast("bigint")).withColumn("bytes_after", F.lit(size(store.path)).cast("bigint"))


# --- conversations with questions, and run files ------------------------------------------


def read_dialogues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Turns (sample_id, session, turn, dia_id, text) and questions (sample_id, i, question, answer, category, evidence).

    A sample's conversation maps ``session_<n>`` to its turns; other keys, such
    as dates, are skipped. Sessions are ordered by their number.
    """
    sample = "sample_id string, conversation map<string, string>, qa array<struct<question:string,answer:string,category:int,evidence:array<string>>>"
    rows = spark.read.schema(sample).json(path, multiLine=True)
    turn = "array<struct<dia_id:string,speaker:string,text:string>>"
    sessions = rows.select("sample_id", F.explode("conversation").alias("key", "value")).where(F.col("key").rlike(r"^session_\d+$"))
    turns = sessions.select("sample_id", F.regexp_extract("key", r"\d+", 0).cast("int").alias("session"), F.posexplode(F.from_json("value", turn)).alias("turn", "t"))
    questions = rows.select("sample_id", F.posexplode("qa").alias("i", "q")).select("sample_id", "i", "q.*")
    return turns.select("sample_id", "session", "turn", "t.dia_id", "t.text"), questions


def paired_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs side by side; fails if they are not of the same questions."""
    both = a.select("i", F.struct(*a.columns).alias("x")).join(b.select("i", F.struct(*b.columns).alias("y")), "i", "full")
    bad = both.where(F.col("x").isNull() | F.col("y").isNull() | (F.col("x.q") != F.col("y.q"))).count()
    if bad:
        raise ValueError(f"{bad} questions of the two runs do not match")
    return both


def number(raw: str | None, default: float | None = None, low: float = -math.inf, high: float = math.inf) -> float | None:
    """A finite number from a setting, held within bounds; the default for anything else."""
    try:
        value = float(raw) if raw not in (None, "") else math.nan
    except ValueError:
        value = math.nan
    return min(high, max(low, value)) if math.isfinite(value) else default


def token_estimate(n_chars: int) -> int:
    return -(-n_chars // 4)


def dump(path: str, data: dict) -> None:
    """A legacy store for tests and tools."""
    with open(path, "w", encoding="utf-8") as out:
        json.dump(data, out)
