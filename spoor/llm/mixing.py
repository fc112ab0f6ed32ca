"""Problem 9: mixing sources to target weights.

Method: a time-varying curriculum. Each source has a weight schedule over
training time t in [0, 1], here linear: share * (1 + ramp * (2t - 1)), with
ramps that cancel out, so that all weights always sum to the sum of shares.
Its integral is the source's cumulative demand for tokens; inverted in closed
form at the token where a copy of a document begins, it gives the copy its
training position, by which the mixture is range-sorted.

The tokens before a document within its source come from a two-level running
sum: totals of hash slices of each source, a running sum of those (a small
table: sources times slices), and a running sum within a slice. No task holds
a whole source, even one with a third of all rows.

Defined results
* sources compare trimmed and lowered; null or blank ones are no source, and
  sources without a target are not used, but their tokens count in the total;
* the budget is the total of the tokens of all documents, each id once
  (policy ``keep``): where a source falls short its part stays empty, and all others
  have exactly their share of the budget. With policy ``shrink`` the budget is the most
  that lets all sources that have documents keep their shares to each other;
* a source gives target_share * budget tokens, at most max_repeats times its
  own: it then falls short, and its documents spread over the whole time. The
  report finds this in the mixture: every document is placed as often as it may be,
  and still the tokens placed are fewer than wanted;
* copy j of a document begins j times the source's tokens later; copies whose
  middle lies beyond the source's tokens to give are left out;
* documents without a token are not used; a source named twice in the targets
  has the sum of its shares and its largest cap; null shares or caps count 0;
* empty tables give an empty mixture, and a report of zeros for each target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoor.llm.tokens import VOCABULARY, document_tokens
from spoor.runtime import load, materialize

#: Documents wished for in a hash slice of a source.
SLICE = 50_000
#: Steepest ramp of a schedule.
STEEPEST = 0.5


def _source(name: str):
    clean = F.lower(F.btrim(F.col(name).cast("string"), F.lit(" \t\r\n")))
    return F.when(clean != "", clean)


def source_plan(sizes: DataFrame, targets: DataFrame, policy: str = "keep") -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, budget, want, give, ramp) of each target source.

    ``sizes`` is (doc_id, n_tokens, source). The result has a row per target.
    """
    wanted = (
        targets.select(_source("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(0)).alias("m"))
        .where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.sum("s").alias("target_share"), F.max("m").alias("max_repeats"))
    )
    have = sizes.groupBy("source").agg(F.count_if(F.col("n_tokens") > 0).alias("documents"), F.sum("n_tokens").alias("tokens"))
    budget = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("budget"))
    plan = wanted.join(have, "source", "left").crossJoin(F.broadcast(budget))
    cap = F.col("max_repeats") * F.col("tokens")
    want = F.col("target_share") * F.col("budget")
    plan = plan.select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        "budget",
    )
    if policy == "shrink":
        # the targets are few, so one window over them is small
        there = Window.partitionBy(F.lit(0))
        rest = F.sum(F.when(cap > 0, F.col("target_share"))).over(there)
        share = F.when(cap > 0, F.col("target_share") / rest).otherwise(F.lit(0.0))
        plan = plan.withColumn("target_share", share)
        plan = plan.withColumn("budget", F.least(F.col("budget").cast("double"), F.coalesce(F.min(F.when(F.col("target_share") > 0, cap / F.col("target_share"))).over(there), F.lit(0.0))))
    plan = plan.withColumn("want", want).withColumn("give", F.least(want, cap.cast("double")))
    # sources that repeat more come later; the targets are few, so one window over them is small
    every = Window.partitionBy(F.lit(0))
    lean = F.col("max_repeats") - F.sum(F.col("target_share") * F.col("max_repeats")).over(every) / F.sum("target_share").over(every)
    plan = plan.withColumn("lean", F.coalesce(lean, F.lit(0.0)))
    top = F.max(F.abs("lean")).over(every)
    return plan.withColumn("ramp", F.when(top > 0, STEEPEST * F.col("lean") / top).otherwise(F.lit(0.0))).drop("lean")


def _sizes(documents: DataFrame, vocabulary: str) -> DataFrame:
    sizes = document_tokens(documents, _source("source"), vocabulary=vocabulary)
    return materialize(sizes.select("doc_id", "n_tokens", F.col("keep0").alias("source")), "p9-sizes")


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, policy: str = "keep") -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, copy, n_tokens, position) sorted by position, and the source plan."""
    sizes = _sizes(documents, vocabulary)
    plan = materialize(source_plan(sizes, targets, policy), "p9-plan")
    slices = max(1, -(-sizes.count() // SLICE))
    used = (
        sizes.where("n_tokens > 0")
        .join(F.broadcast(plan.where("give > 0").select("source", F.col("tokens").alias("total"), "want", "give", "ramp", "max_repeats")), "source")
        .withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)))
    )
    w = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = used.groupBy("source", "slice").agg(F.sum("n_tokens").alias("n")).select(
        "source", "slice", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")
    )
    v = Window.partitionBy("source", "slice").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    begin = used.withColumn("within", F.coalesce(F.sum("n_tokens").over(v), F.lit(0))).join(starts, ["source", "slice"])
    begin = begin.withColumn("begin", F.col("before") + F.col("within"))
    middle = F.col("begin") + F.col("n_tokens") / 2
    copies = F.least(F.col("max_repeats"), F.floor((F.col("give") - middle) / F.col("total")) + 1).cast("int")
    copied = begin.withColumn("copies", copies).where("copies > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    # demand(t) = want * (t + ramp * (t^2 - t)); x is the share of the source's tokens gone before this copy
    x = (F.col("copy") * F.col("total") + F.col("begin")) / F.col("give")
    r = F.col("ramp")
    root = F.sqrt((1 - r) * (1 - r) + 4 * r * x)
    position = F.when(F.abs(r) < 1e-9, x).otherwise(2 * x / ((1 - r) + root))
    mixed = copied.select("doc_id", "source", "copy", "n_tokens", position.alias("position"))
    return mixed.orderBy("position", "source", "doc_id", "copy"), plan


def mix_report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, budget_share, actual_share, documents, uses, tokens, used_tokens, short) of each target.

    ``budget_share`` is of the budget, ``actual_share`` of the tokens placed.
    """
    given = mixed.groupBy("source").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("used_tokens"))
    joined = plan.join(given, "source", "left").na.fill(0, ["uses", "used_tokens"])
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))
    of = lambda t: F.when(t > 0, F.col("used_tokens") / t).otherwise(F.lit(0.0))
    short = (F.col("used_tokens") < F.col("want")) & (F.col("uses") >= F.col("documents") * F.col("max_repeats"))
    return joined.select(
        "source", "target_share", F.round(of(F.col("budget")), 6).alias("budget_share"), F.round(of(total), 6).alias("actual_share"), "documents", "uses", "tokens", "used_tokens", short.alias("short")
    )


def _mixed(spark: SparkSession, sf_dir: str, policy: str = "keep") -> tuple[DataFrame, DataFrame]:
    return mixture(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), policy=policy)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that fall short of their target however often they may repeat."""
    mixed, plan = _mixed(spark, sf_dir)
    return mix_report(mixed, plan).where("short").select("source")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture in training order."""
    return _mixed(spark, sf_dir)[0].withColumn("position", F.round("position", 9))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source, of the tokens of all documents."""
    return mix_report(*_mixed(spark, sf_dir))


def p9_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in the largest mixture that keeps all shares of sources with documents."""
    return mix_report(*_mixed(spark, sf_dir, "shrink"))


QUERIES = {"p9_found": p9_found, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_shrunk": p9_shrunk}
# which sources fall short is the same in characters as in tokens
ORACLE: dict[str, str] = {
    "p9_found": """
WITH d AS (SELECT doc_id, max(length(text)) AS n, any_value(lower(trim(source, ' ' || chr(9) || chr(10) || chr(13)))) AS source FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
t AS (SELECT lower(trim(source)) AS source, sum(target_share) AS share, max(max_repeats) AS repeats FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
h AS (SELECT source, sum(n) AS n FROM d GROUP BY 1)
SELECT t.source FROM t LEFT JOIN h USING (source) WHERE repeats * coalesce(h.n, 0) < share * (SELECT sum(n) FROM d)"""
}
