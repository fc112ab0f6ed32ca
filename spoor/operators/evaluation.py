"""Retrieval and answer metrics, and paired tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERMUTATIONS = 20_000


def recall_mrr(gold_ranks: DataFrame, by: str | None = None) -> DataFrame:
    """r1, r3, r5, r10 and mrr over rows (query_id, rank of the first gold hit or null)."""
    hit = lambda k: F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double"))
    metrics = [hit(k).alias(f"r{k}") for k in (1, 3, 5, 10)] + [F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count("*").alias("n")]
    return (gold_ranks.groupBy(by) if by else gold_ranks.groupBy()).agg(*metrics)


def answer_words(text: Column) -> Column:
    """Lower-case words of an answer without articles and marks."""
    s = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?<![a-z0-9_])(a|an|the)(?![a-z0-9_])", " ")
    s = F.regexp_replace(s, r"[^a-z0-9_\s]", " ")
    return F.filter(F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " "), lambda w: w != "")


def _overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two short arrays."""
    count = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))


def answer_scores(pred: Column, gold: Column) -> tuple[Column, Column, Column]:
    """(f1, em, bleu1) of an answer: word overlap, equality, share of predicted words that occur in the gold."""
    p, g = answer_words(pred), answer_words(gold)
    common = _overlap(p, g)
    precision, recall = common / F.size(p), common / F.size(g)
    f1 = F.when((F.size(p) > 0) & (F.size(g) > 0) & (common > 0), 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    em = (F.array_join(p, " ") == F.array_join(g, " ")).cast("int")
    bleu = F.when(F.size(p) > 0, F.size(F.filter(p, lambda w: F.array_contains(g, w))) / F.size(p)).otherwise(F.lit(0.0))
    return f1, em, bleu


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, x, y): the values of two runs for the questions both have."""
    return a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)


def mcnemar(pairs: DataFrame) -> DataFrame:
    """b, c and p of the exact two-sided test and of the normal one with continuity correction."""
    n = pairs.agg(F.count_if((F.col("x") == 1) & (F.col("y") == 0)).alias("b"), F.count_if((F.col("x") == 0) & (F.col("y") == 1)).alias("c"))
    m, k = F.col("b") + F.col("c"), F.least("b", "c")
    # the terms of the tail one from the other: ln C(m, i + 1) = ln C(m, i) + ln((m - i) / (i + 1))
    first = -m * F.log(F.lit(2.0))

    def step(s: Column, i: Column) -> Column:
        ln = s["ln"] + F.log((m - i) / (i + 1))
        return F.struct((s["sum"] + F.exp(ln)).alias("sum"), ln.alias("ln"))

    places = F.filter(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")), lambda i: i < k)
    tail = F.aggregate(places, F.struct(F.exp(first).alias("sum"), first.alias("ln")), step)["sum"]
    z = F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)) / F.sqrt(m)
    return n.select(
        "b",
        "c",
        F.when(m == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)).alias("p_exact"),
        F.when(m == 0, 1.0).otherwise(2 * (1 - (1 + erf(z / F.sqrt(F.lit(2.0)))) / 2)).alias("p_normal"),
    )


def erf(x: Column) -> Column:
    """The error function by a polynomial with an error below 1.5e-7 (published constants)."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def permutation_test(pairs: DataFrame, key: str, draws: int = PERMUTATIONS, seed: int = 7) -> DataFrame:
    """mean difference and p of a sign-flip test; signs come from a hash of draw and key, one bit a draw.

    Each row carries 64 draws in the bits of one hash, so the rows made are
    draws / 64 a question, and sums combine before the shuffle.
    """
    diffs = pairs.select(F.col(key).cast("string").alias("key"), (F.col("x") - F.col("y")).alias("d")).where(F.col("d").isNotNull())
    words = -(-draws // 64)
    bits = diffs.select("key", "d", F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("word")).withColumn("h", F.xxhash64("key", "word", F.lit(seed)))
    sums = bits.groupBy("word").agg(*(F.sum(F.when(F.getbit("h", F.lit(i)) == 1, F.col("d")).otherwise(-F.col("d"))).alias(f"s{i}") for i in range(64)))
    drawn = sums.select("word", F.posexplode(F.array(*(F.col(f"s{i}") for i in range(64)))).alias("bit", "s")).where(F.col("word") * 64 + F.col("bit") < draws)
    seen = diffs.agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("mean_diff"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("total"), F.count("*").alias("n"))
    return (
        drawn.crossJoin(F.broadcast(seen))
        .groupBy("mean_diff", "n")
        .agg(((F.count_if(F.abs("s") >= F.abs("total") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))
    )
