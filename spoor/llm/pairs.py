"""Problem 3: items that appear together.

Method: large-basket blocking. A basket of up to ``CHUNK`` items yields its
pairs where it lies; a larger one is split into chunks of ``CHUNK`` items, and
the products of its chunk pairs are rows of their own, spread over all tasks,
so that no task ever holds the pairs of a huge basket. Both kinds are counted
together, with partial sums before the shuffle, and joined to the single
counts for the association scores.

Items are trimmed and lowered and count once per basket; pairs are counted
under 64-bit hashes of the items, whose strings return with the single counts.

Defined results
* null or blank items are none; null or empty baskets name nothing and do not
  count in N, the number of baskets with at least one item;
* rows with the same id are one basket;
* a pair has the smaller item first in the order of code points;
* scores: ``lift`` = n_ab * N / (n_a * n_b), ``pmi`` its natural logarithm,
  ``npmi`` that over -ln(n_ab / N), 1 where n_ab = N;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.runtime import load, materialize

#: Items of a basket whose pairs are made in one row.
CHUNK = 128


def baskets(df: DataFrame, id_col: str = "unit_id", items_col: str = "entities") -> DataFrame:
    """(unit_id, items): the distinct items of each basket, sorted."""
    clean = F.transform(items_col, lambda x: F.lower(F.btrim(x.cast("string"), F.lit(" \t\r\n"))))
    items = F.array_sort(F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != ""))))
    return (
        df.select(F.col(id_col).cast("string").alias("unit_id"), items.alias("items"))
        .where(F.col("unit_id").isNotNull() & (F.size("items") > 0))
        .dropDuplicates(["unit_id"])
    )


def _small(hashed: DataFrame) -> DataFrame:
    return hashed.select("hs", F.posexplode("hs").alias("i", "x")).select(
        "x", F.explode(F.slice("hs", F.col("i") + 2, F.greatest(F.size("hs") - F.col("i") - 1, F.lit(0)))).alias("y")
    )


def _large(hashed: DataFrame, chunk: int) -> DataFrame:
    """Pairs of large baskets by chunk products: within a chunk, and between chunks i < j."""
    items = hashed.select("unit_id", F.posexplode("hs").alias("i", "h"))
    chunks = items.groupBy("unit_id", F.floor(F.col("i") / chunk).alias("c")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda s: s["h"]).alias("hs")
    )
    chunks = materialize(chunks, "p3-chunks")
    a, b = chunks.alias("a"), chunks.alias("b")
    products = a.join(b, (F.col("a.unit_id") == F.col("b.unit_id")) & (F.col("a.c") < F.col("b.c"))).select(
        F.col("a.hs").alias("xs"), F.col("b.hs").alias("ys")
    )
    between = products.select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y"))
    return _small(chunks).unionByName(between)


def pair_counts(
    df: DataFrame, min_count: int = 1, id_col: str = "unit_id", items_col: str = "entities", chunk: int = CHUNK
) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, n, lift, pmi, npmi) of all pairs met at least ``min_count`` times."""
    held = materialize(baskets(df, id_col, items_col), "p3-baskets")
    spark = df.sparkSession
    total, largest = held.agg(F.count("*"), F.max(F.size("items"))).first()
    hashed = held.select("unit_id", F.transform("items", lambda x: F.xxhash64(x)).alias("hs"))
    pairs = _small(hashed.where(F.size("hs") <= chunk))
    if (largest or 0) > chunk:
        pairs = pairs.unionByName(_large(hashed.where(F.size("hs") > chunk), chunk))
    # hashes are not in the order of the items, so a pair is counted under the smaller hash
    counted = (
        pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        .groupBy("x", "y")
        .agg(F.count("*").alias("n_ab"))
        .where(F.col("n_ab") >= min_count)
    )
    single = (
        held.select(F.explode("items").alias("item"))
        .groupBy("item")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_count)
        .withColumn("h", F.xxhash64("item"))
    )
    joined = counted.join(single.select(F.col("h").alias("x"), F.col("item").alias("p"), F.col("n").alias("np")), "x").join(
        single.select(F.col("h").alias("y"), F.col("item").alias("q"), F.col("n").alias("nq")), "y"
    )
    ordered = F.col("p") <= F.col("q")
    n = F.lit(int(total or 0)).cast("bigint")
    out = joined.select(
        F.least("p", "q").alias("item_a"),
        F.greatest("p", "q").alias("item_b"),
        F.when(ordered, F.col("np")).otherwise(F.col("nq")).alias("n_a"),
        F.when(ordered, F.col("nq")).otherwise(F.col("np")).alias("n_b"),
        "n_ab",
        n.alias("n"),
    )
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    share = F.log(F.col("n_ab") / F.col("n"))
    return (
        out.withColumn("lift", lift)
        .withColumn("pmi", F.log("lift"))
        .withColumn("npmi", F.when(F.col("n_ab") == F.col("n"), F.lit(1.0)).otherwise(-F.col("pmi") / share))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity pairs named together by 5 units or more and 8 times as often as by chance."""
    pairs = pair_counts(load(spark, sf_dir, "trace_units"), min_count=5)
    return pairs.where(F.col("n_ab") * F.col("n") >= 8 * F.col("n_a") * F.col("n_b")).select(
        F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b")
    )


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entity pairs with their counts and association scores."""
    pairs = pair_counts(load(spark, sf_dir, "trace_units"))
    return pairs.select(
        F.col("item_a").alias("entity_a"),
        F.col("item_b").alias("entity_b"),
        "n_a",
        "n_b",
        "n_ab",
        F.round("lift", 4).alias("lift"),
        F.round("pmi", 4).alias("pmi"),
        F.round("npmi", 4).alias("npmi"),
    )


QUERIES = {"p3_found": p3_found, "p3_pairs": p3_pairs}

_SQL = """
WITH u AS (
  SELECT DISTINCT unit_id, lower(trim(e, ' ' || chr(9) || chr(10) || chr(13))) AS e
  FROM (SELECT unit_id, unnest(entities) AS e FROM trace_units)
  WHERE e IS NOT NULL AND trim(e, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND unit_id IS NOT NULL
), s AS (SELECT e, count(*) AS n FROM u GROUP BY e),
t AS (SELECT count(DISTINCT unit_id) AS n FROM u),
p AS (SELECT a.e AS ea, b.e AS eb, count(*) AS n_ab FROM u a JOIN u b ON a.unit_id = b.unit_id AND a.e < b.e GROUP BY 1, 2)
"""
ORACLE = {
    "p3_found": _SQL
    + """SELECT ea AS entity_a, eb AS entity_b FROM p JOIN s x ON x.e = ea JOIN s y ON y.e = eb, t
WHERE n_ab >= 5 AND n_ab * t.n >= 8 * x.n * y.n""",
    "p3_pairs": _SQL
    + """SELECT ea AS entity_a, eb AS entity_b, x.n AS n_a, y.n AS n_b, n_ab,
  round(n_ab * t.n / (x.n::DOUBLE * y.n), 4) AS lift,
  round(ln(n_ab * t.n / (x.n::DOUBLE * y.n)), 4) + 0.0 AS pmi,
  round(CASE WHEN n_ab = t.n THEN 1.0 ELSE -ln(n_ab * t.n / (x.n::DOUBLE * y.n)) / ln(n_ab / t.n::DOUBLE) END, 4) + 0.0 AS npmi
FROM p JOIN s x ON x.e = ea JOIN s y ON y.e = eb, t""",
}
