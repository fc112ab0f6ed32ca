"""Problem 2: long exact spans shared between records.

Method: a De Bruijn graph in minimizer space. A token is a character k-mer
(``ANCHOR`` characters) that is the smallest hash in some window of
``MIN_SPAN - ANCHOR + 1`` k-mers; every run of ``MIN_SPAN`` equal characters
therefore holds the same token in both texts, so nothing is lost by keeping
about one k-mer in thirty. Tokens seen in more than one text are the nodes,
consecutive ones with their distance the edges. Edges taken by every
occurrence of both their ends do not branch: they compact, by joins of edge
with node counts, into paths that stand for all their tokens. Texts that share
a path are compared at their source coordinates, which verifies the span
character by character and extends it to its full length.

Equal texts are one node source (keyed by a 64-bit hash of the text), so a
group of copies of any size costs one text.

Defined results
* texts that are null or shorter than ``MIN_SPAN`` share nothing;
* a text repeated within one unit, or a unit delivered twice, is no sharing;
* lengths and positions count code points; spans may overlap and are merged
  before a unit's share is taken;
* texts without a text have no row in ``shared_spans``; a blank text has share 0;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoor.runtime import load, materialize

#: Characters of a shared run, at least.
MIN_SPAN = 120
#: Characters of a token of the graph.
ANCHOR = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Characters hashed at once.
_CHUNK = 1 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width], for all i with a full window, by doubling."""
    have, y = 1, x
    while have * 2 <= width:
        y = op(y[:-have], y[have:])
        have *= 2
    rest = width - have
    return op(y[:-rest], y[rest:]) if rest else y


def anchors(texts: list[str], span: int = MIN_SPAN, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of the minimizers of texts of at least ``span`` characters."""
    lens = np.array([len(t) for t in texts])
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype("u8") + np.uint64(1)
    n = len(chars)
    ends = np.cumsum(lens)
    starts = ends - lens
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)], dtype="u8")
        inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE_INV)], dtype="u8")
        prefix = np.r_[np.uint64(0), np.cumsum(chars * power[:n], dtype="u8")]
        h = (prefix[k:] - prefix[:-k]) * inverse[: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    text_of = np.repeat(np.arange(len(texts)), lens)[: len(h)]
    inside = np.arange(len(h)) + k <= ends[text_of]
    h[~inside] = _NONE
    width = span - k + 1
    low = _sliding(h, width, np.minimum)
    full = np.arange(len(low)) + span <= ends[text_of[: len(low)]]
    low[~full] = 0
    pad = np.zeros(width - 1, "u8")
    best = _sliding(np.r_[pad, low, pad], width, np.maximum)[: len(h)]
    at = np.flatnonzero((best == h) & inside)
    return text_of[at], at - starts[text_of[at]], h[at].view("i8")


def _anchor_rows(span: int, k: int):
    def rows(batches):
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size + len(texts[end]) <= _CHUNK):
                    size += len(texts[end])
                    end += 1
                who, pos, h = anchors(texts[at:end], span, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(keys[at:end][who]), pa.array(pos.astype("i4"))], names=["h", "th", "pos"]
                )
                at = end

    return rows


def _extend(batches):
    """Rows (a, b, pa, pb, text_a, text_b) to their full equal run (a, b, sa, sb, n)."""
    for batch in batches:
        a, b, at_a, at_b, ta, tb = (batch.column(i).to_pylist() for i in range(6))
        out_sa, out_sb, out_n = [], [], []
        for i, j, s, t in zip(at_a, at_b, ta, tb):
            left = min(i, j)
            x, y = s[i - left : i][::-1], t[j - left : j][::-1]
            back = _common(x, y)
            ahead = _common(s[i:], t[j:])
            out_sa.append(i - back), out_sb.append(j - back), out_n.append(back + ahead)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out_sa, pa.int32()), pa.array(out_sb, pa.int32()), pa.array(out_n, pa.int32())],
            names=["a", "b", "sa", "sb", "n"],
        )


def _common(x: str, y: str) -> int:
    """Length of the common prefix, by bisection over equal slices."""
    low, high = 0, min(len(x), len(y))
    if x[:high] == y[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(
        F.col(id_col).cast("string").alias("unit_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")
    ).where(F.col("unit_id").isNotNull() & F.col("text").isNotNull())


def shared_runs(df: DataFrame, min_span: int = MIN_SPAN, anchor: int = ANCHOR, id_col: str = "unit_id", text_col: str = "text") -> DataFrame:
    """(a, b, sa, sb, n): the full equal runs of two different texts, named by their hashes."""
    long_ = _texts(df, id_col, text_col).where(F.length("text") >= min_span)
    found = materialize(long_.select("th", "text").mapInArrow(_anchor_rows(min_span, anchor), "h long, th long, pos int"), "p2-anchors")
    nodes = found.groupBy("h").agg(F.min("th").alias("x"), F.max("th").alias("y")).where("x <> y").select("h")
    seen = materialize(found.join(nodes, "h").distinct(), "p2-nodes")
    # edges between consecutive nodes of a text, and which of them branch nowhere
    by_text = Window.partitionBy("th").orderBy("pos")
    steps = seen.withColumn("next", F.lead("h").over(by_text)).withColumn("gap", F.lead("pos").over(by_text) - F.col("pos"))
    near = F.col("gap") <= min_span - anchor + 1
    node_n = seen.groupBy("h").agg(F.count("*").alias("n"))
    edge_n = steps.where(near).groupBy("h", "next", "gap").agg(F.count("*").alias("n"))
    plain = (
        edge_n.join(node_n, ["h", "n"])
        .join(node_n.withColumnRenamed("h", "next"), ["next", "n"])
        .select("h", "next", "gap", F.lit(1).alias("inner"))
    )
    marked = steps.join(plain, ["h", "next", "gap"], "left")
    opened = F.when(F.lag("inner").over(by_text) == 1, 0).otherwise(1)
    paths = (
        marked.withColumn("open", opened)
        .withColumn("run", F.sum("open").over(by_text))
        .groupBy("th", "run")
        .agg(F.min_by("h", "pos").alias("path"), F.min("pos").alias("pos"))
    )
    paths = materialize(paths.select("path", "th", "pos"), "p2-paths")
    x, y = paths.alias("x"), paths.alias("y")
    met = x.join(y, (F.col("x.path") == F.col("y.path")) & (F.col("x.th") < F.col("y.th"))).select(
        F.col("x.th").alias("a"), F.col("y.th").alias("b"), F.col("x.pos").alias("pa"), F.col("y.pos").alias("pb")
    )
    # only texts on a path that meets another text are needed again
    needed = paths.select("th").distinct()
    texts = materialize(long_.select("th", "text").join(needed, "th", "left_semi").dropDuplicates(["th"]), "p2-texts")
    pairs = (
        met.join(texts.select(F.col("th").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("th").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "pa", "pb", "ta", "tb")
    )
    return pairs.mapInArrow(_extend, "a long, b long, sa int, sb int, n int").where(F.col("n") >= min_span).distinct()


def shared_pairs(df: DataFrame, min_span: int = MIN_SPAN, id_col: str = "unit_id", text_col: str = "text") -> DataFrame:
    """(unit_id_a, unit_id_b): units whose texts share a run of at least ``min_span`` characters."""
    classes = shared_runs(df, min_span, id_col=id_col, text_col=text_col).select("a", "b").distinct()
    units = _texts(df, id_col, text_col).where(F.length("text") >= min_span).select("unit_id", "th").distinct()
    first = units.select(F.col("th").alias("a"), F.col("unit_id").alias("u"))
    second = units.select(F.col("th").alias("b"), F.col("unit_id").alias("v"))
    across = classes.join(first, "a").join(second, "b").select("u", "v")
    within = first.join(second, F.col("a") == F.col("b")).where(F.col("u") < F.col("v")).select("u", "v")
    return (
        across.unionByName(within)
        .where(F.col("u") != F.col("v"))
        .select(F.least("u", "v").alias("unit_id_a"), F.greatest("u", "v").alias("unit_id_b"))
        .distinct()
    )


def shared_spans(df: DataFrame, min_span: int = MIN_SPAN, id_col: str = "unit_id", text_col: str = "text") -> DataFrame:
    """(unit_id, n_chars, shared_chars, share): how much of each text occurs in another unit too."""
    runs = materialize(shared_runs(df, min_span, id_col=id_col, text_col=text_col), "p2-runs")
    spans = runs.select(F.col("a").alias("th"), F.col("sa").alias("s"), "n").unionByName(
        runs.select(F.col("b").alias("th"), F.col("sb").alias("s"), "n")
    )
    spans = spans.select("th", "s", (F.col("s") + F.col("n")).alias("e")).distinct()
    before = Window.partitionBy("th").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("e").over(before), F.lit(0))
    covered = (
        spans.withColumn("new", F.greatest(F.lit(0), F.col("e") - F.greatest("s", reach)))
        .groupBy("th")
        .agg(F.sum("new").alias("shared"))
    )
    units = _texts(df, id_col, text_col).select("unit_id", "th", F.length("text").alias("n_chars")).distinct()
    copies = units.where(F.col("n_chars") >= min_span).groupBy("th").agg(F.count("*").alias("copies")).where("copies > 1")
    shared = F.when(F.col("copies").isNotNull(), F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0)))
    return (
        units.join(covered, "th", "left")
        .join(copies, "th", "left")
        .select("unit_id", "n_chars", shared.cast("bigint").alias("shared_chars"))
        .withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0)))
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of units sharing a run of at least 120 characters."""
    return shared_pairs(load(spark, sf_dir, "trace_units"))


def p2_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each unit the share of its text that occurs in another unit."""
    return shared_spans(load(spark, sf_dir, "trace_units"))


QUERIES = {"p2_found": p2_found, "p2_shared": p2_shared}
ORACLE: dict[str, str] = {}
