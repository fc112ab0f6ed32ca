"""BM25 over batches of queries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.functions.text import tokens
from spoor.operators.ranking import top_k
from spoor.runtime import materialize, swept

K1, B = 1.5, 0.75
#: Units that are scored together in one task.
BLOCK = 65_536


@dataclass
class Bm25Index:
    """terms (unit_id, term, tf, len) of the query terms, df (term, n), stats (n_units, avgdl) of all units."""

    terms: DataFrame
    df: DataFrame
    stats: DataFrame


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qn): the tokens of each query with their repetitions."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))


def bm25_index(units: DataFrame, wanted: DataFrame) -> Bm25Index:
    """Statistics over all units; postings only of the wanted terms (a frame with a column term).

    Document frequencies come from the same postings, so terms that no query
    asks for are dropped before the first shuffle.
    """
    toks = units.select("unit_id", tokens(F.col("text")).alias("toks"))
    stats = toks.agg(F.count("*").alias("n_units"), F.avg(F.size("toks")).alias("avgdl"))
    stats = stats.select("n_units", F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(F.lit(1.0)).alias("avgdl"))
    terms = (
        toks.select("unit_id", F.size("toks").alias("len"), F.explode("toks").alias("term"))
        .join(wanted.select("term").distinct(), "term")
        .groupBy("unit_id", "term")
        .agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    )
    return Bm25Index(terms, terms.groupBy("term").agg(F.count("*").alias("n")), stats)


def bm25(terms: DataFrame, index: Bm25Index) -> DataFrame:
    """(query_id, unit_id, bm) of every unit with a term of the query."""
    idf = F.log(1 + (F.col("n_units") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    weights = index.df.crossJoin(F.broadcast(index.stats)).select("term", idf.alias("idf"), "avgdl")
    return (
        terms.join(weights, "term")
        .join(index.terms, "term")
        .groupBy("query_id", "unit_id")
        .agg(F.sum(F.col("qn") * F.col("idf") * tf).alias("bm"))
    )


def coverage(terms: DataFrame, index: Bm25Index) -> DataFrame:
    """(query_id, cov): the share of a query's tokens that some unit has."""
    met = terms.join(index.df, "term", "left")
    return met.groupBy("query_id").agg((F.sum(F.when(F.col("n").isNotNull(), F.col("qn")).otherwise(0)) / F.sum("qn")).alias("cov"))


def _postings(words):
    """(unit_id, len, term numbers, counts, more...) of units (unit_id, toks, more...), of the words asked for."""

    def held(batches):
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype("i8")
            found = pc.index_in(lists.values, value_set=words.value)
            term = found.fill_null(-1).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            length = np.diff(offsets)
            row = np.repeat(np.arange(len(length)), length)[term >= 0]
            key, tf = np.unique(row * len(words.value) + term[term >= 0], return_counts=True)
            row, term = np.divmod(key, max(1, len(words.value)))
            ends = pa.array(np.searchsorted(row, np.arange(len(length) + 1)).astype("i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(length.astype("i4")), pa.ListArray.from_arrays(ends, pa.array(term.astype("i4"))), pa.ListArray.from_arrays(ends, pa.array(tf.astype("i4"))), *batch.columns[2:]],
                names=["unit_id", "len", "terms", "tfs", *batch.schema.names[2:]],
            )

    return held


def _best(asked, k: int, digits: int):
    """The k best units of each query among the units of a task, in blocks of BLOCK units."""

    def block(ids, lengths, terms, counts, sizes, best):
        starts, query_terms, weights, avgdl = asked.value
        # by id, so that the place of a unit breaks ties
        order = np.asarray(pc.sort_indices(ids))
        place = np.empty(len(ids), "i8")
        place[order] = np.arange(len(ids))
        unit = place[np.repeat(np.arange(len(ids)), sizes)]
        value = counts * (K1 + 1) / (counts + K1 * (1 - B + B * np.repeat(lengths, sizes) / avgdl))
        by = np.argsort(terms, kind="stable")
        unit, value = unit[by], value[by]
        first = np.searchsorted(terms[by], np.arange(int(query_terms.max(initial=-1)) + 2))
        scale, score = 10.0**digits, np.zeros(len(ids))
        for q in range(len(starts) - 1):
            some = False
            for at in range(starts[q], starts[q + 1]):
                a, b = first[query_terms[at]], first[query_terms[at] + 1]
                if a < b:
                    score[unit[a:b]] += weights[at] * value[a:b]
                    some = True
            if not some:
                continue
            kept = best[q]
            # what rounds to the last one kept or more; all with a term score above 0
            least = (kept[-1][0] - 1) / scale if len(kept) == k else 0.0
            near = np.flatnonzero(score > max(least, 0.0))
            if len(near):
                key = np.floor(score[near] * scale + 0.5).astype("i8")
                if len(near) > k:
                    # the k-th best and its equals, of which the first ones by id stay
                    top = np.flatnonzero(key >= np.partition(key, len(key) - k)[len(key) - k])
                    near, key = near[top], key[top]
                    top = np.argsort(-key, kind="stable")[:k]
                    near, key = near[top], key[top]
                if len(kept) < k or key[0] >= kept[-1][0]:
                    best[q] = sorted([*kept, *((int(s), ids[int(order[n])].as_py()) for s, n in zip(key, near))], key=lambda x: (-x[0], x[1]))[:k]
            score[:] = 0.0

    def found(batches):
        best: list[list] = [[] for _ in range(len(asked.value[0]) - 1)]
        parts, n = [], 0

        def score():
            if n:
                t = pa.Table.from_batches(parts).combine_chunks()
                lists, tfs = t.column("terms").combine_chunks(), t.column("tfs").combine_chunks()
                block(t.column("unit_id").combine_chunks(), t.column("len").to_numpy(), lists.flatten().to_numpy(), tfs.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()), best)

        for batch in batches:
            parts.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                score()
                parts, n = [], 0
        score()
        rows = [(q, s, u) for q, kept in enumerate(best) for s, u in kept]
        for at in range(0, len(rows), BLOCK):
            q, s, u = zip(*rows[at : at + BLOCK])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(u, pa.string()), pa.array(np.array(s) / 10.0**digits)], names=["q", "unit_id", "bm"])

    return found


def numbered(asked: pa.Table, named: pa.Array):
    """(words, starts, term numbers, repetitions) of query terms (query_id, term, qn), by the place of the query in ``named``."""
    words = pc.unique(asked.column("term"))
    number = pc.index_in(asked.column("term"), value_set=words).to_numpy()
    query = pc.index_in(asked.column("query_id"), value_set=named).to_numpy()
    by = np.lexsort((number, query))
    starts = np.searchsorted(query[by], np.arange(len(named) + 1))
    return words, starts, number[by], asked.column("qn").to_numpy()[by]


def term_lists(toks: DataFrame, words: pa.Array) -> DataFrame:
    """(unit_id, len, terms, tfs, more...) of units (unit_id, toks, more...): how often each has which of the words."""
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in toks.schema.fields[2:])
    return toks.mapInArrow(_postings(toks.sparkSession.sparkContext.broadcast(words)), f"unit_id string, len int, terms array<int>, tfs array<int>{more}")


def frequencies(docs: DataFrame, n_words: int):
    """(units, mean length, units of each word) of written ``term_lists``."""
    with swept(docs.sparkSession):
        n_units, avgdl = docs.agg(F.count("*"), F.avg("len")).first()
        df = docs.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toArrow()
    n = np.zeros(n_words, "f8")
    n[df.column("t").to_numpy()] = df.column("n").to_numpy()
    return n_units, avgdl, n


def bm25_topk(terms: DataFrame, units: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, unit_id, bm, rank): the k best units of each query, by the score rounded to so many digits, then by id.

    The query set is stated and goes to every task. Every unit with a term of a query is scored, in the memory
    of the task that holds it, and a task hands on k rows a query: no pair of query and unit is shuffled.
    """
    spark = units.sparkSession
    context = spark.sparkContext
    with swept(spark):
        asked = terms.toArrow()
    named = pc.unique(asked.column("query_id"))
    words, starts, number, qn = numbered(asked, named)
    docs = materialize(term_lists(units.select("unit_id", tokens(F.col("text")).alias("toks")), words), "bm25-units")
    n_units, avgdl, n = frequencies(docs, len(words))
    weights = qn * np.log(1 + (n_units - n + 0.5) / (n + 0.5))[number]
    scorer = context.broadcast((starts, number, weights, avgdl if avgdl and avgdl > 0 else 1.0))
    best = docs.mapInArrow(_best(scorer, k, digits), "q int, unit_id string, bm double")
    names = spark.createDataFrame(pa.table({"query_id": named, "q": pa.array(np.arange(len(named)), pa.int32())}))
    return top_k(best, k, F.desc("bm"), "unit_id", by="q").join(names, "q").select("query_id", "unit_id", "bm", "rank")
