"""Problem 7: the frequency of every distinct value, term or run of terms.

Method: suffix arrays with common-prefix intervals. Records are spread by
their id; each task numbers the terms of a block of records and sorts all
suffixes of its term sequence, to the ends of their records, by prefix
doubling. The ranks of the doublings give the length of the common prefix of
neighbours in the array; suffixes whose common prefixes have n terms or more
are the interval of an n-gram, for every n at once. The size of an interval is the number of
occurrences. Each suffix is linked to the one before it in the array that is of the
same record; the least common prefix between the two (a range minimum) says
up to which n this occurrence is a duplicate within its record, and these
duplicates are subtracted to give the number of records. A record
lies in one block as a whole, so blocks add up: only one row per distinct
n-gram and block is shuffled, and a term in a third of all records is merged
before it moves. Single terms are the intervals of depth 1.

Defined results
* terms are trimmed and lowered; null and blank ones are none (they part no
  run: their neighbours stay neighbours);
* rows with the same id are one record;
* the number of records N counts all distinct ids, those with null or empty
  lists included; an n-gram is ``rare`` if exactly one record has it,
  ``common`` if more than a twentieth of N have it, else unmarked (null);
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.runtime import load

#: Terms of a block of records whose suffixes are sorted together.
BLOCK_TERMS = 1 << 20
#: Between the terms of an n-gram.
JOINER = "\x1f"
#: A term is common if more than one in so many records has it.
COMMON_PARTS = 20


def suffix_array(codes: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the suffixes, each to the end of its record, in order, and the common prefix of each with the one before.

    ``codes`` are the terms (0 and up) of all records in a row, ``record`` the record of
    each, in ascending order. Suffixes are equal if their terms are; equal ones stand in the order of their places.
    """
    n = len(codes)
    left = np.searchsorted(record, record, side="right") - np.arange(n)  # terms to the end of the record
    ranks = [np.unique(codes, return_inverse=True)[1].astype("i4")]
    width = 1
    while width < int(left.max()):
        # the rank of the next ``width`` terms; a suffix that has ended comes first
        ahead = np.zeros(n, "i8")
        at = np.flatnonzero(left > width)
        ahead[at] = ranks[-1][at + width].astype("i8") + 1
        key = ranks[-1].astype("i8") * (n + 1) + ahead
        ranks.append(np.unique(key, return_inverse=True)[1].astype("i4"))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, "i4")
    most = np.minimum(left[a], left[b])
    for k in range(len(ranks) - 1, -1, -1):
        ok = np.flatnonzero(lcp[1:] + (1 << k) <= most)
        same = ok[ranks[k][a[ok]] == ranks[k][b[ok]]]
        lcp[1 + same] += 1 << k
        # what is not compared further must stay within the array
        a[same] = np.minimum(a[same] + (1 << k), n - 1)
        b[same] = np.minimum(b[same] + (1 << k), n - 1)
    return order, lcp


def duplicate_depth(order: np.ndarray, lcp: np.ndarray, record: np.ndarray) -> np.ndarray:
    """For each suffix of the array, the common prefix with the last one before it of the same record (0 if none)."""
    n = len(order)
    who = record[order]
    by = np.argsort(who, kind="stable")
    again = np.r_[False, who[by][1:] == who[by][:-1]]
    right = by[again]
    left = by[np.flatnonzero(again) - 1] + 1  # the least of lcp[left : right + 1]
    span = right - left + 1
    least = np.zeros(len(right), "i4")
    table, k = lcp, 0
    while len(right) and (1 << k) <= int(span.max()):
        at = np.flatnonzero((span >> k) == 1)
        least[at] = np.minimum(table[left[at]], table[right[at] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
        k += 1
    out = np.zeros(n, "i4")
    out[right] = least
    return out


def ngram_intervals(codes: np.ndarray, record: np.ndarray, n_max: int | None):
    """For n = 1, 2, ... (up to n_max): n, and start of an occurrence, occurrences and records of each distinct n-gram."""
    if not len(codes):
        return
    order, lcp = suffix_array(codes, record)
    again = duplicate_depth(order, lcp, record)
    left = np.searchsorted(record, record, side="right") - np.arange(len(codes))
    longest = int(left.max())
    for n in range(1, min(n_max or longest, longest) + 1):
        alive = left[order] >= n
        heads = np.flatnonzero(alive & (lcp < n))
        # suffixes that ended earlier stand before the interval of those that go on
        size = np.add.reduceat(alive.astype("i8"), heads)
        repeated = np.add.reduceat((alive & (again >= n)).astype("i8"), heads)
        yield n, order[heads], size, size - repeated


def _count_rows(fields: list[str], n_max: int | None):
    def flush(held: dict[str, list]):
        for number, (name, parts) in enumerate(held.items()):
            if not parts:
                continue
            lists = pa.concat_arrays(parts)
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().dictionary_encode()
            codes = values.indices.to_numpy()
            record = np.repeat(np.arange(len(sizes)), np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0))
            words = values.dictionary
            for n, at, size, records in ngram_intervals(codes, record, n_max):
                if n == 1:
                    gram = words.take(pa.array(codes[at]))
                else:
                    table = np.array(words.to_pylist(), object)
                    gram = pa.array([JOINER.join(table[codes[i : i + n]]) for i in at], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), number, "i4")), pa.array(np.full(len(at), n, "i4")), gram.cast(pa.string()), pa.array(size.astype("i8")), pa.array(records.astype("i8"))],
                    names=["f", "n", "term", "occurrences", "records"],
                )

    def rows(batches):
        held, count = {f: [] for f in fields}, 0
        for batch in batches:
            for f in fields:
                column = batch.column(f)
                held[f].append(column)
                count += len(column.flatten())
            if count >= BLOCK_TERMS:
                yield from flush(held)
                held, count = {f: [] for f in fields}, 0
        yield from flush(held)

    return rows


def term_counts(df: DataFrame, fields: tuple[str, ...] = ("tokens", "entities"), n_max: int | None = 1, id_col: str = "unit_id") -> DataFrame:
    """(field, n, term, occurrences, records, mark) of every distinct n-gram, up to ``n_max`` terms (None: of any length), of each list column."""

    def clean(name):
        lower = F.transform(name, lambda x: F.lower(F.btrim(x.cast("string"), F.lit(" \t\r\n"))))
        return F.filter(lower, lambda x: x.isNotNull() & (x != "")).alias(f"list{fields.index(name)}")

    ids = df.select(F.col(id_col).cast("string").alias("id"), *(clean(f) for f in fields)).where(F.col("id").isNotNull())
    records = ids.dropDuplicates(["id"]).drop("id")
    names = [f"list{i}" for i in range(len(fields))]
    parts = records.mapInArrow(_count_rows(names, n_max), "f int, n int, term string, occurrences long, records long")
    total = ids.agg(F.count_distinct("id").alias("total"))
    counted = parts.groupBy("f", "n", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") * COMMON_PARTS > F.col("total"), "common")
    named = F.element_at(F.array(*(F.lit(f) for f in fields)), F.col("f") + 1)
    return counted.crossJoin(F.broadcast(total)).select(named.alias("field"), "n", "term", "occurrences", "records", mark.alias("mark"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common to help recall."""
    return term_counts(load(spark, sf_dir, "trace_units")).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p7_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and units of every term."""
    return term_counts(load(spark, sf_dir, "trace_units")).select("field", "term", "occurrences", F.col("records").alias("units"), "mark")


def p7_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of up to three tokens that at least two units have."""
    counted = term_counts(load(spark, sf_dir, "trace_units"), ("tokens",), n_max=3).where("records >= 2")
    return counted.select("n", F.translate("term", JOINER, " ").alias("term"), "occurrences", F.col("records").alias("units"))


QUERIES = {"p7_found": p7_found, "p7_terms": p7_terms, "p7_ngrams": p7_ngrams}

_SQL = """
WITH u AS (
  SELECT unit_id, any_value(tokens) AS tokens, any_value(entities) AS entities FROM trace_units WHERE unit_id IS NOT NULL GROUP BY unit_id
), l AS (
  SELECT unit_id, 'tokens' AS field, unnest(tokens) AS term FROM u
  UNION ALL SELECT unit_id, 'entities', unnest(entities) FROM u
), c AS (
  SELECT field, lower(trim(term, ' ' || chr(9) || chr(10) || chr(13))) AS term, count(*) AS occurrences, count(DISTINCT unit_id) AS units
  FROM l WHERE term IS NOT NULL AND trim(term, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY 1, 2
), m AS (
  SELECT *, CASE WHEN units = 1 THEN 'rare' WHEN units * 20 > (SELECT count(*) FROM u) THEN 'common' END AS mark FROM c
)
"""
ORACLE = {
    "p7_found": _SQL + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p7_terms": _SQL + "SELECT field, term, occurrences, units, mark FROM m",
    "p7_ngrams": """
WITH u AS (SELECT unit_id, any_value(tokens) AS tokens FROM trace_units WHERE unit_id IS NOT NULL GROUP BY unit_id), c AS (
  SELECT unit_id, list_filter(list_transform(tokens, lambda x: lower(trim(x, ' ' || chr(9) || chr(10) || chr(13)))), lambda x: x IS NOT NULL AND x <> '') AS l FROM u
), g AS (
  SELECT unit_id, n, unnest(list_transform(generate_series(1, len(l) - n + 1), lambda i: array_to_string(l[i : i + n - 1], ' '))) AS term
  FROM c, (VALUES (1), (2), (3)) t(n) WHERE len(l) >= n
) SELECT n::INT AS n, term, count(*) AS occurrences, count(DISTINCT unit_id) AS units FROM g GROUP BY 1, 2 HAVING count(DISTINCT unit_id) >= 2""",
}
