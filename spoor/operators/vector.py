"""Vector search for a stated query set: exact in blocks, and approximate by an inverted file."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.functions.vectors import cosine
from spoor.operators.ranking import top_k

#: Queries held by every task at once; more are searched in turns.
QUERY_BLOCK = 4_096
#: Similarities that a task holds at once.
SCORES = 1 << 20
#: Share of true neighbours that the cells visited must hold, and the queries on which their number is found, at most.
RECALL, CALIBRATION = 0.92, 256
#: Below this many vectors a search is exact.
EXACT_BELOW = 10_000
#: Vectors on which cells are fitted, at most.
FIT_SAMPLE = 50_000


def _rows(column, dim):
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten(), "f8").reshape(-1, dim)


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, unit_id, cosine, rank): nearest vectors of each query (query_id, qvec).

    The query set is stated; it goes to every task in blocks of
    QUERY_BLOCK rows, each task compares its batches of the one scan with all of them by products of
    about SCORES elements and hands on k rows a query.
    """
    return top_k(_scanned(queries, vectors, k).distinct(), k, F.desc(F.round("cosine", 9)), "unit_id")


def similarities(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, unit_id, cosine) of every query with every vector of its length, unranked."""
    return _scanned(queries, vectors, None)


def extremes(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, lowest, highest): the least and greatest cosine of each query with any vector of its length; a batch hands on two numbers a query."""
    found = _scanned(queries, vectors, 0)
    return found.groupBy("query_id").agg(F.min("cosine").alias("lowest"), F.max("cosine").alias("highest"))


def _scanned(queries: DataFrame, vectors: DataFrame, k: int | None) -> DataFrame:
    """k None: all pairs; 0: the extremes of each batch; else the k nearest of each batch and what is as near as the last."""
    context = vectors.sparkSession.sparkContext
    asked = queries.where(F.size("qvec") > 0).select(F.col("query_id").cast("string"), F.col("qvec").cast("array<double>")).toArrow()
    blocks = []
    for start in range(0, asked.num_rows, QUERY_BLOCK):
        block = asked.slice(start, QUERY_BLOCK).combine_chunks()
        names, lists = block.column(0).combine_chunks(), block.column(1).combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        held = {}
        for dim in np.unique(sizes):
            at = pa.array(np.flatnonzero(sizes == dim))
            held[int(dim)] = (names.take(at), _normal(_rows(lists.take(at), int(dim))))
        blocks.append(context.broadcast(held))

    def scan(batches):
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for block in blocks:
                for dim, (names, x) in block.value.items():
                    at = np.flatnonzero(sizes == dim)
                    if not len(at):
                        continue
                    y = _normal(_rows(batch.column(1).take(pa.array(at)), dim))
                    step = max(1, SCORES // len(at))
                    for first in range(0, len(x), step):
                        s = x[first : first + step] @ y.T
                        if k == 0:
                            a = np.repeat(np.arange(len(s)), 2)
                            b = np.stack([s.argmin(axis=1), s.argmax(axis=1)], axis=1).ravel()
                        elif k is None or k >= s.shape[1]:
                            a, b = np.indices(s.shape).reshape(2, -1)
                        else:
                            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                            # rows as near as the k-th stay, so that ties are broken by id later
                            a, b = np.nonzero(s >= np.take_along_axis(s, best, 1).min(axis=1, keepdims=True))
                        yield pa.RecordBatch.from_arrays(
                            [names.take(pa.array(first + a)), batch.column(0).take(pa.array(at[b])), pa.array(s[a, b])], names=["query_id", "unit_id", "cosine"]
                        )

    src = vectors.where(F.size("embedding") > 0).select(F.col("unit_id").cast("string"), F.col("embedding").cast("array<double>"))
    return src.mapInArrow(scan, "query_id string, unit_id string, cosine double")


def _normal(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


class CellIndex:
    """An inverted file: vectors by the nearest of k-means cells fitted on a bounded sample."""

    def __init__(self, vectors: DataFrame, cells: int | None = None, seed: int = 7):
        src = vectors.where(F.size("embedding") > 0).withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
        n = src.count()
        # as many cells as vectors in each, as far as the sample can place them
        cells = cells or max(1, min(FIT_SAMPLE // 12, round(n**0.5)))
        share = min(1.0, FIT_SAMPLE / max(1, n))
        sample = src.where(F.pmod(F.xxhash64("unit_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
        self.model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(sample)
        self.centres = np.array(self.model.clusterCenters())
        self.size = n
        self.vectors = self.model.transform(src).select("unit_id", "embedding", F.col("prediction").alias("cell"))
        self.probes = self._calibrate(vectors)
        self.added = 0

    def _calibrate(self, vectors: DataFrame) -> int:
        """Cells to visit so that RECALL of the true neighbours of CALIBRATION vectors, chosen by hash, lie in them."""
        some = vectors.where(F.size("embedding") > 0).orderBy(F.xxhash64("unit_id")).limit(CALIBRATION)
        asked = some.select(F.col("unit_id").alias("query_id"), F.col("embedding").alias("qvec"))
        true = exact_topk(asked, vectors, 11).where("query_id <> unit_id").select("query_id", "unit_id")
        rows = true.join(self.vectors.select("unit_id", "cell"), "unit_id").join(asked, "query_id").select("qvec", "cell").toArrow()
        if not rows.num_rows:
            return 1
        x = _normal(np.array(rows.column("qvec").to_pylist(), "f8"))
        near = np.argsort(-(x @ _normal(self.centres).T), axis=1)
        place = np.sort((near == rows.column("cell").to_numpy()[:, None]).argmax(axis=1))
        return int(place[min(len(place) - 1, int(np.ceil(RECALL * len(place))) - 1)]) + 1

    def add(self, vectors: DataFrame) -> None:
        """New vectors join the cells at once. When half as many again have come, the cells are fitted anew to all."""
        src = vectors.where(F.size("embedding") > 0)
        self.added += src.count()
        if 2 * self.added > self.size:
            self.__init__(self.vectors.select("unit_id", "embedding").unionByName(vectors.select("unit_id", "embedding")))
            return
        centres = _normal(self.centres)

        @F.pandas_udf("int")
        def nearest_cell(v: pd.Series) -> pd.Series:
            return pd.Series((_normal(np.stack(v.to_numpy()).astype("f8")) @ centres.T).argmax(axis=1), dtype="int32")

        placed = src.select("unit_id", "embedding", nearest_cell(F.col("embedding").cast("array<double>")).alias("cell"))
        self.vectors = self.vectors.unionByName(placed)

    def remove(self, ids: DataFrame) -> None:
        """Vectors of evicted units (unit_id) leave the cells."""
        self.vectors = self.vectors.join(ids.select("unit_id"), "unit_id", "left_anti")

    def save(self, path: str) -> None:
        """The cells and what lies in them, below ``path``."""
        self.vectors.sparkSession.createDataFrame([(self.size, self.probes, [c.tolist() for c in self.centres])], "size long, probes int, centres array<array<double>>").write.mode("overwrite").parquet(f"{path}/cells")
        self.vectors.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")

    @classmethod
    def read(cls, spark, path: str) -> CellIndex:
        """A saved index; vectors are placed by their nearest centre."""
        index, row = cls.__new__(cls), spark.read.parquet(f"{path}/cells").first()
        index.size, index.probes, index.centres, index.added, index.model = row["size"], row["probes"], np.array(row["centres"]), 0, None
        index.vectors = spark.read.parquet(f"{path}/vectors").select("unit_id", "embedding", "cell")
        return index

    def topk(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, unit_id, cosine, rank) from the ``probes`` nearest cells of each query (as calibrated), re-ranked exactly."""
        probes = probes or self.probes
        spark = queries.sparkSession
        cells = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.centres)], "cell int, centre array<double>")
        near = top_k(queries.crossJoin(F.broadcast(cells)).select("query_id", "qvec", "cell", cosine(F.col("qvec").cast("array<double>"), F.col("centre")).alias("s")), probes, F.desc("s"), "cell")
        found = near.select("query_id", "qvec", "cell").join(self.vectors, "cell")
        scored = found.select("query_id", "unit_id", cosine(F.col("qvec").cast("array<double>"), F.col("embedding").cast("array<double>")).alias("cosine"))
        return top_k(scored, k, F.desc(F.round("cosine", 9)), "unit_id")


def embed(units: DataFrame, encoder, limit: int | None = None) -> DataFrame:
    """(unit_id, embedding) of units without a vector; ``encoder`` takes a column of texts to a column of vectors.

    No model is bundled: pass a ``pandas_udf`` that loads one. ``limit`` bounds the
    units encoded, in order of arrival.
    """
    todo = units.where((F.col("embedding").isNull() if "embedding" in units.columns else F.lit(True)) & F.col("text").rlike(r"\S"))
    if limit is not None:
        todo = todo.orderBy("seq", "unit_id").limit(limit)
    return todo.select("unit_id", encoder(F.col("text")).cast("array<double>").alias("embedding")).where(F.size("embedding") > 0)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, index: CellIndex | None = None) -> DataFrame:
    """Exact search of small collections, the inverted file (``index``, or one made here) for large ones."""
    if index is None and vectors.count() < EXACT_BELOW:
        return exact_topk(queries, vectors, k)
    return (index or CellIndex(vectors)).topk(queries, k)


__all__ = ["CellIndex", "embed", "exact_topk", "extremes", "nearest", "similarities"]
