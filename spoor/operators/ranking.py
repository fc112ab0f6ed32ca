"""Rank fusion, duplicate removal, diversity, top-k."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def top_k(scored: DataFrame, k: int, *order, by: str = "query_id") -> DataFrame:
    """The first k rows of each query in the given order, with their rank."""
    w = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_of_each(scored: DataFrame, key: str, *order, by: str = "query_id") -> DataFrame:
    """Of rows of a query with an equal key the first in the given order."""
    w = Window.partitionBy(by, key).orderBy(*order)
    return scored.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def rrf(*ranked: DataFrame, key: str = "unit_id", depth: int = 10) -> DataFrame:
    """(query_id, key, rrf): reciprocal rank fusion of ranked lists (query_id, key, rank from 1)."""
    parts = [r.where(F.col("rank") <= depth).select("query_id", key, (1.0 / (RRF_K + F.col("rank") - 1)).alias("s")) for r in ranked]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("query_id", key).agg(F.sum("s").alias("rrf"))


def _similarity(a, b) -> float:
    """Cosine of equally long vectors, else Jaccard of the token sets."""
    va, vb, ta, tb = a[0], b[0], a[1], b[1]
    if va is not None and vb is not None and len(va) == len(vb) and len(va):
        n = float(np.linalg.norm(va) * np.linalg.norm(vb))
        return float(np.dot(va, vb)) / n if n else 0.0
    union = len(ta | tb)
    return len(ta & tb) / union if union else 0.0


def select_diverse(scores: list[float], items: list, k: int, weight: float) -> list[int]:
    """Greedy picks of the best score less weight times the likeness to what is picked; first of equals wins."""
    left, picked = list(range(len(scores))), []
    worst = [0.0] * len(scores)
    while left and len(picked) < k:
        best = max(left, key=lambda i: (scores[i] - weight * worst[i], -i))
        left.remove(best)
        picked.append(best)
        for i in left:
            worst[i] = max(worst[i], _similarity(items[i], items[best]))
    return picked


def mmr(pool: DataFrame, k: int) -> DataFrame:
    """(query_id, unit_id, rank): diverse picks from small ranked pools.

    ``pool`` has query_id, unit_id, place (from 1), score, lam, embedding and
    toks, a few dozen rows a query at most: pools are cut before they come
    here, so a group is bounded.
    """

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place", kind="stable").reset_index(drop=True)
        if len(frame) <= k:
            order = list(range(len(frame)))
        else:
            items = [(None if v is None else np.asarray(v, float), frozenset(t if t is not None else ())) for v, t in zip(frame["embedding"], frame["toks"])]
            order = select_diverse(frame["score"].tolist(), items, k, float(frame["lam"].iloc[0]))
        return pd.DataFrame({"query_id": frame["query_id"].iloc[order].values, "unit_id": frame["unit_id"].iloc[order].values, "rank": range(1, len(order) + 1)})

    return pool.groupBy("query_id").applyInPandas(pick, "query_id string, unit_id string, rank int")
