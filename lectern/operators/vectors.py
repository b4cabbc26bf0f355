"""Nearest vectors by cosine: a stated set of queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Query vectors that one pass over the rows compares with.
BLOCK = 2000
#: Of these, as many as are compared with a batch of rows at a time: a task holds the scores of so many.
SLICE = 100


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, digits: int = 6) -> DataFrame:
    """(query, key, rank, score): the k rows most alike to each query, itself left out; ties by key.

    Each batch of rows keeps the k best of each query, so what is shuffled is k rows a query and batch, not all pairs.
    Null and zero vectors have cosine 0; vectors are taken to be of one width (shorter ones as if filled with zeros). Scores are rounded before they are ranked.
    """
    count = queries.count()
    blocks = -(-count // BLOCK)
    part = F.pmod(F.xxhash64(key), F.lit(max(1, blocks)))
    found = None
    for b in range(max(1, blocks)):
        listed = queries.filter(part == b).select(key, vector).collect()
        best = rows.select(key, vector).mapInPandas(_matcher([r[0] for r in listed], [r[1] for r in listed], k, digits), "query long, match long, score double")
        found = best if found is None else found.unionByName(best)
    window = W.partitionBy("query").orderBy(F.desc("score"), "match")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def _unit(vectors: list, width: int) -> np.ndarray:
    m = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None:
            m[i, : min(width, len(v))] = v[:width]
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _matcher(ids: list, vectors: list, k: int, digits: int):
    width = max((len(v) for v in vectors if v is not None), default=1)
    mine = _unit(vectors, width) if ids else None

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not ids or batch.empty:
                continue
            keys = batch.iloc[:, 0].to_numpy()
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            units = _unit([batch.iloc[i, 1] for i in order], width).T
            for low in range(0, len(ids), SLICE):
                part = np.array(ids[low : low + SLICE])
                scores = np.round(mine[low : low + SLICE] @ units, digits)
                scores[part[:, None] == keys[None, :]] = -np.inf
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                out = pd.DataFrame({"query": np.repeat(part, top.shape[1]), "match": keys[top].ravel(), "score": np.take_along_axis(scores, top, 1).ravel()})
                yield out[np.isfinite(out["score"])]

    return match
