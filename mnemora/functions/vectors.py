"""Hashed token vectors in built-in expressions, and exact nearest neighbours by batched matrix products."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora import config
from mnemora.runtime import broadcast_if_small


def token_bucket(token: Column, dimensions: int = config.HASH_DIMENSIONS) -> Column:
    """Bucket of a token: its SHA-1's first four bytes, big-endian, modulo the dimensions."""
    return F.conv(F.substring(F.sha1(token), 1, 8), 16, 10).cast("bigint") % dimensions


def token_sign(token: Column) -> Column:
    """1 or -1 by the lowest bit of the SHA-1's fifth byte."""
    return F.when(F.conv(F.substring(F.sha1(token), 9, 2), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)


def sparse_vectors(texts: DataFrame, keys: list[str], tokens: str = "tokens", dimensions: int = config.HASH_DIMENSIONS) -> DataFrame:
    """``keys, bucket, weight``: unit vectors of texts, only buckets that aren't 0; repeated tokens count again.

    One aggregation on (key, bucket) with map-side partial sums; a zero vector gives no rows.
    """
    parts = texts.select(*keys, F.explode(tokens).alias("t"))
    sums = parts.select(*keys, token_bucket(F.col("t"), dimensions).alias("bucket"), token_sign(F.col("t")).alias("s")).groupBy(*keys, "bucket").agg(F.sum("s").alias("w")).where("w <> 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return sums.select(*keys, "bucket", (F.col("w") / norm).alias("weight"))


def corpus_mean(vectors: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """``group, bucket, mean``: mean of a group's vectors per bucket (absent buckets count 0); groups of one vector have mean 0."""
    n = vectors.select(*group, *keys).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    sums = vectors.groupBy(*group, "bucket").agg(F.sum("weight").alias("s"))
    return sums.join(broadcast_if_small(n), group).select(*group, "bucket", F.when(F.col("n") > 1, F.col("s") / F.col("n")).otherwise(0.0).alias("mean"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of one length, summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows at unit length; zero rows stay."""
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def corpus_mean_vector(vectors: DataFrame, vec: str = "embedding") -> np.ndarray:
    """Mean of all vectors in double precision (0 for fewer than two): one short row reaches the driver."""
    rows = vectors.select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n")).collect()
    rows.sort(key=lambda r: r.pos)
    return np.array([r.m if r.n > 1 else 0.0 for r in rows])


def centred(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Vectors less their corpus mean at unit length, as ``centred``; one matrix operation per Arrow batch. Null vectors stay null."""
    mean = corpus_mean_vector(vectors, vec)

    @F.pandas_udf("array<double>")
    def shift(column: pd.Series) -> pd.Series:
        there = [i for i, v in enumerate(column) if v is not None]
        out: list = [None] * len(column)
        if there:
            m = np.stack([np.asarray(column.iloc[i], "float64") for i in there])
            for i, v in zip(there, _unit(m - mean), strict=True):
                out[i] = v
        return pd.Series(out, index=column.index, dtype=object)

    return vectors.withColumn("centred", shift(vec))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_id: str, vector_id: str, vec: str = "centred", block: int = 4096) -> DataFrame:
    """``q_id, v_id, score, rank`` of the ``k`` best vectors of each query, exactly (ties by id).

    The stated query set meets all rows in blocks of ``block`` queries, the only part of it that's ever sent at once.
    Each Arrow batch multiplies matrices and keeps its own ``k`` best per query, so the shuffle carries a few rows per
    batch and query instead of every pair.
    """
    kinds = dict(queries.dtypes)[query_id], dict(vectors.dtypes)[vector_id]
    schema = f"q_id {kinds[0]}, v_id {kinds[1]}, score double"
    rows = vectors.where(F.col(vec).isNotNull()).select(F.col(vector_id).alias("v_id"), F.col(vec).alias("v"))
    asked = queries.where(F.col(vec).isNotNull()).select(F.col(query_id).alias("q_id"), F.col(vec).alias("q")).toLocalIterator()
    parts = []
    while piece := list(itertools.islice(asked, block)):
        names, matrix = np.array([r.q_id for r in piece], dtype=object), np.array([r.q for r in piece], "float64")

        def best(batches: Iterator[pd.DataFrame], names: np.ndarray = names, matrix: np.ndarray = matrix) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    scores = np.round(matrix @ np.stack([np.asarray(v, "float64") for v in pdf["v"]]).T, 9)
                    ids = pdf["v_id"].to_numpy()
                    for name, row in zip(names, scores, strict=True):
                        cut = np.partition(-row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
                        at = np.flatnonzero(-row <= cut)  # ties at the cut all stay for the final order
                        yield pd.DataFrame({"q_id": name, "v_id": ids[at], "score": row[at]})

        parts.append(rows.mapInPandas(best, schema))
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    pairs = reduce(lambda a, b: a.unionByName(b), parts)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "v_id")))
    return ranked.where(F.col("rank") <= k)
