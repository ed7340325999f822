"""Random-hyperplane signatures: bit j of a row is set iff its dot product with hyperplane j is not negative."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_BITS = 16
DEFAULT_SEED = 42


def hyperplanes(bits: int, dims: int, seed: int = DEFAULT_SEED) -> np.ndarray:
    """bits x dims standard normal draws, the same for the same arguments."""
    if not 1 <= bits <= 62:
        raise ValueError("bits must be from 1 to 62")
    return np.random.default_rng(seed).standard_normal((bits, dims))


def pack_bits(matrix: np.ndarray, planes: np.ndarray) -> np.ndarray:
    bits = (matrix @ planes.T) >= 0
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(len(planes), dtype=np.int64))


def signature(v: Column | str, planes: np.ndarray) -> Column:
    """BIGINT signature, one matrix product per Arrow batch. The planes (bits x dims doubles, at most 62 x 4096) go with the task. Null vectors get null."""

    @F.pandas_udf("long")
    def sign(rows: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(rows), dtype="Int64")
        there = rows.notna().to_numpy()
        if there.any():
            out[there] = pack_bits(np.stack(rows[there].to_numpy()).astype(np.float64), planes)
        return out

    return sign(F.col(v) if isinstance(v, str) else v)


def buckets(signed: DataFrame) -> DataFrame:
    """(sig, n, first_vec_id): how many rows share a signature, and the least id. For inspection; searches never gather a bucket."""
    return signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_vec_id"))


def members(signed: DataFrame) -> DataFrame:
    """(sig, vec_id): the contents of the buckets, a row for each member, so that a bucket of any size can be listed."""
    return signed.where("sig IS NOT NULL").select("sig", "vec_id")
