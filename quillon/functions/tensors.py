"""Digests and metadata of array columns as tensors."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bytes_digest(values: Column, dtype: str = "<f4") -> Column:
    """sha256 of an array's raw bytes in a numpy type (`<f4` vectors, `<i8` token ids)."""

    @F.pandas_udf("string")
    def digest(batch: pd.Series) -> pd.Series:
        return batch.map(lambda v: None if v is None else hashlib.sha256(np.asarray(v).astype(dtype).tobytes()).hexdigest())

    return digest(values)


def metadata(tensors: DataFrame, by: list[str], column: str = "h") -> DataFrame:
    """by, rows, least and greatest width, and rows with a value that isn't finite."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return tensors.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.size(column)).alias("least_width"), F.max(F.size(column)).alias("greatest_width"), F.count_if(odd).alias("not_finite"))
