"""Vectors of a table as arrays: which rows take part, and in what form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, not empty, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def with_usable(rows: DataFrame, vec_col: str) -> DataFrame:
    """The usable rows, with their dimension ``dim``."""
    return rows.filter(usable(F.col(vec_col))).withColumn("dim", F.size(vec_col))


def matrix(column: pd.Series, dim: int = 0) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, dim))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in one order wherever a row stands."""
    return (a * b).sum(axis=1)
