"""Usable vectors, and their division into blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgauge.sources.tables import usable, with_vector


def usable_vectors(table: DataFrame, group: str, key: str) -> DataFrame:
    """``grp, id, vec`` with one usable vector per group and key, of those that differ the smallest.

    Null groups or keys and vectors with null, NaN or infinite components or
    only zeros are left out.
    """
    rows = with_vector(table.select(F.col(group).alias("grp"), F.col(key).alias("id"), *[c for c in table.columns if c.startswith("dim_")]))
    return rows.where(F.col("grp").isNotNull() & F.col("id").isNotNull() & usable(F.col("vec"))).groupBy("grp", "id").agg(F.min("vec").alias("vec"))


def blocked(vectors: DataFrame, block_rows: int) -> DataFrame:
    """Adds ``blocks`` (how many the group has) and ``block``, of about ``block_rows`` rows each at most."""
    sizes = vectors.groupBy("grp").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    return vectors.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def unit_matrix(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
