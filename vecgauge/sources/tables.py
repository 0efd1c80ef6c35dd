"""Readers for the Parquet tables and the wide/array vector forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dim_columns(df: DataFrame) -> list[str]:
    """The ``dim_<i>`` columns in numeric order."""
    names = [c for c in df.columns if c.startswith("dim_") and c[4:].isdigit()]
    return sorted(names, key=lambda c: int(c[4:]))


def with_vector(df: DataFrame, out: str = "vec") -> DataFrame:
    """Replace the wide ``dim_*`` columns by one ``array<double>``."""
    dims = dim_columns(df)
    keep = [F.col(f"`{c}`") for c in df.columns if c not in set(dims)]
    return df.select(*keep, F.array(*[F.col(c).cast("double") for c in dims]).alias(out))


def widen_vector(df: DataFrame, n_dims: int, vec: str = "vec") -> DataFrame:
    """The inverse of :func:`with_vector`, for export."""
    keep = [F.col(f"`{c}`") for c in df.columns if c != vec]
    return df.select(*keep, *[F.col(vec)[i].alias(f"dim_{i}") for i in range(n_dims)])


def usable(vec: Column) -> Column:
    """No null, NaN or infinite component and not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def normal_form(code: Column) -> Column:
    """Spaces and tabs removed at both ends, upper case."""
    return F.upper(F.trim(code, F.lit(" \t")))
