"""Nuisance covariates in a vector table: association with principal components, and their removal.

``vectors`` has ``id, label, vec``, ``covariates`` one row per ``id`` with a column
for each covariate. Statistics come from the rows of ``fit`` only.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from vecgauge.functions.scalars import missing
from vecgauge.operators import geometry as geo
from vecgauge.operators import scores


def is_numeric(covariates: DataFrame, name: str) -> bool:
    """Whether a covariate is continuous by its type; all others, booleans too, are levels."""
    return isinstance(covariates.schema[name].dataType, NumericType)


def association(rows: DataFrame, keys: list[str], y: str, covariates: DataFrame, names: list[str]) -> DataFrame:
    """``keys, covariate, r2``: squared correlation with each continuous covariate, correlation ratio with each of levels."""
    parts = []
    for name in names:
        r2 = scores.numeric_r2(rows, keys, name, y) if is_numeric(covariates, name) else scores.eta_squared(rows, keys, name, y).withColumnRenamed("eta2", "r2")
        parts.append(r2.select(*keys, F.lit(name).alias("covariate"), "r2"))
    return reduce(DataFrame.unionByName, parts)


def component_association(vectors: DataFrame, covariates: DataFrame, fit: Column | str | None = None, unit: bool = False) -> DataFrame:
    """``pc, explained, covariate, r2`` for every principal component of the fit rows (``unit``: of their directions).

    Rows without covariates count where a covariate is there; no row to fit on
    gives no rows.
    """
    names = [c for c in covariates.columns if c != "id"]
    table = geo.normalised(vectors) if unit else vectors
    fitted = table if fit is None else table.where(fit)
    if fitted.isEmpty():
        return vectors.sparkSession.createDataFrame([], "pc int, explained double, covariate string, r2 double")
    mean, axes, ratio = geo.principal_axes(fitted)
    scored = geo.project(fitted, mean, axes).join(covariates, "id", "left").select(*names, F.posexplode("vec").alias("pc", "score"))
    found = association(scored, ["pc"], "score", covariates, names)
    return found.withColumn("explained", F.element_at(F.lit(ratio.tolist()), F.col("pc") + 1)).select("pc", "explained", "covariate", "r2")


def by_component(found: DataFrame, names: list[str], n_top: int = 10) -> DataFrame:
    """``pc, explained, r2__<covariate>..., dominant_covariate, dominant_r2`` of the leading components, half-even to four digits.

    Of equally strong covariates the first of ``names`` dominates.
    """
    place = F.array_position(F.lit(names), F.col("covariate"))
    best = F.max(F.when(F.col("r2").isNotNull(), F.struct("r2", (-place).alias("place"), "covariate")))
    four = lambda c: F.bround(c, 4)
    return found.where(F.col("pc") < n_top).groupBy("pc").agg(
        four(F.max("explained")).alias("explained"), *[four(F.max(F.when(F.col("covariate") == n, F.col("r2")))).alias(f"r2__{n}") for n in names],
        best["covariate"].alias("dominant_covariate"), four(best["r2"]).alias("dominant_r2"),
    )


def by_covariate(found: DataFrame) -> DataFrame:
    """``covariate, variance_weighted_r2, leading_pc_r2, top_pc, top_pc_r2``; a missing association weighs nothing, of equal components the first is the top."""
    best = F.max(F.when(F.col("r2").isNotNull(), F.struct("r2", (-F.col("pc")).alias("pc"))))
    return found.groupBy("covariate").agg(
        F.bround(F.sum(F.col("explained") * F.coalesce("r2", F.lit(0.0))), 4).alias("variance_weighted_r2"),
        F.bround(F.max(F.when(F.col("pc") == 0, F.col("r2"))), 4).alias("leading_pc_r2"), (-best["pc"]).alias("top_pc"), F.bround(best["r2"], 4).alias("top_pc_r2"),
    )


def design_matrix(ids: DataFrame, covariates: DataFrame, fit: Column | str | None = None) -> DataFrame:
    """``ids`` with ``z``: each continuous covariate in z-scores of the fit rows, missing values at their mean.

    A covariate that the fit rows lack, or in which they don't vary, is 0 where
    it is missing and is only centred elsewhere. Covariates that are not
    continuous are refused.
    """
    names = [c for c in covariates.columns if c != "id"]
    for name in names:
        if not is_numeric(covariates, name):
            raise ValueError(f"covariate {name!r} is not continuous")
    rows = ids.join(covariates.select("id", *[F.when(~missing(F.col(n).cast("double")), F.col(n).cast("double")).alias(n) for n in names]), "id", "left")
    fitted = rows if fit is None else rows.where(fit)
    # the spread is that of the imputed values: missing ones lie at the mean
    stats = fitted.agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(f"m_{i}") for i, n in enumerate(names)], *[F.sqrt(F.try_divide(F.var_pop(n) * F.count(n), F.count("*"))).alias(f"s_{i}") for i, n in enumerate(names)])
    z = [(F.coalesce(F.col(n), F.col(f"m_{i}")) - F.col(f"m_{i}")) / F.when(F.col(f"s_{i}") > 0, F.col(f"s_{i}")).otherwise(1.0) for i, n in enumerate(names)]
    return rows.join(F.broadcast(stats)).select(*ids.columns, F.array(*z).alias("z"))


def residualised(vectors: DataFrame, covariates: DataFrame, fit: Column | str | None = None) -> DataFrame:
    """``vectors`` without each dimension's linear part in the covariates, fitted on the fit rows.

    One Gram pass over ``[z, vec]`` of the fit rows gives the normal equations;
    what reaches the driver is a square matrix of both widths.
    """
    rows = design_matrix(vectors, covariates, fit)
    n_cov = len(covariates.columns) - 1
    fitted = (rows if fit is None else rows.where(fit)).select(F.concat("z", "vec").alias("vec"))
    n, s, g = geo.gram(fitted)
    if not n:
        raise ValueError("no rows to fit on")
    mean, c = s / n, g - np.outer(s, s) / n
    slope = np.linalg.lstsq(c[:n_cov, :n_cov], c[:n_cov, n_cov:], rcond=None)[0]

    @F.pandas_udf("array<double>")
    def rest(vec: pd.Series, z: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype=object)
        out = np.stack(vec.to_numpy()) - mean[n_cov:] - (np.stack(z.to_numpy()) - mean[:n_cov]) @ slope
        return pd.Series(list(out), index=vec.index)

    return rows.withColumn("vec", rest("vec", "z")).drop("z")
