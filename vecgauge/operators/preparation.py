"""Preparation arms of a vector table, metrics by split, and nonlinear decodability."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecgauge.functions.scalars import missing
from vecgauge.operators import geometry as geo

SCALINGS = ("raw", "standard", "spherical")


def prepare(vectors: DataFrame, scaling: str, fit: Column | str | None = None, n_components: int | None = None, n_drop: int = 1) -> DataFrame:
    """``vec`` in one of the arms; statistics come from the rows of ``fit`` (null: all), and hold for all rows.

    ``raw`` leaves the vectors, ``standard`` takes z-scores with the population
    deviation (a constant dimension becomes 0), ``spherical`` normalises, drops
    the ``n_drop`` leading principal axes, keeps up to ``n_components`` of the
    rest and normalises again; a zero vector stays zero. Any other name is
    refused. Only sums and a d x d matrix reach the driver.
    """
    if scaling not in SCALINGS:
        raise ValueError(f"unknown scaling {scaling!r}")
    if scaling == "raw":
        return vectors
    if scaling == "standard":
        return geo.standardised(vectors, fit)
    unit = geo.normalised(vectors)
    fitted = unit if fit is None else unit.where(fit)
    n_rows, dims = fitted.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n_rows:
        raise ValueError("no rows to fit on")
    mean, axes, _ = geo.principal_axes(fitted)
    n = max(1, min(n_components or dims, min(n_rows, dims) - n_drop))
    return geo.normalised(geo.project(unit, mean, axes[:, n_drop : n_drop + n]))


def metrics_by_split(rows: DataFrame, splits: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """``split, n, n_clusters, silhouette, calinski_harabasz, davies_bouldin`` of ``id, vec, label, split``.

    A split without rows or with fewer than two clusters is left out; if none is
    left, the result is empty.
    """
    sizes = {r.split: r for r in rows.where(F.col("split").isin(*splits)).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).collect()}
    parts = []
    for s in splits:
        if s in sizes and sizes[s].k > 1:
            part = rows.where(F.col("split") == s)
            mean = geo.silhouettes(part).agg(F.avg("silhouette").alias("silhouette"))
            head = mean.select(F.lit(s).alias("split"), F.lit(sizes[s].n).cast("long").alias("n"), F.lit(sizes[s].k).cast("long").alias("n_clusters"), "silhouette")
            parts.append(head.join(F.broadcast(geo.calinski_harabasz(part))).join(F.broadcast(geo.davies_bouldin(part))))
    if not parts:
        return rows.sparkSession.createDataFrame([], "split string, n long, n_clusters long, silhouette double, calinski_harabasz double, davies_bouldin double")
    return reduce(DataFrame.unionByName, parts)


def nonlinear_decodability(rows: DataFrame, target: str, rounds: int = 20, least_rows: int = 30) -> DataFrame:
    """``n_train, n_val, r2_val``: boosted trees for ``target`` on ``vec``, fitted on ``train``, scored on ``val``.

    Rows with a missing target do not count. With fewer than ``least_rows`` rows
    on either side, or a constant target there, the score is null; it may be
    negative.
    """
    good = rows.where(~missing(F.col(target).cast("double"))).select(F.col(target).cast("double").alias("y"), array_to_vector("vec").alias("features"), "split")
    train, val = good.where("split = 'train'"), good.where("split = 'val'")
    n_train, n_val = good.agg(F.count_if(F.col("split") == "train"), F.count_if(F.col("split") == "val")).first()
    schema = "n_train long, n_val long, r2_val double"
    if n_train < least_rows or n_val < least_rows:
        return rows.sparkSession.createDataFrame([(n_train, n_val, None)], schema)
    model = GBTRegressor(labelCol="y", featuresCol="features", maxIter=rounds, stepSize=0.1, maxDepth=5, minInstancesPerNode=20, seed=0, cacheNodeIds=False).fit(train)
    error = F.sum((F.col("y") - F.col("prediction")) * (F.col("y") - F.col("prediction")))
    total = F.var_pop("y") * F.count("*")
    return model.transform(val).agg(F.lit(n_train).alias("n_train"), F.count("*").alias("n_val"), F.bround(1 - F.try_divide(error, total), 4).alias("r2_val"))
