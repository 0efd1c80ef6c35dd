"""Whole-matrix geometry of vector tables: ``id, vec array<double>[, label]``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecgauge.functions.scalars import dot, l2_normalise, norm, squared_distance
from vecgauge.operators.scores import exact_quantile


def long_form(vectors: DataFrame) -> DataFrame:
    """``id, label, dim, x``, one row per component."""
    return vectors.select("id", "label", F.posexplode("vec").alias("dim", "x"))


def mean_vectors(vectors: DataFrame, *keys: str) -> DataFrame:
    """``keys, centroid``: component means, from sums formed in the map tasks."""
    means = long_form(vectors).groupBy(*keys, "dim").agg(F.avg("x").alias("m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))


def embedding_checks(vectors: DataFrame) -> DataFrame:
    """One row: size, faulty rows, dead dimensions, duplicates, norms, mean cosine to the centroid."""
    bad = lambda test: F.count_if(F.exists("vec", test))
    length = norm(F.col("vec"))
    basic = vectors.agg(
        F.count("*").alias("n"), F.max(F.size("vec")).cast("long").alias("n_dims"),
        bad(lambda x: F.isnan(x)).alias("n_nan_rows"), bad(lambda x: F.abs(x) == float("inf")).alias("n_inf_rows"),
        F.min(length).alias("norm_min"), F.max(length).alias("norm_max"),
    )
    copies = vectors.groupBy("vec").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))
    median = exact_quantile(vectors.select(length.alias("norm")), "norm", 0.5)
    basic = basic.join(F.broadcast(copies)).withColumn("norm_median", F.lit(median).cast("double"))
    dead = long_form(vectors).groupBy("dim").agg(F.stddev_pop("x").alias("s")).agg(F.count_if(F.col("s") < 1e-8).alias("n_dead_dims"))
    return basic.join(F.broadcast(dead)).join(F.broadcast(mean_cosine(vectors)))


def mean_cosine(vectors: DataFrame) -> DataFrame:
    """Mean cosine of the rows to their mean vector; the one-row mean is broadcast."""
    centre = mean_vectors(vectors.withColumn("all", F.lit(1)).select("id", "label", "vec"))
    both = vectors.join(F.broadcast(centre))
    return both.agg(F.avg(dot(F.col("vec"), F.col("centroid")) / (norm(F.col("vec")) * norm(F.col("centroid")) + 1e-12)).alias("mean_cosine"))


def normalised(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vec", l2_normalise(F.col("vec")))


def standardised(vectors: DataFrame, fit: Column | str | None = None) -> DataFrame:
    """Z-scores with the population deviation of the rows of ``fit`` (null: all); a constant dimension becomes 0."""
    long = long_form(vectors if fit is None else vectors.where(fit))
    stats = long.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    scale = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("scale"))
    z = F.zip_with("vec", "scale", lambda x, s: (x - s["m"]) / F.when(s["s"] > 0, s["s"]).otherwise(1.0))
    return vectors.join(F.broadcast(scale)).withColumn("vec", z).drop("scale")


def nearest_centroid(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``id, cluster, distance, confidence``: the nearest of a few centroids and the softmax of minus the squared distances.

    The centroids (one array for all rows) are broadcast; their number is that
    of the clusters.
    """
    table = centroids.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("c"))
    d = F.transform("c", lambda c: F.struct(squared_distance(F.col("vec"), c["centroid"]).alias("d"), c["label"].alias("cluster")))
    best = vectors.join(F.broadcast(table)).select("id", "label", d.alias("d")).withColumn("best", F.array_min("d"))
    weight = F.aggregate("d", F.lit(0.0), lambda s, x: s + F.exp(F.col("best.d") - x["d"]))
    return best.select("id", "label", F.col("best.cluster").alias("cluster"), F.sqrt("best.d").alias("distance"), (1 / weight).alias("confidence"))


def cluster_scatter(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``label, n, centroid, mean_distance, within``: what the centroid-based indices need."""
    rows = vectors.join(F.broadcast(centroids), "label")
    d2 = squared_distance(F.col("vec"), F.col("centroid"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.any_value("centroid").alias("centroid"), F.avg(F.sqrt(d2)).alias("mean_distance"), F.sum(d2).alias("within"))


def calinski_harabasz(vectors: DataFrame) -> DataFrame:
    """Between- over within-cluster variance, one row."""
    scatter = cluster_scatter(vectors, mean_vectors(vectors, "label"))
    centre = mean_vectors(vectors).withColumnRenamed("centroid", "middle")
    s = scatter.join(F.broadcast(centre)).agg(
        F.sum(F.col("n") * squared_distance(F.col("centroid"), F.col("middle"))).alias("b"), F.sum("within").alias("w"), F.count("*").alias("k"), F.sum("n").alias("n")
    )
    return s.select(F.try_divide(F.try_divide(F.col("b"), F.col("k") - 1), F.try_divide(F.col("w"), F.col("n") - F.col("k"))).alias("calinski_harabasz"))


def davies_bouldin(vectors: DataFrame) -> DataFrame:
    """Mean over clusters of the worst ratio of spreads to separation, one row; clusters meet clusters, not rows."""
    s = cluster_scatter(vectors, mean_vectors(vectors, "label"))
    a = s.select(F.col("label").alias("i"), F.col("mean_distance").alias("si"), F.col("centroid").alias("ci"))
    b = s.select(F.col("label").alias("j"), F.col("mean_distance").alias("sj"), F.col("centroid").alias("cj"))
    worst = a.join(b, F.col("i") != F.col("j")).groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / F.sqrt(squared_distance(F.col("ci"), F.col("cj")))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def _distance_sums(key, part: pd.DataFrame) -> pd.DataFrame:
    asked, held = part[part["asks"]], part[~part["asks"]]
    if not len(asked) or not len(held):
        return pd.DataFrame({"id": [], "own": [], "label": [], "total": [], "n": []})
    x, y = np.stack(asked["vec"].to_numpy()), np.stack(held["vec"].to_numpy())
    d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None, :]))
    d[asked["id"].to_numpy()[:, None] == held["id"].to_numpy()[None, :]] = 0
    labels, at = np.unique(held["label"].to_numpy(), return_inverse=True)
    onehot = np.eye(len(labels))[at]
    total, n = d @ onehot, onehot.sum(0)
    return pd.DataFrame({
        "id": np.repeat(asked["id"].to_numpy(), len(labels)), "own": np.repeat(asked["label"].to_numpy(), len(labels)),
        "label": np.tile(labels, len(asked)), "total": total.ravel(), "n": np.tile(n, len(asked)).astype(np.int64),
    })


def silhouettes(vectors: DataFrame, block_rows: int = 4000) -> DataFrame:
    """``id, silhouette``, exact and Euclidean; 0 for a singleton.

    Blocks of rows meet blocks of rows in a task, which returns sums of
    distances per row and cluster; no pair of rows ever leaves a task.
    """
    blocks = max(1, -(-vectors.count() // block_rows))
    rows = vectors.select("id", "label", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asks = rows.select("id", "label", "vec", F.col("b").alias("qb"), every.alias("db"), F.lit(True).alias("asks"))
    held = rows.select("id", "label", "vec", every.alias("qb"), F.col("b").alias("db"), F.lit(False).alias("asks"))
    sums = asks.unionByName(held).groupBy("qb", "db").applyInPandas(_distance_sums, "id long, own long, label long, total double, n long")
    sums = sums.groupBy("id", "own", "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("own") == F.col("label")
    ab = sums.groupBy("id").agg(F.max(F.when(own, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    return ab.select("id", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def contingency_scores(pairs: DataFrame) -> DataFrame:
    """Adjusted Rand index of the columns ``a`` and ``b``, in closed form, one row."""
    c2 = lambda n: n * (n - 1) / 2
    cells = pairs.groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("n")), cells.groupBy("b").agg(F.sum("n").alias("n"))
    total = (
        cells.agg(F.sum(c2(F.col("n"))).alias("s"), F.sum("n").alias("n")).join(rows.agg(F.sum(c2(F.col("n"))).alias("r"))).join(cols.agg(F.sum(c2(F.col("n"))).alias("c")))
    )
    expected = F.try_divide(F.col("r") * F.col("c"), c2(F.col("n")))
    return total.select(F.coalesce(F.try_divide(F.col("s") - expected, (F.col("r") + F.col("c")) / 2 - expected), F.lit(1.0)).alias("ari"))


def comembership_strength(pairs: DataFrame) -> DataFrame:
    """Least share, over the clusters ``b``, of pairs of members that ``a`` keeps together; 1 for a single member."""
    cells = pairs.groupBy("b", "a").agg(F.count("*").alias("n"))
    per = cells.groupBy("b").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("together"), F.sum("n").alias("size"))
    return per.agg(F.min(F.coalesce(F.try_divide(F.col("together"), F.col("size") * (F.col("size") - 1)), F.lit(1.0))).alias("strength"))


def gram(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """``n, sum of x, sum of xx'`` from one pass; each task sends one d x d matrix.

    Rows with a null, NaN or infinite component do not count.
    """

    def partial(frames):
        n, s, g = 0, None, None
        for f in frames:
            x = np.stack(f["vec"].to_numpy()).astype(float)
            x = x[np.isfinite(x).all(1)]
            if len(x):
                n += len(x)
                s = x.sum(0) if s is None else s + x.sum(0)
                g = x.T @ x if g is None else g + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "g": [g.ravel()]})

    def add(key, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [part["n"].sum()], "s": [np.sum(np.stack(part["s"].to_numpy()), axis=0)], "g": [np.sum(np.stack(part["g"].to_numpy()), axis=0)]})

    schema = "n long, s array<double>, g array<double>"
    parts = vectors.select("vec").mapInPandas(partial, schema).withColumn("portion", F.pmod(F.spark_partition_id(), F.lit(32)))
    sums = parts.groupBy("portion").applyInPandas(add, schema).collect()
    if not sums:
        return 0, np.zeros(0), np.zeros((0, 0))
    s = np.sum([r.s for r in sums], axis=0)
    return sum(r.n for r in sums), s, np.sum([r.g for r in sums], axis=0).reshape(len(s), len(s))


def principal_axes(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, axes (columns, leading first) and explained variance ratios, from the Gram matrix."""
    n, s, g = gram(vectors)
    mean = s / n
    values, axes = np.linalg.eigh(g / n - np.outer(mean, mean))
    order = np.argsort(-values)
    values = np.maximum(0, values[order])
    return mean, axes[:, order], values / max(values.sum(), 1e-300)


def rankme(vectors: DataFrame) -> float:
    """Effective rank of the uncentred matrix: the exponential of the entropy of its singular values."""
    _, _, g = gram(vectors)
    sigma = np.sqrt(np.maximum(0, np.linalg.eigvalsh(g)))
    p = sigma / (sigma.sum() + 1e-7) + 1e-7
    return float(np.exp(-(p * np.log(p)).sum()))


def project(vectors: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """``vec`` becomes its scores on the axes, a product of each Arrow batch with the d x r matrix; a null vector stays null."""

    @F.pandas_udf("array<double>")
    def scores(vec: pd.Series) -> pd.Series:
        there = vec.notna()
        out = pd.Series([None] * len(vec), index=vec.index, dtype=object)
        if there.any():
            out[there] = pd.Series(list((np.stack(vec[there].to_numpy()) - mean) @ axes), index=vec.index[there])
        return out

    return vectors.withColumn("vec", scores("vec"))

