"""Repeated clusterings as work units: a row for each (draw, k, repeat), spread over tasks.

A battery fits thousands of small clusterings of one table. Where the table is
below a checked number of bytes it is broadcast once, and every task works off
its units; a null draw is made anew in each task from the seed, the mean and the
covariance, so no draw is ever sent. A larger table is not broadcast: its fits are
distributed one by one (``learning.prediction_strength`` and ``learning.stability``).
Every unit's random numbers come from the seed and its own key, so no result
depends on how the units are spread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most bytes of a table that are broadcast.
MATRIX_BYTES = 64 << 20
STARTS, PASSES, TOLERANCE = 10, 100, 1e-4
CURVE = "draw long, k long, repeat long, strength double"


def broadcast_matrix(vectors: DataFrame) -> np.ndarray | None:
    """The rows in order of id, or None where they take more than ``MATRIX_BYTES``."""
    n, dims = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    if n * (dims or 0) * 8 > MATRIX_BYTES:
        return None
    rows = vectors.select("id", "vec").collect()
    return np.array([r.vec for r in sorted(rows, key=lambda r: r.id)], float).reshape(n, dims or 0)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * (x @ centres.T) + (centres**2).sum(1)[None, :]


def _spread_starts(x: np.ndarray, k: int, rng: np.random.Generator, starts: int) -> np.ndarray:
    """Starting centres, each drawn in proportion to the squared distance from those before it."""
    centres = np.empty((starts, k, x.shape[1]), x.dtype)
    centres[:, 0] = x[rng.integers(0, len(x), starts)]
    near = np.maximum(_squares(x, centres[:, 0]), 0).T
    for j in range(1, k):
        total = near.cumsum(1)
        chosen = (total < rng.random((starts, 1)) * total[:, -1:]).sum(1).clip(0, len(x) - 1)
        centres[:, j] = x[chosen]
        near = np.minimum(near, np.maximum(_squares(x, centres[:, j]), 0).T)
    return centres


def fit_centres(x: np.ndarray, k: int, rng: np.random.Generator, starts: int = STARTS) -> np.ndarray:
    """k-means of the least inertia of several starts, which share the passes."""
    x = np.ascontiguousarray(x, np.float32)
    k = min(k, len(x))
    centres = _spread_starts(x, k, rng, starts)
    limit = TOLERANCE * float(x.var(0).mean())
    active = np.arange(starts)
    inertia = np.full(starts, np.inf)
    own = (x**2).sum(1)
    for _ in range(PASSES):
        part = centres[active]
        d = (part**2).sum(2)[None] - 2 * (x @ part.reshape(-1, x.shape[1]).T).reshape(len(x), len(active), k)
        label = d.argmin(2)
        inertia[active] = (np.take_along_axis(d, label[:, :, None], 2)[:, :, 0] + own[:, None]).sum(0)
        hot = np.zeros((len(x), len(active) * k), np.float32)
        hot[np.arange(len(x))[:, None], label + k * np.arange(len(active))[None, :]] = 1
        n = hot.sum(0).reshape(len(active), k, 1)
        new = np.where(n > 0, (hot.T @ x).reshape(len(active), k, -1) / np.maximum(n, 1), part)
        centres[active] = new
        active = active[((new - part) ** 2).sum((1, 2)) > limit]
        if not len(active):
            break
    return centres[inertia.argmin()].astype(float)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _squares(x, centres).argmin(1)


def _pairs(n: np.ndarray) -> np.ndarray:
    return n * (n - 1.0)


def split_strength(x: np.ndarray, k: int, rng: np.random.Generator) -> float:
    """Fits on two random halves; the least share of pairs of a test cluster that the training fit keeps together (1 for a single member)."""
    order, seed = rng.permutation(len(x)), int(rng.integers(2**31))
    train, test = x[order[: len(x) // 2]], x[order[len(x) // 2 :]]
    fit = lambda part: fit_centres(part, k, np.random.default_rng(seed))
    a, b = nearest(test, fit(train)), nearest(test, fit(test))
    table = np.zeros((k, k))
    np.add.at(table, (b, a), 1)
    size = table.sum(1)
    share = np.where(size > 1, _pairs(table).sum(1) / np.maximum(_pairs(size), 1), 1.0)
    return float(share[size > 0].min())


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    cells, rows, cols, every = (_pairs(t).sum() / 2 for t in (table, table.sum(1), table.sum(0), np.array([len(a)])))
    expected = rows * cols / max(every, 1)
    most = (rows + cols) / 2
    return 1.0 if most == expected else float((cells - expected) / (most - expected))


def _on_units(spark, units: list[tuple[int, int, int]], schema: str, shared: dict, work: Callable) -> DataFrame:
    """``work(matrix or draw, draw, k, repeat)`` for every unit; the longest ones first, so that they don't end last."""
    held = spark.sparkContext.broadcast(shared)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: tuple[int, np.ndarray] | None = None
        for frame in frames:
            rows = []
            for draw, k, repeat in sorted(map(tuple, frame.itertuples(index=False))):
                if known is None or known[0] != draw:
                    known = draw, held.value["matrix"] if draw < 0 else null_draw(held.value, draw)
                rows.append((draw, k, repeat, work(known[1], draw, k, repeat)))
            yield pd.DataFrame(rows, columns=["draw", "k", "repeat", "value"])

    table = spark.createDataFrame(sorted(units, key=lambda u: -u[1]), "draw long, k long, repeat long")
    parts = max(1, min(len(units), 4 * spark.sparkContext.defaultParallelism))
    return table.repartition(parts).mapInPandas(run, schema.replace("strength", "value").replace("ari", "value"))


def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the root of the covariance (n - 1) with 1e-9 on its diagonal."""
    cov = np.atleast_2d(np.cov(x.T)) + 1e-9 * np.eye(x.shape[1])
    values, vectors = np.linalg.eigh(cov)
    return x.mean(0), vectors * np.sqrt(np.maximum(values, 0))


def null_draw(shared: dict, draw: int) -> np.ndarray:
    """As many Gaussian rows with the mean and covariance of the table; on the unit sphere where the table is."""
    rng = np.random.default_rng([shared["seed"], draw])
    z = shared["mean"] + rng.standard_normal((shared["n"], len(shared["mean"]))) @ shared["root"].T
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12) if shared["sphere"] else z


def strength_curves(vectors: DataFrame, ks: list[int], repeats: int, draws: int = 0, seed: int = 0, sphere: bool = False) -> DataFrame:
    """``draw, k, repeat, strength``; draw -1 is the table itself.

    A table of fewer than four rows, and k above half its rows, give no rows.
    """
    spark = vectors.sparkSession
    matrix = broadcast_matrix(vectors)
    if matrix is None:
        return spark.createDataFrame(_distributed_strengths(vectors, ks, repeats, draws, seed, sphere), CURVE)
    ks = [k for k in ks if 1 <= k <= len(matrix) // 2]
    if len(matrix) < 4 or not ks:
        return spark.createDataFrame([], CURVE)
    mean, root = moments(matrix)
    shared = {"matrix": matrix, "n": len(matrix), "mean": mean, "root": root, "seed": seed, "sphere": sphere}
    units = [(d, k, r) for d in range(-1, draws) for k in ks for r in range(repeats)]

    def work(x: np.ndarray, draw: int, k: int, repeat: int) -> float:
        return split_strength(x, k, np.random.default_rng([seed, draw + 1, k, repeat]))

    return _on_units(spark, units, CURVE, shared, work).withColumnRenamed("value", "strength")


def _distributed_strengths(vectors: DataFrame, ks: list[int], repeats: int, draws: int, seed: int, sphere: bool) -> list[tuple[int, int, int, float]]:
    from vecgauge.operators import geometry, learning

    rows = []
    for draw in range(-1, draws):
        table = vectors if draw < 0 else learning.null_draw(vectors, seed + draw)
        table = (geometry.normalised(table) if sphere and draw >= 0 else table).persist()
        rows += [(draw, k, r, learning.prediction_strength(table, k, seed + 1000 * r + k)) for k in ks for r in range(repeats)]
        table.unpersist()
    return rows


def summarise_curve(curve: DataFrame) -> DataFrame:
    """``k, strength_mean, strength_std``: half-even to four digits, with the population deviation."""
    return curve.groupBy("k").agg(F.bround(F.avg("strength"), 4).alias("strength_mean"), F.bround(F.stddev_pop("strength"), 4).alias("strength_std"))


def tendency(curves: DataFrame) -> DataFrame:
    """``k, real, null_median, null_p95, exceeds_null, margin`` from ``strength_curves`` with draws.

    Means of the repeats are compared with the 95th percentile over the draws
    before anything is rounded.
    """
    means = curves.groupBy("draw", "k").agg(F.avg("strength").alias("s"))
    out = means.groupBy("k").agg(
        F.max(F.when(F.col("draw") < 0, F.col("s"))).alias("real"), F.percentile(F.when(F.col("draw") >= 0, F.col("s")), F.lit(0.5)).alias("null_median"),
        F.percentile(F.when(F.col("draw") >= 0, F.col("s")), F.lit(0.95)).alias("null_p95"),
    )
    four = lambda c: F.bround(c, 4).alias(c)
    return out.select(
        "k", four("real"), four("null_median"), four("null_p95"), (F.col("real") > F.col("null_p95")).alias("exceeds_null"),
        F.bround(F.try_divide(F.col("real") - F.col("null_median"), 1 - F.col("null_median")), 4).alias("margin"),
    )


def gate_verdict(table: DataFrame, threshold: float = 0.10) -> DataFrame:
    """One row from ``tendency``: ``any_k_beats_null, max_margin, k_at_max_margin, verdict, sentence``; of equal margins the smallest k.

    Nothing to judge gives a null verdict.
    """
    best = F.max(F.when(F.col("margin").isNotNull(), F.struct("margin", (-F.col("k")).alias("k"))))
    row = table.agg(F.bool_or("exceeds_null").alias("any_k_beats_null"), best["margin"].alias("max_margin"), (-best["k"]).alias("k_at_max_margin"))
    verdict = F.when(F.col("any_k_beats_null").isNull(), None).when(~F.col("any_k_beats_null"), "CONTINUOUS").when(F.col("max_margin") < threshold, "WEAK").otherwise("DISCRETE")
    text = F.when(F.col("verdict") == "CONTINUOUS", F.lit("no k is stronger than the covariance-matched null")).otherwise(
        F.format_string("greatest margin %.4f over the null at k = %d", "max_margin", "k_at_max_margin")
    )
    return row.withColumn("verdict", verdict).withColumn("sentence", F.when(F.col("verdict").isNotNull(), F.concat_ws(": ", "verdict", text)))


def stability_curve(vectors: DataFrame, ks: list[int], resamples: int = 25, seed: int = 0) -> DataFrame:
    """``k, repeat, ari``: agreement of the fit on each resample with replacement (of a large table, with Poisson weights) with the fit on all."""
    matrix = broadcast_matrix(vectors)
    if matrix is None:
        from vecgauge.operators import learning

        parts = [learning.stability(vectors, k, resamples).select(F.lit(k).cast("long").alias("k"), F.col("resample").alias("repeat"), "ari") for k in ks]
        return reduce(DataFrame.unionByName, parts)
    spark, schema = vectors.sparkSession, "draw long, k long, repeat long, ari double"
    ks = [k for k in ks if 1 <= k <= len(matrix)]
    if not len(matrix) or not ks:
        return spark.createDataFrame([], "k long, repeat long, ari double")

    def work(x: np.ndarray, draw: int, k: int, repeat: int) -> float:
        base = nearest(x, fit_centres(x, k, np.random.default_rng([seed, k])))
        rows = np.random.default_rng([seed, k, repeat + 1]).integers(0, len(x), len(x))
        return adjusted_rand(base, nearest(x, fit_centres(x[rows], k, np.random.default_rng([seed, k]))))

    units = [(-1, k, r) for k in ks for r in range(resamples)]
    return _on_units(spark, units, schema, {"matrix": matrix}, work).select("k", "repeat", F.col("value").alias("ari"))


def summarise_stability(curve: DataFrame) -> DataFrame:
    """``k, mean_ari, std_ari``: half-even to four digits, with the population deviation."""
    return curve.groupBy("k").agg(F.bround(F.avg("ari"), 4).alias("mean_ari"), F.bround(F.stddev_pop("ari"), 4).alias("std_ari"))


def fitted_labels(vectors: DataFrame, k: int, fit: DataFrame | None = None, seed: int = 0, starts: int = STARTS) -> DataFrame:
    """``vectors`` with ``cluster``, of k-means fitted on ``fit`` (null: all) with several starts; null without rows to fit on.

    A fit table above ``MATRIX_BYTES`` is fitted by MLlib, start by start.
    """
    matrix = broadcast_matrix(vectors if fit is None else fit)
    if matrix is None:
        from vecgauge.operators.learning import assign, kmeans

        return assign(kmeans(vectors if fit is None else fit, k, seed, starts), vectors)
    if not len(matrix):
        return vectors.withColumn("cluster", F.lit(None).cast("int"))
    centres = fit_centres(matrix, k, np.random.default_rng(seed), starts)

    @F.pandas_udf("int")
    def cluster(vec: pd.Series) -> pd.Series:
        return pd.Series(nearest(np.stack(vec.to_numpy()), centres).astype(np.int32), index=vec.index) if len(vec) else pd.Series([], dtype=np.int32)

    return vectors.withColumn("cluster", cluster("vec"))
