"""Distributed fits, probes and resampling on vector tables: ``id, vec array<double>[, label]``; repeated fits of tables that fit a task are in ``replicates``.

Single fits are distributed (MLlib, or sums formed in the map tasks and solved
as small dense systems), so the rows never gather anywhere; repeats differ only
by a seed that enters a hash of the row's id, so no result depends on how the
rows are partitioned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecgauge.functions.scalars import dot
from vecgauge.operators.geometry import comembership_strength, contingency_scores, gram, standardised
from vecgauge.operators.resamples import resampled_auroc
from vecgauge.operators.scores import auroc


def hash_uniform(seed: int | Column, *keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys and the seed only; the same in SQL engines with md5."""
    text = F.md5(F.concat_ws("-", *[k.cast("string") for k in keys], (F.lit(seed) if isinstance(seed, int) else seed).cast("string")))
    return (F.conv(F.substring(text, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def hash_normal(seed: int, *keys: Column) -> Column:
    return F.sqrt(-2 * F.log(hash_uniform(seed, *keys, F.lit("a")))) * F.cos(2 * math.pi * hash_uniform(seed, *keys, F.lit("b")))


def kmeans(vectors: DataFrame, k: int, seed: int = 0, restarts: int = 1):
    """The fit of least inertia of several seeds."""
    rows = vectors.select(array_to_vector("vec").alias("features"))
    fits = [KMeans(k=k, seed=seed + i, maxIter=50, tol=1e-4).fit(rows) for i in range(restarts)]
    return min(fits, key=lambda m: m.summary.trainingCost)


def assign(model, vectors: DataFrame, name: str = "cluster") -> DataFrame:
    return model.transform(vectors.withColumn("features", array_to_vector("vec"))).drop("features").withColumnRenamed("prediction", name)


def prediction_strength(vectors: DataFrame, k: int, seed: int = 0) -> float:
    """Fits on both halves; the least share of pairs of a test cluster that the training fit keeps together."""
    half = hash_uniform(seed, F.col("id")) < 0.5
    train, test = vectors.where(half), vectors.where(~half)
    a, b = kmeans(train, k, seed), kmeans(test, k, seed)
    both = assign(b, assign(a, test, "a"), "b")
    return comembership_strength(both.select("a", "b")).first().strength


def stability(vectors: DataFrame, k: int, resamples: int) -> DataFrame:
    """``resample, ari``: agreement of the fit on each resample (Poisson weights, whole copies) with the fit on all."""
    base = assign(kmeans(vectors, k), vectors, "a").select("id", "vec", "a")
    rows = []
    for r in range(resamples):
        copies = vectors.withColumn("w", poisson_weight(r, F.col("id"))).where("w > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("w"))))
        fit = kmeans(copies, k, seed=r)
        rows.append((r, contingency_scores(assign(fit, base, "b").select("a", "b")).first().ari))
    return vectors.sparkSession.createDataFrame(rows, "resample long, ari double")


def poisson_weight(seed: int | Column, *keys: Column) -> Column:
    """Poisson(1) copies of a row in a resample, from its hash."""
    u, weight, total, term = hash_uniform(seed, *keys), F.lit(0), 0.0, math.exp(-1)
    for i in range(8):
        total += term
        weight = weight + (u >= total).cast("int")
        term /= i + 1
    return weight


def null_draw(vectors: DataFrame, seed: int) -> DataFrame:
    """As many Gaussian rows with the mean and covariance of ``vectors``; each row is drawn from its id and the seed."""
    n, s, g = gram(vectors)
    mean = s / n
    root = np.linalg.cholesky((g - n * np.outer(mean, mean)) / max(1, n - 1) + 1e-9 * np.eye(len(s)))

    def draw(frames):
        for f in frames:
            # the numbers of a row follow from its id and the seed by a counter-based mixture, whatever batch it is in
            at = (f["id"].to_numpy().astype(np.int64).view(np.uint64)[:, None] * np.uint64(2 * len(mean)) + np.arange(2 * len(mean), dtype=np.uint64)[None, :]) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
            u = (mixed_bits(at) >> np.uint64(11)).astype(float) / float(1 << 53)
            z = np.sqrt(-2 * np.log(np.maximum(u[:, ::2], 1e-300))) * np.cos(2 * np.pi * u[:, 1::2])
            yield pd.DataFrame({"id": f["id"], "vec": list(mean + z @ root.T)})

    return vectors.select(F.col("id").cast("long").alias("id")).mapInPandas(draw, "id long, vec array<double>")


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which neighbours have nothing in common."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gmm_confidence(vectors: DataFrame, k: int, iterations: int = 100, floor: float = 1e-6, tolerance: float = 1e-3) -> DataFrame:
    """``id, component, confidence`` of a diagonal Gaussian mixture, by EM from a k-means start.

    Each pass sends k x (1 + 2 d) sums a task; it is the last once the mean
    log-likelihood grows by less than ``tolerance``.
    """
    n, s, g = gram(vectors)
    spread = np.maximum(np.diag(g) / n - (s / n) ** 2, floor)
    state = (np.full(k, 1 / k), np.stack(kmeans(vectors, k).clusterCenters()), np.tile(spread, (k, 1)))

    def posterior(x, pi, mu, var):
        log = np.log(pi + 1e-300) - 0.5 * (np.log(var).sum(1) + ((x[:, None, :] - mu) ** 2 / var).sum(-1))
        log -= 0.5 * len(s) * math.log(2 * math.pi)
        top = log.max(1, keepdims=True)
        p = np.exp(log - top)
        return p / p.sum(1, keepdims=True), float((top[:, 0] + np.log(p.sum(1))).sum())

    def step(state):
        def run(frames):
            total = 0
            for f in frames:
                x = np.stack(f["vec"].to_numpy())
                for low in range(0, len(x), 2000):
                    part = x[low : low + 2000]
                    p, likelihood = posterior(part, *state)
                    total = total + np.append(np.concatenate([p.sum(0)[:, None], p.T @ part, p.T @ part**2], axis=1), likelihood)
            if not np.isscalar(total):
                yield pd.DataFrame({"sums": [total]})

        return run

    before = -math.inf
    for _ in range(iterations):
        rows = vectors.select("vec").mapInPandas(step(state), "sums array<double>").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        sums = np.zeros(k * (1 + 2 * len(s)) + 1)
        for r in rows:
            sums[r.i] = r.x
        likelihood, sums = sums[-1] / max(1, n), sums[:-1].reshape(k, -1)
        weight = np.maximum(sums[:, :1], 1e-12)
        mu = sums[:, 1 : 1 + len(s)] / weight
        state = (sums[:, 0] / sums[:, 0].sum(), mu, np.maximum(sums[:, 1 + len(s) :] / weight - mu**2, floor))
        if likelihood - before < tolerance:
            break
        before = likelihood

    def final(frames):
        for f in frames:
            p = np.concatenate([posterior(np.stack(f["vec"].iloc[low : low + 2000].to_numpy()), *state)[0] for low in range(0, len(f), 2000)])
            yield pd.DataFrame({"id": f["id"], "component": p.argmax(1), "confidence": p.max(1)})

    return vectors.select(F.col("id").cast("long").alias("id"), "vec").mapInPandas(final, "id long, component long, confidence double")


ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)


def ridge_decodability(rows: DataFrame, target: str, alphas: tuple[float, ...] = ALPHAS, least_rows: int = 30) -> DataFrame:
    """``alpha, loo_error, r2_val, chosen``: ridge of ``target`` on ``vec``, fitted on ``split = 'train'``, scored on ``'val'``.

    The alpha of the least leave-one-out error on the training rows is chosen (of
    equal ones the smallest). One Gram pass over ``[vec, target]`` gives the normal
    equations, one pass over the training rows the leave-one-out errors, and one
    aggregation the scores. Rows with a missing target do not count; fewer than
    ``least_rows`` rows on either side give no rows; R2 may be negative.
    """
    spark = rows.sparkSession
    good = rows.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))).withColumn("y", F.col(target).cast("double"))
    n_train, n_val = good.agg(F.count_if(F.col("split") == "train"), F.count_if(F.col("split") == "val")).first()
    if n_train < least_rows or n_val < least_rows:
        return spark.createDataFrame([], "alpha double, loo_error double, r2_val double, chosen boolean")
    train = good.where("split = 'train'").select(F.concat("vec", F.array("y")).alias("vec"))
    n, s, g = gram(train)
    mean, c = s / n, g - np.outer(s, s) / n
    values, axes = np.linalg.eigh(c[:-1, :-1])
    values = np.maximum(values, 0)
    grid = np.array(alphas)
    weights = (axes.T @ c[:-1, -1])[:, None] / (values[:, None] + grid[None, :])

    def left_out(frames):
        total = np.zeros(len(grid))
        for f in frames:
            x = np.stack(f["vec"].to_numpy()) - mean
            z = x[:, :-1] @ axes
            leverage = 1 / n + (z**2) @ (1 / (values[:, None] + grid[None, :]))
            total += (((x[:, -1:] - z @ weights) / np.maximum(1 - leverage, 1e-9)) ** 2).sum(0)
        yield pd.DataFrame({"alpha": grid, "error": total})

    loo = {r.alpha: r.error for r in train.mapInPandas(left_out, "alpha double, error double").groupBy("alpha").agg(F.sum("error").alias("error")).collect()}
    best = min(alphas, key=lambda a: (loo[a], a))
    sums = [F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("sq"), F.count("*").alias("n")]
    for i in range(len(alphas)):
        w = axes @ weights[:, i]
        guess = dot(F.col("vec"), F.lit(w.tolist())) + float(mean[-1] - w @ mean[:-1])
        sums.append(F.sum((F.col("y") - guess) * (F.col("y") - guess)).alias(f"e{i}"))
    total = F.col("sq") - F.col("sy") * F.col("sy") / F.col("n")
    wide = good.where("split = 'val'").agg(*sums)
    row = lambda i, a: F.struct(F.lit(float(a)).alias("alpha"), F.lit(loo[a] / n).alias("loo_error"), (1 - F.try_divide(F.col(f"e{i}"), total)).alias("r2_val"), F.lit(a == best).alias("chosen"))
    return wide.select(F.inline(F.array(*[row(i, a) for i, a in enumerate(alphas)])))


CS = (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0)


def scorable(rows: DataFrame) -> dict[str, bool]:
    """Which splits hold both classes."""
    return {r.split: r.k > 1 for r in rows.groupBy("split").agg(F.count_distinct("y").alias("k")).collect()}


def standardised_on_train(rows: DataFrame) -> DataFrame:
    """``vec`` in z-scores of the training rows: what is held out has no part in them."""
    return standardised(rows.withColumn("label", F.col("y")), F.col("split") == "train")


def logistic_probe(rows: DataFrame, cs: tuple[float, ...] = CS) -> DataFrame:
    """``c, auroc_val, auroc_test``: logistic head on vectors standardised on train, C by the validation AUROC (ties: largest C).

    ``rows`` has ``id, vec, y, split``. Null where train or test holds one class
    only; where the validation rows do, the middle C is taken.
    """
    spark = rows.sparkSession
    schema = "c double, auroc_val double, auroc_test double"
    both = scorable(rows)
    if not both.get("train") or not both.get("test"):
        return spark.createDataFrame([(None, None, None)], schema)
    ready = standardised_on_train(rows).withColumn("features", array_to_vector("vec")).withColumn("label", F.col("y").cast("double"))
    train = ready.where("split = 'train'")
    n_train = train.count()

    def scored(c: float, split: str) -> tuple[float | None, object]:
        model = LogisticRegression(maxIter=1000, regParam=1 / (n_train * c), elasticNetParam=0.0, standardization=False).fit(train.select("features", "label"))
        return auroc_on(model, split), model

    def auroc_on(model, split: str) -> float | None:
        row = auroc(model.transform(ready.where(F.col("split") == split)).withColumn("score", vector_to_array("probability")[1]), [], "score", "y").first()
        return row.auroc if row else None

    if both.get("val"):
        found = [(*scored(c, "val"), c) for c in cs]
        value, model, c = max(found, key=lambda f: (f[0], f[2]))
        return spark.createDataFrame([(c, value, auroc_on(model, "test"))], schema)
    c = sorted(cs)[len(cs) // 2]
    return spark.createDataFrame([(c, None, scored(c, "test")[0])], schema)


def bootstrap_auroc(rows: DataFrame, score: str, y: str, resamples: int) -> DataFrame:
    """``low, high, n_used``: 95 % interval of the AUROC over Poisson resamples; those of a single class do not count.

    Each row meets the resamples in a map task, which sends on sums (see ``resamples``).
    """
    per = resampled_auroc(rows, score, y, resamples)
    return per.agg(F.percentile("auroc", F.lit(0.025)).alias("low"), F.percentile("auroc", F.lit(0.975)).alias("high"), F.count("*").alias("n_used"))
