"""Synthetic spaces with planted structure, generated row by row in the map tasks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecgauge.functions.scalars import dot, norm
from vecgauge.operators.learning import hash_normal, hash_uniform

STRUCTURES, ORIENTATIONS = ("discrete", "continuum"), ("none", "axis", "radial")
#: What a spec may leave out.
DEFAULTS = {"structure": "discrete", "intrinsic_dim": None, "confound_orientation": "none", "confound_strength": 0.0, "coupling": 0.0, "anisotropy": 0.0, "n_decoys": 0}


def orthonormal_basis(dims: int, seed: int) -> np.ndarray:
    """A random rotation of ``dims`` axes, columns of unit length."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0]


def checked_spec(spec: DataFrame, dims: int) -> DataFrame:
    """The spec with defaults; impossible spaces raise when they are read, spaces without rows are left out."""
    for name, value in DEFAULTS.items():
        if name not in spec.columns:
            spec = spec.withColumn(name, F.lit(dims if name == "intrinsic_dim" else value))
    confound_dims = F.when(F.col("confound_orientation") == "radial", 2).when(F.col("confound_orientation") == "axis", 1).otherwise(0)
    refusals = {
        "more clusters than dimensions": (F.col("n_clusters") >= 1) & (F.col("n_clusters") + confound_dims <= F.col("intrinsic_dim")),
        "more intrinsic than ambient dimensions": F.col("intrinsic_dim") <= dims,
        "anisotropy outside [0, 1)": (F.col("anisotropy") >= 0) & (F.col("anisotropy") < 1),
        "unknown structure": F.col("structure").isin(*STRUCTURES),
        "unknown confound orientation": F.col("confound_orientation").isin(*ORIENTATIONS),
    }
    ok = F.coalesce(*[F.assert_true(F.coalesce(c, F.lit(False)), F.lit(why)) for why, c in refusals.items()])
    return spec.where("n_rows > 0").withColumn("confound_dims", confound_dims).withColumn("ok", ok).where("ok is null").drop("ok")


def _latent(key: list[Column], seed: int) -> Column:
    """The latent vector of a row: structure, confound, background, each dimension with unit scatter of its own."""
    k, label, at = F.col("n_clusters"), F.col("label"), F.col("position") * (F.col("n_clusters") - 1)
    side, value = F.col("separation") / math.sqrt(2), F.col("confound")
    angle = 2 * math.pi * hash_uniform(seed + 5, *key)

    def dimension(j: Column) -> Column:
        own = hash_normal(seed + 2, *key, j)
        blob = (label == j).cast("double") - 1 / k
        # a walk along the polyline through the centres passes each inner one twice as long as the two ends
        share = F.when(k == 1, 1.0).when((j == 0) | (j == k - 1), 0.5 / (k - 1)).otherwise(1 / (k - 1))
        walk = F.greatest(F.lit(0.0), 1 - F.abs(at - j)) - share
        planted = F.when(F.col("structure") == "discrete", blob).otherwise(walk)
        radius = F.col("confound_strength") * F.exp(0.5 * value)
        confound = F.when(F.col("confound_dims") == 1, F.col("confound_strength") * value).when(j == k, radius * F.cos(angle)).otherwise(radius * F.sin(angle))
        return F.when(j < k, side * planted + own).when(j < k + F.col("confound_dims"), confound).otherwise(own)

    return F.transform(F.sequence(F.lit(0), F.col("intrinsic_dim").cast("int") - 1), dimension)


def simulate_spaces(spec: DataFrame, dims: int = 16, seed: int = 0) -> DataFrame:
    """``cell_id, id, label, position, split, log_n_events, decoys, vec`` for each row of the spec.

    The spec has ``cell_id, n_rows, n_clusters, separation, noise`` and may have
    the columns of ``DEFAULTS``. Discrete spaces have clusters whose centres lie
    ``separation`` apart around a mean of zero (``position`` is null); a
    continuum is a walk along the line through the same centres (``label`` is
    null). ``log_n_events`` is the confound, coupled to the structure by
    ``coupling`` and planted along an axis or as a radius. The latent vector is
    rotated into ``dims`` dimensions, gets ambient noise, and by ``anisotropy``
    the whole space is moved along one direction. Every number comes from a hash
    of cell, row and dimension, so any part can be made again by itself.
    """
    rows = checked_spec(spec, dims).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)).alias("id"))
    key = [F.col("cell_id"), F.col("id")]
    discrete, u, k = F.col("structure") == "discrete", hash_uniform(seed + 1, *key), F.col("n_clusters")
    rows = rows.withColumn("label", F.when(discrete, F.floor(hash_uniform(seed, *key) * k))).withColumn("position", F.when(~discrete, hash_uniform(seed, *key)))
    along = F.when(discrete, F.coalesce(F.try_divide(2.0 * F.col("label"), k - 1), F.lit(1.0)) - 1).otherwise(2 * F.col("position") - 1)
    rows = rows.withColumn("confound", hash_normal(seed + 4, *key) + F.col("coupling") * along)
    split = F.when(u < 0.6, "train").when(u < 0.8, "val").otherwise("test")
    decoys = F.when(F.col("n_decoys") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_decoys").cast("int"), F.lit(1))), lambda i: hash_normal(seed + 6, *key, i))).otherwise(F.array().cast("array<double>"))

    basis = orthonormal_basis(dims, seed)
    axes = spec.sparkSession.createDataFrame([([[float(x) for x in r] for r in basis],)], "axes array<array<double>>")
    latent = F.concat(_latent(key, seed), F.array_repeat(F.lit(0.0), F.lit(dims) - F.col("intrinsic_dim").cast("int")))
    rows = rows.withColumn("latent", latent).join(F.broadcast(axes))
    vec = F.transform("axes", lambda axis, i: dot(axis, F.col("latent")) + F.col("noise") * hash_normal(seed + 3, *key, i))
    made = rows.select("cell_id", "id", "label", "position", split.alias("split"), F.col("confound").alias("log_n_events"), decoys.alias("decoys"), "anisotropy", vec.alias("vec"))
    if "anisotropy" not in spec.columns:
        return made.drop("anisotropy")
    direction = F.lit(1 / math.sqrt(dims))
    radius = made.groupBy("cell_id").agg(F.avg(norm(F.col("vec"))).alias("radius"))
    shift = F.col("radius") * F.col("anisotropy") / F.sqrt(1 - F.col("anisotropy") * F.col("anisotropy")) * direction
    return made.join(radius, "cell_id").withColumn("vec", F.transform("vec", lambda x: x + shift)).drop("radius", "anisotropy")
