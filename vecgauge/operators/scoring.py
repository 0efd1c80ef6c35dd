"""The whole battery on one space and preparation arm, joined into one row and a curve by k.

``space`` has ``id, label, vec, split``; ``label`` is the planted cluster, null where
there is none. The numbers of repeats, draws and resamples are the callers', with
the frozen constants as defaults.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgauge.operators import confounds, learning, preparation, replicates, scores
from vecgauge.operators import geometry as geo

KS, REPEATS, DRAWS, RESAMPLES, COMPARISON_K = list(range(2, 11)), 20, 20, 25, 5
PRIMARY_ARM = "spherical"
TRAIN = "split = 'train'"


def post_preparation_cosine(space: DataFrame) -> float | None:
    """Mean cosine to the centroid after the primary arm, which is fitted on train."""
    return geo.mean_cosine(preparation.prepare(space, PRIMARY_ARM, TRAIN)).first().mean_cosine


def run_clustering(space: DataFrame, scaling: str = PRIMARY_ARM, ks: list[int] = KS, repeats: int = REPEATS) -> dict[str, DataFrame]:
    """``labels, sweep, metrics, sizes`` of k-means at the chosen k, fitted on the training rows of the prepared space."""
    matrix = preparation.prepare(space, scaling, TRAIN)
    sweep = replicates.summarise_curve(replicates.strength_curves(matrix.where(TRAIN), ks, repeats))
    k = chosen_k(sweep)
    labels = labels_frame(matrix, k)
    rows = matrix.drop("label").join(labels.select("id", F.col("cluster").alias("label")), "id")
    return {"labels": labels, "sweep": sweep, "metrics": preparation.metrics_by_split(rows), "sizes": scores.group_shares(labels, "split", "cluster")}


def chosen_k(sweep: DataFrame) -> int | None:
    row = scores.choose_k(sweep.select(F.lit(1).alias("one"), "k", F.col("strength_mean").alias("strength")), ["one"]).first()
    return row.chosen_k if row else None


def labels_frame(matrix: DataFrame, k: int) -> DataFrame:
    """``id, split, cluster, confidence``: nearest centre of the training fit, and the softmax of minus the squared distances."""
    fitted = replicates.fitted_labels(matrix, k, matrix.where(TRAIN))
    centres = geo.mean_vectors(fitted.where(TRAIN).select("id", F.col("cluster").alias("label"), "vec"), "label")
    near = geo.nearest_centroid(matrix, centres)
    return matrix.select("id", "split").join(near.select("id", "cluster", "confidence"), "id")


def at_k(curve: DataFrame, k: int | None, column: str) -> float | None:
    """A column of a curve at one k; null where it wasn't swept."""
    row = curve.where(F.col("k") == k).select(column).first() if k is not None else None
    return row[0] if row else None


def worst_decoy(by_covariate: DataFrame, confound: str, column: str):
    """The highest value of any covariate but the confound."""
    return by_covariate.where(F.col("covariate") != confound).agg(F.max(column)).first()[0]


def representation_row(space: DataFrame, scaling: str) -> dict:
    """Mechanical checks, of the vectors as they are; the cosine after preparation for the primary arm only."""
    checks, rank = geo.embedding_checks(space.select("id", "label", "vec")).first(), geo.rankme(space)
    return {
        "n_nan_rows": checks.n_nan_rows, "n_constant_dims": checks.n_dead_dims, "n_duplicate_vectors": checks.n_duplicates, "mean_cosine": checks.mean_cosine, "rankme": rank,
        "rankme_ratio": rank / checks.n_dims, "mean_cosine_post_prep": post_preparation_cosine(space) if scaling == PRIMARY_ARM else None,
    }


def partition_row(matrix: DataFrame, sweep: DataFrame, stability: DataFrame, k: int) -> dict:
    """The partition at the chosen k, fitted and measured on train."""
    train = matrix.where(TRAIN)
    rows = replicates.fitted_labels(train, k).drop("label").withColumnRenamed("cluster", "label")
    m = preparation.metrics_by_split(rows, ("train",)).first()
    return {
        "chosen_k": k, "strength_at_chosen_k": at_k(sweep, k, "strength_mean"), "bootstrap_ari_at_chosen_k": at_k(stability, k, "mean_ari"),
        **{c: m[c] if m else None for c in ("silhouette", "calinski_harabasz", "davies_bouldin")},
    }


def gate_row(table: DataFrame | None) -> dict:
    """The null gate, or nulls where it did not run."""
    names = ("gate_verdict", "gate_any_k_beats_null", "gate_max_margin", "gate_k_at_max_margin", "gate_margin_at_comparison_k")
    if table is None:
        return {"gate_ran": False, **dict.fromkeys(names)}
    v = replicates.gate_verdict(table).first()
    return {"gate_ran": True, **dict(zip(names, (v.verdict, v.any_k_beats_null, v.max_margin, v.k_at_max_margin, at_k(table, COMPARISON_K, "margin")), strict=True))}


def decodability(space: DataFrame, covariates: DataFrame) -> DataFrame:
    """``covariate, r2_linear, r2_nonlinear`` of every continuous covariate, fitted on train and scored on val; null with too few rows."""
    names = [c for c in covariates.columns if c != "id" and confounds.is_numeric(covariates, c)]
    rows = space.join(covariates, "id", "left")
    out = []
    for name in names:
        linear = learning.ridge_decodability(rows, name).where("chosen").first()
        nonlinear = preparation.nonlinear_decodability(rows, name).first()
        out.append((name, None if linear is None else linear.r2_val, None if nonlinear is None else nonlinear.r2_val))
    table = space.sparkSession.createDataFrame(out, "covariate string, r2_linear double, r2_nonlinear double")
    return table.select("covariate", F.bround("r2_linear", 4).alias("r2_linear"), "r2_nonlinear")


def confound_row(space: DataFrame, covariates: DataFrame, confound: str, scaling: str) -> dict:
    """Orientation of the confound beside its decodability, and what decoys reach."""
    found = confounds.by_covariate(confounds.component_association(space, covariates, TRAIN, unit=scaling == PRIMARY_ARM)).persist()
    probes = decodability(space, covariates).persist()
    own, probe = found.where(F.col("covariate") == confound).first(), probes.where(F.col("covariate") == confound).first()
    row = {
        "pcr_confound_variance_weighted_r2": own.variance_weighted_r2, "pcr_confound_leading_pc_r2": own.leading_pc_r2, "pcr_decoy_max_variance_weighted_r2": worst_decoy(found, confound, "variance_weighted_r2"),
        "decode_confound_r2_linear": probe.r2_linear, "decode_confound_r2_nonlinear": probe.r2_nonlinear, "decode_decoy_max_r2_nonlinear": worst_decoy(probes, confound, "r2_nonlinear"),
    }
    found.unpersist()
    probes.unpersist()
    return row


def truth_row(matrix: DataFrame, n_clusters: int, k: int) -> dict:
    """How near the chosen k is to the planted one, and agreement with the planted labels at both; fitted on all rows that have one."""
    planted = matrix.where("label is not null")
    row = {"n_true_clusters": n_clusters, "k_error": None, "ari_at_chosen_k": None, "ari_at_true_k": None}
    if planted.isEmpty():
        return row
    ari = lambda at: geo.contingency_scores(replicates.fitted_labels(planted, at).select(F.col("label").alias("a"), F.col("cluster").alias("b"))).select(F.bround("ari", 4)).first()[0]
    return row | {"k_error": k - n_clusters, "ari_at_chosen_k": ari(k), "ari_at_true_k": ari(n_clusters)}


def declared_vs_measured(summary: dict, anisotropy: float, intrinsic_dim: float) -> dict:
    return {"anisotropy_error": round(summary["mean_cosine"] - anisotropy, 4), "rankme_minus_intrinsic_dim": round(summary["rankme"] - intrinsic_dim, 4)}


SUMMARY = """scaling string, n_nan_rows long, n_constant_dims long, n_duplicate_vectors long, mean_cosine double, rankme double, rankme_ratio double, mean_cosine_post_prep double,
    chosen_k long, strength_at_chosen_k double, bootstrap_ari_at_chosen_k double, silhouette double, calinski_harabasz double, davies_bouldin double,
    gate_ran boolean, gate_verdict string, gate_any_k_beats_null boolean, gate_max_margin double, gate_k_at_max_margin long, gate_margin_at_comparison_k double,
    pcr_confound_variance_weighted_r2 double, pcr_confound_leading_pc_r2 double, pcr_decoy_max_variance_weighted_r2 double, decode_confound_r2_linear double, decode_confound_r2_nonlinear double,
    decode_decoy_max_r2_nonlinear double, n_true_clusters long, k_error long, ari_at_chosen_k double, ari_at_true_k double, anisotropy_error double, rankme_minus_intrinsic_dim double"""


def score_space(
    space: DataFrame, covariates: DataFrame, confound: str, spec: dict, scaling: str = PRIMARY_ARM, run_gate: bool = False,
    ks: list[int] = KS, repeats: int = REPEATS, draws: int = DRAWS, resamples: int = RESAMPLES,
) -> tuple[DataFrame, DataFrame]:
    """One summary row, and a row for each k, of the battery on one arm.

    ``spec`` declares ``n_clusters, anisotropy, intrinsic_dim``. Every check reads
    the space through the arm, but for the mechanical ones.
    """
    matrix = preparation.prepare(space, scaling, TRAIN).persist()
    train = matrix.where(TRAIN)
    curves = replicates.strength_curves(train, ks, repeats, draws if run_gate else 0, sphere=scaling == PRIMARY_ARM).persist()
    sweep = replicates.summarise_curve(curves.where("draw < 0")).persist()
    stability = replicates.summarise_stability(replicates.stability_curve(train, ks, resamples)).persist()
    table = replicates.tendency(curves).persist() if run_gate else None
    k = chosen_k(sweep)
    summary = {
        "scaling": scaling, **representation_row(space, scaling), **partition_row(matrix, sweep, stability, k), **gate_row(table),
        **confound_row(space, covariates, confound, scaling), **truth_row(matrix, spec["n_clusters"], k),
    }
    summary |= declared_vs_measured(summary, spec["anisotropy"], spec["intrinsic_dim"])
    spark = space.sparkSession
    names = [c.strip().split()[0] for c in SUMMARY.split(",")]
    row = spark.createDataFrame([tuple(summary[n] for n in names)], SUMMARY)
    parts = [sweep, stability, *([table.drop("real")] if run_gate else [])]
    curve = reduce(lambda a, b: a.join(b, "k", "full"), parts).withColumn("scaling", F.lit(scaling))
    return row, curve
