"""Result tables over scored cells: one row per condition, replicates rolled up.

``scored`` has ``cell_id, scaling``, the planted conditions and the scores of
``scoring.SUMMARY``; a cell's id ends in ``-s<replicate>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecgauge.functions.scalars import verdict
from vecgauge.operators.scores import spread, unanimous

PRIMARY = "spherical"


def condition_of(cell_id: Column) -> Column:
    """A cell's condition: its id up to the last ``-s``."""
    return F.regexp_replace(cell_id, "-s(?:(?!-s).)*$", "")


def sweep_of(cell_id: Column) -> Column:
    """The sweep a cell belongs to: its id without the replicate and the value; an id without a value is its own sweep."""
    return F.regexp_replace(condition_of(cell_id), "-[^-]*$", "")


#: The sweeps on which the null gate runs, and those of them where it runs on both arms.
GATE_SWEEPS = ("base", "separation", "continuum", "anisotropy", "cone-only", "noise", "n-patients", "imbalance")
GATE_BOTH_ARMS = ("anisotropy", "cone-only")


def runs_null_gate(cell_id: Column, scaling: Column) -> Column:
    sweep = sweep_of(cell_id)
    return sweep.isin(*GATE_SWEEPS) & ((scaling == PRIMARY) | sweep.isin(*GATE_BOTH_ARMS))


def with_condition(scored: DataFrame) -> DataFrame:
    return scored.withColumn("condition", condition_of(F.col("cell_id")))


def with_derived_verdict(scored: DataFrame, threshold: float = 0.10) -> DataFrame:
    """``gate_verdict`` anew from the recorded margin, so that the threshold may move; null where the gate did not run."""
    label = verdict(F.coalesce("gate_any_k_beats_null", F.lit(False)), F.col("gate_max_margin"), threshold)
    return scored.withColumn("gate_verdict", F.when(F.col("gate_ran"), label))


def _mean(column: str, name: str, digits: int = 3) -> Column:
    return F.bround(F.avg(F.when(~F.isnan(column), F.col(column))), digits).alias(name)


def _starts(*prefixes: str, also: str | None = None) -> Column:
    found = F.lit(False) if also is None else F.col("condition") == also
    for p in prefixes:
        found = found | F.col("condition").startswith(p)
    return found


def primary_rows(scored: DataFrame) -> DataFrame:
    return with_derived_verdict(with_condition(scored).where(F.col("scaling") == PRIMARY))


def separation_table(scored: DataFrame) -> DataFrame:
    """By planted separation: the gate's verdict and margin, the chosen ks, agreement at the true k, silhouette."""
    rows = primary_rows(scored).where(_starts("separation-", also="base"))
    return rows.groupBy("separation").agg(
        unanimous("gate_verdict").alias("verdict"), _mean("gate_max_margin", "margin"), spread("gate_k_at_max_margin").alias("k_at_max_margin"),
        _mean("ari_at_true_k", "ari_at_true_k"), spread("chosen_k").alias("chosen_k"), _mean("silhouette", "silhouette"),
    )


def continuum_table(scored: DataFrame, separations: tuple[float, ...] = (2.0, 3.0, 6.0)) -> DataFrame:
    """Blobs beside a continuum at matched separations."""
    rows = primary_rows(scored).where(F.col("separation").isin(*separations) & _starts("separation-", "continuum-", also="base"))
    return rows.groupBy("separation", "structure").agg(
        unanimous("gate_verdict").alias("verdict"), _mean("gate_max_margin", "margin"), spread("gate_k_at_max_margin").alias("k_at_max_margin"),
        _mean("strength_at_chosen_k", "prediction_strength"), _mean("silhouette", "silhouette"),
    )


def confound_table(scored: DataFrame) -> DataFrame:
    """By orientation and strength of an uncoupled confound: association with components beside decodability."""
    rows = primary_rows(scored).where(F.col("confound_orientation").isin("axis", "radial") & (F.col("confound_cluster_coupling") == 0))
    return rows.groupBy("confound_orientation", "confound_strength").agg(
        _mean("pcr_confound_leading_pc_r2", "pcr_leading_pc_r2"), _mean("pcr_confound_variance_weighted_r2", "pcr_variance_weighted_r2"), _mean("decode_confound_r2_linear", "probe_linear_r2"),
        _mean("decode_confound_r2_nonlinear", "probe_nonlinear_r2"), _mean("decode_decoy_max_r2_nonlinear", "decoy_floor"), _mean("ari_at_true_k", "ari_at_true_k"),
    )


def rankme_table(scored: DataFrame) -> DataFrame:
    """``varied, value, rankme, error``: effective rank against planted dimensions, then against noise."""
    primary = primary_rows(scored)

    def block(prefix: str, column: str, varied: str) -> DataFrame:
        rows = primary.where(_starts(prefix, also="base")).groupBy(F.col(column).cast("double").alias("value"))
        return rows.agg(_mean("rankme", "rankme", 2), _mean("rankme_minus_intrinsic_dim", "error", 2)).select(F.lit(varied).alias("varied"), "value", "rankme", "error")

    return block("intrinsic-dim-", "intrinsic_dim", "intrinsic dimension").unionByName(block("noise-", "noise", "ambient noise SD"))


def cone_table(scored: DataFrame) -> DataFrame:
    """Anisotropy without structure, on both arms."""
    rows = with_derived_verdict(with_condition(scored)).where(_starts("cone-only-", also="separation-0.0"))
    return rows.groupBy("anisotropy", "scaling").agg(
        unanimous("gate_verdict").alias("verdict"), _mean("gate_max_margin", "margin"), _mean("mean_cosine", "measured_cosine"), _mean("anisotropy_error", "anisotropy_error"),
    )


def oracle_table(oracle: DataFrame) -> DataFrame:
    """One row per task: our AUROC with its interval as text beside the published value."""
    return oracle.select(
        "task", F.bround("auroc", 3).alias("ours"), F.format_string("[%.3f, %.3f]", "ci_low", "ci_high").alias("ci"), F.bround("published_auroc", 3).alias("published"),
        F.bround("delta", 4).alias("delta"), "n_test", "informative",
    )
