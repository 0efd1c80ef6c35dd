"""Checks of a finished run: inventory, alignment of keys, numerics, provenance, records and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgauge.functions.scalars import norm
from vecgauge.operators import scores
from vecgauge.sources.tables import usable


def passed(ok) -> F.Column:
    return F.when(ok, "PASS").otherwise("FAIL")


def inventory(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``key, status``: ``ok``, ``missing`` or ``extra``; repeated keys count once, null keys not at all."""
    sides = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("f")).unionByName(found.select(key, F.lit(0).alias("e"), F.lit(1).alias("f")))
    both = sides.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("e").alias("e"), F.max("f").alias("f"))
    return both.select(key, F.when(F.col("f") == 0, "missing").when(F.col("e") == 0, "extra").otherwise("ok").alias("status"))


def key_alignment(reference: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: sizes of both sides, keys that only one side has, keys the other side repeats, and the verdict.

    Null equals null. Both sides are added up by key before they meet, so
    repeated keys never multiply.
    """
    sides = reference.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(other.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
    both = sides.groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    out = both.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("n_reference"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_other"), F.count_if(F.col("b") == 0).alias("n_missing"),
        F.count_if(F.col("a") == 0).alias("n_extra"), F.count_if(F.col("b") > 1).alias("n_repeated"),
    )
    return out.withColumn("verdict", passed((F.col("n_missing") == 0) & (F.col("n_extra") == 0) & (F.col("n_repeated") == 0)))


def numerics(vectors: DataFrame) -> DataFrame:
    """Per ``grp``: rows, rows with a missing or infinite component or all zero, further copies of a usable vector, norms, verdict.

    Equal vectors are added up by value first, so a large group is spread over
    many tasks.
    """
    values = vectors.groupBy("grp", "vec").agg(F.count("*").alias("n"))
    good = usable(F.col("vec"))
    values = values.select("grp", "n", good.alias("good"), F.when(good, norm(F.col("vec"))).alias("norm"))
    out = values.groupBy("grp").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(~F.col("good"), F.col("n"))), F.lit(0)).alias("n_unusable"),
        F.coalesce(F.sum(F.when(F.col("good"), F.col("n") - 1)), F.lit(0)).alias("n_copies"), F.min("norm").alias("least_norm"), F.max("norm").alias("greatest_norm"),
    )
    return out.withColumn("verdict", passed((F.col("n_unusable") == 0) & (F.col("n_copies") == 0)))


def provenance(lengths: DataFrame) -> DataFrame:
    """Per model and context length: measurements, those whose flag contradicts the length, and anchors measured differently on other days."""
    per = lengths.where("n_tokens >= 0").groupBy("model_name", "context_length", "person_id", "cutoff").agg(
        F.count("*").alias("n"), F.count_if(F.col("truncated") != (F.col("n_tokens") > F.col("context_length"))).alias("n_contradicting"),
        (F.min("n_tokens") < F.max("n_tokens")).cast("long").alias("drifts"),
    )
    out = per.groupBy("model_name", "context_length").agg(
        F.sum("n").alias("n_measured"), F.count("*").alias("n_anchors"), F.sum("n_contradicting").alias("n_contradicting"), F.sum("drifts").alias("n_drifting"),
    )
    return out.withColumn("verdict", passed(F.col("n_contradicting") + F.col("n_drifting") == 0))


def extraction_record(lengths: DataFrame) -> DataFrame:
    """Per model and context length, what a run reports of itself: anchors, persons, undated and cut anchors, coverage."""
    n, limit = F.col("n_tokens"), F.col("context_length")
    covered = F.when(n == 0, 1.0).otherwise(F.least(n, limit) / n)
    return lengths.where("n_tokens >= 0").groupBy("model_name", "context_length").agg(
        F.count("*").alias("n_anchors"), F.count_distinct("person_id").alias("n_persons"), F.count_if(F.col("cutoff").isNull()).alias("n_whole_record"),
        F.count_if(n > limit).alias("n_cut"), F.avg(covered).alias("mean_covered"), F.sum(F.least(n, limit)).alias("n_seen"),
    )


def latest_measurements(measurements: DataFrame) -> DataFrame:
    """The last measurement of each cell and arm; superseded ones are left out."""
    rest = [c for c in measurements.columns if c not in ("cell_id", "scaling", "measured_at")]
    last = measurements.groupBy("cell_id", "scaling").agg(F.max(F.struct("measured_at", *rest)).alias("m"))
    return last.select("cell_id", "scaling", "m.*")


def condition_table(measurements: DataFrame, keys: Sequence[str], means: Sequence[str], digits: int = 3) -> DataFrame:
    """Roll-up by condition: cells, the common verdict (``mixed``, ``-``), least and greatest k, and half-even means without NaN."""
    mean = lambda c: F.bround(F.avg(F.when(~F.isnan(c), F.col(c))), digits).alias(f"mean_{c}")
    return measurements.groupBy(*keys).agg(
        F.count("*").alias("n_cells"), scores.unanimous("verdict").alias("verdict"), F.min("chosen_k").alias("least_k"), F.max("chosen_k").alias("greatest_k"), *[mean(c) for c in means],
    )


def completion(index: DataFrame, measured: DataFrame, keys: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Per group, whether every key of the index is measured: ``n_expected, n_found, n_missing, verdict``; null equals null.

    Repeated keys and measurements count once. A group of which nothing is
    measured is not known here.
    """
    expected = index.select(*keys).distinct()
    n = expected.agg(F.count("*").alias("n_expected"))
    found = measured.select(*groups, *keys).distinct()
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys]
    met = found.alias("m").join(expected.withColumn("there", F.lit(1)).alias("i"), same, "left")
    out = met.groupBy(*[F.col(f"m.{g}").alias(g) for g in groups]).agg(F.count("there").alias("n_found")).join(F.broadcast(n))
    return out.withColumn("n_missing", F.col("n_expected") - F.col("n_found")).withColumn("verdict", passed(F.col("n_missing") == 0))


def throughput(lengths: DataFrame) -> DataFrame:
    """Per model and context length: measurements, days on which any was made, and measurements and tokens a day."""
    seen = F.least("n_tokens", "context_length")
    out = lengths.where("n_tokens >= 0").groupBy("model_name", "context_length").agg(F.count("*").alias("n"), F.count_distinct("run_day").alias("n_days"), F.sum(seen).alias("n_seen"))
    return out.select("model_name", "context_length", "n", "n_days", F.bround(F.try_divide("n", "n_days"), 4).alias("per_day"), F.bround(F.try_divide("n_seen", "n_days"), 2).alias("tokens_per_day"))
