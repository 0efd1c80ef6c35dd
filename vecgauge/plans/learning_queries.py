"""Queries of clustering strength, probes, resampling, simulation and extraction."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgauge.operators import learning, replicates, simulate
from vecgauge.plans.audit_queries import _vectors
from vecgauge.sources.tables import read_table
from vecgauge.streaming.extraction import history_vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _probe_rows(spark: SparkSession, d: str) -> DataFrame:
    part = F.col("id") % 5
    return _vectors(spark, d).withColumn("y", (F.col("label") < 5).cast("int")).withColumn("split", F.when(part < 3, "train").when(part == 3, "val").otherwise("test"))


KS, REPEATS, DRAWS, RESAMPLES, BOOTSTRAPS = list(range(2, 11)), 20, 20, 25, 1000


@query()
def kmeans_sweep(spark, d):
    """Prediction strength for every k, with the frozen number of repeats."""
    return replicates.summarise_curve(replicates.strength_curves(_vectors(spark, d), KS, REPEATS))


@query()
def stability(spark, d):
    return replicates.summarise_stability(replicates.stability_curve(_vectors(spark, d), KS, RESAMPLES))


@query()
def null_gate(spark, d):
    return replicates.tendency(replicates.strength_curves(_vectors(spark, d), KS, REPEATS, DRAWS))


@query()
def gmm_confidence(spark, d):
    return learning.gmm_confidence(_vectors(spark, d), 3)


@query()
def ridge_probe(spark, d):
    return learning.ridge_decodability(_probe_rows(spark, d), "label")


@query()
def logistic_probe(spark, d):
    return learning.logistic_probe(_probe_rows(spark, d))


_HASH = "(cast('0x' || md5({0})[1:8] as bigint) + 0.5) / 4294967296.0"
_STEPS = " + ".join(f"(u >= {sum(math.exp(-1) / math.factorial(j) for j in range(i + 1))!r})::int" for i in range(8))


@query(f"""with r as (select unnest(range({BOOTSTRAPS}))::bigint as r), c as (select value as s, (event_type = 'purchase')::int as y, r, {_HASH.format("event_id || '-' || r")} as u from events, r),
    w as (select r, s, y, {_STEPS} as w from c), g as (select r, s, sum(w)::double as n, sum(w * y)::double as p from w where w > 0 group by all),
    k as (select *, coalesce(sum(n) over (partition by r order by s rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2 as mid from g),
    a as (select r, (sum(mid * p) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * sum(n - p)) as auroc from k group by r)
    select round_even(quantile_cont(auroc, 0.025), 8) as low, round_even(quantile_cont(auroc, 0.975), 8) as high, count(*) as n_used from a""")
def bootstrap_ci(spark, d):
    rows = read_table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("s"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    return learning.bootstrap_auroc(rows, "s", "y", BOOTSTRAPS).select(F.bround("low", 8).alias("low"), F.bround("high", 8).alias("high"), "n_used")


@query("""with s as (select cell_id, max(n_patients) as n, max(chosen_k) as k from measurements where chosen_k is not null group by cell_id), r as (select cell_id, k, unnest(range(n)) as id from s),
    l as (select cell_id, k, id, floor((cast('0x' || md5(cell_id || '-' || id || '-0')[1:8] as bigint) + 0.5) / 4294967296.0 * k) as label from r) select cell_id, cast(label as bigint) as label, count(*) as n from l group by all""")
def simulated_space_sizes(spark, d):
    return simulated(spark, d).groupBy("cell_id", F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"))


def simulated(spark: SparkSession, d: str) -> DataFrame:
    """One space for each measured cell, as large as the cell."""
    spec = read_table(spark, d, "measurements").where("chosen_k is not null").groupBy("cell_id").agg(F.max("n_patients").alias("n_rows"), F.max("chosen_k").alias("n_clusters"))
    return simulate.simulate_spaces(spec.withColumns({"separation": F.lit(6.0), "noise": F.lit(0.1)}))


@query()
def simulate_space(spark, d):
    return simulated(spark, d)


@query("""with e as (select person_id, time, cast('0x' || md5(upper(trim(code, ' ' || chr(9))))[1:8] as bigint) % 32 as bucket from patient_timeline where person_id is not null and code is not null and upper(trim(code, ' ' || chr(9))) <> ''),
    a as (select distinct person_id, cutoff from anchors), c as (select a.person_id, a.cutoff, bucket, count(*) as n from a join e on a.person_id = e.person_id and (a.cutoff is null or e.time is null or e.time <= a.cutoff) group by all)
    select person_id, cutoff, cast(bucket as int) as bucket, n / sum(n) over (partition by person_id, cutoff) as weight from c""")
def history_mean_pool(spark, d):
    """One vector for each anchor, of what lies at or before its cutoff."""
    return history_vectors(read_table(spark, d, "patient_timeline"), read_table(spark, d, "anchors"))
