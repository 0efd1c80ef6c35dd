"""Queries of run validation, records, result tables, preparation arms and simulated spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecgauge.operators import preparation, scores, simulate, validation
from vecgauge.plans.audit_queries import _V
from vecgauge.plans.learning_queries import _probe_rows
from vecgauge.sources.tables import read_table, with_vector

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""with e as (select distinct cell_id from measurements), f as (select distinct cell_id from cell_embeddings where cell_id is not null)
    select coalesce(e.cell_id, f.cell_id) as cell_id, case when f.cell_id is null then 'missing' when e.cell_id is null then 'extra' else 'ok' end as status from e full join f on e.cell_id = f.cell_id
    where coalesce(e.cell_id, f.cell_id) is not null""")
def run_inventory(spark, d):
    return validation.inventory(read_table(spark, d, "measurements"), read_table(spark, d, "cell_embeddings"), "cell_id")


@query("""with u as (select person_id, cutoff, 1 as a, 0 as b from anchors union all select patient_id, prediction_time, 0, 1 from labeled_patients), k as (select sum(a) as a, sum(b) as b from u group by person_id, cutoff),
    s as (select coalesce(sum(a), 0)::bigint as n_reference, coalesce(sum(b), 0)::bigint as n_other, count(*) filter (b = 0) as n_missing, count(*) filter (a = 0) as n_extra, count(*) filter (b > 1) as n_repeated from k)
    select *, case when n_missing = 0 and n_extra = 0 and n_repeated = 0 then 'PASS' else 'FAIL' end as verdict from s""")
def run_alignment(spark, d):
    labels = read_table(spark, d, "labeled_patients").select(F.col("patient_id").alias("person_id"), F.col("prediction_time").alias("cutoff"))
    return validation.key_alignment(read_table(spark, d, "anchors").select("person_id", "cutoff"), labels, ["person_id", "cutoff"])


_DIMS = ", ".join(f"dim_{i}" for i in range(64))


@query(f"""with v as (select cell_id, [{_DIMS}] as x from cell_embeddings), g as (select cell_id, x, count(*) as n from v group by all),
    u as (select cell_id, n, len(list_filter(x, lambda e: e is not null and isfinite(e))) = 64 and len(list_filter(x, lambda e: e <> 0)) > 0 as good, sqrt(list_sum(list_transform(x, lambda e: e * e))) as norm from g),
    s as (select cell_id, sum(n)::bigint as n_rows, coalesce(sum(n) filter (not good), 0)::bigint as n_unusable, coalesce(sum(n - 1) filter (good), 0)::bigint as n_copies,
        round_even(min(norm) filter (good), 6) as least_norm, round_even(max(norm) filter (good), 6) as greatest_norm from u group by cell_id)
    select *, case when n_unusable = 0 and n_copies = 0 then 'PASS' else 'FAIL' end as verdict from s""")
def run_numerics(spark, d):
    out = validation.numerics(with_vector(read_table(spark, d, "cell_embeddings")).select(F.col("cell_id").alias("grp"), "vec")).withColumnRenamed("grp", "cell_id")
    return out.withColumns({c: F.bround(c, 6) for c in ("least_norm", "greatest_norm")})


@query("""with p as (select model_name, context_length, person_id, cutoff, count(*) as n, count(*) filter (truncated <> (n_tokens > context_length)) as c, (min(n_tokens) < max(n_tokens))::bigint as dr
        from token_lengths where n_tokens >= 0 group by all),
    s as (select model_name, context_length, sum(n)::bigint as n_measured, count(*) as n_anchors, sum(c)::bigint as n_contradicting, sum(dr)::bigint as n_drifting from p group by all)
    select *, case when n_contradicting + n_drifting = 0 then 'PASS' else 'FAIL' end as verdict from s""")
def run_provenance(spark, d):
    return validation.provenance(read_table(spark, d, "token_lengths"))


@query("""select model_name, context_length, count(*) as n_anchors, count(distinct person_id) as n_persons, count(*) filter (cutoff is null) as n_whole_record, count(*) filter (n_tokens > context_length) as n_cut,
    round_even(avg(case when n_tokens = 0 then 1.0::double else least(n_tokens, context_length)::double / n_tokens end), 8) as mean_covered, sum(least(n_tokens, context_length))::bigint as n_seen from token_lengths where n_tokens >= 0 group by all""")
def extraction_record(spark, d):
    return validation.extraction_record(read_table(spark, d, "token_lengths")).withColumn("mean_covered", F.bround("mean_covered", 8))


def _table(keys: str) -> str:
    return f"""with r as (select *, row_number() over (partition by cell_id, scaling order by measured_at desc) as pos from measurements), l as (select * from r where pos = 1)
    select {keys}, count(*) as n_cells, case when count(distinct verdict) = 0 then '-' when count(distinct verdict) = 1 then min(verdict) else 'mixed' end as verdict, min(chosen_k) as least_k, max(chosen_k) as greatest_k,
        round_even(avg(prediction_strength) filter (not isnan(prediction_strength)), 6) as mean_prediction_strength, round_even(avg(silhouette) filter (not isnan(silhouette)), 6) as mean_silhouette from l group by {keys}"""


def _conditions(spark, d, *keys):
    return validation.condition_table(validation.latest_measurements(read_table(spark, d, "measurements")), keys, ["prediction_strength", "silhouette"], 6)


@query(_table("scaling"))
def table_by_arm(spark, d):
    return _conditions(spark, d, "scaling")


@query(_table("scaling, chosen_k"))
def table_by_arm_and_k(spark, d):
    return _conditions(spark, d, "scaling", "chosen_k")


@query()
def spherical_prep(spark, d):
    """The spherical arm, fitted on the training rows: norms are 1, and the mean cosine is near 0."""
    return preparation.prepare(_probe_rows(spark, d), "spherical", F.col("split") == "train", n_drop=1).select("id", "label", "split", "vec")


@query(f"""with {_V}, w as (select *, case when id % 5 < 3 then 'train' else 'val' end as split from v where id % 5 < 4),
    p as (select a.split, a.id, a.label, b.label as other, sum(list_distance(a.vec, b.vec)) as total, count(*) as n from w a join w b on a.split = b.split group by all),
    s as (select split, id, max(total / (n - 1)) filter (other = label and n > 1) as a, min(total / n) filter (other <> label) as b from p group by split, id),
    sil as (select split, avg(coalesce((b - a) / greatest(a, b), 0)) as silhouette, count(*) as n from s group by split),
    l as (select split, label, id, unnest(vec) as x, generate_subscripts(vec, 1) as dim from w), c as (select split, label, dim, avg(x) as m, count(*) as n from l group by all), g as (select split, dim, avg(x) as m from l group by all),
    f as (select l.split, l.label, l.id, sum((x - m) * (x - m)) as d2 from l join c using (split, label, dim) group by all),
    k as (select split, label, avg(sqrt(d2)) as spread, sum(d2) as within from f group by all), b as (select split, sum(n * (c.m - g.m) * (c.m - g.m)) as between_ from c join g using (split, dim) group by split),
    x as (select split, count(*) as k, sum(within) as within from k group by split),
    far as (select i.split, i.label as i, j.label as j, sqrt(sum((i.m - j.m) * (i.m - j.m))) as d from c i join c j on i.split = j.split and i.dim = j.dim and i.label <> j.label group by all),
    r as (select far.split, i, max((ki.spread + kj.spread) / d) as r from far join k ki on ki.split = far.split and ki.label = i join k kj on kj.split = far.split and kj.label = j group by all), db as (select split, avg(r) as db from r group by split)
    select split, n, k as n_clusters, round_even(silhouette, 6) as silhouette, round_even((between_ / (k - 1)) / (within / (n - k)), 6) as calinski_harabasz, round_even(db, 6) as davies_bouldin
    from sil join x using (split) join b using (split) join db using (split)""")
def metrics_by_split(spark, d):
    return preparation.metrics_by_split(_probe_rows(spark, d)).withColumns({c: F.bround(c, 6) for c in ("silhouette", "calinski_harabasz", "davies_bouldin")})


@query()
def nonlinear_probe(spark, d):
    return preparation.nonlinear_decodability(_probe_rows(spark, d), "label")


@query()
def simulated_confounds(spark, d):
    """R2 of the confound in the squared norm and in each dimension, of a radial and an axis space of each measured cell's size."""
    sizes = read_table(spark, d, "measurements").where("chosen_k is not null").groupBy("cell_id").agg(F.max("n_patients").alias("n_rows"), F.max("chosen_k").alias("n_clusters"))
    spec = sizes.withColumn("confound_orientation", F.explode(F.array(F.lit("axis"), F.lit("radial")))).withColumn("cell_id", F.concat_ws("/", "cell_id", "confound_orientation"))
    spaces = simulate.simulate_spaces(spec.withColumns({"separation": F.lit(0.0), "noise": F.lit(0.1), "confound_strength": F.lit(4.0)}))
    linear = scores.numeric_r2(spaces.select("cell_id", "log_n_events", F.posexplode("vec").alias("dim", "x")), ["cell_id", "dim"], "log_n_events", "x")
    squared = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    radial = scores.numeric_r2(spaces.select("cell_id", "log_n_events", F.log(squared).alias("x")), ["cell_id"], "log_n_events", "x").withColumn("dim", F.lit(None).cast("int"))
    return linear.unionByName(radial)
