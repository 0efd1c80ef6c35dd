"""Queries of the audit's own operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgauge.functions import scalars as fn
from vecgauge.operators import geometry as geo
from vecgauge.operators import scores
from vecgauge.operators import timeline as tl
from vecgauge.sources.tables import normal_form, read_table

CONTEXTS = [512, 1024, 2048, 4096, 8192, 16384]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings scaled by 1 + label, so that normalising has work to do."""
    e = read_table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label"))).alias("vec"))


_V = "v as (select vec_id as id, cast(label as bigint) as label, list_transform(embedding, lambda x: cast(x as double) * (1 + label)) as vec from embeddings)"
_L = _V + ", l as (select id, label, unnest(vec) as x, generate_subscripts(vec, 1) - 1 as dim from v)"
_NF = "upper(trim(code, ' ' || chr(9)))"
_CLINICAL = f"not coalesce({_NF} = 'MEDS_BIRTH' or regexp_matches({_NF}, '^(GENDER|RACE|ETHNICITY)/'), false)"
_YEARS = "floor((epoch_us({1}) - epoch_us({0})) / 86400000000.0) / 365.25"
_SUMMARY = f"""
c as (select person_id, time, {_NF} as code, {_CLINICAL} as clinical from patient_timeline where person_id is not null),
d as (select person_id, split_part(code, '/', 1) as kind, split_part(code, '/', -1) as value, row_number() over (partition by person_id, split_part(code, '/', 1) order by time nulls first, code) as pos
      from c where regexp_matches(code, '^(GENDER|RACE|ETHNICITY)/')),
b as (select person_id, time, row_number() over (partition by person_id order by time nulls first) as pos from c where code = 'MEDS_BIRTH'),
s as (select person_id, count(*) filter (clinical) as n_events, max(time) filter (clinical) as last_event,
        case when count(*) filter (clinical and time is null) = 0 then min(time) filter (clinical) end as first_event from c group by person_id),
t as (select s.person_id, b.time as birth_date, first_event, last_event, n_events, {_YEARS.format('first_event', 'last_event')} as observation_years,
        {_YEARS.format('b.time', 'last_event')} as age_at_last_event, g.value as gender, r.value as race, e.value as ethnicity
      from s left join b on s.person_id = b.person_id and b.pos = 1 left join d g on s.person_id = g.person_id and g.kind = 'GENDER' and g.pos = 1
        left join d r on s.person_id = r.person_id and r.kind = 'RACE' and r.pos = 1 left join d e on s.person_id = e.person_id and e.kind = 'ETHNICITY' and e.pos = 1)
"""


@query(f"with {_SUMMARY} select * from t")
def timeline_summary(spark, d):
    return tl.timeline_summary(read_table(spark, d, "patient_timeline"))


@query("select user_id, min(ts) as first_event, max(ts) as last_event, count(*) as n_events, count(distinct event_type) as n_types from events group by user_id")
def event_summary(spark, d):
    return read_table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_event"), F.max("ts").alias("last_event"), F.count("*").alias("n_events"), F.count_distinct("event_type").alias("n_types"))


@query("""select a.anchor_id, count(t.code_row) as n_events from anchors a left join (select person_id, time, 1 as code_row from patient_timeline) t
    on a.person_id = t.person_id and (a.cutoff is null or t.time is null or t.time <= a.cutoff) group by a.anchor_id""")
def events_until_counts(spark, d):
    return tl.history_counts(read_table(spark, d, "patient_timeline"), read_table(spark, d, "anchors"))


@query(f"with {_SUMMARY} select person_id, last_event as cutoff from t where last_event is not null")
def anchors_lastevent(spark, d):
    return tl.lastevent_index(tl.timeline_summary(read_table(spark, d, "patient_timeline")))


@query("select distinct patient_id as person_id, prediction_time as cutoff from labeled_patients where patient_id is not null and prediction_time is not null")
def anchors_perlabel(spark, d):
    return tl.perlabel_index(read_table(spark, d, "labeled_patients"))


_PERLABEL = "select distinct patient_id as person_id, prediction_time as cutoff from labeled_patients where patient_id is not null and prediction_time is not null"


@query(f"select * from ({_PERLABEL}) where person_id in (select person_id from patient_timeline where person_id is not null)")
def restrict_known(spark, d):
    return tl.restrict_to_known(tl.perlabel_index(read_table(spark, d, "labeled_patients")), read_table(spark, d, "patient_timeline"))[0]


@query(f"select count(*) as n_dropped from ({_PERLABEL}) where person_id not in (select person_id from patient_timeline where person_id is not null)")
def restrict_dropped(spark, d):
    return tl.restrict_to_known(tl.perlabel_index(read_table(spark, d, "labeled_patients")), read_table(spark, d, "patient_timeline"))[1].agg(F.count("*").alias("n_dropped"))


@query("select row_number() over (order by person_id nulls first, cutoff nulls first) as pos, person_id, cutoff from (select distinct person_id, cutoff from anchors)")
def ordered_index(spark, d):
    """Positions by range-partitioned order: the count of earlier partitions plus the place within."""
    return tl.numbered_index(read_table(spark, d, "anchors").select("person_id", "cutoff").distinct())


@query("""select l.label_id, l.patient_id as person_id, l.prediction_time, a.n_anchors, a.n_anchors is not null as matched from labeled_patients l
    left join (select person_id, cutoff, count(*) as n_anchors from anchors group by all) a on l.patient_id = a.person_id and l.prediction_time = a.cutoff""")
def align_left_mask(spark, d):
    index = read_table(spark, d, "anchors").groupBy("person_id", F.col("cutoff").alias("prediction_time")).agg(F.count("*").alias("n_anchors"))
    labels = read_table(spark, d, "labeled_patients").select("label_id", F.col("patient_id").alias("person_id"), "prediction_time")
    return tl.align_features(labels, index, ["person_id", "prediction_time"]).select("label_id", "person_id", "prediction_time", "n_anchors", "matched")


_SPLIT = "case when patient_id % 5 < 3 then 'train' when patient_id % 5 = 3 then 'val' else 'test' end"


def _splits(spark, d):
    persons = read_table(spark, d, "patient_timeline").where("person_id is not null").select("person_id").distinct()
    part = F.col("person_id") % 5
    return persons.withColumn("split", F.when(part < 3, "train").when(part == 3, "val").otherwise("test"))


@query(f"""select label_id, patient_id as person_id, case when patient_id in (select person_id from patient_timeline where person_id is not null) then {_SPLIT} end as split,
    coalesce(patient_id % 5 < 3 and patient_id in (select person_id from patient_timeline where person_id is not null), false) as fit from labeled_patients""")
def split_lookup(spark, d):
    labels = read_table(spark, d, "labeled_patients").select("label_id", F.col("patient_id").alias("person_id"))
    return labels.join(tl.unique_by(_splits(spark, d), ["person_id"]), "person_id", "left").withColumn("fit", F.coalesce(F.col("split") == "train", F.lit(False)))


@query(f"""with l as (select {_SPLIT} as split, task from labeled_patients where patient_id in (select person_id from patient_timeline where person_id is not null)), c as (select split, task, count(*) as n from l group by all)
    select split, task, n, n / sum(n) over (partition by split) as share from c""")
def split_sizes_share(spark, d):
    return scores.group_shares(split_lookup(spark, d).join(read_table(spark, d, "labeled_patients").select("label_id", "task"), "label_id"), "split", "task")


@query(f"""with c as (select {_NF} as code, count(*) as n from patient_timeline group by 1), k as (select distinct {_NF} as code, 1 as covered from code_panel),
    j as (select split_part(c.code, '/', 1) as v, n, covered from c left join k on c.code = k.code where c.code is not null)
    select coalesce(v, 'ALL') as vocabulary, cast(sum(n) as bigint) as n_events, cast(coalesce(sum(n) filter (covered = 1), 0) as bigint) as n_events_covered, count(*) as n_codes, count(covered) as n_codes_covered
    from j group by grouping sets ((v), ())""")
def code_coverage_all_row(spark, d):
    events = read_table(spark, d, "patient_timeline").select(normal_form(F.col("code")).alias("code"))
    return scores.code_coverage(events, read_table(spark, d, "code_panel").select(normal_form(F.col("code")).alias("code")).distinct())


@query("""select person_id, cutoff, model_name, context_length, run_day, n_tokens as n_untruncated, least(n_tokens, context_length) as n_seen, n_tokens > context_length as was_cut,
    case when n_tokens = 0 then 1.0 else least(n_tokens, context_length) / n_tokens end as covered from token_lengths where n_tokens >= 0""")
def truncation_report(spark, d):
    return scores.truncation_report(read_table(spark, d, "token_lengths"))


@query("""select model_name, context_length, avg(case when n_tokens >= context_length then 1.0 else 0.0 end) as cap_hit_rate, quantile_cont(n_tokens, 0.5) as median_tokens,
    quantile_cont(n_tokens, 0.95) as p95_tokens, max(n_tokens) as max_tokens from token_lengths where n_tokens >= 0 group by all""")
def truncation_stats(spark, d):
    return scores.truncation_stats(read_table(spark, d, "token_lengths"))


@query("""with m as (select model_name, context_length, avg(case when n_tokens > context_length then 1.0 else 0.0 end) as share from token_lengths where n_tokens >= 0 group by all),
    s as (select *, lag(share) over (partition by model_name order by context_length) as before from m)
    select model_name, coalesce(bool_and(before is null or share <= before + 1e-12), true) as never_rises from s group by model_name""")
def trend_monotone(spark, d):
    share = read_table(spark, d, "token_lengths").where("n_tokens >= 0").groupBy("model_name", "context_length").agg(F.avg((F.col("n_tokens") > F.col("context_length")).cast("double")).alias("share"))
    return scores.monotone_trend(share, ["model_name"], "context_length", "share")


@query(f"""with {_SUMMARY}, x as (select unnest({CONTEXTS})::bigint as context_length), m as (select quantile_cont(n_events, 0.5) as m from t)
    select context_length, avg(case when n_events <= context_length then 1.0 else 0.0 end) as fits, least(context_length, any_value(m)) / any_value(m) as median_share from t, x, m group by context_length""")
def context_table(spark, d):
    return scores.context_table(tl.timeline_summary(read_table(spark, d, "patient_timeline")), CONTEXTS)


@query("""select label_id, task, case when label_type = 'boolean' then case when lower(trim(value)) in ('true', '1', 'yes') then 1 when lower(trim(value)) in ('false', '0', 'no') then 0 end
    else case when try_cast(trim(value) as double) is not null then cast(try_cast(trim(value) as double) >= 1 as int) end end as y from labeled_patients""")
def label_binarise(spark, d):
    return read_table(spark, d, "labeled_patients").select("label_id", "task", fn.binary_outcome(F.col("value"), F.col("label_type")).alias("y"))


@query("select cell_id, avg(silhouette) as mean_silhouette, avg(prediction_strength) as mean_strength from measurements where scaling = 'spherical' and verdict = 'DISCRETE' and not isnan(silhouette) group by cell_id")
def published_mean_filter(spark, d):
    m = read_table(spark, d, "measurements").where("scaling = 'spherical' and verdict = 'DISCRETE' and not isnan(silhouette)")
    return m.groupBy("cell_id").agg(F.avg("silhouette").alias("mean_silhouette"), F.avg("prediction_strength").alias("mean_strength"))


@query("""with n as (select cell_id, count(distinct person_id) as n_persons from cell_embeddings group by 1)
    select m.cell_id, scaling, measured_at, chosen_k, n_patients, n.n_persons from measurements m left join n on m.cell_id = n.cell_id""")
def measurements_m1_join(spark, d):
    design = read_table(spark, d, "cell_embeddings").groupBy("cell_id").agg(F.count_distinct("person_id").alias("n_persons"))
    facts = read_table(spark, d, "measurements").select("cell_id", "scaling", "measured_at", "chosen_k", "n_patients")
    return facts.join(tl.unique_by(design, ["cell_id"]), "cell_id", "left")


@query("""with a as (select chosen_k as k, avg(prediction_strength) as raw_strength from measurements where scaling = 'raw' and chosen_k is not null group by 1),
    b as (select chosen_k as k, avg(prediction_strength) as spherical_strength from measurements where scaling = 'spherical' and chosen_k is not null group by 1)
    select coalesce(a.k, b.k) as k, raw_strength, spherical_strength from a full join b on a.k = b.k""")
def curve_full_outer(spark, d):
    m = read_table(spark, d, "measurements").where("chosen_k is not null")
    arm = lambda s: m.where(F.col("scaling") == s).groupBy(F.col("chosen_k").alias("k")).agg(F.avg("prediction_strength").alias(f"{s}_strength"))
    return arm("raw").join(arm("spherical"), "k", "full")


@query("select person_id, cutoff, 'anchor' as kind, anchor_level from anchors union all by name select patient_id as person_id, prediction_time as cutoff, 'label' as kind from labeled_patients")
def union_by_name(spark, d):
    a = read_table(spark, d, "anchors").select("person_id", "cutoff", F.lit("anchor").alias("kind"), "anchor_level")
    b = read_table(spark, d, "labeled_patients").select(F.col("patient_id").alias("person_id"), F.col("prediction_time").alias("cutoff"), F.lit("label").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""select cell_id, case when count(distinct verdict) = 0 then '-' when count(distinct verdict) = 1 then min(verdict) else 'mixed' end as verdict,
    coalesce(nullif(array_to_string(list_sort(list(chosen_k) filter (chosen_k is not null)), ', '), ''), '-') as k_spread from measurements group by cell_id""")
def verdict_and_spread(spark, d):
    return read_table(spark, d, "measurements").groupBy("cell_id").agg(scores.unanimous("verdict").alias("verdict"), scores.spread("chosen_k").alias("k_spread"))


@query("""with s as (select cell_id, chosen_k as k, prediction_strength as strength from measurements where chosen_k is not null and prediction_strength is not null)
    select cell_id, coalesce(max(k) filter (strength >= 0.8), arg_max(k, (strength, -k))) as chosen_k from s group by cell_id""")
def choose_k(spark, d):
    return scores.choose_k(read_table(spark, d, "measurements").where("chosen_k is not null").select("cell_id", F.col("chosen_k").alias("k"), F.col("prediction_strength").alias("strength")), ["cell_id"])


@query("""with m as (select cell_id, max(prediction_strength) filter (scaling = 'spherical') as real, max(prediction_strength) filter (scaling = 'raw') as null_level from measurements group by cell_id),
    g as (select cell_id, round_even((real - null_level) / nullif(1 - null_level, 0), 4) as margin, real > null_level as beats from m)
    select cell_id, margin, case when beats is null then null when not beats then 'CONTINUOUS' when margin < 0.10 then 'WEAK' else 'DISCRETE' end as verdict from g""")
def null_margin_verdict(spark, d):
    arm = lambda s: F.max(F.when(F.col("scaling") == s, F.col("prediction_strength")))
    m = read_table(spark, d, "measurements").groupBy("cell_id").agg(arm("spherical").alias("real"), arm("raw").alias("null_level"))
    m = m.withColumn("margin", fn.null_margin(F.col("real"), F.col("null_level")))
    return m.select("cell_id", "margin", fn.verdict(F.col("real") > F.col("null_level"), F.col("margin")).alias("verdict"))


_NORM = "sqrt(list_dot_product(vec, vec))"


@query(f"""with {_L}, m as (select dim, avg(x) as m, stddev_pop(x) as s from l group by dim), c as (select list(m order by dim) as centre from m)
    select count(*) as n, cast(max(len(vec)) as bigint) as n_dims, count(*) filter (len(list_filter(vec, lambda x: isnan(x))) > 0) as n_nan_rows, count(*) filter (len(list_filter(vec, lambda x: isinf(x))) > 0) as n_inf_rows,
    count(*) - count(distinct vec) as n_duplicates, min({_NORM}) as norm_min, quantile_cont({_NORM}, 0.5) as norm_median, max({_NORM}) as norm_max,
    (select count(*) from m where s < 1e-8) as n_dead_dims, avg(list_dot_product(vec, centre) / ({_NORM} * sqrt(list_dot_product(centre, centre)) + 1e-12)) as mean_cosine from v, c""")
def embedding_checks(spark, d):
    return geo.embedding_checks(_vectors(spark, d))


@query(f"with {_V} select id, round_even(list_sum(list_transform(vec, lambda x: x / {_NORM})), 6) as total, round_even(list_max(vec) / {_NORM}, 6) as largest from v")
def l2_normalize(spark, d):
    return geo.normalised(_vectors(spark, d)).select("id", F.bround(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.bround(F.array_max("vec"), 6).alias("largest"))


@query(f"""with {_L}, m as (select dim, avg(x) as m, stddev_pop(x) as s from l group by dim)
    select id, round_even(sum((x - m) / case when s > 0 then s else 1 end), 6) as total, round_even(max((x - m) / case when s > 0 then s else 1 end), 6) as largest from l join m using (dim) group by id""")
def standard_scale(spark, d):
    return geo.standardised(_vectors(spark, d)).select("id", F.bround(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.bround(F.array_max("vec"), 6).alias("largest"))


@query(f"""with {_L} select a.dim as i, b.dim as j, round_even(sum(a.x * b.x), 4) as g from l a join l b on a.id = b.id group by all""")
def gram_matrix(spark, d):
    n, s, g = geo.gram(_vectors(spark, d))
    rows = [(i, j, float(g[i, j])) for i in range(len(s)) for j in range(len(s))]
    return spark.createDataFrame(rows, "i long, j long, g double").select("i", "j", F.bround("g", 4).alias("g"))


_CENTROIDS = _L + ", m as (select label, dim, avg(x) as m from l group by all), c as (select label, list(m order by dim) as centroid from m group by label)"


@query(f"with {_CENTROIDS} select label, dim, round_even(m, 6) as m from m")
def centroids(spark, d):
    return geo.mean_vectors(_vectors(spark, d), "label").select("label", F.posexplode("centroid").alias("dim", "m")).select("label", "dim", F.bround("m", 6).alias("m"))


_NEAREST = _CENTROIDS + """, p as (select v.id, v.label, c.label as cluster, list_sum(list_transform(list_zip(vec, centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d2 from v, c),
    n as (select id, any_value(label) as label, arg_min(cluster, (d2, cluster)) as cluster, min(d2) as best from p group by id)"""


@query(f"with {_NEAREST} select n.id, n.label, n.cluster, round_even(sqrt(best), 5) as distance, round_even(1 / sum(exp(best - d2)), 5) as confidence from n join p on n.id = p.id group by n.id, n.label, n.cluster, best")
def nearest_centroid(spark, d):
    v = _vectors(spark, d)
    return geo.nearest_centroid(v, geo.mean_vectors(v, "label")).select("id", "label", "cluster", F.bround("distance", 5).alias("distance"), F.bround("confidence", 5).alias("confidence"))


@query(f"with {_NEAREST}, s as (select case when id % 5 < 3 then 'train' when id % 5 = 3 then 'val' else 'test' end as split, cluster, count(*) as n from n group by all) select split, cluster, n, n / sum(n) over (partition by split) as share from s")
def cluster_sizes(spark, d):
    v = _vectors(spark, d)
    part = F.col("id") % 5
    near = geo.nearest_centroid(v, geo.mean_vectors(v, "label")).withColumn("split", F.when(part < 3, "train").when(part == 3, "val").otherwise("test"))
    return scores.group_shares(near, "split", "cluster")


@query(f"""with {_NEAREST}, x as (select label, cluster, count(*) as n from n group by all), s as (select cluster, sum(n * (n - 1)) as t, sum(n) as z from x group by cluster)
    select min(case when z > 1 then t / (z * (z - 1)) else 1.0 end) as strength from s""")
def comembership_strength(spark, d):
    v = _vectors(spark, d)
    return geo.comembership_strength(geo.nearest_centroid(v, geo.mean_vectors(v, "label")).select(F.col("label").alias("a"), F.col("cluster").alias("b")))


@query(f"""with {_NEAREST}, x as (select label, cluster, count(*)::double as n from n group by all), a as (select sum(n) as n from x group by label), b as (select sum(n) as n from x group by cluster),
    q as (select (select sum(n * (n - 1) / 2) from x) as s, (select sum(n * (n - 1) / 2) from a) as r, (select sum(n * (n - 1) / 2) from b) as c, (select sum(n) from x) as n)
    select round_even((s - r * c / (n * (n - 1) / 2)) / ((r + c) / 2 - r * c / (n * (n - 1) / 2)), 8) as ari from q""")
def ari_closed_form(spark, d):
    v = _vectors(spark, d)
    return geo.contingency_scores(geo.nearest_centroid(v, geo.mean_vectors(v, "label")).select(F.col("label").alias("a"), F.col("cluster").alias("b"))).select(F.bround("ari", 8).alias("ari"))


@query(f"""with {_V}, p as (select a.id, a.label as own, b.label as other, sum(sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) as t, count(*) as n from v a, v b group by all),
    q as (select id, max(case when own = other then t / nullif(n - 1, 0) end) as a, min(case when own <> other then t / n end) as b from p group by id)
    select id, round_even(coalesce((b - a) / greatest(a, b), 0), 5) as silhouette from q""")
def silhouette_exact(spark, d):
    return geo.silhouettes(_vectors(spark, d)).select("id", F.bround("silhouette", 5).alias("silhouette"))


_SCATTER = _CENTROIDS + """, w as (select v.label, list_sum(list_transform(list_zip(vec, centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d2, centroid from v join c on v.label = c.label),
    s as (select label, count(*) as n, avg(sqrt(d2)) as spread, sum(d2) as within, any_value(centroid) as centroid from w group by label)"""


@query(f"""with {_SCATTER}, o as (select list(m order by dim) as middle from (select dim, avg(x) as m from l group by dim)),
    t as (select sum(n * list_sum(list_transform(list_zip(centroid, middle), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as b, sum(within) as w, count(*) as k, sum(n) as n from s, o)
    select round_even((b / (k - 1)) / (w / (n - k)), 6) as calinski_harabasz from t""")
def calinski_harabasz(spark, d):
    return geo.calinski_harabasz(_vectors(spark, d)).select(F.bround("calinski_harabasz", 6).alias("calinski_harabasz"))


@query(f"""with {_SCATTER}, r as (select i.label, max((i.spread + j.spread) / sqrt(list_sum(list_transform(list_zip(i.centroid, j.centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) as r
    from s i join s j on i.label <> j.label group by i.label) select round_even(avg(r), 6) as davies_bouldin from r""")
def davies_bouldin(spark, d):
    return geo.davies_bouldin(_vectors(spark, d)).select(F.bround("davies_bouldin", 6).alias("davies_bouldin"))


_DIMS = [f"dim_{i}" for i in range(64)]


@query(f"select cell_id, copies, count(*) as n_vectors from (select cell_id, count(*) as copies from cell_embeddings group by cell_id, {', '.join(_DIMS)}) group by cell_id, copies")
def duplicate_vectors(spark, d):
    """How many distinct vectors of each cell occur once, twice, ..."""
    groups = read_table(spark, d, "cell_embeddings").groupBy("cell_id", *_DIMS).agg(F.count("*").alias("copies"))
    return groups.groupBy("cell_id", "copies").agg(F.count("*").alias("n_vectors"))


def _covariates(spark, d):
    per = read_table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    lang = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower("lang").alias("lang"))
    rows = _vectors(spark, d).join(per, "id", "left").join(lang, "id", "left").withColumn("log_n_events", F.log(1 + F.coalesce("n", F.lit(0))))
    return rows.select("id", "log_n_events", "lang", F.posexplode("vec").alias("dim", "x"))


_COV = _L + """, e as (select user_id, count(*) as n from events group by 1),
    z as (select l.dim, l.x, ln(1 + coalesce(e.n, 0)) as log_n_events, lower(d.lang) as lang from l left join e on l.id = e.user_id left join documents d on l.id = d.doc_id)"""


@query(f"with {_COV} select dim, round_even(case when var_pop(x) * var_pop(log_n_events) > 0 then pow(covar_pop(x, log_n_events), 2) / (var_pop(x) * var_pop(log_n_events)) else 0 end, 6) as r2 from z group by dim")
def numeric_r2(spark, d):
    return scores.numeric_r2(_covariates(spark, d), ["dim"], "log_n_events", "x").select("dim", F.bround("r2", 6).alias("r2"))


@query(f"""with {_COV}, p as (select dim, lang, count(*) as n, sum(x) as s, sum(x * x) as q from z where lang is not null group by all),
    t as (select dim, sum(n) as n, sum(s) as s, sum(q) as q, sum(s * s / n) as b from p group by dim) select dim, round_even((b - s * s / n) / (q - s * s / n), 6) as eta2 from t""")
def eta_squared(spark, d):
    return scores.eta_squared(_covariates(spark, d), ["dim"], "lang", "x").select("dim", F.bround("eta2", 6).alias("eta2"))


@query(f"""with {_COV}, y as (select dim, lang, x, (lang = 'en')::int as y from z where lang is not null), r as (select *, rank() over (partition by dim order by x) + (count(*) over (partition by dim, x) - 1) / 2.0 as mid from y),
    s as (select dim, sum(mid * y) as r, sum(y)::double as p, sum(1 - y)::double as q from r group by dim) select dim, round_even((r - p * (p + 1) / 2) / (p * q), 8) as auroc from s""")
def auroc_midrank(spark, d):
    rows = _covariates(spark, d).where("lang is not null").withColumn("y", (F.col("lang") == "en").cast("int"))
    return scores.auroc(rows, ["dim"], "x", "y").select("dim", F.bround("auroc", 8).alias("auroc"))


@query("select user_id, arg_max(value, (ts, event_id)) as pooled_last, round_even(avg(value), 6) as pooled_mean, count(*) as length from events group by user_id")
def pool_last_mean(spark, d):
    pooled = read_table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value"))["value"].alias("pooled_last"), F.avg("value").alias("m"), F.count("*").alias("length"))
    return pooled.select("user_id", "pooled_last", F.bround("m", 6).alias("pooled_mean"), "length")


@query(f"with {_L}, m as (select dim, avg(x) as m from l group by dim), c as (select a.dim as i, b.dim as j, sum((a.x - p.m) * (b.x - q.m)) / count(*) as s from l a join l b on a.id = b.id join m p on a.dim = p.dim join m q on b.dim = q.dim group by all) select round_even(sum(s) filter (i = j), 4) as total_variance, round_even(sqrt(sum(s * s)), 4) as frobenius from c")
def pca_variance_identities(spark, d):
    """Total variance and Frobenius norm of the covariance, from the principal values."""
    v = _vectors(spark, d)
    n, s, g = geo.gram(v)
    _, _, ratio = geo.principal_axes(v)
    total = float((g.trace() - (s**2).sum() / n) / n)
    return spark.createDataFrame([(total, float((ratio**2).sum() ** 0.5 * total))], "t double, f double").select(F.bround("t", 4).alias("total_variance"), F.bround("f", 4).alias("frobenius"))


@query()
def pca_explained_variance(spark, d):
    _, _, ratio = geo.principal_axes(_vectors(spark, d))
    return spark.createDataFrame([(i, float(r)) for i, r in enumerate(ratio)], "pc long, explained double")


@query()
def rankme(spark, d):
    v = _vectors(spark, d)
    return v.agg(F.count("*").alias("n")).withColumn("rankme", F.lit(geo.rankme(v)))
