"""Queries of the battery as a whole, nuisance covariates, result tables, index and registry, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgauge.functions.scalars import norm, pool
from vecgauge.operators import confounds, preparation, registry, replicates, scores, scoring, validation
from vecgauge.operators import result_tables as tables
from vecgauge.operators import timeline as tl
from vecgauge.plans.audit_queries import _L, _NF, _V, _vectors
from vecgauge.sources.tables import normal_form, read_table, widen_vector

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- nuisance covariates

TRAIN = "id % 5 < 3"


def _covariates(spark: SparkSession, d: str) -> DataFrame:
    """Per vector: the logarithms of its user's events and of its document's length, and the document's language."""
    events = read_table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", F.coalesce(F.lower("lang"), F.lit("none")).alias("lang"))
    rows = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id")).join(events, "id", "left").join(docs, "id", "left")
    return rows.select("id", F.log(1 + F.coalesce("n", F.lit(0))).alias("log_n_events"), F.log(1 + F.col("n_chars")).alias("log_n_chars"), F.coalesce("lang", F.lit("none")).alias("lang"))


_C = """c as (select v.id, v.id % 5 < 3 as train, ln(1 + coalesce(e.n, 0)) as log_n_events, ln(1 + d.n_chars) as log_n_chars, coalesce(lower(d.lang), 'none') as lang from v
    left join (select user_id, count(*) as n from events group by 1) e on v.id = e.user_id left join documents d on v.id = d.doc_id)"""
_LONG = f"{_L}, {_C}, z as (select l.dim, l.x, c.* from l join c on l.id = c.id where c.train)"


def _associations(spark: SparkSession, d: str) -> DataFrame:
    return confounds.component_association(_vectors(spark, d), _covariates(spark, d).drop("log_n_chars"), TRAIN)


@query(f"""with {_LONG}, t as (select dim, var_pop(x) as v from z group by dim), s as (select sum(v) as total from t),
    a as (select dim, pow(covar_pop(x, log_n_events), 2) / var_pop(log_n_events) as r from z group by dim),
    p as (select dim, lang, count(*) as n, sum(x) as s from z group by all), b as (select dim, sum(s * s / n) / sum(n) - pow(sum(s) / sum(n), 2) as r from p group by dim)
    select 'log_n_events' as covariate, round_even(sum(r) / any_value(total), 4) as variance_weighted_r2 from a, s union all select 'lang', round_even(sum(r) / any_value(total), 4) from b, s""")
def pcr_by_covariate(spark, d):
    """The variance-weighted association over all components, which does not depend on the axes."""
    return confounds.by_covariate(_associations(spark, d)).select("covariate", "variance_weighted_r2")


@query()
def pcr_by_component(spark, d):
    found = confounds.component_association(_vectors(spark, d), _covariates(spark, d), TRAIN, unit=True)
    return confounds.by_component(found, ["log_n_events", "log_n_chars", "lang"])


@query(f"""with {_V}, {_C}, m as (select coalesce(avg(log_n_events) filter (train), 0) as m0, coalesce(avg(log_n_chars) filter (train), 0) as m1 from c),
    i as (select c.id, train, coalesce(log_n_events, m0) - m0 as a, coalesce(log_n_chars, m1) - m1 as b from c, m), s as (select sqrt(var_pop(a) filter (train)) as s0, sqrt(var_pop(b) filter (train)) as s1 from i)
    select id, round_even(a / case when s0 > 0 then s0 else 1 end, 6) as z_events, round_even(b / case when s1 > 0 then s1 else 1 end, 6) as z_chars from i, s""")
def design_matrix(spark, d):
    ids = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    z = confounds.design_matrix(ids, _covariates(spark, d).drop("lang"), TRAIN)
    return z.select("id", F.bround(F.col("z")[0], 6).alias("z_events"), F.bround(F.col("z")[1], 6).alias("z_chars"))


@query(f"with {_L} select distinct dim, c.name as covariate, 0.0 as r2 from l, (select unnest(['log_n_events', 'log_n_chars']) as name) c")
def residualised_association(spark, d):
    """Of two covariates that have been taken out, nothing is left in any dimension of the rows they were fitted on."""
    covariates = _covariates(spark, d).drop("lang")
    rest = confounds.residualised(_vectors(spark, d), covariates, TRAIN).where(TRAIN)
    z = confounds.design_matrix(rest, covariates, TRAIN).select(F.col("z")[0].alias("log_n_events"), F.col("z")[1].alias("log_n_chars"), F.posexplode("vec").alias("dim", "x"))
    return confounds.association(z, ["dim"], "x", z.select("log_n_events", "log_n_chars"), ["log_n_events", "log_n_chars"]).select("dim", "covariate", F.bround("r2", 6).alias("r2"))


# --- the battery as a whole


def _space(spark: SparkSession, d: str) -> DataFrame:
    part = F.col("id") % 5
    return _vectors(spark, d).withColumn("split", F.when(part < 3, "train").when(part == 3, "val").otherwise("test"))


def _scored_space(spark: SparkSession, d: str, scaling: str, gate: bool) -> tuple[DataFrame, DataFrame]:
    space = _space(spark, d)
    spec = {"n_clusters": space.select("label").distinct().count(), "anisotropy": 0.0, "intrinsic_dim": 64.0}
    return scoring.score_space(space, _covariates(spark, d), "log_n_events", spec, scaling, gate)


@query()
def score_space(spark, d):
    """Both arms, the null gate on the primary one, with the frozen constants."""
    return _scored_space(spark, d, "spherical", True)[0].unionByName(_scored_space(spark, d, "raw", False)[0])


@query()
def score_curve(spark, d):
    return _scored_space(spark, d, "spherical", True)[1]


@query()
def clustering_labels(spark, d):
    return scoring.run_clustering(_space(spark, d))["labels"]


@query("select case when vec_id % 5 < 3 then 'train' when vec_id % 5 = 3 then 'val' else 'test' end as split, count(*) as n, 1.0 as share from embeddings group by 1")
def clustering_sizes(spark, d):
    """Sizes of the clusters by split, added up again."""
    sizes = scoring.run_clustering(_space(spark, d))["sizes"]
    return sizes.groupBy("split").agg(F.sum("n").alias("n"), F.bround(F.sum("share"), 9).alias("share"))


@query("select count(*) as n, 0 as n_off_sphere, 63 as n_components from embeddings")
def spherical_norms(spark, d):
    """After the primary arm every vector has length 1, and one component less than before."""
    ready = preparation.prepare(_space(spark, d), "spherical", scoring.TRAIN)
    return ready.agg(F.count("*").alias("n"), F.count_if(F.abs(norm(F.col("vec")) - 1) > 1e-9).alias("n_off_sphere"), F.max(F.size("vec")).cast("long").alias("n_components"))


@query()
def post_preparation_cosine(spark, d):
    return spark.createDataFrame([(scoring.post_preparation_cosine(_space(spark, d)),)], "mean_cosine_post_prep double")


@query("select chosen_k as k, round_even(avg(prediction_strength / 3), 4) as strength_mean, round_even(stddev_pop(prediction_strength / 3), 4) as strength_std from measurements where chosen_k is not null group by 1")
def curve_summary(spark, d):
    rows = read_table(spark, d, "measurements").where("chosen_k is not null").select(F.col("chosen_k").alias("k"), (F.col("prediction_strength") / 3).alias("strength"))
    return replicates.summarise_curve(rows)


_MARGIN = "round_even((strength - null_median) / nullif(1 - null_median, 0), 4)"


@query(f"""with g as (select chosen_k as k, avg(prediction_strength) filter (scaling = 'spherical') as strength, avg(prediction_strength) filter (scaling = 'raw') as null_median from measurements where chosen_k is not null group by 1),
    m as (select k, {_MARGIN} as margin, strength > null_median as exceeds from g), b as (select bool_or(exceeds) as any_k, max(margin) as margin, arg_max(k, (margin, -k)) filter (margin is not null) as k from m)
    select any_k as any_k_beats_null, margin as max_margin, k as k_at_max_margin, case when any_k is null then null when not any_k then 'CONTINUOUS' when margin < 0.1 then 'WEAK' else 'DISCRETE' end as verdict from b""")
def gate_verdict(spark, d):
    """The verdict over ks, with the measurements of the raw arm in place of null draws."""
    arm = lambda s: F.avg(F.when(F.col("scaling") == s, F.col("prediction_strength")))
    per = read_table(spark, d, "measurements").where("chosen_k is not null").groupBy(F.col("chosen_k").alias("k")).agg(arm("spherical").alias("real"), arm("raw").alias("null_median"))
    table = per.select("k", (F.col("real") > F.col("null_median")).alias("exceeds_null"), F.bround(F.try_divide(F.col("real") - F.col("null_median"), 1 - F.col("null_median")), 4).alias("margin"))
    return replicates.gate_verdict(table).drop("sentence")


# --- result tables: conditions follow from the number of a measured cell, scores from its measurements

_I = "cast(substr(cell_id, 6) as int)"
_CASE = lambda values, i: f"case {i} % {len(values)} " + " ".join(f"when {n} then {v}" for n, v in enumerate(values)) + " end"
_CONDITIONS = ["'base'", "'separation-2.0'", "'separation-3.0'", "'continuum-3.0'", "'intrinsic-dim-8'", "'noise-0.3'", "'cone-only-0.6'", "'separation-0.0'", "'anisotropy-0.6'"]
_SCORED = {
    "cell_id": _CASE(_CONDITIONS, _I) + f" || '-s' || cast({_I} % 3 as varchar(9))",
    "scaling": "scaling",
    "separation": _CASE(["4.0e0", "2.0e0", "3.0e0", "3.0e0", "4.0e0", "4.0e0", "0.0e0", "0.0e0", "4.0e0"], _I),
    "structure": _CASE(["'blobs'", "'blobs'", "'blobs'", "'continuum'", "'blobs'", "'blobs'", "'none'", "'none'", "'blobs'"], _I),
    "anisotropy": f"cast({_I} % 4 as double) / 5", "intrinsic_dim": f"8 + 8 * ({_I} % 3)", "noise": f"cast({_I} % 5 as double) / 10",
    "confound_orientation": _CASE(["'axis'", "'radial'", "'none'"], _I), "confound_strength": f"cast({_I} % 4 as double)", "confound_cluster_coupling": f"{_I} % 2",
    "gate_ran": "verdict is not null", "gate_any_k_beats_null": "prediction_strength > 0.5", "gate_max_margin": "prediction_strength - 0.5", "gate_k_at_max_margin": "chosen_k", "chosen_k": "chosen_k",
    "strength_at_chosen_k": "prediction_strength", "silhouette": "silhouette", "ari_at_true_k": "prediction_strength * 0.5", "rankme": "cast(n_patients as double) / 7", "rankme_minus_intrinsic_dim": f"cast(n_patients as double) / 7 - (8 + 8 * ({_I} % 3))",
    "mean_cosine": "prediction_strength * 0.25", "anisotropy_error": f"prediction_strength * 0.25 - cast({_I} % 4 as double) / 5", "pcr_confound_leading_pc_r2": "prediction_strength * 0.3", "pcr_confound_variance_weighted_r2": "prediction_strength * 0.1",
    "decode_confound_r2_linear": "prediction_strength * 0.6", "decode_confound_r2_nonlinear": "prediction_strength * 0.7", "decode_decoy_max_r2_nonlinear": "prediction_strength * -0.2",
}


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "measurements").select(*[F.expr(e).alias(n) for n, e in _SCORED.items()])


_S = "s as (select " + ", ".join(f"{e} as {n}" for n, e in _SCORED.items()) + " from measurements)"
_VERDICT = "case when not gate_ran then null when not coalesce(gate_any_k_beats_null, false) then 'CONTINUOUS' when gate_max_margin < 0.1 then 'WEAK' else 'DISCRETE' end"
_R = f"{_S}, r as (select *, regexp_replace(cell_id, '-s[0-9]$', '') as condition, {_VERDICT} as gate_verdict from s), p as (select * from r where scaling = 'spherical')"
_AGREED = "case when count(distinct gate_verdict) = 0 then '-' when count(distinct gate_verdict) = 1 then min(gate_verdict) else 'mixed' end as verdict"
_SPREAD = "coalesce(nullif(array_to_string(list_sort(list({0}) filter ({0} is not null)), ', '), ''), '-') as {1}"
_AVG = "round_even(avg({0}) filter (not isnan({0})), {2}) as {1}"
_KS = _SPREAD.format("gate_k_at_max_margin", "k_at_max_margin")
_MEAN = lambda column, name, digits=3: _AVG.format(column, name, digits)


@query(f"""with {_R} select separation, {_AGREED}, {_MEAN("gate_max_margin", "margin")}, {_KS}, {_MEAN("ari_at_true_k", "ari_at_true_k")}, {_SPREAD.format("chosen_k", "chosen_k")}, {_MEAN("silhouette", "silhouette")}
    from p where starts_with(condition, 'separation-') or condition = 'base' group by separation""")
def separation_table(spark, d):
    return tables.separation_table(_scored(spark, d))


@query(f"""with {_R} select separation, structure, {_AGREED}, {_MEAN("gate_max_margin", "margin")}, {_KS}, {_MEAN("strength_at_chosen_k", "prediction_strength")}, {_MEAN("silhouette", "silhouette")}
    from p where separation in (2, 3, 6) and (starts_with(condition, 'separation-') or starts_with(condition, 'continuum-') or condition = 'base') group by all""")
def continuum_table(spark, d):
    return tables.continuum_table(_scored(spark, d))


@query(f"""with {_R} select confound_orientation, confound_strength, {_MEAN("pcr_confound_leading_pc_r2", "pcr_leading_pc_r2")}, {_MEAN("pcr_confound_variance_weighted_r2", "pcr_variance_weighted_r2")},
    {_MEAN("decode_confound_r2_linear", "probe_linear_r2")}, {_MEAN("decode_confound_r2_nonlinear", "probe_nonlinear_r2")}, {_MEAN("decode_decoy_max_r2_nonlinear", "decoy_floor")}, {_MEAN("ari_at_true_k", "ari_at_true_k")}
    from p where confound_orientation in ('axis', 'radial') and confound_cluster_coupling = 0 group by all""")
def confound_table(spark, d):
    return tables.confound_table(_scored(spark, d))


_BLOCK = "select '{2}' as varied, cast({1} as double) as value, " + _MEAN("rankme", "rankme", 2) + ", " + _MEAN("rankme_minus_intrinsic_dim", "error", 2) + " from p where starts_with(condition, '{0}') or condition = 'base' group by {1}"


@query(f"with {_R} {_BLOCK.format('intrinsic-dim-', 'intrinsic_dim', 'intrinsic dimension')} union all {_BLOCK.format('noise-', 'noise', 'ambient noise SD')}")
def rankme_table(spark, d):
    return tables.rankme_table(_scored(spark, d))


@query(f"""with {_R} select anisotropy, scaling, {_AGREED}, {_MEAN("gate_max_margin", "margin")}, {_MEAN("mean_cosine", "measured_cosine")}, {_MEAN("anisotropy_error", "anisotropy_error")}
    from r where starts_with(condition, 'cone-only-') or condition = 'separation-0.0' group by all""")
def cone_table(spark, d):
    return tables.cone_table(_scored(spark, d))


_ORACLE = {
    "task": "cell_id || '/' || scaling || '/' || cast(chosen_k as varchar(9))", "auroc": "prediction_strength", "ci_low": "prediction_strength - 0.05", "ci_high": "prediction_strength + 0.05", "published_auroc": "silhouette",
    "delta": "prediction_strength - silhouette", "n_test": "n_patients", "informative": "verdict = 'DISCRETE'",
}


@query(f"""with o as (select {", ".join(f"{e} as {n}" for n, e in _ORACLE.items())} from measurements where chosen_k is not null)
    select task, round_even(auroc, 3) as ours, printf('[%.3f, %.3f]', ci_low, ci_high) as ci, round_even(published_auroc, 3) as published, round_even(delta, 4) as delta, n_test, informative from o""")
def oracle_table(spark, d):
    return tables.oracle_table(read_table(spark, d, "measurements").where("chosen_k is not null").select(*[F.expr(e).alias(n) for n, e in _ORACLE.items()]))


@query(f"""with {_S}, w as (select cell_id, scaling, regexp_replace(regexp_replace(cell_id, '-s[0-9]$', ''), '-[^-]*$', '') as sweep from s)
    select cell_id, scaling, sweep, sweep in ('base', 'separation', 'continuum', 'anisotropy', 'cone-only', 'noise', 'n-patients', 'imbalance') and (scaling = 'spherical' or sweep in ('anisotropy', 'cone-only')) as runs_gate from w""")
def gate_subset(spark, d):
    return _scored(spark, d).select("cell_id", "scaling", tables.sweep_of(F.col("cell_id")).alias("sweep"), tables.runs_null_gate(F.col("cell_id"), F.col("scaling")).alias("runs_gate"))


# --- codes, pooling, index

_TOKENS = f"""t as (select {_NF} || ' || ' || cast(try_cast(floor(numeric_value) as bigint) as varchar) as token from patient_timeline where code is not null and abs(numeric_value) < 1e6
    union all select '[' || code || ']' from code_panel union all select code from code_panel)"""


@query(f"with {_TOKENS} select distinct split_part(token, ' || ', 1) as code from t where not starts_with(token, '[')")
def base_codes(spark, d):
    valued = read_table(spark, d, "patient_timeline").where("code is not null and abs(numeric_value) < 1e6").select(F.concat_ws(" || ", normal_form(F.col("code")), F.floor("numeric_value").cast("bigint").cast("string")).alias("token"))
    panel = read_table(spark, d, "code_panel").select(F.explode(F.array(F.concat(F.lit("["), "code", F.lit("]")), "code")).alias("token"))
    return scores.known_base_codes(valued.unionByName(panel))


@query(f"""with {_V}, n as (select *, id % 9 as seen from v) select id, i as dim, vec[8 * (greatest(seen, 1) - 1) + i + 1] as pooled_last,
    round_even(coalesce(list_sum([vec[8 * t + i + 1] for t in range(seen)]), 0) / greatest(seen, 1), 9) as pooled_mean from n, (select unnest(range(8)) as i)""")
def masked_pooling(spark, d):
    """Each vector as eight states of eight numbers, of which the first ``id % 9`` are real."""
    states = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("vec", 8 * t + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: (t < F.col("id") % 9).cast("int"))
    rows = _vectors(spark, d).select("id", states.alias("hidden"), mask.alias("mask"))
    both = rows.select("id", pool(F.col("hidden"), F.col("mask"), "last").alias("a"), pool(F.col("hidden"), F.col("mask"), "mean").alias("b"))
    return both.select("id", F.posexplode(F.arrays_zip("a", "b")).alias("dim", "x")).select("id", "dim", F.col("x.a").alias("pooled_last"), F.bround("x.b", 9).alias("pooled_mean"))


SCOUT_TASKS = ("lab_glucose_low", "lab_sodium_low")
_SCOUT = f"select distinct patient_id as person_id, prediction_time as cutoff from labeled_patients where task in {SCOUT_TASKS} and prediction_time is not null and patient_id in (select person_id from patient_timeline where person_id is not null)"


@query(_SCOUT)
def index_of_scouts(spark, d):
    return tl.build_index("perlabel-scout", read_table(spark, d, "patient_timeline"), read_table(spark, d, "labeled_patients"), SCOUT_TASKS)[0]


@query(f"with i as ({_SCOUT}), n as (select *, row_number() over (order by person_id nulls first, cutoff nulls first) as pos from i) select (pos - 1) // 8 as batch, count(*) as n_anchors, count(distinct person_id) as n_persons, min(pos) as first_pos from n group by 1")
def index_batches(spark, d):
    return tl.index_batches(index_of_scouts(spark, d), 8)


@query("select person_id, cutoff from (select distinct person_id, cutoff from anchors) order by person_id nulls first, cutoff nulls first limit 100")
def index_head(spark, d):
    """The first hundred anchors in order, for a trial run."""
    return tl.ordered_index(read_table(spark, d, "anchors").select("person_id", "cutoff").distinct()).limit(100)


@query("""with e as (select time, code, case when isnan(numeric_value) then null else numeric_value end as value from patient_timeline where person_id = (select max(person_id) from anchors where person_id in (select person_id from patient_timeline)))
    select row_number() over (order by time nulls first, code nulls first, value nulls first) as pos, * from e""")
def events_of_a_person(spark, d):
    events = read_table(spark, d, "patient_timeline")
    known = tl.restrict_to_known(read_table(spark, d, "anchors"), events)[0]
    return tl.person_events(events, known.agg(F.max("person_id")).first()[0] or -1)


@query("select person_id, count(*) as n, count(code) as n_codes, count(case when isnan(numeric_value) then null else numeric_value end) as n_values from patient_timeline where person_id is not null group by 1")
def model_event_counts(spark, d):
    rows = tl.model_events(read_table(spark, d, "patient_timeline")).where("person_id is not null")
    return rows.groupBy("person_id").agg(F.count("*").alias("n"), F.count("event.code").alias("n_codes"), F.count("event.value").alias("n_values"))


@query("select vec_id as id, " + ", ".join(f"cast(embedding[{i + 1}] as double) * (1 + label) as dim_{i}" for i in range(64)) + " from embeddings")
def wide_vectors(spark, d):
    return widen_vector(_vectors(spark, d).select("id", "vec"), 64)


# --- registry and run checks


def _cells(spark: SparkSession, d: str) -> DataFrame:
    passes = read_table(spark, d, "token_lengths").select(F.col("model_name").alias("family"), F.lit("base").alias("size"), F.col("context_length").alias("context"))
    return registry.cells(passes)


_CELLS = """k as (select distinct model_name as family, 'base' as size, context_length as context from token_lengths where model_name is not null and context_length is not null),
    g as (select family || '-' || size || '-' || context || '-' || p as cell_id, 'model' as source, family, size, context, p as pooling from k, (select unnest(['last', 'mean']) as p) union all select 'counts', null, null, null, null, null)"""


@query(f"with {_CELLS} select * from g")
def registry_cells(spark, d):
    return _cells(spark, d)


@query(f"with {_CELLS} select family || '-' || size || '-' || context as extraction_key, count(*) as n_cells, string_agg(cell_id, ' ' order by cell_id) as members from g where source is not null group by 1")
def poolings_by_extraction(spark, d):
    return registry.poolings_by_extraction(_cells(spark, d))


@query(f"""with {_CELLS}, n as (select model_name || '-base-' || context_length || '-last' as cell_id, count(*) as n_measured from token_lengths group by 1)
    select 'records' as dataset, 'perlabel' as anchor, n.cell_id, 'raw' as scaling, source, family, size, context, pooling, n_measured from n join g on n.cell_id = g.cell_id""")
def identified_rows(spark, d):
    counts = read_table(spark, d, "token_lengths").groupBy(F.concat_ws("-", "model_name", F.lit("base"), F.col("context_length").cast("string"), F.lit("last")).alias("cell_id")).agg(F.count("*").alias("n_measured"))
    return registry.with_identity(counts, _cells(spark, d), "records", "perlabel", "raw")


@query("""with i as (select distinct person_id, cutoff, 1 as there from anchors), f as (select distinct model_name, context_length, person_id, cutoff from token_lengths),
    m as (select model_name, context_length, count(there) as n_found from f left join i on f.person_id is not distinct from i.person_id and f.cutoff is not distinct from i.cutoff group by all), n as (select count(*) as n_expected from i)
    select model_name, context_length, n_found, n_expected, n_expected - n_found as n_missing, case when n_expected = n_found then 'PASS' else 'FAIL' end as verdict from m, n""")
def run_completion(spark, d):
    return validation.completion(read_table(spark, d, "anchors"), read_table(spark, d, "token_lengths"), ["person_id", "cutoff"], ["model_name", "context_length"])


@query("""with t as (select model_name, context_length, count(*) as n, count(distinct run_day) as n_days, sum(least(n_tokens, context_length)) as seen from token_lengths where n_tokens >= 0 group by all)
    select model_name, context_length, n, n_days, round_even(n / n_days, 4) as per_day, round_even(seen / n_days, 2) as tokens_per_day from t""")
def run_throughput(spark, d):
    return validation.throughput(read_table(spark, d, "token_lengths"))
