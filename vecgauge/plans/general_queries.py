"""Queries of the general training-data problems (p3, p5) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgauge.operators.asof_attributes import attributes_at, change_history, pivot_attributes
from vecgauge.operators.entity_features import entity_vectors, expand_features, long_features
from vecgauge.sources.tables import read_table

AS_OF = "2025-01-01 00:00:00"
ATTRIBUTES = {"payer": "PAYER/", "residence": "RESIDENCE/", "smoking": "SMOKING/"}


def _p3(spark: SparkSession, d: str):
    panel = read_table(spark, d, "code_panel")
    return entity_vectors(read_table(spark, d, "patient_timeline"), panel, AS_OF), panel


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    vectors, panel = _p3(spark, d)
    return long_features(vectors, panel, AS_OF).select("person_id", "code", "n_events", "days_ago")


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    vectors, panel = _p3(spark, d)
    return long_features(vectors, panel, AS_OF).select("person_id", "code", F.bround("total", 4).alias("total"))


def p3_feature_table(spark: SparkSession, d: str) -> DataFrame:
    vectors, panel = _p3(spark, d)
    return expand_features(vectors, panel, AS_OF)


def _moments(spark: SparkSession, d: str) -> DataFrame:
    anchors = read_table(spark, d, "anchors").select(F.lit("anchor").alias("ref_kind"), F.col("anchor_id").alias("ref_id"), "person_id", F.col("cutoff").alias("moment"))
    labels = read_table(spark, d, "labeled_patients").where("prediction_time is not null")
    return anchors.unionByName(labels.select(F.lit("label").alias("ref_kind"), F.col("label_id").alias("ref_id"), F.col("patient_id").alias("person_id"), F.col("prediction_time").alias("moment")))


def _p5(spark: SparkSession, d: str) -> DataFrame:
    history = change_history(read_table(spark, d, "patient_timeline"), ATTRIBUTES)
    return attributes_at(history, _moments(spark, d), list(ATTRIBUTES))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).where("code is not null").select("ref_kind", "ref_id", "code")


def p5_attributes(spark: SparkSession, d: str) -> DataFrame:
    return pivot_attributes(_p5(spark, d), list(ATTRIBUTES))


QUERIES = {"p3_found": p3_found, "p3_totals": p3_totals, "p3_feature_table": p3_feature_table, "p5_found": p5_found, "p5_attributes": p5_attributes}

_NF = "upper(trim(code, ' ' || chr(9)))"
_P3 = f"""
with e as (select person_id, time, {_NF} as code,
             max(case when isfinite(numeric_value) then struct_pack(a := coalesce(recorded_at, timestamp '0001-01-01'), v := numeric_value) end) as reading
           from patient_timeline where person_id is not null and code is not null and {_NF} <> ''
             and (time is null or time < timestamp '2025-01-01') group by all),
     f as (select e.person_id, e.code, count(*) as n_events,
             max(e.time) as latest, sum(coalesce(reading.v, 0.0)) as total
           from e join (select distinct {_NF} as code from code_panel) p on e.code = p.code group by e.person_id, e.code)
"""
_P5 = f"""
with m as (select 'anchor' as ref_kind, anchor_id as ref_id, person_id, cutoff as moment from anchors
           union all select 'label', label_id, patient_id, prediction_time from labeled_patients where prediction_time is not null),
     e as (select person_id, time, {_NF} as code, min(coalesce(recorded_at, time, timestamp '0001-01-01')) as known
           from patient_timeline where person_id is not null and regexp_matches({_NF}, '^(PAYER|RESIDENCE|SMOKING)/') group by all),
     r as (select ref_kind, ref_id, code, row_number() over (partition by ref_kind, ref_id, split_part(code, '/', 1)
             order by time desc nulls last, known desc, code desc) as pos
           from m join e using (person_id)
           where moment is null or ((time is null or time <= moment) and known <= moment))
"""
SQL = {
    "p3_found": _P3 + "select person_id, code, n_events, coalesce(cast(floor((epoch_us(timestamp '2025-01-01') - epoch_us(latest)) / 86400000000.0) as bigint), -1) as days_ago from f",
    "p3_totals": _P3 + "select person_id, code, round_even(total, 4) as total from f",
    "p5_found": _P5 + "select ref_kind, ref_id, code from r where pos = 1",
    "p5_attributes": _P5 + """, w as (select ref_kind, ref_id, max(code) filter (code like 'PAYER/%') as payer, max(code) filter (code like 'RESIDENCE/%') as residence,
             max(code) filter (code like 'SMOKING/%') as smoking from r where pos = 1 group by all)
        select m.ref_kind, m.ref_id, payer, residence, smoking from m left join w on m.ref_kind = w.ref_kind and m.ref_id = w.ref_id""",
}

#: The panel holds the positions 0 to 299.
SQL["p3_feature_table"] = (
    _P3 + ", g as (select f.*, p.panel_pos as pos from f join (select " + _NF + " as code, min(panel_pos) as panel_pos from code_panel group by 1) p on f.code = p.code) select person_id, "
    + ", ".join(
        f"cast(coalesce(max(n_events) filter (pos = {i}), 0) as bigint) as n_{i}, cast(max(floor((epoch_us(timestamp '2025-01-01') - epoch_us(latest)) / 86400000000.0)) filter (pos = {i}) as bigint) as days_{i}, coalesce(max(total) filter (pos = {i}), 0.0) as total_{i}"
        for i in range(300)
    )
    + " from g group by person_id"
)
