"""Timelines: summaries, the time firewall and anchor sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecgauge.functions.scalars import years_between
from vecgauge.session import cut
from vecgauge.sources.tables import normal_form

BIRTH = "MEDS_BIRTH"
DEMOGRAPHIC = ("GENDER/", "RACE/", "ETHNICITY/")


def is_demographic(code: Column) -> Column:
    """Birth or a birth-stamped demographic; ``code`` in normal form, null counts as clinical."""
    return F.coalesce((code == BIRTH) | F.array_contains(F.transform(F.array(*map(F.lit, DEMOGRAPHIC)), lambda p: F.startswith(code, p)), True), F.lit(False))


def timeline_summary(events: DataFrame) -> DataFrame:
    """One row per person: birth, first and last clinical event, their number, spans in years, demographics.

    Undated events sort first, so one undated clinical event makes
    ``first_event`` null. Of several codes of one demographic the earliest
    counts, undated first, then the smallest. Persons of null id are left out.
    """
    rows = events.where("person_id is not null").select("person_id", F.col("time"), normal_form(F.col("code")).alias("code"))
    clinical = ~is_demographic(F.col("code"))
    first = {p: F.min(F.when(F.col("code").startswith(p), F.struct("time", "code")))["code"] for p in DEMOGRAPHIC}
    out = rows.groupBy("person_id").agg(
        F.min(F.when(F.col("code") == BIRTH, F.struct("time", "code")))["time"].alias("birth_date"),
        F.count_if(clinical).alias("n_events"),
        F.count_if(clinical & F.col("time").isNull()).alias("undated"),
        F.min(F.when(clinical, F.col("time"))).alias("first_dated"),
        F.max(F.when(clinical, F.col("time"))).alias("last_event"),
        *[c.alias(p.strip("/").lower()) for p, c in first.items()],
    )
    out = out.withColumn("first_event", F.when(F.col("undated") == 0, F.col("first_dated")))
    value = lambda c: F.substring_index(c, "/", -1)
    return out.select(
        "person_id", "birth_date", "first_event", "last_event", "n_events",
        years_between(F.col("first_event"), F.col("last_event")).alias("observation_years"),
        years_between(F.col("birth_date"), F.col("last_event")).alias("age_at_last_event"),
        *[value(F.col(c)).alias(c) for c in ("gender", "race", "ethnicity")],
    )


def within(time: Column, cutoff: Column) -> Column:
    """The firewall: undated events always pass, a null cutoff admits everything, the cutoff itself is inside."""
    return cutoff.isNull() | time.isNull() | (time <= cutoff)


def history_counts(events: DataFrame, anchors: DataFrame, chunk_days: int = 30) -> DataFrame:
    """``anchor_id, n_events`` within each anchor's cutoff, 0 where there is none.

    Undated events always count and a null cutoff admits everything. Events and
    anchors of a person are ordered together; running counts are taken within
    chunks of a few days and the sums of earlier chunks are carried forward, so
    a person with very many events is spread over tasks and no anchor is joined
    to single events.
    """
    at = lambda c, empty: F.coalesce(F.unix_micros(c.cast("timestamp")), F.lit(empty).cast("long"))
    low, high = -(10**17), 10**18
    known = anchors.where("person_id is not null")
    both = events.where("person_id is not null").groupBy("person_id", "time").agg(F.count("*").alias("n")).select(
        "person_id", at(F.col("time"), low).alias("at"), "n", F.lit(None).cast("long").alias("anchor_id")
    ).unionByName(known.select("person_id", at(F.col("cutoff"), high).alias("at"), F.lit(0).cast("long").alias("n"), "anchor_id"))
    both = both.withColumn("chunk", F.floor(F.col("at") / (86_400_000_000 * chunk_days)))
    inside = Window.partitionBy("person_id", "chunk").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("here", F.sum("n").over(inside)).where("anchor_id is not null").select("person_id", "chunk", "anchor_id", "here")
    earlier = Window.partitionBy("person_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("person_id", "chunk").agg(F.sum("n").alias("n")).select("person_id", "chunk", F.sum("n").over(earlier).alias("before"))
    counted = here.join(carried, ["person_id", "chunk"]).select("anchor_id", (F.col("here") + F.coalesce("before", F.lit(0))).alias("n_events"))
    return counted.unionByName(anchors.where("person_id is null").select("anchor_id", F.lit(0).cast("long").alias("n_events")))


def perlabel_index(labels: DataFrame) -> DataFrame:
    """Distinct ``person_id, cutoff`` of all tasks' label times."""
    return labels.where("patient_id is not null and prediction_time is not null").select(F.col("patient_id").alias("person_id"), F.col("prediction_time").alias("cutoff")).distinct()


def lastevent_index(summary: DataFrame) -> DataFrame:
    """One anchor per person that has a dated clinical event."""
    return summary.where("last_event is not null").select("person_id", F.col("last_event").alias("cutoff"))


def build_index(anchor: str, events: DataFrame | None, labels: DataFrame | None = None, scout_tasks: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The index of one anchor level, and its anchors of persons without events.

    ``lastevent``, ``perlabel-scout`` (the labels of a few tasks) or ``perlabel``;
    every level needs the events. ``shared`` is refused, as no outcome window is
    declared, and so is any other name.
    """
    if anchor == "shared":
        raise ValueError("the shared level needs a declared outcome window")
    if anchor not in ("lastevent", "perlabel-scout", "perlabel"):
        raise ValueError(f"unknown anchor level {anchor!r}")
    if events is None:
        raise ValueError(f"the {anchor} level needs the events")
    if anchor == "lastevent":
        index = lastevent_index(timeline_summary(events))
        return index, index.limit(0)
    if labels is None:
        raise ValueError(f"the {anchor} level needs the labels")
    chosen = labels.where(F.col("task").isin(*scout_tasks)) if anchor == "perlabel-scout" else labels
    return restrict_to_known(perlabel_index(chosen), events)


def person_events(events: DataFrame, person_id: int) -> DataFrame:
    """``pos, time, code, value`` of one person, undated events first; a NaN value is null.

    Equal times are ordered by code and value. The person is a filter that reaches
    the scan.
    """
    rows = events.where(F.col("person_id") == person_id).select("time", "code", F.nanvl("numeric_value", F.lit(None).cast("double")).alias("value"))
    order = Window.orderBy(F.col("time").asc_nulls_first(), F.col("code").asc_nulls_first(), F.col("value").asc_nulls_first())
    return rows.select(F.row_number().over(order).alias("pos"), "time", "code", "value")


def model_events(events: DataFrame) -> DataFrame:
    """``person_id, time, event`` with ``event`` the code and its value, null where it is missing or NaN; what an encoder reads."""
    value = F.nanvl(F.col("numeric_value"), F.lit(None).cast("double")).alias("value")
    return events.select("person_id", "time", F.struct("code", value).alias("event"))


def index_batches(index: DataFrame, size: int) -> DataFrame:
    """``batch, n_anchors, n_persons, first_pos``: runs of ``size`` anchors in the index's order, so that a person's lie together."""
    numbered = numbered_index(index).withColumn("batch", F.floor((F.col("pos") - 1) / size))
    return numbered.groupBy("batch").agg(F.count("*").alias("n_anchors"), F.count_distinct("person_id").alias("n_persons"), F.min("pos").alias("first_pos"))


def restrict_to_known(index: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors of persons with events, and those of unknown persons."""
    known = events.select("person_id").distinct()
    return index.join(known, "person_id", "left_semi"), index.join(known, "person_id", "left_anti")


def ordered_index(index: DataFrame) -> DataFrame:
    """By person and cutoff, null cutoffs first."""
    return index.orderBy(F.col("person_id").asc_nulls_first(), F.col("cutoff").asc_nulls_first())


def numbered_index(index: DataFrame) -> DataFrame:
    """``pos, person_id, cutoff``: places from 1 in that order; ``index`` has no repeated rows.

    The rows are range-partitioned and numbered within each partition; only the
    sizes of the partitions are ordered together.
    """
    order = [F.col("person_id").asc_nulls_first(), F.col("cutoff").asc_nulls_first()]
    parts = cut(index.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within_part = parts.withColumn("here", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return within_part.join(F.broadcast(before), "part").select((F.col("before") + F.col("here")).alias("pos"), "person_id", "cutoff")


def align_features(labels: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Every label with its feature row and ``matched``; duplicate feature keys fan out."""
    return labels.join(features.withColumn("matched", F.lit(True)), keys, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def unique_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows themselves; the query fails where a key occurs twice."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("n_of_key", n).where(F.assert_true(F.col("n_of_key") == 1, F.lit("repeated key")).isNull()).drop("n_of_key")
