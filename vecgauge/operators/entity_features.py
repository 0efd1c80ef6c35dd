"""Per-entity feature table from events.

Event types are encoded as small indices. For every entity a sparse vector
holds, per index, a count, a total and the latest time; these vectors merge by
addition and maximum, so parts built from different partitions or days combine
without the events. Only at the very end are they expanded into columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecgauge.sources.tables import normal_form

#: Upper limit of event types; the expanded table has three columns for each.
MAX_TYPES = 2000


def encode_types(panel: DataFrame, code: str = "code", position: str = "panel_pos") -> DataFrame:
    """``(code, idx)`` with codes in normal form; of repeated codes the smallest position stays."""
    return (
        panel.select(normal_form(F.col(code)).alias("code"), F.col(position).cast("int").alias("idx"))
        .where("code is not null and code != '' and idx is not null")
        .groupBy("code")
        .agg(F.min("idx").alias("idx"))
    )


def _combine(parts: DataFrame) -> DataFrame:
    """Merge ``(person_id, idx, n, total, latest)`` rows into one sparse vector per entity."""
    merged = parts.groupBy("person_id", "idx").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("latest").alias("latest")
    )
    entry = F.struct("idx", "n", "total", "latest")
    return merged.groupBy("person_id").agg(F.sort_array(F.collect_list(entry)).alias("features"))


def entity_vectors(events: DataFrame, panel: DataFrame, as_of: str) -> DataFrame:
    """One sparse vector per entity: ``person_id, features array<struct<idx,n,total,latest>>``.

    Rows without person or code do not count. All rows that agree in person,
    time (null equals null) and normal form of the code are one event; its value
    is that of its latest recorded row with a finite value. Events at or after
    ``as_of`` are left out, undated ones stay. A vector never holds more entries
    than there are types, however many events an entity has: events are
    deduplicated on (person, time, type), then counted in the map tasks, so a
    hot entity reaches one task only as its few type counts.

    An empty table gives no rows; extra columns are ignored; an entity without
    an event of the panel has no row.
    """
    limit = F.lit(as_of).cast("timestamp_ntz")
    value = F.col("numeric_value")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    rows = (
        events.select("person_id", F.col("time").cast("timestamp_ntz").alias("time"), normal_form(F.col("code")).alias("code"), "numeric_value", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"))
        .where(F.col("person_id").isNotNull() & (F.col("time").isNull() | (F.col("time") < limit)))
        .join(encode_types(panel), "code")
        .select("person_id", "time", "idx", F.when(finite, F.struct("recorded_at", "numeric_value")).alias("reading"))
    )
    once = rows.groupBy("person_id", "time", "idx").agg(F.max("reading").alias("reading"))
    return _combine(
        once.select("person_id", "idx", F.lit(1).cast("long").alias("n"), F.coalesce(F.col("reading.numeric_value"), F.lit(0.0)).alias("total"), F.col("time").alias("latest"))
    )


def merge_vectors(*parts: DataFrame) -> DataFrame:
    """Add vectors of separate days or partitions (whose events must not overlap)."""
    flat = [p.select("person_id", F.inline("features")) for p in parts]
    whole = flat[0]
    for more in flat[1:]:
        whole = whole.unionByName(more)
    return _combine(whole)


def days_before(as_of: str, moment: Column) -> Column:
    """Whole 24-hour days from ``moment`` to ``as_of``."""
    return F.extract(F.lit("DAY"), F.lit(as_of).cast("timestamp_ntz") - moment).cast("long")


def long_features(vectors: DataFrame, panel: DataFrame, as_of: str) -> DataFrame:
    """``person_id, code, n_events, days_ago, total``; days_ago is -1 where no event is dated."""
    return (
        vectors.select("person_id", F.inline("features"))
        .join(encode_types(panel), "idx")
        .select("person_id", "code", F.col("n").alias("n_events"), F.coalesce(days_before(as_of, F.col("latest")), F.lit(-1).cast("long")).alias("days_ago"), "total")
    )


def expand_features(vectors: DataFrame, panel: DataFrame, as_of: str) -> DataFrame:
    """One row per entity with ``n_<idx>``, ``days_<idx>`` and ``total_<idx>`` for every type.

    The indices are the panel positions. A type without events has count 0,
    total 0.0 and null days.
    """
    codes = encode_types(panel)
    indices = [r.idx for r in codes.select("idx").distinct().orderBy("idx").limit(MAX_TYPES + 1).collect()]
    if len(indices) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types cannot become columns")
    wide = (
        vectors.select("person_id", F.inline("features"))
        .select("person_id", "idx", "n", "total", days_before(as_of, F.col("latest")).alias("days"))
        .groupBy("person_id")
        .pivot("idx", indices)
        .agg(F.first("n").alias("n"), F.first("days").alias("days"), F.first("total").alias("total"))
    )
    columns: list[Column] = []
    for i in indices:
        columns += [
            F.coalesce(F.col(f"{i}_n"), F.lit(0)).cast("long").alias(f"n_{i}"),
            F.col(f"{i}_days").alias(f"days_{i}"),
            F.coalesce(F.col(f"{i}_total"), F.lit(0.0)).alias(f"total_{i}"),
        ]
    return wide.select("person_id", *columns)
