"""Attributes as known at event time.

Each attribute keeps its own change history. A fact has a time at which it
holds and a time at which it became known; it is eligible from the later of
the two. Ordered by eligibility, the running maximum of (time, known, code) is
the value in force, so one ordered pass per attribute answers every moment:
the last-known match needs no join of all facts with all moments.

A history is cut into chunks of a few days. The running maximum is taken
inside each chunk, and a second, small pass carries the maximum of all earlier
chunks forward. An entity that holds a large part of all rows is thereby spread
over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecgauge.sources.tables import normal_form

ALWAYS = "0001-01-01 00:00:00"
FOREVER = "9999-12-31 00:00:00"


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _chunk(moment: Column, days: int) -> Column:
    return F.floor(F.datediff(moment.cast("date"), F.lit("0001-01-01").cast("date")) / days).cast("int")


def change_history(events: DataFrame, prefixes: Mapping[str, str]) -> DataFrame:
    """``person_id, attribute, eligible, fact struct<time,known,code>``, one row per event.

    ``prefixes`` maps an attribute to the prefix (in normal form) of its codes.
    A missing ``recorded_at`` stands for the row's time; if that is missing too
    the row was always known. Rows of one event became known with the earliest.
    """
    code = normal_form(F.col("code"))
    attribute = F.lit(None).cast("string")
    for name, prefix in prefixes.items():
        attribute = F.when(code.startswith(prefix), F.lit(name)).otherwise(attribute)
    time, recorded = F.col("time").cast("timestamp_ntz"), F.col("recorded_at").cast("timestamp_ntz")
    return (
        events.select("person_id", attribute.alias("attribute"), time.alias("time"), code.alias("code"), F.coalesce(recorded, time, _ntz(ALWAYS)).alias("known"))
        .where("person_id is not null and attribute is not null")
        .groupBy("person_id", "attribute", "time", "code")
        .agg(F.min("known").alias("known"))
        .select("person_id", "attribute", F.greatest("time", "known").alias("eligible"), F.struct("time", "known", "code").alias("fact"))
    )


def attributes_at(history: DataFrame, moments: DataFrame, attributes: list[str], chunk_days: int = 7) -> DataFrame:
    """Long result ``ref_kind, ref_id, attribute, code``; code is null where nothing was known.

    ``moments`` has ``ref_kind, ref_id, person_id, moment``; a null moment admits
    every event. Of the admitted events the latest time wins, then the latest
    known, then the greatest code; undated events come before all dated ones.
    Moments without a person, or of a person without events, come out with null
    codes. Empty tables give empty results, repeated moments repeated answers.
    """
    asked = moments.select(
        "ref_kind", "ref_id", "person_id", F.coalesce(F.col("moment").cast("timestamp_ntz"), _ntz(FOREVER)).alias("eligible"),
        F.explode(F.array(*[F.lit(a) for a in attributes])).alias("attribute"),
    )
    known = asked.where("person_id is not null")
    fact_type = history.schema["fact"].dataType
    both = history.select(
        "person_id", "attribute", "eligible", "fact", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("ref_kind"), F.lit(None).cast("long").alias("ref_id")
    ).unionByName(
        known.select("person_id", "attribute", "eligible", F.lit(None).cast(fact_type).alias("fact"), F.lit(1).alias("kind"), "ref_kind", F.col("ref_id").cast("long").alias("ref_id"))
    ).withColumn("chunk", _chunk(F.col("eligible"), chunk_days))

    key = ["person_id", "attribute", "chunk"]
    inside = Window.partitionBy(*key).orderBy("eligible", "kind").rowsBetween(Window.unboundedPreceding, 0)
    answered = both.withColumn("here", F.max("fact").over(inside)).where("kind = 1").select(*key, "ref_kind", "ref_id", "here")

    earlier = Window.partitionBy("person_id", "attribute").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = both.groupBy(*key).agg(F.max("fact").alias("fact"), F.max("kind").alias("asked"))
    carried = chunks.withColumn("before", F.max("fact").over(earlier)).where("asked = 1 and before is not null").select(*key, "before")

    found = answered.join(carried, key, "left").select("ref_kind", "ref_id", "attribute", F.greatest("here", "before")["code"].alias("code"))
    missing = asked.where("person_id is null").select("ref_kind", F.col("ref_id").cast("long").alias("ref_id"), "attribute", F.lit(None).cast("string").alias("code"))
    return found.unionByName(missing)


def pivot_attributes(answers: DataFrame, attributes: list[str]) -> DataFrame:
    """One row per moment with a column for each attribute."""
    return answers.groupBy("ref_kind", "ref_id").agg(*[F.max(F.when(F.col("attribute") == a, F.col("code"))).alias(a) for a in attributes])
