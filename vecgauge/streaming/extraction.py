"""Resumable extraction of history vectors, in batch and as a stream of arriving anchors.

A history is encoded by hashing its codes into a fixed number of buckets. Work
done is known by the person and cutoff already written, so a lost run goes on where it
stopped and a repeated one adds nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecgauge.sources.tables import normal_form

BUCKETS = 32


def code_bucket(code: Column, buckets: int = BUCKETS) -> Column:
    return (F.conv(F.substring(F.md5(code), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def history_vectors(events: DataFrame, anchors: DataFrame, buckets: int = BUCKETS, chunk_days: int = 30) -> DataFrame:
    """``person_id, cutoff, bucket, weight``: mean-pooled bucket shares of each anchor's history, sparse.

    The history of an anchor is what lies at or before its cutoff; undated events
    always do, and a null cutoff admits everything. Rows without person or code
    do not count; an anchor without history gives no rows, a repeated one the
    rows once. Counts of a person and bucket run within chunks of a few days, and
    the sums of earlier chunks are carried forward, so a person with very many
    events is spread over tasks and no anchor is joined to single events.
    """
    code = normal_form(F.col("code"))
    rows = events.select("person_id", "time", code.alias("code")).where("person_id is not null and code is not null and code != ''")
    micros = lambda c, empty: F.coalesce(F.unix_micros(c.cast("timestamp")), F.lit(empty).cast("long"))
    counts = rows.groupBy("person_id", code_bucket(F.col("code"), buckets).alias("bucket"), micros(F.col("time"), -(10**17)).alias("at")).agg(F.count("*").alias("n"))
    wanted = anchors.where("person_id is not null").select("person_id", "cutoff").distinct()
    held = counts.groupBy("person_id").agg(F.collect_set("bucket").alias("held"))
    asked = wanted.join(held, "person_id").select("person_id", F.explode("held").alias("bucket"), micros(F.col("cutoff"), 10**18).alias("at"), "cutoff", F.lit(True).alias("asks"))
    both = counts.withColumn("asks", F.lit(False)).unionByName(asked, allowMissingColumns=True).withColumn("chunk", F.floor(F.col("at") / (86_400_000_000 * chunk_days)))
    inside = Window.partitionBy("person_id", "bucket", "chunk").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("here", F.coalesce(F.sum("n").over(inside), F.lit(0))).where("asks").select("person_id", "bucket", "chunk", "cutoff", "here")
    earlier = Window.partitionBy("person_id", "bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = both.groupBy("person_id", "bucket", "chunk").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    carried = sums.select("person_id", "bucket", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    seen = here.join(carried, ["person_id", "bucket", "chunk"]).select("person_id", "cutoff", "bucket", (F.col("here") + F.col("before")).alias("n")).where("n > 0")
    total = F.sum("n").over(Window.partitionBy("person_id", "cutoff"))
    return seen.select("person_id", "cutoff", "bucket", (F.col("n") / total).alias("weight"))


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def extract_missing(events: DataFrame, anchors: DataFrame, path: str) -> None:
    """Append the vectors of those ``anchors`` (``person_id, cutoff``) that ``path`` does not hold yet.

    A null cutoff is one of its own. Anchors without history write nothing and
    are looked at again.
    """
    spark = events.sparkSession
    wanted = anchors.select("person_id", "cutoff").where("person_id is not null").distinct()
    done = _written(spark, path)
    if done is not None:
        done = done.select(F.col("person_id").alias("p"), F.col("cutoff").alias("c")).distinct()
        wanted = wanted.join(done, (F.col("person_id") == F.col("p")) & F.col("cutoff").eqNullSafe(F.col("c")), "left_anti")
    history_vectors(events.join(wanted.select("person_id").distinct(), "person_id", "left_semi"), wanted).write.mode("append").parquet(path)


def stream_extraction(events: DataFrame, anchors: DataFrame, path: str, checkpoint: str):
    """Extract for anchors as their files arrive; ``anchors`` is a streaming frame. Returns the started query."""
    return (
        anchors.writeStream.foreachBatch(lambda batch, _: extract_missing(events, batch, path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
