"""Readers of label, split and score files, and small sinks for records and tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgauge.functions.scalars import binary_outcome


def read_labels(spark: SparkSession, path: str, task: str) -> DataFrame:
    """``person_id, prediction_time, y, label_type, task`` from a CSV of ``patient_id, prediction_time, label_type, value``."""
    raw = spark.read.csv(path, header=True, schema="patient_id long, prediction_time timestamp_ntz, label_type string, value string", enforceSchema=False)
    y = binary_outcome(F.col("value"), F.lower("label_type"))
    return raw.select(F.col("patient_id").alias("person_id"), "prediction_time", y.alias("y"), "label_type", F.lit(task).alias("task"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """``person_id, split`` from a CSV of ``omop_person_id, split``."""
    return spark.read.csv(path, header=True, schema="omop_person_id long, split string", enforceSchema=False).withColumnRenamed("omop_person_id", "person_id")


def published_score(spark: SparkSession, path: str, **wanted: str) -> DataFrame:
    """One row, ``value``: the mean of the published scores whose columns have the wanted values; null without any."""
    rows = spark.read.csv(path, header=True, schema="model string, head string, k string, score string, value double", enforceSchema=False)
    for column, value in wanted.items():
        rows = rows.where(F.col(column) == value)
    return rows.agg(F.avg("value").alias("value"))


def write_record(df: DataFrame, path: str) -> None:
    """A record of a run as JSON lines, through Spark's committed write."""
    df.write.mode("overwrite").json(path)


def read_record(spark: SparkSession, path: str) -> DataFrame:
    """Records of runs, as written by :func:`write_record`."""
    return spark.read.json(path)


def parquet_rows(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table, from its footers alone."""
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return spark.read.parquet(path).count()


def write_markdown(df: DataFrame, path: str, caption: str, label: str, most_rows: int = 1000) -> None:
    """A result table as Markdown, for reading; one of more than ``most_rows`` rows is refused."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows: not a table to be read")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f":::{{table}} {caption}", f":label: {label}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows]
    Path(path).write_text("\n".join([*lines, ":::", ""]), encoding="utf-8")
