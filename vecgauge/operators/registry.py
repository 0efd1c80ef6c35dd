"""The registry of embedding cells: what each one is, which share a forward pass, and the identity of result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POOLINGS = ("last", "mean")
BASELINES = ("counts",)


def cells(passes: DataFrame, poolings: tuple[str, ...] = POOLINGS, baselines: tuple[str, ...] = BASELINES) -> DataFrame:
    """``cell_id, source, family, size, context, pooling``: every pooling of every ``family, size, context``, and baselines, which run no model.

    Repeated passes are one; passes with a null part are left out.
    """
    each = passes.where("family is not null and size is not null and context is not null").select("family", "size", "context").distinct()
    named = each.select("*", F.explode(F.array(*map(F.lit, poolings))).alias("pooling"))
    models = named.select(F.concat_ws("-", "family", "size", F.col("context").cast("string"), "pooling").alias("cell_id"), F.lit("model").alias("source"), "family", "size", "context", "pooling")
    if not baselines:
        return models
    plain = passes.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, baselines))).alias("cell_id"))
    return models.unionByName(plain, allowMissingColumns=True)


def extraction_key() -> Column:
    """What one forward pass is keyed on: all of a cell but its pooling; null for a baseline."""
    return F.when(F.col("source").isNotNull(), F.concat_ws("-", "family", "size", F.col("context").cast("string")))


def poolings_by_extraction(registry: DataFrame) -> DataFrame:
    """``extraction_key, n_cells, members``: cells of the same pass in order of their ids; baselines have none."""
    keyed = registry.withColumn("extraction_key", extraction_key()).where("extraction_key is not null")
    return keyed.groupBy("extraction_key").agg(F.count("*").alias("n_cells"), F.array_join(F.array_sort(F.collect_list("cell_id")), " ").alias("members"))


def with_identity(rows: DataFrame, registry: DataFrame, dataset: str, anchor: str, scaling: str) -> DataFrame:
    """``rows`` of a ``cell_id`` with the leading columns that say what they are; rows of unknown cells are left out."""
    lead = ["dataset", "anchor", "cell_id", "scaling", *[c for c in registry.columns if c != "cell_id"]]
    known = rows.join(F.broadcast(registry), "cell_id").withColumns({"dataset": F.lit(dataset), "anchor": F.lit(anchor), "scaling": F.lit(scaling)})
    return known.select(*lead, *[c for c in rows.columns if c not in lead])
