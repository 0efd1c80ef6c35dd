"""Frequency of every distinct term, by recursive radix partitioning.

Terms are partitioned by the leading bits of their hash. A prefix that holds
more bytes than a task may take is split by further bits, and what is still too
large is measured and split again, as deep as the hash goes; only where a single
term is left are its rows split by the bits of the holder and event instead, and
its partial results are merged. Each partition is then aggregated by DuckDB,
streaming from Arrow, within a memory limit and with a spill folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecgauge.session import ensure_checkpoint_dir

#: Leading bits of which all values are counted before the first split.
FIRST_BITS = 12
#: A partition's bytes at least and at most, and the partitions aimed at between them.
LEAST_BYTES, MOST_BYTES, PARTITIONS = 8 << 20, 256 << 20, 10_000


def plan_prefixes(histogram: dict[int, int], partition_bytes: int, bits: int = FIRST_BITS) -> tuple[list[int], list[int], int]:
    """First partition and number of further bits for every value of the leading bits, and the number of partitions.

    Neighbouring values share a partition as long as they fit.
    """
    first, take, count, held = [0] * (1 << bits), [0] * (1 << bits), -1, partition_bytes + 1
    for i in range(1 << bits):
        size = histogram.get(i, 0)
        take[i] = max(0, -(-size // partition_bytes) - 1).bit_length()
        if take[i] or held + size > partition_bytes:
            count, held = count + 1, 0
        first[i] = count
        held += size
        if take[i]:
            count, held = count + (1 << take[i]) - 1, partition_bytes + 1
    return first, take, count + 1


def split_plan(large: list[tuple[int, int, bool, int]], partition_bytes: int, count: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """How partitions that are too large are split: partition, first new one, further bits, splits by event; and the new number of partitions.

    ``large`` has partition, bytes, whether it holds a single term, and the hash bits used.
    """
    rows = []
    for part, size, single, used in large:
        pieces = -(-size // partition_bytes)
        bits = 0 if single or used >= 64 else min(64 - used, max(1, (pieces - 1).bit_length()))
        rows.append((part, count, bits, 1 if bits else pieces))
        count += 1 << bits if bits else pieces
    return rows, count


def _aggregate(memory: str, spill: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(batches, None)
        if first is None:
            return
        # a folder of its own for each task, on whatever host; without a shared one nothing is spilled
        con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": f"{spill}/{uuid.uuid4().hex}" if spill else ""})

        def all_batches():
            yield first
            yield from batches

        incoming = pa.RecordBatchReader.from_batches(first.schema, all_batches())
        con.register("incoming", incoming)
        con.execute(
            "create temp table held as select term, holder, split, count(*) as n from "
            "(select distinct term, holder, e1, e2, split from incoming) group by all"
        )
        found = con.sql(
            "select term, cast(null as varchar) as holder, cast(sum(n) as bigint) as n_events, count(*) as n_holders from held where not split group by term "
            "union all select term, holder, n, 1 from held where split"
        )
        yield from found.to_arrow_reader(50_000)
        con.close()

    return run


def radix_partitions(rows: DataFrame, partition_bytes: int | None) -> tuple[DataFrame, int, bool]:
    """``rows`` (``term, h, size`` and what else is there) with ``part, used, split``; the number of partitions, and whether one holds a part of a term.

    The driver gathers the sizes of the leading 12 bits, and of partitions that
    are larger than twice ``partition_bytes``.
    """
    spark = rows.sparkSession
    leading = F.shiftrightunsigned("h", 64 - FIRST_BITS).cast("int")
    histogram = {r.b: r.n for r in rows.groupBy(leading.alias("b")).agg(F.sum("size").alias("n")).collect()}
    if partition_bytes is None:
        partition_bytes = min(MOST_BYTES, max(LEAST_BYTES, sum(histogram.values()) // PARTITIONS))
    first, take, count = plan_prefixes(histogram, partition_bytes)

    def bits(used: str, n: str) -> Column:
        """The ``n`` bits of the hash that follow the first ``used``."""
        return F.expr(f"case when {n} = 0 then 0 else shiftrightunsigned(shiftleft(h, {used}), 64 - {n}) end").cast("int")

    known = rows.withColumn("take", F.element_at(F.lit(take), leading + 1))
    placed = known.withColumn("part", F.element_at(F.lit(first), leading + 1) + bits(str(FIRST_BITS), "take")).withColumn("used", F.col("take") + FIRST_BITS).drop("take").withColumn("split", F.lit(False))
    examined, hot = 0, False
    while any(take) and examined < count:
        sizes = placed.where((F.col("part") >= examined) & ~F.col("split")).groupBy("part").agg(F.sum("size").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"), F.max("used").alias("used"))
        large = [(r.part, r.n, r.low == r.high, r.used) for r in sizes.where(F.col("n") > 2 * partition_bytes).collect()]
        examined = count
        if not large:
            break
        plan, count = split_plan(large, partition_bytes, count)
        hot = hot or any(pieces > 1 for *_, pieces in plan)
        table = F.broadcast(spark.createDataFrame(plan, "part int, base int, more int, pieces int"))
        wide = placed.join(table, "part", "left")
        further = F.when(F.col("pieces") > 1, F.expr("pmod(xxhash64(holder, e1, e2), pieces)").cast("int")).otherwise(bits("used", "more"))
        placed = wide.withColumn("part", F.when(F.col("base").isNull(), F.col("part")).otherwise(F.col("base") + further)).withColumn("split", F.col("split") | (F.coalesce("pieces", F.lit(1)) > 1))
        placed = placed.withColumn("used", F.col("used") + F.coalesce("more", F.lit(0))).drop("base", "more", "pieces")
    return placed, max(count, 1), hot


def term_frequency(
    rows: DataFrame, term: Column, holder: Column, event: Sequence[Column], partition_bytes: int | None = None, memory: str = "400MB"
) -> DataFrame:
    """``term, n_events, n_holders`` for every distinct term.

    Rows with a null or empty term or a null holder do not count. Rows that
    agree in term, holder and all ``event`` columns (null equals null) are one
    event. An empty table gives no rows; terms may be of any length; extra
    columns, whatever their names, are ignored. ``partition_bytes`` bounds what a
    task aggregates, about 8 to 256 MB by the size of the table.
    """
    shared = ensure_checkpoint_dir(rows.sparkSession)
    slim = rows.select(term.alias("term"), holder.cast("string").alias("holder"), F.xxhash64(*[c.isNull() for c in event], *event).alias("e1"), F.hash(*[c.isNull() for c in event], *event).alias("e2")).where(
        "term is not null and term != '' and holder is not null"
    )
    sized = slim.select("*", F.xxhash64("term").alias("h"), (F.octet_length("term") + F.octet_length("holder") + 24).cast("long").alias("size"))
    placed, count, hot = radix_partitions(sized, partition_bytes)
    spill = shared.removeprefix("file:").replace("///", "/") if shared.startswith(("file:", "/")) else None
    by_part = placed.repartitionById(count, F.col("part")).select("term", "holder", "e1", "e2", "split")
    parts = by_part.mapInArrow(_aggregate(memory, spill), "term string, holder string, n_events long, n_holders long")
    if not hot:  # every term lies in one partition
        return parts.select("term", "n_events", "n_holders")
    return (
        parts.groupBy("term", "holder").agg(F.sum("n_events").alias("n_events"), F.max("n_holders").alias("n_holders"))
        .groupBy("term").agg(F.sum("n_events").alias("n_events"), F.sum("n_holders").alias("n_holders"))
    )


def mark_terms(counts: DataFrame, holders: int, min_holders: int = 5, max_share: float = 0.4) -> DataFrame:
    """Adds ``mark``: ``rare`` below ``min_holders`` holders, ``common`` above ``max_share`` of all, else null."""
    return counts.withColumn("mark", F.when(F.col("n_holders") < min_holders, "rare").when(F.col("n_holders") > F.lit(max_share) * F.lit(holders), "common"))
