"""Filling containers of fixed capacity by linear grouping.

Items above the capacity are split; whole capacities of them fill containers of
their own. Large items are divided into groups of equal number by size and
rounded up to the largest of their group. For these few sizes a linear program
over configurations (column generation) says how many containers of which
configuration to use. The actual items take the places of their group, and small
items go by best fit into what room is left.

Only the histogram of sizes, no longer than the capacity, reaches the driver.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecgauge.session import cut

CAPACITY = 2048
#: Items above this share of the capacity are large.
LARGE_SHARE = 1 / 8
GROUPS = 24
SHARD_ROWS = 40_000
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The public pre-tokenisation pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``item, size``: length of each text in tokens; null texts have none. ``tokenizer``: a file of ranks, which is sent to the executors."""
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["item", "size"])

    texts = documents.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    return texts.mapInArrow(run, "item long, size long")


def linear_groups(histogram: dict[int, int], groups: int = GROUPS) -> list[tuple[int, int]]:
    """``(rounded size, number of items)`` from large to small; sizes up to a rounded one belong to it."""
    total, out, inside = sum(histogram.values()), [], 0
    if not total:
        return []
    per, top = -(-total // groups), None
    for size in sorted(histogram, reverse=True):
        if top is None:
            top = size
        inside += histogram[size]
        if inside >= per:
            out.append((top, inside))
            inside, top = 0, None
    if inside:
        out.append((top, inside))
    return out


def _knapsack(sizes: list[int], values: np.ndarray, demand: list[int], capacity: int) -> tuple[float, list[int]]:
    """Best configuration for the given values of the sizes."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        for i, s in enumerate(sizes):
            if s <= room and best[room - s] + values[i] > best[room] + 1e-12:
                best[room], choice[room] = best[room - s] + values[i], i
    counts, room = [0] * len(sizes), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """``(items of each size, number of containers)`` that hold the demand, near the fewest containers."""
    m = len(sizes)
    if not m:
        return []
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    d = np.array(demand, float)
    for _ in range(40 * m):
        x = np.linalg.solve(basis, d)
        prices = np.linalg.solve(basis.T, np.ones(m))
        value, column = _knapsack(sizes, prices, demand, capacity)
        if value <= 1 + 1e-7:
            break
        enter = np.linalg.solve(basis, np.array(column, float))
        ratio = np.where(enter > 1e-9, x / np.where(enter > 1e-9, enter, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.maximum(0, np.linalg.solve(basis, d))
    left, out = np.array(demand), []
    for j in np.argsort(-x):
        column = basis[:, j].astype(int)
        n = int(min(np.floor(x[j] + 1e-9), *(left[i] // column[i] for i in range(m) if column[i])))
        if n:
            out.append((column.tolist(), n))
            left = left - n * column
    rest: dict[tuple[int, ...], int] = {}
    while left.any():  # what rounding left over, by first fit from large to small
        room, counts = capacity, [0] * m
        for i, s in enumerate(sizes):
            take = int(min(left[i], room // s))
            counts[i], room = take, room - take * s
        n = int(min(left[i] // counts[i] for i in range(m) if counts[i]))
        rest[tuple(counts)] = rest.get(tuple(counts), 0) + n
        left = left - n * np.array(counts)
    return out + [(list(k), n) for k, n in rest.items()]


class Places:
    """Which container holds the r-th item of a group."""

    def __init__(self, plan: list[tuple[list[int], int]], groups: int):
        self.starts: list[list[int]] = [[] for _ in range(groups)]
        self.base: list[list[int]] = [[] for _ in range(groups)]
        self.per: list[list[int]] = [[] for _ in range(groups)]
        reached, container = [0] * groups, 0
        for counts, n in plan:
            for g, c in enumerate(counts):
                if c:
                    self.starts[g].append(reached[g])
                    self.base[g].append(container)
                    self.per[g].append(c)
                    reached[g] += c * n
            container += n

    def container(self, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.empty(len(group), np.int64)
        for g in np.unique(group):
            at = group == g
            run = np.searchsorted(self.starts[g], rank[at], "right") - 1
            out[at] = np.array(self.base[g])[run] + (rank[at] - np.array(self.starts[g])[run]) // np.array(self.per[g])[run]
        return out


def _place(places: Places):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"item": f["item"].to_numpy(object), "piece": f["piece"], "n": f["n"], "container": places.container(f["grp"].to_numpy(), f["rank"].to_numpy())})

    return run


def _best_fit(capacity: int):
    def run(key, room: pd.DataFrame, small: pd.DataFrame) -> pd.DataFrame:
        if not len(small):
            return pd.DataFrame({"item": np.empty(0, object), "piece": np.empty(0, np.int32), "n": np.empty(0, np.int64), "container_id": np.empty(0, object)})
        free: dict[int, list[str]] = {}
        for name, r in zip(room["container_id"], room["free"], strict=True):
            free.setdefault(int(r), []).append(name)
        levels, opened, where = sorted(free), 0, []
        small = small.sort_values(["n", "item", "piece"], ascending=[False, True, True])
        for n in small["n"].to_numpy():
            i = bisect.bisect_left(levels, n)
            if i == len(levels):
                name, r, opened = f"small-{key[0]}-{opened}", capacity, opened + 1
            else:
                r = levels[i]
                name = free[r].pop()
                if not free[r]:
                    del free[r], levels[i]
            where.append(name)
            r -= int(n)
            if r not in free:
                free[r] = []
                bisect.insort(levels, r)
            free[r].append(name)
        return pd.DataFrame({"item": small["item"].to_numpy(), "piece": small["piece"].to_numpy(), "n": small["n"].to_numpy(), "container_id": where})

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, large_share: float = LARGE_SHARE, groups: int = GROUPS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``item, piece, start, n, container_id`` for every item of ``sizes`` (``item, size``).

    Only an item above the capacity has more than one piece. No container holds
    more than the capacity. Items of size 0 are placed like small ones; null and
    negative sizes are left out; an empty table gives no rows; repeated items
    are packed repeatedly, and null ones are items like others. Small items meet the open containers in shards of
    bounded size, so at most one container a shard stays open.
    """
    kept = cut(sizes.where("size >= 0").select(F.col("item").cast("long").alias("item"), F.col("size").cast("long").alias("size")).withColumn("no", F.monotonically_increasing_id()))
    # rows are told apart by their number, as items may be repeated or null; items travel as text, a null as an empty one, so that none turns into a float
    pieces = kept.select("no", F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)))).alias("piece"))
    pieces = pieces.select("no", "item", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("long").alias("n"))
    bound = int(capacity * large_share)
    histogram = {int(r.n): r.c for r in pieces.groupBy("n").agg(F.count("*").alias("c")).collect()}
    grouped = linear_groups({s: c for s, c in histogram.items() if bound < s < capacity}, groups)
    tops = [s for s, _ in grouped]
    plan = configurations(tops, [c for _, c in grouped], capacity)

    full = pieces.where(F.col("n") == capacity).select("item", "piece", "n", F.format_string("full-%d-%d", "no", "piece").alias("container_id"))
    large = pieces.where((F.col("n") > bound) & (F.col("n") < capacity))
    grp = F.lit(0)
    for i, top in enumerate(tops):
        grp = F.when(F.col("n") <= top, i).otherwise(grp)
    chunks = max(1, sum(histogram.values()) // shard_rows)
    large = large.withColumn("grp", grp).withColumn("chunk", F.pmod(F.xxhash64("no", "piece"), F.lit(chunks)).cast("int"))
    before = Window.partitionBy("grp").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = large.groupBy("grp", "chunk").agg(F.count("*").alias("c")).select("grp", "chunk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("grp", "chunk").orderBy("n", "no", "piece")
    ranked = large.withColumn("at", F.row_number().over(inside) - 1).join(offsets, ["grp", "chunk"]).select("item", "piece", "n", "grp", (F.col("at") + F.col("offset")).alias("rank"))
    placed = ranked.mapInPandas(_place(Places(plan, len(tops))), "item string, piece int, n long, container long").select("item", "piece", "n", F.format_string("large-%d", "container").alias("container_id"))

    shards = max(1, -(-max(sum(n for _, n in plan), sum(c for s, c in histogram.items() if s <= bound)) // shard_rows))
    room = placed.groupBy("container_id").agg((capacity - F.sum("n")).alias("free")).where("free > 0").withColumn("shard", F.pmod(F.xxhash64("container_id"), F.lit(shards)).cast("int"))
    small = pieces.where(F.col("n") <= bound).withColumn("shard", F.pmod(F.xxhash64("no", "piece"), F.lit(shards)).cast("int"))
    fitted = room.groupBy("shard").cogroup(small.groupBy("shard")).applyInPandas(_best_fit(capacity), "item string, piece int, n long, container_id string")
    return full.unionByName(placed).unionByName(fitted).select(F.when(F.col("item") != "", F.col("item").cast("long")).alias("item"), "piece", (F.col("piece").cast("long") * capacity).alias("start"), "n", "container_id")
