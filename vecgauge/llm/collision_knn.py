"""The k most similar vectors of every vector, by query-aware collision counting.

Every block of vectors keeps one sorted array per random projection, of which
the outer parts are kept: there a window holds few vectors, and near ones far
more often than others. A query takes the projections in which it lies farthest
out and opens a window around its own projection in each of their arrays; a
vector that falls into enough of these windows is a candidate and is verified by
its exact cosine. How far the windows grow (virtual rehashing) and how many
collisions are enough is found on the first queries of a block, which are
compared with all of it. Queries that end with fewer than k results, and blocks
in which no window tells near from far, are searched whole.

A group is divided into blocks of bounded size around pivots, so that a block
holds vectors that are near each other. A query first searches its own block;
then it visits only those blocks that can hold a vector nearer than its k-th
best so far, by the angle between it, the pivot and the block's farthest vector.
Blocks far from each other never meet. Where the vectors have no structure at
all, no block can be excluded, and the work grows as the square of a group,
divided over tasks by blocks. Other blocks are compared by a plain product, which
costs less than their windows; they are read from files, never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecgauge.llm.vector_blocks import unit_matrix
from vecgauge.session import SharedFolder, cut, shuffles_removed

#: Random projections of a block, those of them a query takes, and the share of an array kept at either end.
N_PROJECTIONS, N_TAKEN, TAIL = 1024, 32, 0.12
#: Half width of a window as a multiple of radius / sqrt(dimensions).
HALF_WIDTH = 0.88
#: The first queries of a block are searched whole; from them the narrowest windows (as multiples of the distance of the
#: k-th best) and the highest number of collisions are taken that together find this share of their best at least cost.
PILOT, GROWTH, COLLISIONS, RECALL = 128, (0.5, 0.75, 1.0, 1.25, 1.5), range(2, 13), 0.94
#: Relative costs of a vector met in a window and of a verified one.
MET_COST, VERIFY_COST = 3.0, 70.0
#: A block of at most so many vectors is verified whole.
SMALL = 500
#: Fewer queries than this are verified against the whole block, which costs less than its sorted arrays.
FEW = 300
#: Blocks of a group around pivots of their own at most.
MAX_PIVOTS = 1024
#: Queries and vectors of a plain product at once, which stays in the cache.
SLAB = 500, 1000


def projections(dims: int, count: int, seed: int) -> np.ndarray:
    """``count`` unit directions, orthogonal within each run of ``dims``."""
    rng = np.random.default_rng(seed)
    runs = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-count // dims))]
    return np.concatenate(runs, axis=1)[:, :count]


class SortedProjections:
    """The outer parts of a block's sorted projections, low ends first, then high ends."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x, self.dims = x, x.shape[1]
        self.narrow = x.astype(np.float32)
        self.small, self.seed = len(x) <= SMALL, seed

    def _build(self) -> None:
        x = self.x
        self.directions = projections(self.dims, N_PROJECTIONS, self.seed)
        kept = max(1, int(TAIL * len(x)))
        self.values = np.empty((2 * N_PROJECTIONS, kept), np.float32)
        self.order = np.empty((2 * N_PROJECTIONS, kept), np.int64)
        self.mean, self.spread = np.empty(N_PROJECTIONS, np.float32), np.empty(N_PROJECTIONS, np.float32)
        for low in range(0, N_PROJECTIONS, 64):
            projected = np.ascontiguousarray((self.narrow @ self.directions[:, low : low + 64].astype(np.float32)).T)
            part = np.argpartition(projected, (kept, len(x) - kept), axis=1)
            self.mean[low : low + 64], self.spread[low : low + 64] = projected.mean(1), projected.std(1) + 1e-12
            for side, ends in enumerate((part[:, :kept], part[:, len(x) - kept :])):
                values = np.take_along_axis(projected, ends, axis=1)
                order = np.argsort(values, axis=1, kind="stable")
                at = slice(side * N_PROJECTIONS + low, side * N_PROJECTIONS + low + 64)
                self.values[at] = np.take_along_axis(values, order, axis=1)
                self.order[at] = np.take_along_axis(ends, order, axis=1)

    def take(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays that each query takes, and its projection in them."""
        arrays, at = [], []
        directions = self.directions.astype(np.float32)
        for low in range(0, len(queries), 1000):
            projected = queries[low : low + 1000].astype(np.float32) @ directions
            out = (projected - self.mean) / self.spread
            best = np.argpartition(-np.abs(out), N_TAKEN, axis=1)[:, :N_TAKEN]
            arrays.append(best + N_PROJECTIONS * (np.take_along_axis(out, best, axis=1) > 0))
            at.append(np.take_along_axis(projected, best, axis=1))
        return np.concatenate(arrays), np.concatenate(at)

    def windows(self, arrays: np.ndarray, at: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each query's windows in the arrays it takes."""
        half = np.repeat((HALF_WIDTH * radius / np.sqrt(self.dims)).astype(np.float32), arrays.shape[1])
        flat, centre = arrays.ravel(), at.ravel()
        by_array = np.argsort(flat, kind="stable")
        edges = np.searchsorted(flat[by_array], np.arange(2 * N_PROJECTIONS + 1))
        low, high = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        for i in np.flatnonzero(np.diff(edges)):
            own = by_array[edges[i] : edges[i + 1]]
            low[own] = np.searchsorted(self.values[i], centre[own] - half[own], "left")
            high[own] = np.searchsorted(self.values[i], centre[own] + half[own], "right")
        return low.reshape(arrays.shape), high.reshape(arrays.shape)

    def collisions(self, arrays: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, int]:
        """In how many windows of one query each vector lies, and how many were met in all."""
        met = np.concatenate([self.order[i, a:b] for i, a, b in zip(arrays.tolist(), low.tolist(), high.tolist(), strict=True)])
        return np.bincount(met, minlength=len(self.x)), len(met)

    def best(self, query: np.ndarray, own: int, ids: np.ndarray, o: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best candidates by cosine (equal: the smaller id), none of them worse than ``bound``."""
        if len(o) > 4 * k:  # in single precision first; what can be among the best is computed exactly
            rough = self.narrow[o] @ query.astype(np.float32)
            o = o[rough >= max(np.partition(rough, len(o) - k - 1)[len(o) - k - 1], bound) - 1e-5]
        o = o[ids[o] != own]
        cosine = np.round(self.x[o] @ query, 12)
        if bound > -1:
            o, cosine = o[cosine >= bound], cosine[cosine >= bound]
        if len(o) > k:
            near = cosine >= np.partition(cosine, len(o) - k)[len(o) - k]
            o, cosine = o[near], cosine[near]
        order = np.lexsort((ids[o], -cosine))[:k]
        return o[order], cosine[order]

    def nearest(self, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int, bounds: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the positions of its k best vectors, except itself, with their cosines.

        ``bounds`` are cosines that each query has reached elsewhere: only better
        or equal vectors are sought, at the radius that the bound gives.
        """
        every = np.arange(len(self.x))
        least = np.full(len(queries), -2.0) if bounds is None else bounds
        out: list[tuple[np.ndarray, np.ndarray]] = [(every[:0], np.zeros(0))] * len(queries)

        def scan(rows: np.ndarray) -> None:
            for r in rows:
                out[r] = self.best(queries[r], query_ids[r], ids, every, k, least[r])

        if self.small or len(queries) < FEW:
            scan(np.arange(len(queries)))
            return out
        self._build()
        arrays, at = self.take(queries)
        pilot, rest = np.arange(PILOT), np.arange(PILOT, len(queries))
        scan(pilot)
        if bounds is None:
            last = [out[r][1][-1] for r in pilot if len(out[r][1])]
            radius = np.full(len(queries), np.sqrt(max(0.0, 2 - 2 * np.median(last))))
        else:
            radius = np.sqrt(2 - 2 * np.clip(bounds, -1, 1))
        growth, need = self._windows_needed(arrays[pilot], at[pilot], radius[pilot], [out[r][0] for r in pilot])
        if growth is None:  # no window tells near from far
            scan(rest)
            return out
        wanted = min(k, len(self.x) - 1) if bounds is None else 0
        for low in range(0, len(rest), 2000):
            rows = rest[low : low + 2000]
            begin, end = self.windows(arrays[rows], at[rows], growth * radius[rows])
            for j, r in enumerate(rows):
                o = np.flatnonzero(self.collisions(arrays[r], begin[j], end[j])[0] >= need)
                out[r] = self.best(queries[r], query_ids[r], ids, o, k, least[r])
            scan(np.array([r for r in rows if (len(out[r][0]) < wanted if bounds is None else least[r] <= -1)], int))
        return out

    def _windows_needed(self, arrays: np.ndarray, at: np.ndarray, radius: np.ndarray, truth: list[np.ndarray]) -> tuple[float | None, int]:
        """Growth of the windows and collisions that find ``RECALL`` of the true vectors of some queries at least cost."""
        best: tuple[float, float | None, int] = (np.inf, None, 0)
        if not sum(map(len, truth)):
            return 1.0, max(COLLISIONS) // 2
        for growth in GROWTH:
            low, high = self.windows(arrays, at, growth * radius)
            counts = [self.collisions(a, b, e) for a, b, e in zip(arrays, low, high, strict=True)]
            of_true = np.concatenate([c[t] for (c, _), t in zip(counts, truth, strict=True)])
            spread = np.sum([np.bincount(np.minimum(c, 63), minlength=64) for c, _ in counts], axis=0)
            for need in COLLISIONS:
                cost = MET_COST * sum(n for _, n in counts) + VERIFY_COST * spread[need:].sum()
                if (of_true >= need).mean() >= RECALL and cost < best[0]:
                    best = cost, growth, need
        return best[1], best[2]


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _pivots(key, part: pd.DataFrame) -> pd.DataFrame:
    """As many vectors of a sample as are wanted, each the farthest from those before it."""
    part = part.sort_values("id")
    x, wanted = unit_matrix(part["vec"]), int(part["wanted"].iloc[0])
    taken, near = [0], x @ x[0]
    while len(taken) < min(wanted, len(x)):
        taken.append(int(near.argmin()))
        near = np.maximum(near, x @ x[taken[-1]])
    return pd.DataFrame({"g": key[0], "pivot": np.arange(len(taken)), "vec": part["vec"].iloc[taken].to_numpy(), "parts": part["parts"].iloc[0]})


def _assign(pivots):
    """``grp, id, vec`` with the nearest pivot of each vector and the angle to it; groups without pivots are one cell."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = pivots.value
        for part in frames:
            grp = part["grp"].to_numpy()
            cell, angle = np.zeros(len(part), int), np.zeros(len(part))
            for g in set(grp) & set(centres):
                rows = np.flatnonzero(grp == g)
                for low in range(0, len(rows), 2000):
                    at = rows[low : low + 2000]
                    near = unit_matrix(part["vec"].iloc[at]) @ centres[g].T
                    cell[at], angle[at] = near.argmax(1), _angle(near.max(1))
            yield part.assign(cell=cell, angle=angle)

    return run


def near_blocks(vectors: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """``grp, id, vec, block`` with blocks of about ``block_rows`` near vectors at most, and ``grp, block, pivot, reach`` of the groups of several blocks: each block's pivot and the angle of its cell's farthest vector.

    The pivots of a group, one for each ``block_rows`` vectors and at most
    ``MAX_PIVOTS``, are vectors far from each other out of a sample by the hash
    of the id of about four for each pivot and 60 more; every vector goes to the
    nearest pivot, and what a pivot has beyond a block is split by hash.
    """
    spark, whole = vectors.sparkSession, vectors
    sizes = whole.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).withColumn("parts", F.ceil(F.col("n") / block_rows).cast("int"))
    sizes = F.broadcast(cut(sizes.withColumn("wanted", F.least("parts", F.lit(MAX_PIVOTS)))))
    uniform = F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53)
    some = whole.join(sizes, "grp").where(uniform * F.col("n") <= 4 * F.col("wanted") + 60)
    pivots = cut(some.groupBy("grp").applyInPandas(_pivots, "g string, pivot long, vec array<double>, parts int").select("g", "pivot", "vec"))
    centres: dict[str, list] = {}
    for r in pivots.orderBy("g", "pivot").toLocalIterator():
        centres.setdefault(r.g, []).append(np.array(r.vec))
    shared = spark.sparkContext.broadcast({g: unit_matrix(pd.Series(v)) for g, v in centres.items()})
    assigned = whole.mapInPandas(_assign(shared), "grp string, id long, vec array<double>, cell long, angle double")
    cells = assigned.join(sizes.select("grp"), "grp", "left_semi").groupBy("grp", "cell").agg(F.ceil(F.count("*") / block_rows).alias("parts"), F.max("angle").alias("reach"))
    cells = F.broadcast(cut(cells))
    number = lambda part: F.col("cell") * (1 << 20) + part
    split = assigned.join(cells.select("grp", "cell", "parts"), ["grp", "cell"], "left")
    blocks = split.withColumn("block", number(F.pmod(F.xxhash64("id", F.lit(2)), F.coalesce("parts", F.lit(1)))))
    middle = pivots.select(F.col("g").alias("grp"), F.col("pivot").alias("cell"), F.col("vec").alias("pivot"))
    directory = middle.join(cells, ["grp", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return blocks.select("grp", "id", "vec", "block"), directory.select("grp", number(F.col("part")).alias("block"), "pivot", "reach")


def _may_hold(x: np.ndarray, bound: np.ndarray, pivots: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Whether a block can hold a vector as near as the bound of each of ``x``, by the angles between it, the block's pivot and its farthest vector."""
    away = _angle(x @ pivots.T) - reach[None, :]
    return away <= np.where(bound > -1, _angle(bound), 4.0)[:, None] + 1e-7


class Best:
    """The k best vectors of each query so far, with the cosine that a better one must reach."""

    def __init__(self, k: int, x: np.ndarray, ids: np.ndarray, bound: np.ndarray):
        self.k, self.x, self.ids, self.bound = k, x, ids, bound.copy()
        self.narrow = x.astype(np.float32)
        self.near, self.cosines = [np.zeros(0, np.int64)] * len(x), [np.zeros(0)] * len(x)

    def meet(self, asking: np.ndarray, held: np.ndarray, held_ids: np.ndarray) -> None:
        """Compares the queries ``asking`` with all of ``held``: in single precision first, and what can reach a bound exactly."""
        narrow = np.ascontiguousarray(held.astype(np.float32).T)
        for low in range(0, len(asking), SLAB[0]):
            rows = asking[low : low + SLAB[0]]
            for left in range(0, len(held), SLAB[1]):
                rough = self.narrow[rows] @ narrow[:, left : left + SLAB[1]]
                self._take(rows, rough, held[left : left + SLAB[1]], held_ids[left : left + SLAB[1]])

    def _take(self, rows: np.ndarray, rough: np.ndarray, held: np.ndarray, held_ids: np.ndarray) -> None:
        least = self.bound[rows]
        free = np.flatnonzero(least <= -1)
        if len(free) and len(held) > self.k + 1:  # without a bound the best k + 1 of these, one of which may be the query
            least[free] = np.partition(rough[free], len(held) - self.k - 1, axis=1)[:, len(held) - self.k - 1]
        q, h = np.divmod(np.flatnonzero(rough >= (least - 1e-5).astype(np.float32)[:, None]), len(held))
        if not len(q):
            return
        exact = np.round(np.einsum("ij,ij->i", self.x[rows[q]], held[h]), 12)
        ok = (exact >= self.bound[rows[q]]) & (held_ids[h] != self.ids[rows[q]])
        q, h, exact = q[ok], h[ok], exact[ok]
        edges = np.flatnonzero(np.diff(q, prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:], strict=False):
            r = rows[q[a]]
            ids, cosines = np.concatenate([self.near[r], held_ids[h[a:b]]]), np.concatenate([self.cosines[r], exact[a:b]])
            order = np.lexsort((ids, -cosines))[: self.k]
            self.near[r], self.cosines[r] = ids[order], cosines[order]
            if len(order) == self.k:
                self.bound[r] = max(self.bound[r], cosines[order[-1]])


def _search_own(k: int, floor: float = -2.0, visits: bool = False):
    def run(key, part: pd.DataFrame, directory: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame(columns=["grp", "no", "id", "vec", "near", "cosines", "bound", "visits"], dtype=object)
        x, ids = unit_matrix(part["vec"]), part["id"].to_numpy()
        best = Best(k, x, ids, np.full(len(x), floor))
        if floor <= -1:
            found = SortedProjections(x).nearest(x, ids, ids, k)
            best.near, best.cosines = [ids[o] for o, _ in found], [c for _, c in found]
            best.bound = np.array([c[-1] if len(c) == k else floor for _, c in found])
        else:  # little reaches the floor, and the product finds all of it
            best.meet(np.arange(len(x)), x, ids)
        other = directory["other"].to_numpy()
        out = pd.DataFrame({
            "grp": key[0], "no": directory["no"].iloc[0] if len(other) else -1, "id": ids, "vec": part["vec"].to_numpy(),
            "near": best.near, "cosines": best.cosines, "bound": best.bound, "visits": None,
        })
        if visits and len(other):
            visit = _may_hold(x, best.bound, unit_matrix(directory["pivot"]), directory["reach"].to_numpy()) & (other != key[1])[None, :]
            out["visits"] = [other[v] for v in visit]
        return out

    return run


class _Files:
    """Blocks in the shared folder, read by number."""

    def __init__(self, folder: str):
        self.system, self.path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")

    def read(self, no: int, columns: list[str]) -> pa.Table:
        files = [f for f in self.system.get_file_info(pafs.FileSelector(f"{self.path}/no={no}")) if f.path.endswith(".parquet")]
        return pa.concat_tables([pq.read_table(f.path, columns=columns, filesystem=self.system, partitioning=None) for f in files])

    @staticmethod
    def unit(table: pa.Table) -> np.ndarray:
        vec = table["vec"].combine_chunks()
        x = vec.flatten().to_numpy().reshape(len(vec), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def _search_blocks(k: int, floor: float, folder: str):
    """For each block, given with its group's directory, the best of its vectors' own block and of all others that can hold better ones.

    Each of the others is read from its file and compared by a product in single
    precision; what reaches the bound of a query is computed exactly.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = _Files(folder)
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield _search_block(k, floor, files, row.no, np.array(row.others), unit_matrix(pd.Series(row.pivots)), np.array(row.reaches))

    return run


def _search_block(k: int, floor: float, files: _Files, no: int, others: np.ndarray, pivots: np.ndarray, reach: np.ndarray) -> pd.DataFrame:
    own = files.read(no, ["grp", "id", "vec", "near", "cosines", "bound"])
    x, ids = files.unit(own), own["id"].to_numpy()
    best = Best(k, x, ids, own["bound"].to_numpy())
    best.near = [np.array(v, np.int64) for v in own["near"].to_pylist()]
    best.cosines = [np.array(v, float) for v in own["cosines"].to_pylist()]
    # the nearest pivots first, so that bounds rise early
    for at in np.argsort(-(pivots @ x.mean(0))):
        if others[at] == no:
            continue
        asking = np.flatnonzero(_may_hold(x, best.bound, pivots[at : at + 1], reach[at : at + 1])[:, 0])
        if not len(asking):
            continue
        table = files.read(int(others[at]), ["id", "vec"])
        best.meet(asking, files.unit(table), table["id"].to_numpy())
    return pd.DataFrame({"grp": own["grp"].to_pandas(), "id": ids, "near": best.near, "cosines": best.cosines})


def _search_other(k: int):
    def run(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame(columns=["grp", "id", "neighbour", "cosine"], dtype=object)
        ids, query_ids = held["id"].to_numpy(), asked["id"].to_numpy()
        found = SortedProjections(unit_matrix(held["vec"])).nearest(unit_matrix(asked["vec"]), query_ids, ids, k, asked["bound"].to_numpy())
        at = np.repeat(np.arange(len(found)), [len(o) for o, _ in found])
        return pd.DataFrame({"grp": key[0], "id": query_ids[at], "neighbour": ids[np.concatenate([o for o, _ in found])], "cosine": np.concatenate([c for _, c in found])})

    return run


def _spread(df: DataFrame, n: int, *keys: str):
    """Groups over partitions of their own: a task's work is far larger than its bytes, and the adaptive planner leaves a stated number alone."""
    return df.repartition(int(min(max(2 * n, 1), 20_000)), *keys).groupBy(*keys)


_OWN = "grp string, no long, id long, vec array<double>, near array<long>, cosines array<double>, bound double"


def _within_blocks(vectors: DataFrame, k: int, block_rows: int, floor: float = -2.0, visits: bool = False) -> tuple[DataFrame, DataFrame]:
    """The search of each block in itself, with the block's number, -1 where a group is one block; the numbered directory."""
    blocks, directory = near_blocks(vectors, block_rows)
    known = cut(directory.withColumn("no", F.row_number().over(Window.orderBy("grp", "block")).cast("long")))
    copies = known.select(F.col("grp").alias("g"), F.col("block").alias("other"), "pivot", "reach")
    copies = known.select(F.col("grp").alias("kg"), F.col("block").alias("kb"), "no").join(copies, F.col("kg") == F.col("g")).drop("g")
    n_tasks = known.count() + max(1, vectors.select("grp").distinct().count() // 8)
    own = _spread(blocks, n_tasks, "grp", "block").cogroup(_spread(copies, n_tasks, "kg", "kb")).applyInPandas(_search_own(k, floor, visits), f"{_OWN}, visits array<long>")
    return own if visits else own.drop("visits"), known


def _beyond_copies(whole: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """The vectors to search, and ``grp, id, neighbour, cosine, place`` of the others.

    Of equal vectors only the first k + 1 by id can be among anyone's k nearest;
    the nearest of any further copy are the first k. Copies are ranked in shares,
    so that no task sorts all of them.
    """
    copy = [F.xxhash64("vec").alias("h"), F.xxhash64("vec", F.lit(1)).alias("h1")]
    slim = whole.select("grp", "id", *copy)
    many = slim.groupBy("grp", "h", "h1").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).drop("n")
    if many.isEmpty():
        return whole, None
    keys = ["grp", "h", "h1"]
    rows = cut(slim.join(many, keys))
    share = Window.partitionBy(*keys, F.pmod(F.xxhash64("id"), F.lit(256))).orderBy("id")
    first = rows.withColumn("p", F.row_number().over(share)).where(F.col("p") <= k + 1)
    first = cut(first.withColumn("p", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("p") <= k + 1))
    further = rows.join(first.select("grp", "id"), ["grp", "id"], "left_anti")
    nearest = first.where(F.col("p") <= k).groupBy(*keys).agg(F.array_sort(F.collect_list("id")).alias("near"))
    answers = further.join(nearest, keys).select("grp", "id", F.posexplode("near").alias("at", "neighbour"))
    answers = answers.select("grp", "id", "neighbour", F.lit(1.0).alias("cosine"), (F.col("at") + 1).alias("place"))
    return whole.join(further.select("grp", "id"), ["grp", "id"], "left_anti"), answers


def block_meetings(vectors: DataFrame, k: int = 10, block_rows: int = 10_000) -> tuple[DataFrame, int]:
    """``grp, no, visited``: the pairs of blocks of which vectors meet, by the number of the one and the name of the other, and the number of blocks."""
    own, known = _within_blocks(vectors, k, block_rows, visits=True)
    return own.select("grp", "no", F.explode("visits").alias("visited")).distinct(), known.count()


def most_similar(vectors: DataFrame, k: int = 10, block_rows: int = 10_000, floor: float = -2.0) -> DataFrame:
    """``grp, id, neighbour, cosine, place``: for every vector its k most similar others of the same group, those of a cosine of ``floor`` or more.

    ``vectors`` has ``grp, id, vec`` with usable vectors and distinct ids within
    a group (see ``usable_vectors``). Equal cosines rank by the smaller id; a
    group of fewer than k + 1 vectors gives all others; a single vector and an
    empty table give no rows. Scale and length of the vectors do not matter.
    Equal vectors are searched once for the first k + 1 of them, so that a group
    of copies of any size costs no more than its rows. Each task also holds the pivots of its group's blocks, some hundred bytes
    for every ``block_rows`` vectors.

    The vectors are written twice: as they come, and by blocks with their best in
    their own block. The blocks that a block has to visit are read from there, so
    that disk grows with the vectors, however many blocks meet.
    """
    spark = vectors.sparkSession
    folder = SharedFolder(spark)
    with shuffles_removed(spark):
        kept, answers = _beyond_copies(cut(vectors.select("grp", "id", "vec")), k)
        own, known = _within_blocks(kept, k, block_rows, floor)
        folder.write(own, "no")
        done = spark.read.schema(_OWN).parquet(folder.path)
        found = done.where("no < 0").select("grp", "id", "near", "cosines")
        n_blocks = known.count()
        if n_blocks:
            others = known.groupBy("grp").agg(F.collect_list(F.struct("no", "pivot", "reach")).alias("x"))
            asking = known.select("grp", "no").join(others, "grp").select("no", F.col("x.no").alias("others"), F.col("x.pivot").alias("pivots"), F.col("x.reach").alias("reaches"))
            asking = asking.repartition(min(n_blocks, 20_000), F.rand(1))
            found = found.unionByName(asking.mapInPandas(_search_blocks(k, floor, folder.path), "grp string, id long, near array<long>, cosines array<double>"))
        best = cut(found.where(F.size("near") > 0))
    folder.remove()
    placed = best.select("grp", "id", F.posexplode(F.arrays_zip("near", "cosines")).alias("place", "b")).select("grp", "id", F.col("b.near").alias("neighbour"), F.col("b.cosines").alias("cosine"), (F.col("place") + 1).alias("place"))
    return placed if answers is None else placed.unionByName(answers)


def _exact(k: int):
    def run(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame(columns=["grp", "id", "neighbour", "cosine"], dtype=object)
        ids, block = held["id"].to_numpy(), SortedProjections(unit_matrix(held["vec"]))
        every = np.arange(len(ids))
        found = [block.best(q, i, ids, every, k, -2.0) for q, i in zip(unit_matrix(asked["vec"]), asked["id"].to_numpy(), strict=True)]
        at = np.repeat(np.arange(len(found)), [len(o) for o, _ in found])
        return pd.DataFrame({"grp": key[0], "id": asked["id"].to_numpy()[at], "neighbour": ids[np.concatenate([o for o, _ in found])], "cosine": np.concatenate([c for _, c in found])})

    return run


def exact_nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, block_rows: int = 10_000) -> DataFrame:
    """``grp, id, neighbour, cosine, place``: the same by comparison with every vector of the group, for a stated set of queries.

    The vectors are read in blocks, which each query meets; ``queries`` has the
    same columns and should be a small share of them.
    """
    sizes = vectors.groupBy("grp").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    held = vectors.join(sizes, "grp").select(F.col("grp").alias("hg"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("hb"), F.col("id").alias("id"), F.col("vec").alias("vec"))
    asked = queries.join(sizes, "grp").select(F.col("grp").alias("g"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.col("id").alias("id"), F.col("vec").alias("vec"))
    found = asked.groupBy("g", "b").cogroup(held.groupBy("hg", "hb")).applyInPandas(_exact(k), "grp string, id long, neighbour long, cosine double")
    best = found.groupBy("grp", "id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("away"), "neighbour"))), 1, k).alias("best"))
    return best.select("grp", "id", F.posexplode("best").alias("place", "b")).select("grp", "id", F.col("b.neighbour").alias("neighbour"), (-F.col("b.away")).alias("cosine"), (F.col("place") + 1).alias("place"))
