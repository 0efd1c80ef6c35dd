"""AUROC over many weighted resamples of a table, of which only sums by range of scores are shuffled.

A row's weight in a resample comes from the md5 of its id and the resample's
number, as in SQL. The digests are formed for many rows and resamples of equally
long texts at once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Digests that are formed at once, and resamples whose sums are held and shuffled together.
ROWS, SLAB = 32_768, 100
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Of a message of one block.
MOST_BYTES = 55


def _first_words(messages: np.ndarray) -> np.ndarray:
    """First 32 bits, as in the hexadecimal digest, of the md5 of each row of bytes."""
    n, size = messages.shape
    last = np.frombuffer(b"\x80" + bytes(MOST_BYTES - size) + (8 * size).to_bytes(8, "little"), np.uint8)
    own = -(-(size + 1) // 4)  # words that differ between rows
    front = np.zeros((n, 4 * own), np.uint8)
    front[:, :size] = messages
    front[:, size:] = last[: 4 * own - size]
    words: list = list(np.ascontiguousarray(front.view("<u4").T)) + np.frombuffer(last[4 * own - size :].tobytes(), "<u4").tolist()
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the word of step 60 ends as the first
        kind = i >> 4
        if kind == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            at = i
        elif kind == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            at = (5 * i + 1) & 15
        elif kind == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            at = (3 * i + 5) & 15
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            at = (7 * i) & 15
        np.add(f, a, out=f)
        word = words[at]
        if isinstance(word, int):
            np.add(f, np.uint32((_K[i] + word) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, word, out=f), np.add(f, np.uint32(_K[i]), out=f)
        s = _SHIFTS[kind][i & 3]
        np.left_shift(f, np.uint32(s), out=g), np.right_shift(f, np.uint32(32 - s), out=f), np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)  # the new second word takes the place of the first
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_START[0])).byteswap()


def _limits() -> list[int]:
    """The least 32-bit numbers of 1, 2, ... 8 copies: where ``(number + 0.5) / 2**32`` reaches the Poisson sums."""
    out, total, term = [], 0.0, math.exp(-1)
    for i in range(8):
        total += term
        at = max(0, int(total * 2**32) - 2)
        while at < 2**32 and (at + 0.5) / 4294967296.0 < total:
            at += 1
        out.append(at)
        term /= i + 1
    return [v for v in out if v < 2**32]


_LIMITS = _limits()


def weights(heads: list[bytes], resamples: range) -> np.ndarray:
    """Copies of each row in each resample; ``heads`` are what precedes the resample's number."""
    out = np.zeros((len(resamples), len(heads)), np.uint8)
    size = np.fromiter(map(len, heads), np.int64, len(heads))
    tails = [str(r).encode() for r in resamples]
    width = np.array([len(t) for t in tails])
    for length in np.unique(size):
        of_length = np.flatnonzero(size == length)
        for low in range(0, len(of_length), ROWS):
            rows = of_length[low : low + ROWS]
            head = np.frombuffer(b"".join([heads[i] for i in rows]), np.uint8).reshape(len(rows), length)
            for digits in np.unique(width):
                alike = np.flatnonzero(width == digits)
                for first in range(0, len(alike), step := max(1, ROWS // len(rows))):
                    at = alike[first : first + step]
                    tail = np.frombuffer(b"".join([tails[j] for j in at]), np.uint8).reshape(len(at), digits)
                    both = np.concatenate([np.tile(head, (len(at), 1)), np.repeat(tail, len(rows), axis=0)], axis=1)
                    if length + digits <= MOST_BYTES:
                        u = _first_words(both)
                    else:
                        u = np.fromiter((int.from_bytes(hashlib.md5(m.tobytes()).digest()[:4], "big") for m in both), np.uint32, len(both))
                    copies = (u >= np.uint32(_LIMITS[0])).view(np.uint8)
                    for limit in _LIMITS[1:]:
                        copies += (u >= np.uint32(limit)).view(np.uint8)
                    out[np.ix_(at, rows)] = copies.reshape(len(at), len(rows))
    return out


def _same(a: float, b: float) -> bool:
    return a == b or (a != a and b != b)


class _Part:
    """Sums over an ordered run of rows: those of its first score, of its last, and of the scores between."""

    def __init__(self, resamples: int):
        self.singles: list[tuple[float, np.ndarray, np.ndarray]] = []
        self.zero = np.zeros(resamples)
        self.between: tuple | None = None

    def add(self, score: float, n: np.ndarray, p: np.ndarray) -> None:
        """Counts of one score, not below those before."""
        if self.singles and _same(self.singles[-1][0], score):
            self.singles[-1] = score, self.singles[-1][1] + n, self.singles[-1][2] + p
            return
        if len(self.singles) == 2:
            s, n0, p0 = self.singles.pop()
            low, n1, p1, ranks = self.between or (s, self.zero, self.zero, self.zero)
            self.between = low, n1 + n0, p1 + p0, ranks + (n1 + (n0 + 1) / 2) * p0
        self.singles.append((score, n, p))


def _sums(resamples: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slabs = [range(low, min(low + SLAB, resamples)) for low in range(0, resamples, SLAB)]
        parts = [_Part(len(slab)) for slab in slabs]
        for frame in frames:
            heads = [b"" if i is None else i.encode() + b"-" for i in frame["id"]]
            score, y = frame["s"].to_numpy(), frame["y"].to_numpy()
            first = np.flatnonzero(np.append(True, ~((score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1])))))
            for slab, part in zip(slabs, parts, strict=True):
                w = weights(heads, slab)
                n = np.add.reduceat(w, first, axis=1, dtype=float).T
                p = np.add.reduceat(w * y[None, :], first, axis=1, dtype=float).T
                for s, a, b in zip(score[first].tolist(), n, p, strict=True):
                    part.add(s, a, b)
        for i, part in enumerate(parts):
            rows = [(i, s, n.tobytes(), p.tobytes(), ((n + 1) / 2 * p).tobytes(), True) for s, n, p in part.singles]
            if part.between:
                s, *sums = part.between
                rows.append((i, s, *[v.tobytes() for v in sums], False))
            if rows:
                yield pd.DataFrame(rows, columns=["slab", "s", "n", "p", "ranks", "single"])

    return run


def _joined(key, part: pd.DataFrame) -> pd.DataFrame:
    """AUROC of the resamples of a slab, from the sums of all parts in order."""
    part = part.sort_values("s", na_position="last", kind="stable")
    read = lambda raw: np.frombuffer(raw, float)
    merged: list[list] = []
    for s, n, p, ranks, single in part[["s", "n", "p", "ranks", "single"]].itertuples(index=False):
        n, p, ranks = read(n), read(p), read(ranks)
        if single and merged and merged[-1][4] and _same(merged[-1][0], s):
            n, p = merged[-1][1] + n, merged[-1][2] + p
            merged[-1] = [s, n, p, (n + 1) / 2 * p, True]
        else:
            merged.append([s, n, p, ranks, single])
    below = rank_sum = n_pos = np.zeros(len(merged[0][1]))
    for _, n, p, ranks, _ in merged:
        rank_sum = rank_sum + below * p + ranks
        below, n_pos = below + n, n_pos + p
    with np.errstate(divide="ignore", invalid="ignore"):
        area = (rank_sum - n_pos * (n_pos + 1) / 2) / (n_pos * (below - n_pos))
    some = n_pos * (below - n_pos) != 0
    return pd.DataFrame({"resample": key[0] * SLAB + np.flatnonzero(some), "auroc": area[some]})


def resampled_auroc(rows: DataFrame, score: str, y: str, resamples: int) -> DataFrame:
    """``resample, auroc`` over Poisson resamples of rows with an ``id``, by midranks; those of a single class are left out.

    Rows are divided by ranges of the score and read in its order. A task sends
    on three sums a resample, so that what is shuffled does not grow with the
    rows; a score that lies in several tasks is added up at the end.
    """
    stated = rows.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    stated = stated.select(F.col("id").cast("string").alias("id"), (F.col(score).cast("double") + F.lit(0.0)).alias("s"), F.col(y).cast("double").alias("y"))
    # a row's work is that of all resamples, whatever few files the rows lie in
    n = max(2 * rows.sparkSession.sparkContext.defaultParallelism, stated.count() // 100_000)
    ordered = stated.repartitionByRange(min(n, 20_000), "s", "id").sortWithinPartitions("s")
    sums = ordered.mapInPandas(_sums(resamples), "slab int, s double, n binary, p binary, ranks binary, single boolean")
    return sums.groupBy("slab").applyInPandas(_joined, "resample long, auroc double")
