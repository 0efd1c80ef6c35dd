"""Evaluation texts leaking into training text, by latent semantic retrieval.

Words are compared by a skeleton that wrong encodings, case, punctuation,
markup and common misreadings leave alone. Passages of the corpus are rows of a
TF-IDF matrix over the words of the evaluation texts; a randomised SVD, whose
products are formed in the map tasks and added by Spark, gives its latent space.
Passages near a passage of an item in that space are candidates; a local
longest-common-subsequence alignment decides. A word weighs by its rarity in the
distinct texts of the corpus or in the distinct items, whichever is higher, so
that a passage of which there are many copies weighs no less.

The evaluation texts are a stated query set of bounded size; the corpus is read
whole and never leaves the tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgauge.session import cut

#: Items, and characters of their texts, searched at once; more are searched in several passes. They bound what is broadcast:
#: some 200,000 words of a bit for each item and a row of the latent space, and a quarter as many passages, of 256 bytes
#: each, 115 MB at most.
MAX_ITEMS, MAX_CHARS = 2_000, 1_000_000
RANK = 64
WINDOW, STRIDE = 16, 4
#: Least share of a passage's squared weight on words of the items; below it no item passage can be near.
MIN_SHARE = 0.12
MIN_COSINE = 0.3
#: Words of items that a document must hold, and the score of an alignment that makes a case: above what 8 repeated
#: words reach, and not above 15 with 3 or 16 with 4 exchanged (10.5 and 10) and another word between.
MIN_SHARED, MIN_SCORE, GAP = 9, 9.5, 0.5
BLOCK, MARGIN = 32, 40
#: Regions of one or many documents that are aligned together.
ALIGNED = 2000
#: Cells of a product of passages and item passages that a task forms at once.
PRODUCT_CELLS = 8_000_000
#: Products of the map tasks are added in this many portions first, so that no task reads those of all.
PORTIONS = 64

_ENTITY = re.compile(r"&#?\w{2,8};?")
_TIME = re.compile(r"(?:(?:\A|\n)[ \t]*\d+[ \t]*\r?)?(?:\A|\n)[^\n]*-->[^\n]*")
_MARKUP = re.compile(r"<[^>\n]{1,80}>|\{[^}\n]{1,80}\}|\[[^\]\n]{0,120}\]|\([^)\n]{0,120}\)")
_SPEAKER = re.compile(r"(?m)^[-–♪ \t]*[A-Z][A-Z .'’]{1,24}:")


def _skeleton_table() -> bytes:
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    for seen, kept in ("0o", "1l", "il", "Il", "|l", "5s", "8b", "ec", "Ec"):
        table[ord(seen)] = ord(kept)
    return bytes(table)


_SKELETON = _skeleton_table()
_DROPPED = bytes(c for c in range(128) if not chr(c).isalnum() and chr(c) not in " \n\r\t|")


#: Letters of scripts other than Latin, and those written without spaces, of which each letter counts as a word.
_OTHER_SCRIPT = re.compile("[\u0370-\u1dff\u2c00-\u2dff\u2e80-\u2fff\u3005-\u3007\u3040-\ud7ff\uf900-\ufaff\ufb1d-\ufdff\ufe70-\ufefc\uff66-\uffdc\U00010000-\U0001efff\U00020000-\U0003ffff]")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
#: What the bytes 80 to 9f are read as, where they are read as Windows-1252.
_HIGH = "\x80-\xbf\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178"
_UTF8_MISREAD = re.compile(f"[\xcd-\xf0][{_HIGH}]{{1,3}}(?:[\xcd-\xf0][{_HIGH}]{{1,3}})*")
_CYRILLIC_MISREAD = re.compile("[\xa8\xb8\xc0-\xff]{3,}")
_CYRILLIC_LETTERS = re.compile("[\xa8\xb8\xc0-\xff]+")
#: Runs of accented letters, from which on a text counts as Cyrillic read as Latin.
MISREAD_WORDS = 8


def _as_utf8(match: re.Match) -> str:
    raw = b"".join(c.encode("cp1252") if ord(c) > 255 else c.encode("latin-1") for c in match.group())
    return raw.decode("utf-8", "replace")


def _repaired(text: str) -> str:
    """Letters of other scripts in place of those that a wrong encoding has made of them; Latin ones may stay as they are."""
    text = _UTF8_MISREAD.sub(_as_utf8, text)
    if len(_CYRILLIC_MISREAD.findall(text)) >= MISREAD_WORDS:
        text = _CYRILLIC_LETTERS.sub(lambda m: m.group().encode("latin-1").decode("cp1251", "replace"), text)
    return text


def _other_words(text: str) -> list[bytes]:
    """Words of a text in which other scripts occur; in these the letters count as they are, in lower case."""
    words: list[bytes] = []
    for word in _UNSPACED.sub(r" \g<0> ", text.lower()).split():
        if _OTHER_SCRIPT.search(word):
            words.append("".join(c for c in word if c.isalnum()).encode("utf-8", "replace"))
        else:
            words += _latin_words(word)
    return words


def skeleton_words(text: str) -> list[bytes]:
    """Words as skeletons: ASCII letters and digits, letters that are often misread for one another alike; accented letters are left out.

    Words of other scripts keep all their letters, after wrong encodings have been
    repaired; in scripts without spaces each letter is a word.
    """
    if "&" in text:
        text = _ENTITY.sub("", text)
    if "-->" in text:
        text = _TIME.sub("\n", text)
    if "<" in text or "{" in text or "[" in text or "(" in text:
        text = _MARKUP.sub(" ", text)
    if ":" in text:
        text = _SPEAKER.sub("", text)
    if not text.isascii():
        text = _repaired(text)
        if _OTHER_SCRIPT.search(text):
            return _other_words(text)
    return _latin_words(text)


def _latin_words(text: str) -> list[bytes]:
    return text.encode("ascii", "ignore").translate(_SKELETON, _DROPPED).replace(b"rn", b"m").replace(b"vv", b"w").split()


def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)


def _word_hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words as 64-bit hashes, for several passes over one reading of the texts."""
    known: dict[bytes, int] = {}
    for f in frames:
        if len(known) > 200_000:
            known.clear()
        rows = []
        for t in f["text"]:
            words = skeleton_words(t)
            for w in words:
                if w not in known:
                    known[w] = _hash(w)
            rows.append(np.array([known[w] for w in words], np.int64).tobytes())
        yield pd.DataFrame({"doc_id": f["doc_id"], "words": rows})


def _ids_of_hashes(vocabulary):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = np.array([_hash(w) for w in vocabulary.value], np.int64)
        order = np.argsort(hashes).astype(np.int32)
        hashes = hashes[order]
        for f in frames:
            rows = []
            for raw in f["words"]:
                words = np.frombuffer(raw, np.int64)
                at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
                rows.append(np.where(hashes[at] == words, order[at], -1).astype(np.int32).tobytes())
            yield pd.DataFrame({"doc_id": f["doc_id"], "words": rows})

    return run


def _word_ids(vocabulary):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = vocabulary.value.get
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "words": [np.array([get(w, -1) for w in skeleton_words(t)], np.int32).tobytes() for t in f["text"]]})

    return run


def _distinct(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each sequence of words once in a task."""
    seen: set[bytes] = set()
    for f in frames:
        digests = [hashlib.blake2b(w, digest_size=16).digest() for w in f["words"]]
        new = []
        for d in digests:
            new.append(d not in seen)
            seen.add(d)
        yield f.loc[np.array(new, bool), ["words"]]


def _document_frequency(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        parts = [np.unique(np.frombuffer(w, np.int32)) for w in f["words"]]
        counts = np.bincount(np.concatenate([np.zeros(0, np.int32), *parts]) + 1)
        counts[0] = len(f)  # word -1 counts the texts
        word = np.flatnonzero(counts)
        yield pd.DataFrame({"word": word - 1, "n": counts[word]})


def _passage_products(weights, basis):
    """Partial sums of A'A times the basis; the rows of A are passages of ``WINDOW`` words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, q = weights.value, basis.value
        total = np.zeros_like(q)
        for f in frames:
            words = [np.frombuffer(w, np.int32) for w in f["words"]]
            at, passage, base = [], [], 0
            for w in words:
                held = np.flatnonzero(w >= 0)
                at.append(w[held])
                passage.append(held // WINDOW + base)
                base += len(w) // WINDOW + 1
            word, row = np.concatenate([np.zeros(0, np.int32), *at]), np.concatenate([np.zeros(0, np.int64), *passage])
            for low in range(0, len(word), 100_000):
                high = min(low + 100_000, len(word))
                while high < len(word) and row[high] == row[high - 1]:
                    high += 1
                while low and low < high and row[low] == row[low - 1]:
                    low += 1
                if low == high:
                    continue
                w, r = word[low:high], row[low:high]
                first = np.flatnonzero(np.diff(r, prepend=-1))
                product = np.add.reduceat(q[w] * idf[w, None], first, axis=0)
                spread = np.repeat(product, np.diff(np.append(first, len(r))), axis=0) * idf[w, None]
                order = np.argsort(w, kind="stable")
                start = np.flatnonzero(np.diff(w[order], prepend=-1))
                total[w[order][start]] += np.add.reduceat(spread[order], start, axis=0)
        for low in range(0, len(total), 64):
            yield pd.DataFrame({"block": [low // 64], "portion": [TaskContext.get().partitionId() % PORTIONS], "product": [total[low : low + 64].tobytes()]})

    return run


def _sum_products(key, part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"block": [key[0]], "portion": [0], "product": [np.sum([np.frombuffer(p, np.float32) for p in part["product"]], axis=0, dtype=np.float64).astype(np.float32).tobytes()]})


def _multiply(words: DataFrame, weights, basis: np.ndarray) -> np.ndarray:
    shared = words.sparkSession.sparkContext.broadcast(np.ascontiguousarray(basis, np.float32))
    schema = "block int, portion int, product binary"
    parts = words.mapInPandas(_passage_products(weights, shared), schema).groupBy("block", "portion").applyInPandas(_sum_products, schema)
    rows = parts.groupBy("block").applyInPandas(_sum_products, schema).collect()
    blocks = {r.block: np.frombuffer(r.product, np.float32) for r in rows}
    shared.unpersist()
    if not blocks:
        return np.zeros_like(basis)
    return np.concatenate([blocks[i] for i in sorted(blocks)]).reshape(basis.shape).astype(float)


def latent_space(words: DataFrame, weights, n_words: int, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """Right singular vectors (words x rank) of the passages, by a randomised range finder of two passes."""
    rng = np.random.default_rng(seed)
    sample = rng.standard_normal((n_words, min(rank + 8, n_words)))
    basis = np.linalg.qr(_multiply(words, weights, sample))[0]
    projected = basis.T @ _multiply(words, weights, basis)
    values, vectors = np.linalg.eigh((projected + projected.T) / 2)
    return basis @ vectors[:, np.argsort(-values)[:rank]]


def _windows(words: np.ndarray, size: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    last = max(0, len(words) - size)
    return np.unique(np.append(np.arange(0, last + 1, stride), last))


def _latent(words: np.ndarray, starts: np.ndarray, idf: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Unit vectors of the windows in the latent space."""
    inside = np.maximum(words, 0)
    rows = space[inside] * np.where(words >= 0, idf[inside], 0)[:, None]
    sums = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)])
    u = sums[np.minimum(starts + WINDOW, len(words))] - sums[starts]
    return u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)


def align(regions: list[np.ndarray], items: list[np.ndarray], gap: float = GAP) -> np.ndarray:
    """Best local common subsequence of each region and item: matched words less ``gap`` for each word passed over."""
    n = len(regions)
    a = np.full((n, max(map(len, regions))), -1, np.int32)
    b = np.full((n, max(map(len, items))), -2, np.int32)
    for i, (r, t) in enumerate(zip(regions, items, strict=True)):
        a[i, : len(r)], b[i, : len(t)] = r, t
    a[a < 0] = -1
    row, best = np.zeros((n, b.shape[1] + 1), np.float32), np.zeros(n, np.float32)
    ramp = (np.arange(b.shape[1] + 1) * gap).astype(np.float32)
    for j in range(a.shape[1]):
        step = np.where(b == a[:, j : j + 1], np.float32(1), np.float32(-gap))
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(0, np.maximum(row[:, :-1] + step, row[:, 1:] - gap))
        row = np.maximum.accumulate(new + ramp, axis=1) - ramp
        best = np.maximum(best, row.max(axis=1))
    return best


def _bound(shared: np.ndarray) -> np.ndarray:
    """What no alignment with any order of the item's words can exceed: the best run of shared words, less the gaps."""
    sums = np.cumsum(np.where(shared, np.float32(1), np.float32(-GAP)), axis=1)
    sums = np.concatenate([np.zeros((len(sums), 1), np.float32), sums], axis=1)
    return (sums - np.minimum.accumulate(sums, axis=1)).max(axis=1)


class Searcher:
    """The items' passages in the latent space, for the tasks."""

    def __init__(self, items: list[np.ndarray], idf: np.ndarray, space: np.ndarray):
        self.items, self.idf, self.space = items, idf, space.astype(np.float32)
        starts = [_windows(w) for w in items]
        self.owner = np.repeat(np.arange(len(items)), [len(s) for s in starts])
        self.latent = np.concatenate([_latent(w, s, idf, self.space) for w, s in zip(items, starts, strict=True)]).astype(np.float32)
        self.foreign = float(np.median(idf)) ** 2
        self.held = np.zeros((len(idf) + 1, -(-len(items) // 8)), np.uint8)  # a bit for each word and item; the last word is any other
        for i, w in enumerate(items):
            self.held[np.unique(w), i >> 3] |= np.uint8(1 << (i & 7))

    def candidates(self, words: np.ndarray) -> set[tuple[int, int]]:
        """``(item, block of words)`` with a passage near one of the item's."""
        starts = _windows(words)
        inside = np.maximum(words, 0)
        weight = np.where(words >= 0, self.idf[inside] ** 2, 0)
        sums = np.cumsum(np.stack([weight, np.where(words >= 0, 0, self.foreign)], axis=1), axis=0)
        sums = np.concatenate([np.zeros((1, 2)), sums])
        both = sums[np.minimum(starts + WINDOW, len(words))] - sums[starts]
        starts = starts[both[:, 0] >= MIN_SHARE * both.sum(axis=1)]
        found: set[tuple[int, int]] = set()
        step = max(8, min(500, PRODUCT_CELLS // max(1, len(self.latent))))
        for low in range(0, len(starts), step):
            part = starts[low : low + step]
            around = words[part[0] : part[-1] + WINDOW]
            near, window = np.divmod(np.flatnonzero(_latent(around, part - part[0], self.idf, self.space).astype(np.float32) @ self.latent.T >= MIN_COSINE), len(self.latent))
            found |= set(zip(self.owner[window].tolist(), (part[near] // BLOCK).tolist(), strict=True))
        return found

    def pairs(self, words: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Item positions with the regions that can reach the score."""
        pairs: list[tuple[int, np.ndarray]] = []
        by_block: dict[int, list[int]] = {}
        for item, block in self.candidates(words):
            by_block.setdefault(block, []).append(item)
        for block, items in by_block.items():
            region = words[max(0, block * BLOCK - MARGIN) : block * BLOCK + BLOCK + WINDOW + MARGIN]
            at = np.array(items)
            shared = ((self.held[region][:, at >> 3] >> (at & 7).astype(np.uint8)) & 1).T
            enough = _bound(shared) >= MIN_SCORE
            pairs += [(i, region) for i, ok in zip(items, enough, strict=True) if ok]
        return pairs

    def best(self, found: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, float]]:
        """``document, item, score`` of the best region of each, from ``document, item, region`` of many documents, aligned together."""
        best: dict[tuple[int, int], float] = {}
        for low in range(0, len(found), ALIGNED):
            part = found[low : low + ALIGNED]
            for (doc, item, _), score in zip(part, align([r for _, _, r in part], [self.items[i] for _, i, _ in part]), strict=True):
                if score >= MIN_SCORE:
                    best[doc, item] = max(best.get((doc, item), 0.0), float(score))
        return [(doc, item, score) for (doc, item), score in best.items()]

    def leaks(self, words: np.ndarray) -> dict[int, float]:
        """Item positions with the score of their best region."""
        return {item: score for _, item, score in self.best([(0, item, region) for item, region in self.pairs(words)])}


def _search(searcher):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = searcher.value
        for f in frames:
            rows: list[tuple[int, int, float]] = []
            waiting: list[tuple[int, int, np.ndarray]] = []
            for at, raw in enumerate(f["words"]):
                words = np.frombuffer(raw, np.int32)
                if (words >= 0).sum() >= MIN_SHARED:
                    waiting += [(at, item, region) for item, region in s.pairs(words)]
                if len(waiting) >= ALIGNED:  # all regions of a document are aligned at once
                    rows += s.best(waiting)
                    waiting = []
            rows += s.best(waiting)
            if rows:
                doc = f["doc_id"].to_numpy()
                rows = [(doc[at], item, score) for at, item, score in rows]
                yield pd.DataFrame(rows, columns=["doc_id", "pos", "score"])

    return run


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, doc_id, score``: documents that repeat a passage of an item.

    ``documents`` has ``doc_id, text``, ``items`` has ``item_id, text``. Null and
    empty texts hold nothing; texts of any length are read whole; items of fewer
    words than a case needs are never found; items that share a passage and
    repeated documents are each reported. Texts of any script count, in scripts
    without spaces by the letter. Empty tables give no rows.
    """
    spark = documents.sparkSession
    stated = items.where("text is not null and item_id is not null").select("item_id", "text")
    n_items, n_chars = stated.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    passes = max(1, -(-n_items // MAX_ITEMS), -(-n_chars // MAX_CHARS))
    texts = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    if passes > 1:  # the texts are read once
        texts = cut(texts.mapInPandas(_word_hashes, "doc_id long, words binary"))
    found = None
    for i in range(passes):
        rows = stated.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i).orderBy("item_id").collect()
        part = _one_pass(spark, texts, rows)
        found = part if found is None else found.unionByName(part)
    return found


def _one_pass(spark, texts: DataFrame, rows: list) -> DataFrame:
    empty = spark.createDataFrame([], "item_id long, doc_id long, score double")
    vocabulary: dict[bytes, int] = {}
    stated = [[vocabulary.setdefault(w, len(vocabulary)) for w in skeleton_words(r.text)] for r in rows]
    kept = [(r.item_id, np.array(t, np.int32)) for r, t in zip(rows, stated, strict=True) if len(t) >= MIN_SHARED]
    if not kept:
        return empty
    shared_vocabulary = spark.sparkContext.broadcast(vocabulary)
    to_ids = _word_ids if "text" in texts.columns else _ids_of_hashes
    words = cut(texts.mapInPandas(to_ids(shared_vocabulary), "doc_id long, words binary"))
    once = words.mapInPandas(_distinct, "words binary").repartition(F.xxhash64("words")).mapInPandas(_distinct, "words binary")
    frequency = np.zeros(len(vocabulary) + 1)  # the last is the number of texts
    for r in once.mapInPandas(_document_frequency, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        frequency[r.word] = r.n
    passages = {tuple(t.tolist()) for _, t in kept}
    held = np.bincount(np.concatenate([np.unique(t) for t in passages]), minlength=len(vocabulary))
    idf = np.maximum(np.log(1 + frequency[-1] / (1 + frequency[:-1])), np.log(1 + len(passages) / (1 + held)))
    weights = spark.sparkContext.broadcast(idf.astype(np.float32))
    space = latent_space(words, weights, len(vocabulary))
    searcher = spark.sparkContext.broadcast(Searcher([t for _, t in kept], idf, space))
    found = words.mapInPandas(_search(searcher), "doc_id long, pos int, score double")
    ids = spark.createDataFrame([(i, int(item)) for i, (item, _) in enumerate(kept)], "pos int, item_id long")
    return found.join(F.broadcast(ids), "pos").select("item_id", "doc_id", "score")
