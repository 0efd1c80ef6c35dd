"""Training-data operators against brute force on small fixtures."""

import math
import re
from datetime import datetime as t
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vecgauge.llm import collision_knn, cut_text, leak_search, packing, quantile_sketch as qs, similarity_clusters as sc
from vecgauge.llm.term_frequency import mark_terms, plan_prefixes, radix_partitions, split_plan, term_frequency
from vecgauge.llm.vector_blocks import usable_vectors
from vecgauge.sources.tables import normal_form

# --- 1: terms


@pytest.mark.parametrize("partition_bytes", [800, 20_000, None])
def test_terms_against_brute_force(spark, partition_bytes):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 20)), t(2020, 1, int(rng.integers(1, 28))) if rng.random() > 0.1 else None, "HOT" if rng.random() < 0.4 else f" c{rng.integers(0, 30)}\t") for _ in range(600)]
    rows += [(None, None, "HOT"), (1, None, None), (1, None, " \t"), (2, t(2020, 1, 1), "x" * 5000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "person_id long, time timestamp_ntz, code string, holder string, term int")
    got = {r.term: (r.n_events, r.n_holders) for r in term_frequency(df, normal_form(F.col("code")), F.col("person_id"), [F.col("time")], partition_bytes).collect()}
    events = {(p, w, c.strip(" \t").upper()) for p, w, c in rows if p is not None and c and c.strip(" \t")}
    want = {c: (sum(e[2] == c for e in events), len({e[0] for e in events if e[2] == c})) for c in {e[2] for e in events}}
    assert got == want


def test_terms_of_nothing_and_marks(spark):
    empty = spark.createDataFrame([], "person_id long, time timestamp_ntz, code string")
    assert term_frequency(empty, F.col("code"), F.col("person_id"), [F.col("time")]).count() == 0
    counts = spark.createDataFrame([("a", 9, 4), ("b", 9, 5), ("c", 99, 41)], "term string, n_events long, n_holders long")
    assert [r.mark for r in mark_terms(counts, 100).orderBy("term").collect()] == ["rare", None, "common"]


def test_prefixes_share_or_split_partitions():
    first, take, n = plan_prefixes({0: 10, 1: 10, 5: 95, 4000: 1000, 4095: 5}, 100)
    assert first[0] == first[1] and first[5] != first[0] and take[4000] == 4 and first[4095] == first[4000] + 16 and n == first[4095] + 1
    assert plan_prefixes({}, 100)[2] == 1
    plan, n = split_plan([(3, 1000, True, 20), (4, 350, False, 16), (5, 500, False, 64)], 100, 40)
    assert plan == [(3, 40, 0, 10), (4, 50, 2, 1), (5, 54, 0, 5)] and n == 59


def test_ordinary_terms_are_never_split_by_holder(spark):
    rows = [(i, f"c{i % 900}") for i in range(9000)] + [(i, "hot") for i in range(6000)]
    slim = spark.createDataFrame(rows, "holder string, term string").withColumns({"e1": F.lit(1), "e2": F.lit(2), "h": F.xxhash64("term"), "size": F.lit(30).cast("long")})
    placed, n, hot = radix_partitions(slim, 1500)
    by_term = {r.term: (r.parts, r.split) for r in placed.groupBy("term").agg(F.count_distinct("part").alias("parts"), F.max("split").alias("split")).collect()}
    assert hot and by_term.pop("hot") == (120, True) and set(by_term.values()) == {(1, False)} and len(by_term) == 900
    assert placed.groupBy("part").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] <= 3000 and n < 600
    # all hashes begin alike: the recursion goes as deep as it must
    deep = slim.where("term != 'hot'").withColumn("h", F.shiftrightunsigned("h", 30))
    placed, n, hot = radix_partitions(deep, 1500)
    assert not hot and placed.groupBy("part").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] <= 3000
    assert placed.groupBy("term").agg(F.count_distinct("part").alias("n")).agg(F.max("n")).first()[0] == 1


# --- 2: nearest vectors


def _vector_table(spark, x, ids=None, cells=None):
    n, d = x.shape
    pdf = pd.DataFrame(x, columns=[f"dim_{i}" for i in range(d)])
    pdf.insert(0, "person_id", np.arange(n) if ids is None else ids)
    pdf.insert(0, "cell_id", "c" if cells is None else cells)
    pdf["grp"], pdf["vec"] = 3, "clash"
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("block_rows", [150, 4000])
def test_nearest_recall(spark, block_rows):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 32)) + 0.5
    x[300:330] = x[:30] + 0.02 * rng.normal(size=(30, 32))
    x *= rng.uniform(0.1, 9, (600, 1))
    df = usable_vectors(_vector_table(spark, x), "cell_id", "person_id")
    got = collision_knn.most_similar(df, 10, block_rows).toPandas()
    assert (got.groupby("id").size() == 10).all() and got.groupby("id").place.apply(lambda s: sorted(s) == list(range(1, 11))).all()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, j) for i in range(600) for j in np.argsort(-s[i])[:10]}
    assert len(want & set(zip(got.id, got.neighbour, strict=True))) / len(want) >= 0.9
    close = {(i, j) for i, j in want if s[i, j] > 0.9}
    assert close and close <= set(zip(got.id, got.neighbour, strict=True))


def test_nearest_by_collisions_within_and_across_blocks(spark):
    rng = np.random.default_rng(19)
    x = rng.normal(size=(4000, 64)) + 0.8
    x[2000:] = x[:2000] + 0.3 * rng.normal(size=(2000, 64))
    df = usable_vectors(_vector_table(spark, x), "cell_id", "person_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, j) for i in range(4000) for j in np.argsort(-s[i])[:10]}
    close = {(i, j) for i, j in want if s[i, j] > 0.9}
    for block_rows in (1200, 4000):
        got = collision_knn.most_similar(df, 10, block_rows).toPandas()
        found = set(zip(got.id, got.neighbour, strict=True))
        assert len(found) == 40_000 and len(want & found) >= 0.9 * len(want) and len(close - found) <= 0.001 * len(close)


def test_exact_nearest_against_brute_force(spark):
    rng = np.random.default_rng(26)
    x = rng.normal(size=(300, 8))
    df = usable_vectors(_vector_table(spark, x), "cell_id", "person_id")
    got = collision_knn.exact_nearest(df.where("id % 10 = 0"), df, 4, 90).toPandas().sort_values(["id", "place"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert got.groupby("id").neighbour.apply(list).to_dict() == {i: np.argsort(-s[i])[:4].tolist() for i in range(0, 300, 10)}


def test_far_blocks_never_meet(spark):
    rng = np.random.default_rng(20)
    truth = np.arange(3000) % 12
    x = np.eye(16)[truth] + 0.02 * rng.normal(size=(3000, 16))
    df = usable_vectors(_vector_table(spark, x), "cell_id", "person_id")
    blocks, directory = collision_knn.near_blocks(df, 100)
    assert blocks.count() == 3000 and blocks.groupBy("block").count().agg(F.max("count")).first()[0] < 200
    met, n = collision_knn.block_meetings(df, 10, 100)
    assert n > 25 and met.count() < 0.25 * n * n  # a twelfth lies near
    got = collision_knn.most_similar(df, 10, 100).toPandas()
    assert len(got) == 30_000 and (truth[got.id] == truth[got.neighbour]).all()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, j) for i in range(3000) for j in np.argsort(-s[i])[:10]}
    assert len(want & set(zip(got.id, got.neighbour, strict=True))) >= 0.99 * len(want)


def test_meeting_blocks_cost_no_disk_and_a_floor_loses_nothing(spark, monkeypatch):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(2400, 16))  # without structure: every block meets every other
    x[1200:1500] = x[:300] + 0.15 * rng.normal(size=(300, 16))
    df = usable_vectors(_vector_table(spark, x), "cell_id", "person_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    want = {(i, j) for i in range(2400) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.9}
    got = collision_knn.most_similar(df, 5, 100, floor=0.9).toPandas()
    assert set(zip(got.id, got.neighbour, strict=True)) == want and len(got) == len(want) > 300
    written = []
    write = collision_knn.SharedFolder.write

    def measured(self, own, by):
        write(self, own, by)
        folder = Path(self.path.removeprefix("file:"))
        written.append((folder, sum(p.stat().st_size for p in folder.rglob("*.parquet")), spark.read.parquet(str(folder)).count()))

    monkeypatch.setattr(collision_knn.SharedFolder, "write", measured)
    got = collision_knn.most_similar(df, 5, 100).toPandas()
    assert len(got) == 12_000 and got.groupby("id")["cosine"].is_monotonic_decreasing.all()
    [(folder, size, rows)] = written
    assert rows == 2400 and size < 2400 * 16 * 8 * 4 and not folder.exists()
    met, n = collision_knn.block_meetings(df, 5, 100)
    assert met.count() > 0.9 * n * (n - 1)


def test_nearest_among_many_copies(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(300, 8))
    x[100:200] = x[100]
    df = usable_vectors(_vector_table(spark, x), "cell_id", "person_id")
    got = collision_knn.most_similar(df, 5, 60).toPandas().sort_values(["id", "place"])
    u = x / np.abs(x).max(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    want = {i: np.lexsort((np.arange(300), -s[i]))[:5].tolist() for i in range(300)}
    assert got.groupby("id").neighbour.apply(list).to_dict() == want and len(got) == 1500


def test_nearest_of_faulty_and_few(spark):
    x = np.array([[1.0, 0, 0], [2, 0, 0], [0, 1, 0], [np.nan, 1, 1], [np.inf, 0, 0], [0, 0, 0], [1, 0, 0], [5, 5, 5]])
    df = usable_vectors(_vector_table(spark, x, ids=[3, 1, 2, 4, 5, 6, 3, 7], cells=["c"] * 7 + ["alone"]), "cell_id", "person_id")
    got = collision_knn.most_similar(df, 10).toPandas()
    assert sorted(zip(got.id, got.neighbour, strict=True)) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]
    assert got[(got.id == 2)].sort_values("place").neighbour.tolist() == [1, 3]  # equal cosines: the smaller id first
    assert collision_knn.most_similar(df.limit(0), 10).count() == 0


# --- 4: percentiles


def test_percentiles_within_accuracy_and_mergeable(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.lognormal(3, 2, 3000), -rng.lognormal(1, 1, 500), np.zeros(100)])
    rows = [("g", int(i % 7), float(x), 50.0) for i, x in enumerate(v)] + [("g", 0, None, 50.0), ("g", 0, float("nan"), 50.0), ("h", 1, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, day int, v double, lim double")
    days = qs.sketch(df, ["g", "lim", "day"], "v", limit="lim")
    merged = qs.merge_sketches(days, ["g", "lim"])
    direct = qs.sketch(df, ["g", "lim"], "v", limit="lim")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, direct.collect()))
    got = qs.sketch_percentiles(merged, ["g", "lim"], [1, 10, 50, 90, 99, 100])
    s = np.sort(v)
    for r in got.where("g = 'g'").collect():
        exact = s[math.ceil(r.pct / 100 * len(s)) - 1]
        assert r.low - 1e-6 * abs(r.low) <= exact <= r.high + 1e-6 * abs(r.high) and abs(r.estimate - exact) <= 0.0101 * abs(exact)
    above = {(r.g, r.pct) for r in qs.exceeding(got, "lim").collect()}
    assert above == {("g", p) for p in (1, 10, 50, 90, 99, 100) if s[math.ceil(p / 100 * len(s)) - 1] > 50}
    assert qs.sketch_percentiles(qs.merge_sketches(qs.sketch(df.limit(0), ["g"], "v"), ["g"]), ["g"], [50]).count() == 0


# --- 6: clusters


@pytest.mark.parametrize("block_rows", [60, 5000])
def test_clusters_find_planted_groups(spark, block_rows):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 24))
    truth = rng.integers(0, 4, 500)
    x = (centres[truth] + 0.15 * rng.normal(size=(500, 24))) * rng.uniform(0.5, 5, (500, 1))
    vectors = usable_vectors(_vector_table(spark, x), "cell_id", "person_id")
    k = spark.createDataFrame([("c", 4, 1), ("none", 3, 1), ("c2", None, 1), (None, 2, 1)], "grp string, k long, cluster int")
    out = sc.similarity_clusters(vectors, k, block_rows)
    got = out.toPandas().set_index("id").cluster
    assert len(got) == 500 and len(set(zip(truth, got.loc[range(500)], strict=True))) == 4
    about = sc.describe_clusters(out).toPandas()
    assert about.n_members.sum() == 500 and (about.typical.map(len) == 5).all()
    pairs = {(r.person_a, r.person_b) for r in sc.neighbours_in_order(out, chunk_rows=20).collect()}
    want = set()
    for c in range(4):
        ids = np.flatnonzero(truth == c).tolist()
        want |= set(zip(ids, ids[1:], strict=False))
    assert pairs == want
    assert sc.similarity_clusters(vectors.limit(0), k).count() == 0 and sc.neighbours_in_order(out.limit(0)).count() == 0


@pytest.mark.parametrize(("groups", "rows", "block_rows"), [(200, 6000, 1500), (1000, 8000, 2000)])
def test_clusters_of_many_groups_come_out_whole(spark, groups, rows, block_rows):
    rng = np.random.default_rng(16)
    centres = rng.normal(size=(groups, 32))
    truth = np.arange(rows) % groups
    x = centres[truth] + 0.02 * rng.normal(size=(rows, 32))
    vectors = usable_vectors(_vector_table(spark, x), "cell_id", "person_id")
    got = sc.similarity_clusters(vectors, spark.createDataFrame([("c", groups)], "grp string, k long"), block_rows).toPandas().set_index("id").cluster
    assert got.nunique() == groups and len(set(zip(truth, got.loc[range(rows)], strict=True))) == groups


def test_clusters_are_never_fewer_than_asked_for(spark):
    rng = np.random.default_rng(17)
    x = np.repeat(1 + 0.001 * rng.normal(size=(150, 8)), 3, axis=0)  # 150 distinct vectors, all near each other
    vectors = usable_vectors(_vector_table(spark, x), "cell_id", "person_id")
    for k, want in ((150, 150), (149, 149), (400, 150), (0, 1)):
        assert sc.similarity_clusters(vectors, spark.createDataFrame([("c", k)], "grp string, k long"), 100).select("cluster").distinct().count() == want


def test_tree_bounds_its_leaves_and_keeps_the_sums():
    x = np.random.default_rng(18).normal(size=(3000, 16))
    tree = sc.FeatureTree(16, 256)
    tree.insert(np.ones(len(x)), x, (x**2).sum(1))
    n, linear, square = tree.leaves()
    assert 128 <= len(n) == tree.size <= 256 and n.sum() == 3000
    assert np.allclose(linear.sum(0), x.sum(0)) and np.isclose(square.sum(), (x**2).sum())
    assert all(len(node.n) <= sc.BRANCHING for node in tree.leaf_nodes()) and len(tree.leaf_nodes()) > 1


def test_ward_joins_what_is_near():
    n, at = np.ones(6), np.array([[0.0, 0], [0.1, 0], [5, 0], [5.1, 0], [9, 9], [9, 9.1]])
    assert len({tuple(g) for g in np.split(sc.ward(n, at, 3), 3)}) == 3 and len(set(sc.ward(n, at, 1))) == 1 and len(set(sc.ward(n, at, 9))) == 6


# --- 7: packing


@pytest.mark.parametrize("shard_rows", [200, 10**6])
def test_packing_is_valid_and_tight(spark, shard_rows):
    rng = np.random.default_rng(7)
    sizes = np.concatenate([rng.integers(1, 600, 800), rng.integers(0, 40, 700), [2048, 4096, 5000, 0, 2049]])
    df = spark.createDataFrame([(i, int(s), 1) for i, s in enumerate(sizes)] + [(9999, None, 1), (9998, -4, 1)], "item long, size long, n int")
    got = packing.pack(df, shard_rows=shard_rows).toPandas()
    per = got.groupby("item").agg(n=("n", "sum"), pieces=("piece", "count"))
    assert (per.n == pd.Series(sizes)).all() and len(per) == len(sizes)
    assert (per.pieces == np.maximum(1, -(-sizes // 2048))).all()
    used = got.groupby("container_id").n.sum()
    assert used.max() <= 2048 and len(used) <= 1.06 * sizes.sum() / 2048 + 8


def test_packing_of_repeated_and_null_items(spark):
    rows = [(1, 5000)] * 3 + [(None, 5000)] * 2 + [(2, 700)] * 40 + [(None, 700), (3, 2048), (3, 2048)]
    got = packing.pack(spark.createDataFrame(rows, "item long, size long")).toPandas()
    assert got.n.sum() == sum(s for _, s in rows) and got.groupby("container_id").n.sum().max() <= 2048
    assert (got[got.n == 2048].groupby("container_id").size() == 1).all() and (got.n == 2048).sum() == 12


def test_packing_of_nothing_and_counts(spark):
    assert packing.pack(spark.createDataFrame([], "item long, size long")).count() == 0
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "hello world", 1), (4, "a " * 30000, 1)], "doc_id long, text string, item int")
    got = {r.item: r.size for r in packing.token_counts(docs).collect()}
    assert got[2] == 0 and 2 <= got[3] <= 4 and got[4] >= 30000 and 1 not in got


def test_configurations_meet_the_demand():
    plan = packing.configurations([1500, 900, 500, 300], [10, 21, 40, 77], 2048)
    assert all(sum(a * b for a, b in zip(c, [1500, 900, 500, 300], strict=True)) <= 2048 for c, _ in plan)
    assert [sum(c[i] * n for c, n in plan) for i in range(4)] == [10, 21, 40, 77]


# --- 8: leaks


def test_regions_of_many_documents_are_aligned_together(monkeypatch):
    rng = np.random.default_rng(41)
    items = [rng.integers(0, 300, 40).astype(np.int32) for _ in range(12)]
    docs = [np.concatenate([rng.integers(-1, 300, 60), items[i % 12][: 20 + i % 9], rng.integers(-1, 300, 60)]).astype(np.int32) for i in range(60)]
    searcher = leak_search.Searcher(items, np.ones(300), np.linalg.qr(rng.standard_normal((300, 64)))[0])
    want = {(d, item, score) for d, w in enumerate(docs) for item, score in searcher.leaks(w).items()}
    calls, one = [], leak_search.align
    monkeypatch.setattr(leak_search, "align", lambda regions, *rest: calls.append(len(regions)) or one(regions, *rest))
    frame = pd.DataFrame({"doc_id": range(60), "words": [w.tobytes() for w in docs]})
    got = pd.concat(leak_search._search(type("Shared", (), {"value": searcher}))(iter([frame])))
    assert set(got.itertuples(index=False, name=None)) == want and len(got) == len(want) >= 60
    assert len(calls) == 1

WORDS = [f"{a}{b}{c}" for a in ("bor", "ket", "lum", "nav", "pos", "rud") for b in ("an", "ef", "om", "ut") for c in ("gra", "hix", "jol", "mek", "zup")]


def _srt(lines):
    return "\n\n".join(f"{i}\n00:00:{i % 60:02d},000 --> 00:00:{i % 60:02d},900\n{line}" for i, line in enumerate(lines, 1))


def test_leaks_found_and_short_repeats_not(spark):
    rng = np.random.default_rng(8)
    items = [[WORDS[i] for i in rng.integers(0, len(WORDS), 60)] for _ in range(12)]
    filler = ["the kettle is on the stove again", "she said nothing about the garden", "we walk home tomorrow then"]
    docs, want = [], set()
    for d in range(60):
        lines = [filler[i] for i in rng.integers(0, 3, 30)]
        if d % 3 == 0:
            item, at = int(rng.integers(0, 12)), int(rng.integers(0, 40))
            words = list(items[item][at : at + 18])
            for i in (3, 9, 14):
                words[i] = "indeed"
            words = [w.replace("o", "0").upper() for w in words]
            lines[10:10] = ["- " + " ".join(words[:7]), "[music]", "<i>" + " ".join(words[7:]) + "</i>"]
            want.add((item, d))
        elif d % 3 == 1:
            item = int(rng.integers(0, 12))
            lines[5:5] = [" ".join(items[item][10:18]) + "..."]
        docs.append((d, _srt(lines)))
    docs += [(100, None), (101, ""), (102, " \n")]
    items_df = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(items)] + [(50, None, "x"), (51, "too short", "x"), (60, " ".join(items[0]), "x")], "item_id long, text string, words string")
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1))
    got = {(r.item_id, r.doc_id) for r in leak_search.leaked_items(docs_df, items_df).collect()}
    assert got == want | {(60, d) for i, d in want if i == 0}
    assert leak_search.leaked_items(docs_df.limit(0), items_df).count() == 0 and leak_search.leaked_items(docs_df, items_df.limit(0)).count() == 0


def test_leaks_of_which_a_third_of_the_rows_are_copies(spark):
    rng = np.random.default_rng(14)
    items = [[WORDS[i] for i in rng.permutation(len(WORDS))[:40]] for _ in range(8)]
    filler = ["the kettle is on the stove again", "she said nothing about the garden", "we walk home tomorrow then"]
    passage = list(items[3][12:28])
    for i in (3, 8, 12):
        passage[i] = "indeed"
    docs = [(d, _srt(["hello there", *([" ".join(passage)] if d % 3 == 0 else []), *[filler[i] for i in rng.integers(0, 3, 1 if d % 2 else 8)]])) for d in range(120)]
    items_df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in leak_search.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), items_df).collect()}
    assert got == {(3, d) for d in range(0, 120, 3)}


def test_shortest_leaks_of_the_definition(spark):
    items = [[f"{w}{i}" for w in WORDS[:40]] for i in ("kra", "tov", "pyn")]
    cases = {1: (15, (4, 8, 11)), 2: (16, (3, 7, 10, 13))}
    docs = [(0, _srt(["we walk home tomorrow then", " ".join(items[0][5:13]), "she said nothing about the garden"]))]
    for d, (n, exchanged) in cases.items():
        words = [("indeed" if i in exchanged else w) for i, w in enumerate(items[d][9 : 9 + n])]
        docs.append((d, _srt(["we walk home tomorrow then", " ".join(words[:6]), " ".join(words[6:]), "she said nothing about the garden"])))
    items_df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in leak_search.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), items_df).collect()}
    assert got == {(1, 1), (2, 2)}


def test_leaks_in_other_scripts_and_wrong_encodings(spark):
    rng = np.random.default_rng(22)
    stems, ends = ["кор", "вел", "мос", "дур", "тен", "шал", "гор", "лис"], ["ать", "ение", "ый", "ами", "ок", "ина"]
    cyrillic = [f"{a}{b}{c}" for a in stems for b in ("", "ма", "до") for c in ends]
    han = [chr(c) for c in range(0x5000, 0x5190)]
    items = [[cyrillic[i] for i in rng.permutation(len(cyrillic))[:40]] for _ in range(4)] + [["".join(han[i] for i in rng.permutation(len(han))[:60])] for _ in range(4)]
    text = lambda i, low, high: " ".join(items[i][low:high]) if i < 4 else items[i][0][low:high]
    other = [" ".join(cyrillic[i] for i in rng.integers(0, len(cyrillic), 6)) for _ in range(40)]
    docs, want = [], set()
    for d in range(32):
        i, lines = d % 8, [other[j] for j in rng.integers(0, 40, 8)]
        lines[4:4] = [text(i, 10, 10 + (18 if d % 4 else 7))]
        t = _srt(lines).upper() if d % 3 == 0 else _srt(lines)
        if d % 4 == 1:
            t = t.encode("utf-8").decode("latin-1")
        if d % 4 == 2 and i < 4:
            t = t.encode("cp1251").decode("latin-1")
        docs.append((d, t))
        if d % 4:
            want.add((i, d))
    items_df = spark.createDataFrame([(i, text(i, 0, 60)) for i in range(8)], "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in leak_search.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), items_df).collect()}
    assert got == want


def test_leaks_of_several_passes_equal_those_of_one(spark, monkeypatch):
    rng = np.random.default_rng(23)
    items = [[WORDS[i] for i in rng.permutation(len(WORDS))[:40]] for _ in range(9)]
    docs = [(d, _srt(["hello there", " ".join(items[d % 9][5:22]), "we walk home tomorrow then"])) for d in range(30)]
    docs_df, items_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    want = {(d % 9, d) for d in range(30)}
    for most in (2_000, 4):
        monkeypatch.setattr(leak_search, "MAX_ITEMS", most)
        assert {(r.item_id, r.doc_id) for r in leak_search.leaked_items(docs_df, items_df).collect()} == want


def test_alignment_equals_plain_recursion():
    rng = np.random.default_rng(9)
    for _ in range(20):
        a, b = rng.integers(-1, 6, 25), rng.integers(0, 6, 18)
        h, best = np.zeros((26, 19)), 0.0
        for i in range(25):
            for j in range(18):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -0.5), h[i, j + 1] - 0.5, h[i + 1, j] - 0.5)
                best = max(best, h[i + 1, j + 1])
        got = leak_search.align([a.astype(np.int32)], [b.astype(np.int32)])[0]
        assert abs(got - best) < 1e-5
        assert leak_search._bound(np.isin(a, b)[None, :])[0] >= got - 1e-5


def test_skeletons_ignore_encoding_and_misreading():
    assert leak_search.skeleton_words("Stämme <i>vioIin</i> shc") == leak_search.skeleton_words("StÃ¤mme vi0lin [noise] SHE")


# --- 9: cut texts


def test_cut_texts_held_out(spark):
    rng = np.random.default_rng(10)
    names, nouns, verbs = ["Mira", "Tolan", "Veska", "Ordun"], ["kettle", "garden", "ladder", "mirror", "candle"], ["found", "carried", "painted", "borrowed"]
    say = [lambda: f"She {rng.choice(verbs)} the {rng.choice(nouns)} again.", lambda: f"Where did you put the {rng.choice(nouns)}?", lambda: f"Look at me, {rng.choice(names)}. The {rng.choice(nouns)} is gone.", lambda: f"I thought you {rng.choice(verbs)} it, {rng.choice(names)}...", lambda: "[footsteps]"]
    docs, cut = [], set()
    for d in range(700):
        text = _srt([say[rng.integers(0, 5)]() for _ in range(int(rng.integers(8, 20)))])
        if d % 10 == 0:
            last = text.rindex("\n\n")
            text = text[: last + 3 + int(rng.integers(0, len(text) - last - 4))]
            text += ["", "...", "\n", " ..."][d // 10 % 4]
            cut.add(d)
        docs.append((d, text, "en" if d % 2 else " EN", "s" if d % 3 else None, 1.0))
    docs += [(9000, None, "en", "s", 1.0), (9001, " \n", "en", "s", 1.0), (9002, "", None, None, 1.0)]
    df = spark.createDataFrame(docs, "id long, text string, language string, source string, score double")
    scored = cut_text.cut_scores(df)
    got = {r.id for r in scored.where("is_cut").collect()}
    assert scored.count() == 700 and len(got & cut) >= 0.85 * len(cut) and len(got - cut) <= 10
    shares = {r.source: (r.n_values, r.n_cut) for r in cut_text.cut_share_by_source(scored).collect()}
    assert sum(n for n, _ in shares.values()) == 700 and sum(c for _, c in shares.values()) == len(got)


def test_share_of_cut_values_is_estimated():
    rng = np.random.default_rng(24)
    bins = lambda v: {int(b): float(n) for b, n in zip(*np.unique(np.floor(v / cut_text.BIN), return_counts=True), strict=True)}
    whole, broken = rng.normal(0, 1.5, 4000), rng.normal(-9, 2, 4000)
    for share in (0.02, 0.1, 0.3):
        n = int(share * 5000)
        final = np.concatenate([rng.normal(-9, 2, n), rng.normal(0, 1.5, 5000 - n)])
        assert abs(cut_text.estimated_share(bins(whole), bins(broken), bins(final)) - share) < 0.015
        assert -7 < cut_text.choose_threshold(bins(whole), bins(broken), bins(final)) < -2


def test_cut_values_of_two_columns(spark):
    rng = np.random.default_rng(25)
    nouns, verbs = ["kettle", "garden", "ladder", "mirror", "candle"], ["found", "carried", "painted", "borrowed"]
    rows, cut = [], set()
    for d in range(400):
        text = _srt([f"She {rng.choice(verbs)} the {rng.choice(nouns)} again." for _ in range(int(rng.integers(8, 16)))])
        note = "\n\n".join(f"{rng.choice(nouns)} / {rng.choice(verbs)} / ready" for _ in range(8))
        if d % 10 == 0:
            note = note[: -int(rng.integers(2, 12))]
            cut.add(d)
        rows.append((d, text, note, "en", "s"))
    got = cut_text.cut_scores(spark.createDataFrame(rows, "id long, text string, note string, language string, source string"), ["text", "note"])
    assert got.count() == 800 and got.where("is_cut and field = 'text'").count() <= 2
    assert {r.id for r in got.where("is_cut and field = 'note'").collect()} == cut


def test_cut_texts_of_little(spark):
    schema = "id long, text string, language string, source string"
    assert cut_text.cut_scores(spark.createDataFrame([], schema)).count() == 0
    assert [r.is_cut for r in cut_text.cut_scores(spark.createDataFrame([(1, "one block only", None, None), (2, "x" * 2_000_000 + "\n\nend.", "en", "s")], schema)).collect()].count(True) <= 1


def test_text_that_ends_within_a_character():
    assert cut_text._half("1\n00:01 --> 00:02\nwieder gef\ufffd \n") and not cut_text._half("gef\ufffdhl wieder gef\ufffd") and not cut_text._half("done.") and not cut_text._half("\ufffd a")


def test_bare_number_lines_count_as_one_tail():
    from vecgauge.llm.cut_text import _alike, _encode

    alike = {_alike(_encode(b)[0]) for b in ("7\n00:01:02,", "117\r\n00:01:02,", "12\n00:01:03,")}
    assert len(alike) == 1
    assert _alike(_encode("7\nRoom 12")[0]) != _alike(_encode("17\nRoom 12")[0])


def test_positions_of_long_blocks_are_counted_once(monkeypatch):
    monkeypatch.setattr(cut_text, "FINAL_BYTES", 40)
    texts = ["First words. " + "Then they spoke on and on. " * 30 + "\n\nLast block, not ended", "one block only", "Whole.\n\n..."]
    counter = cut_text.Counter(20, b"")
    counter.passing = lambda h: h

    def counted(chunk_bytes):
        monkeypatch.setattr(cut_text, "CHUNK_BYTES", chunk_bytes)
        portions = list(cut_text._chunks((t, 0) for t in texts))
        frames = [counter.counts([x[:2] for x in p], np.array([x[2] for x in p]), lead=np.array([x[3] for x in p])) for p in portions]
        assert max(len(x[0]) for p in portions for x in p) <= chunk_bytes + 40
        return pd.concat(frames).groupby(["hash", "kind"])["n"].sum().to_dict()

    whole = counted(1_000_000)
    assert counted(150) == whole and sum(n for (_, kind), n in whole.items() if not kind) == len(cut_text.CONTEXTS) * (12 + 30 * 27 + 7 + 1)


def test_contexts_are_counted_exactly_however_many(spark):
    rng = np.random.default_rng(12)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    lines = ["".join(rng.choice(letters, 200)) for _ in range(4000)]  # 0.8 million different contexts of 18 bytes
    docs = [(i, "\n\n".join(lines[i * 10 : i * 10 + 10]), "s", "en") for i in range(400)]
    df = spark.createDataFrame(docs, "id long, text string, source string, language string").withColumns({"column_no": F.lit(0), "field": F.lit("text")})
    finals = df.mapInPandas(cut_text._finals, "row long, id long, source string, language string, field string, half boolean, raw binary, style int, kind int, alike binary, whole_kind int, hashes array<long>").cache()
    needed = finals.select(F.posexplode("hashes").alias("at", "hash"))
    counts = {r.hash: (r.everything, r.plain) for r in cut_text.count_contexts(df, finals, needed, needed.count()).collect()}
    size, last = len(cut_text.CONTEXTS), cut_text.CONTEXTS.index(18)
    for r in finals.collect():
        assert [counts[r.hashes[k * size + last]] for k in range(2)] == [(1, 1), (1, 1)]
    text = "\n\n".join("\n\n".join(d[1].split("\n\n")[:-1]) for d in docs)
    for r in finals.limit(50).collect():  # of two bytes, in the blocks and in the last tails
        tail = bytes(r.raw[-2:]).decode()
        want = len(re.findall(f"(?={tail})", text)) + sum(d[1].endswith(tail) for d in docs)
        assert counts[r.hashes[0]][0] == want
    finals.unpersist()


def test_tasks_without_anything_to_do_return_typed_nothing(spark):
    left = spark.createDataFrame([("a", 1, [1.0, 0.0])], "grp string, id long, vec array<double>")
    for kernel, schema in (
        (sc._assign(5), "grp string, id long, cluster int, distance double, place int"),
        (collision_knn._search_other(3), "grp string, id long, neighbour long, cosine double"),
        (collision_knn._exact(3), "grp string, id long, neighbour long, cosine double"),
    ):
        right = spark.createDataFrame([("b", 1, [1.0, 0.0])], "g string, id long, vec array<double>")
        assert left.groupBy("grp").cogroup(right.groupBy("g")).applyInPandas(kernel, schema).count() == 0
