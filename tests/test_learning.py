"""Clustering strength, probes, simulation and extraction on planted structure."""

import hashlib
import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecgauge.operators import learning, replicates, resamples, scores
from vecgauge.operators.simulate import simulate_spaces
from vecgauge.streaming.extraction import extract_missing, history_vectors, stream_extraction

SPEC = "cell_id string, n_rows long, n_clusters long, separation double, noise double"


@pytest.fixture(scope="module")
def space(spark):
    return simulate_spaces(spark.createDataFrame([("a", 300, 3, 8.0, 0.1)], SPEC), dims=8).cache()


def test_planted_clusters_are_strong_and_stable(space):
    assert learning.prediction_strength(space, 3, 1) > 0.8
    assert learning.stability(space, 3, 1).first().ari > 0.85
    conf = learning.gmm_confidence(space, 3).agg(F.avg("confidence").alias("c")).first().c
    assert 0.9 < conf <= 1


def test_space_does_not_depend_on_partitions(spark, space):
    again = simulate_spaces(spark.createDataFrame([("a", 300, 3, 8.0, 0.1)], SPEC).repartition(7), dims=8)
    assert again.exceptAll(space).count() == 0 and space.groupBy("label").count().count() == 3
    with pytest.raises(Exception, match="more clusters"):
        simulate_spaces(spark.createDataFrame([("a", 3, 9, 1.0, 0.1)], SPEC), dims=8).collect()


def test_null_draw_matches_mean_and_covariance(space):
    draw = np.stack([r.vec for r in learning.null_draw(space, 3).collect()])
    real = np.stack([r.vec for r in space.collect()])
    assert draw.shape == real.shape and np.abs(draw.mean(0) - real.mean(0)).max() < 0.9
    assert np.abs(np.cov(draw.T) - np.cov(real.T)).max() < 3


def test_probes_find_signal(space):
    rows = space.withColumn("y", (F.col("label") == 0).cast("int")).withColumn("label", F.col("label").cast("long"))
    r = learning.logistic_probe(rows).first()
    assert r.auroc_test > 0.8
    assert learning.logistic_probe(rows.withColumn("y", F.lit(1))).first().auroc_test is None
    assert max(x.r2_val for x in learning.ridge_decodability(rows.withColumn("z", F.col("vec")[0] * 2 + 1), "z").collect()) > 0.99


def test_probe_never_sees_what_is_held_out(space):
    rows = space.withColumn("y", (F.col("label") == 0).cast("int")).withColumn("label", F.col("label").cast("long"))
    train = lambda r: {x.id: x.vec for x in learning.standardised_on_train(r).where("split = 'train'").collect()}
    shifted = rows.withColumn("vec", F.when(F.col("split") == "train", F.col("vec")).otherwise(F.transform("vec", lambda x: x + 1000)))
    assert train(rows) == train(shifted)
    one_class = rows.withColumn("y", F.when(F.col("split") == "val", 1).otherwise(F.col("y")))
    r = learning.logistic_probe(one_class).first()
    assert r.c == 0.1 and r.auroc_val is None and r.auroc_test > 0.8


def test_ridge_chooses_by_leaving_one_out(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 6))
    y = x @ [1.0, -2, 0, 0, 0.5, 0] + rng.normal(size=120)
    split = np.where(np.arange(120) < 80, "train", "val")
    rows = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), str(split[i])) for i in range(120)] + [(999, [0.0] * 6, None, "train")], "id long, vec array<double>, z double, split string")
    got = {r.alpha: r for r in learning.ridge_decodability(rows, "z").collect()}
    xt, yt = x[:80], y[:80]
    want = {}
    for a in learning.ALPHAS:
        errors = []
        for i in range(80):
            k = np.arange(80) != i
            # the mean is that of all rows, as in the closed form
            xc, yc = xt - xt.mean(0), yt - yt.mean()
            h = 1 / 80 + xc[i] @ np.linalg.solve(xc.T @ xc + a * np.eye(6), xc[i])
            fit = xc[i] @ np.linalg.solve(xc.T @ xc + a * np.eye(6), xc.T @ yc)
            errors.append(((yc[i] - fit) / (1 - h)) ** 2)
            assert k.sum() == 79
        want[a] = np.mean(errors)
        assert abs(got[a].loo_error - want[a]) < 1e-6
    assert [a for a, r in got.items() if r.chosen] == [min(want, key=want.get)]
    assert learning.ridge_decodability(rows.limit(20), "z").count() == 0


def test_curves_of_planted_and_of_shapeless_tables(spark, space):
    curves = replicates.strength_curves(space, [2, 3, 4], 4, 4).cache()
    assert curves.count() == 3 * 4 * 5
    table = {r.k: r for r in replicates.tendency(curves).collect()}
    assert table[3].exceeds_null and table[3].real > 0.8 and table[3].margin > 0.5
    v = replicates.gate_verdict(replicates.tendency(curves)).first()
    assert (v.verdict, v.k_at_max_margin) == ("DISCRETE", 3) and "k = 3" in v.sentence
    again = replicates.strength_curves(space.repartition(7), [2, 3, 4], 4, 4)
    assert curves.exceptAll(again).count() == 0
    rng = np.random.default_rng(8)
    cloud = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "id long, vec array<double>")
    flat = replicates.gate_verdict(replicates.tendency(replicates.strength_curves(cloud, [2, 3], 4, 12, seed=3))).first()
    assert flat.max_margin < 0.3
    s = {r.k: r.mean_ari for r in replicates.summarise_stability(replicates.stability_curve(space, [3, 5], 4)).collect()}
    assert s[3] > 0.85 and s[3] > s[5]
    assert replicates.gate_verdict(replicates.tendency(curves.where("k > 9"))).first().verdict is None
    assert replicates.strength_curves(space.limit(0), [2], 2).count() == 0 and replicates.stability_curve(space.limit(0), [2], 2).count() == 0


def test_large_tables_take_the_distributed_way(space, monkeypatch):
    monkeypatch.setattr(replicates, "MATRIX_BYTES", 10)
    assert replicates.broadcast_matrix(space) is None
    curve = replicates.strength_curves(space, [3], 1, 1)
    assert [r.draw for r in curve.orderBy("draw").collect()] == [-1, 0] and curve.where("draw < 0").first().strength > 0.8
    assert replicates.stability_curve(space, [3], 1).first().ari > 0.85
    assert replicates.fitted_labels(space, 3).select("cluster").distinct().count() == 3


def test_counts_below_and_quantiles_need_no_single_order(spark):
    rng = np.random.default_rng(9)
    v = np.round(rng.normal(size=3001) ** 3, 2)
    rows = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "x double").repartition(5)
    for q in (0, 0.1, 0.5, 0.95, 1):
        assert abs(scores.exact_quantile(rows, "x", q) - np.quantile(v, q)) < 1e-12
    assert scores.exact_quantile(rows.limit(0), "x", 0.5) is None
    per = rows.where("x is not null").groupBy("x").agg(F.count("*").cast("double").alias("n"))
    s = np.sort(v)
    assert all(r.below == np.searchsorted(s, r.x) for r in scores.counts_below(per, "x", "n").collect())


def test_bootstrap_interval_holds_the_estimate(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    rows = spark.createDataFrame([(i, float(np.round(rng.normal(v), 1)), int(v)) for i, v in enumerate(y)], "id long, s double, y int")
    r = learning.bootstrap_auroc(rows, "s", "y", 60).first()
    assert r.low < 0.76 < r.high and r.n_used == 60
    assert learning.bootstrap_auroc(rows.where("y = 1"), "s", "y", 5).first().n_used == 0


def test_resamples_weigh_rows_as_their_hash_says_and_ties_join_over_tasks(spark, monkeypatch):
    heads = [b"", b"7-", *(f"{10**i + i}-".encode() for i in range(18)), b"x" * 50 + b"-", b"y" * 90 + b"-", "é-".encode()]
    got = resamples.weights(heads, range(8, 103))
    steps = np.cumsum([math.exp(-1) / math.factorial(j) for j in range(8)])
    for i, h in enumerate(heads):
        u = [(int(hashlib.md5(h + str(r).encode()).hexdigest()[:8], 16) + 0.5) / 2**32 for r in range(8, 103)]
        assert [sum(v >= s for s in steps) for v in u] == got[:, i].tolist()
    rng = np.random.default_rng(2)
    s = np.round(rng.normal(size=3000), 1)
    s[:900] = 0.5  # one score over several tasks
    s[2990:] = np.nan
    rows = spark.createDataFrame([(i, float(v), int(rng.random() < 0.4)) for i, v in enumerate(s)] + [(3000, None, 1), (3001, 1.0, None), (3002, -0.0, 1)], "id long, s double, y int")
    weighed = rows.crossJoin(spark.range(130).withColumnRenamed("id", "resample")).withColumn("w", learning.poisson_weight(F.col("resample"), F.col("id"))).where("w > 0")
    want = {r.resample: r.auroc for r in scores.auroc(weighed, ["resample"], "s", "y", "w").collect()}
    found = {r.resample: r.auroc for r in resamples.resampled_auroc(rows, "s", "y", 130).collect()}
    assert found.keys() == want.keys() and all(abs(found[r] - want[r]) < 1e-13 for r in want)
    plan = resamples.resampled_auroc(rows, "s", "y", 130)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # rows are not repeated for each resample


def test_extraction_goes_on_where_it_stopped(spark, tmp_path):
    at = F.expr("timestamp_ntz '2020-01-01 00:00:00' + make_interval(0, 0, 0, day)")
    events = spark.createDataFrame([(p, c, d) for p in range(6) for d, c in enumerate("abc")] + [(None, "a", 0), (1, None, 0), (1, " ", 0), (5, "u", None)], "person_id long, code string, day int").withColumn("time", at)
    wanted = spark.createDataFrame([(p, d) for p in range(7) for d in (0, 1, None)] + [(1, 0), (None, 1), (0, -9), (5, -9)], "person_id long, day int").withColumn("cutoff", at).select("person_id", "cutoff")
    path = str(tmp_path / "vectors")
    extract_missing(events, wanted.where("person_id < 3 and cutoff is not null"), path)
    before = {tuple(r) for r in spark.read.parquet(path).collect()}
    source = str(tmp_path / "anchors")
    wanted.write.parquet(source)
    stream = spark.readStream.schema("person_id long, cutoff timestamp_ntz").parquet(source)
    for _ in range(2):
        stream_extraction(events, stream, path, str(tmp_path / "checkpoint")).awaitTermination()
    after = spark.read.parquet(path)
    assert before < {tuple(r) for r in after.collect()} and after.groupBy("person_id", "cutoff", "bucket").count().where("count > 1").count() == 0
    day = lambda r: None if r.cutoff is None else (r.cutoff - datetime(2020, 1, 1)).days
    got = {}
    for r in after.collect():
        got.setdefault((r.person_id, day(r)), []).append(r.weight)
    assert set(got) == {(p, d) for p in range(6) for d in (0, 1, None)} | {(5, -9)}
    assert all(abs(sum(w) - 1) < 1e-9 for w in got.values()) and max(got[(0, 0)]) == 1.0 and len(got[(0, 0)]) == 1
    assert history_vectors(events.limit(0), wanted).count() == 0 and history_vectors(events, wanted.limit(0)).count() == 0
