"""Timelines, scores and geometry: hand-built cases and brute force."""

from datetime import datetime as t

import numpy as np
import pytest

from vecgauge.functions import scalars as fn
from vecgauge.operators import confounds
from vecgauge.operators import geometry as geo
from vecgauge.operators import scores
from vecgauge.operators import timeline as tl
from pyspark.sql import functions as F

EVENTS = "person_id long, time timestamp_ntz, code string, numeric_value double"


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (1, t(1950, 3, 4), "MEDS_BIRTH", None), (1, t(1950, 3, 4), "Gender/F", None), (1, t(1950, 3, 4), "Race/5", None), (1, t(1950, 3, 4), "Ethnicity/Hispanic", None),
        (1, t(2010, 1, 1), "SNOMED/1234", None), (1, t(2015, 6, 15), "LOINC/29463-7", 70.5), (1, t(2020, 12, 31), "RxNorm/999", None),
        (2, t(1960, 1, 1), "MEDS_BIRTH", None), (3, None, "SNOMED/1", None), (3, t(2001, 1, 1), "SNOMED/1", None), (None, t(2001, 1, 1), "SNOMED/1", None),
    ]
    return spark.createDataFrame(rows, EVENTS)


def test_timeline_summary(events):
    got = {r.person_id: r for r in tl.timeline_summary(events).collect()}
    one = got[1]
    assert (one.n_events, one.first_event, one.last_event, one.gender, one.race, one.ethnicity) == (3, t(2010, 1, 1), t(2020, 12, 31), "F", "5", "HISPANIC")
    assert abs(one.observation_years - 10.99) < 0.01 and abs(one.age_at_last_event - 70.83) < 0.01
    assert (got[2].n_events, got[2].first_event, got[2].observation_years) == (0, None, None)
    assert (got[3].n_events, got[3].first_event, got[3].last_event) == (2, None, t(2001, 1, 1))


@pytest.mark.parametrize(("cutoff", "n"), [(t(2015, 6, 15), 6), (t(2016, 1, 1), 6), (t(1999, 1, 1), 4), (None, 7), (t(1900, 1, 1), 0)])
def test_firewall(spark, events, cutoff, n):
    anchors = spark.createDataFrame([(5, 1, cutoff), (6, 3, cutoff), (7, None, cutoff), (8, 99, cutoff)], "anchor_id long, person_id long, cutoff timestamp_ntz")
    got = {r.anchor_id: r.n_events for r in tl.history_counts(events, anchors, chunk_days=3).collect()}
    assert got[5] == n and got[6] == (2 if cutoff is None or cutoff >= t(2001, 1, 1) else 1) and got[7] == got[8] == 0


def test_repeated_key_fails(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(Exception, match="repeated key"):
        tl.unique_by(df, ["k"]).collect()


def test_verdict_and_margin(spark):
    df = spark.createDataFrame([(0.7622, 0.3887, True), (0.21, 0.2, True), (0.9, 0.95, False), (None, None, None), (1.0, 1.0, True)], "r double, m double, b boolean")
    got = [(r.margin, r.v) for r in df.withColumn("margin", fn.null_margin(F.col("r"), F.col("m"))).withColumn("v", fn.verdict(F.col("b"), F.col("margin"))).collect()]
    assert got[0][1] == "DISCRETE" and abs(got[0][0] - 0.611) < 1e-3 and [v for _, v in got[1:4]] == ["WEAK", "CONTINUOUS", None] and got[4][0] is None


def test_choose_k_prefers_large_then_smallest_best(spark):
    df = spark.createDataFrame([("a", 2, 0.9), ("a", 3, 0.8), ("a", 4, 0.1), ("b", 2, 0.3), ("b", 3, 0.3), ("c", 2, None)], "g string, k long, strength double")
    assert {r.g: r.chosen_k for r in scores.choose_k(df, ["g"]).collect()} == {"a": 3, "b": 2, "c": None}


def test_auroc_with_ties_equals_pairs(spark):
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 8, 200), rng.integers(0, 2, 200)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(s, y, strict=True)], "s int, y int")
    pairs = (s[y == 1][:, None] > s[y == 0][None, :]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :])
    assert abs(scores.auroc(df, [], "s", "y").first().auroc - pairs.mean()) < 1e-12
    assert scores.auroc(df.where("y = 1"), [], "s", "y").first().auroc is None


def test_r2_of_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 1.0), (float("nan"), 1.0)], "x double, y double")
    assert scores.numeric_r2(df, [], "x", "y").first().r2 == 0.0
    assert scores.numeric_r2(df.limit(1), [], "x", "y").first().r2 is None
    assert scores.eta_squared(df.withColumn("l", F.lit("a")), [], "l", "y").first().eta2 == 0.0


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 1, (40, 6)) for c in (0, 6, 12)])
    return x, spark.createDataFrame([(i, i // 40, [float(v) for v in r]) for i, r in enumerate(x)], "id long, label long, vec array<double>")


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_gram_and_axes(blobs, parts):
    x, df = blobs
    n, s, g = geo.gram(df.repartition(parts))
    assert n == 120 and np.allclose(s, x.sum(0)) and np.allclose(g, x.T @ x)
    _, _, ratio = geo.principal_axes(df)
    c = x - x.mean(0)
    sv = np.linalg.svd(c, compute_uv=False) ** 2
    assert np.allclose(ratio, sv / sv.sum())


def test_rankme_of_one_direction(spark):
    df = spark.createDataFrame([(i, 0, [float(i), 2.0 * i, 3.0 * i]) for i in range(1, 21)], "id long, label long, vec array<double>")
    assert abs(geo.rankme(df) - 1) < 0.1


def test_silhouette_and_assignment(blobs):
    x, df = blobs
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    label = np.arange(120) // 40
    want = []
    for i in range(120):
        means = [d[i][label == c].sum() / (39 if c == label[i] else 40) for c in range(3)]
        a, b = means[label[i]], min(m for c, m in enumerate(means) if c != label[i])
        want.append((b - a) / max(a, b))
    got = {r.id: r.silhouette for r in geo.silhouettes(df, block_rows=50).collect()}
    assert np.allclose([got[i] for i in range(120)], want)
    near = geo.nearest_centroid(df, geo.mean_vectors(df, "label"))
    assert near.where("cluster != label").count() == 0
    assert geo.contingency_scores(near.select(F.col("label").alias("a"), F.col("cluster").alias("b"))).first().ari == 1.0


def test_residual_has_nothing_left(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=200)
    df = spark.createDataFrame([(i, 0, [float(2 * a + 1), float(-a)], float(a) if i % 9 else None) for i, a in enumerate(z)], "id long, label long, vec array<double>, z double")
    rest = confounds.residualised(df.where("z is not null").drop("z"), df.select("id", "z"))
    assert np.allclose(np.stack([r.vec for r in rest.collect()]), 0, atol=1e-9)


def test_entry_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
