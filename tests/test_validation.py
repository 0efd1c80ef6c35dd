"""Run checks, records, tables, preparation arms, files and simulated structure."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecgauge.operators import preparation, scores, validation
from vecgauge.operators.simulate import simulate_spaces
from vecgauge.sources import files

V = "id long, label long, split string, vec array<double>"


def test_inventory_and_alignment(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,), ("y",)], "k string")
    b = spark.createDataFrame([("y",), ("z",)], "k string")
    assert sorted(map(tuple, validation.inventory(a, b, "k").collect())) == [("x", "missing"), ("y", "ok"), ("z", "extra")]
    r = validation.key_alignment(a, b, ["k"]).first()
    assert (r.n_reference, r.n_other, r.n_missing, r.n_extra, r.n_repeated, r.verdict) == (4, 2, 2, 1, 0, "FAIL")
    same = validation.key_alignment(a.distinct(), a.distinct(), ["k"]).first()
    assert same.verdict == "PASS"  # null equals null
    empty = validation.key_alignment(a.limit(0), b.limit(0), ["k"]).first()
    assert (empty.n_reference, empty.n_other, empty.verdict) == (0, 0, "PASS")


def test_numerics(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [3.0, 4.0]), ("a", [3.0, 4.0]), ("a", [0.0, 0.0]), ("a", [nan, 1.0]), ("a", [None, 1.0]), ("b", [1.0, 0.0]), ("c", [inf, 0.0])]
    got = {r.grp: tuple(r)[1:] for r in validation.numerics(spark.createDataFrame(rows, "grp string, vec array<double>")).collect()}
    assert got == {"a": (5, 3, 1, 5.0, 5.0, "FAIL"), "b": (1, 0, 0, 1.0, 1.0, "PASS"), "c": (1, 1, 0, None, None, "FAIL")}


def test_provenance_and_record(spark):
    rows = [(1, None, "m", 10, 12, True), (1, None, "m", 10, 13, True), (2, None, "m", 10, 3, True), (3, None, "m", 10, None, None), (4, None, "m", 10, 0, None)]
    t = spark.createDataFrame(rows, "person_id long, cutoff timestamp, model_name string, context_length long, n_tokens long, truncated boolean")
    r = validation.provenance(t).first()
    assert (r.n_measured, r.n_anchors, r.n_contradicting, r.n_drifting, r.verdict) == (4, 3, 1, 1, "FAIL")
    r = validation.extraction_record(t).first()
    assert (r.n_anchors, r.n_persons, r.n_whole_record, r.n_cut, r.n_seen) == (4, 3, 4, 2, 23)
    assert r.mean_covered == pytest.approx((10 / 12 + 10 / 13 + 1 + 1) / 4)


def test_condition_table_takes_the_last_measurement(spark):
    rows = [("c", "raw", 1, 3, 0.5, "WEAK"), ("c", "raw", 2, 4, 0.75, "DISCRETE"), ("d", "raw", 1, None, float("nan"), None)]
    m = spark.createDataFrame(rows, "cell_id string, scaling string, measured_at long, chosen_k long, s double, verdict string")
    r = validation.condition_table(validation.latest_measurements(m), ["scaling"], ["s"]).first()
    assert (r.n_cells, r.verdict, r.least_k, r.greatest_k, r.mean_s) == (2, "DISCRETE", 4, 4, 0.75)


def test_spherical_arm_equals_dense_algebra(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 6)) + 2
    t = spark.createDataFrame([(i, 0, "train" if i < 40 else "val", v.tolist()) for i, v in enumerate(x)], V)
    got = {r.id: r.vec for r in preparation.prepare(t, "spherical", F.col("split") == "train", n_components=3).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = u[:40].mean(0)
    axes = np.linalg.svd(u[:40] - mean, full_matrices=False)[2][1:4]
    want = (u - mean) @ axes.T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = np.stack([got[i] for i in range(60)])
    assert np.allclose(np.abs((got * want).sum(0)), (want**2).sum(0), atol=1e-8)  # axes have no sign
    z = np.stack([r.vec for r in preparation.prepare(t, "standard", F.col("split") == "train").orderBy("id").collect()])
    assert np.allclose(z, (x - x[:40].mean(0)) / x[:40].std(0))
    assert preparation.prepare(t, "raw") is t
    with pytest.raises(ValueError, match="unknown scaling"):
        preparation.prepare(t, "other")
    with pytest.raises(ValueError, match="no rows"):
        preparation.prepare(t.limit(0), "spherical")


def test_metrics_by_split_leaves_out_what_cannot_be_scored(spark):
    rows = [(i, i % 2, "train", [10.0 * (i % 2), float(i)]) for i in range(8)] + [(20 + i, 0, "val", [0.0, float(i)]) for i in range(3)]
    t = spark.createDataFrame(rows, V)
    (r,) = preparation.metrics_by_split(t).collect()
    assert (r.split, r.n, r.n_clusters) == ("train", 8, 2) and 0 < r.silhouette < 1
    assert preparation.metrics_by_split(t.where("split = 'val'")).count() == 0


def test_nonlinear_decodability(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 2))
    rows = [(i, 0, "train" if i < 300 else "val", v.tolist(), float((v**2).sum())) for i, v in enumerate(x)] + [(900, 0, "val", [0.0, 0.0], None)]
    t = spark.createDataFrame(rows, V + ", y double")
    r = preparation.nonlinear_decodability(t, "y").first()
    assert (r.n_train, r.n_val) == (300, 100) and r.r2_val > 0.5
    assert preparation.nonlinear_decodability(t.where("id < 310"), "y").first().r2_val is None


SPEC = "cell_id string, n_rows long, n_clusters long, separation double, noise double, structure string, confound_orientation string, confound_strength double, coupling double, anisotropy double, n_decoys int"


def test_simulated_structure(spark):
    def space(**k):
        row = {"cell_id": "a", "n_rows": 1500, "n_clusters": 3, "separation": 6.0, "noise": 0.0, "structure": "discrete", "confound_orientation": "none", "confound_strength": 0.0, "coupling": 0.0, "anisotropy": 0.0, "n_decoys": 2} | k
        return simulate_spaces(spark.createDataFrame([tuple(row.values())], SPEC), dims=8)

    one = space(anisotropy=0.6).toPandas()
    x = np.stack(one["vec"])
    cosine = (x @ x.mean(0)) / np.linalg.norm(x, axis=1) / np.linalg.norm(x.mean(0))
    assert abs(cosine.mean() - 0.6) < 0.08 and one["position"].isna().all() and (one["decoys"].map(len) == 2).all()
    centres = np.stack([np.stack(g["vec"]).mean(0) for _, g in one.groupby("label")])
    assert all(abs(math.dist(centres[i], centres[j]) - 6) < 0.6 for i in range(3) for j in range(i))
    line = space(structure="continuum", separation=8.0).toPandas()
    assert line["label"].isna().all() and line["position"].between(0, 1).all() and np.abs(np.stack(line["vec"]).mean(0)).max() < 0.5
    coupled = space(coupling=2.0).toPandas()
    assert np.corrcoef(coupled["label"].astype(float), coupled["log_n_events"])[0, 1] > 0.7
    for orientation, seen in (("axis", True), ("radial", False)):
        rows = space(confound_orientation=orientation, confound_strength=6.0, separation=0.0)
        linear = scores.numeric_r2(rows.select("log_n_events", F.posexplode("vec").alias("dim", "x")), ["dim"], "log_n_events", "x").agg(F.sum("r2")).first()[0]
        assert (linear > 0.5) == seen
    for bad in ({"anisotropy": 1.0}, {"structure": "ring"}, {"confound_orientation": "odd"}, {"n_clusters": 7, "confound_orientation": "radial"}):
        with pytest.raises(Exception, match="anisotropy|unknown|more"):
            space(**bad).collect()


def test_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("patient_id,prediction_time,label_type,value\n1,2020-01-01 00:00:00,boolean,True\n2,2020-01-02 00:00:00,categorical,0\n3,,boolean,\n")
    assert [(r.person_id, r.y) for r in files.read_labels(spark, str(tmp_path / "l.csv"), "t").orderBy("person_id").collect()] == [(1, 1), (2, 0), (3, None)]
    (tmp_path / "s.csv").write_text("omop_person_id,split\n5,train\n")
    assert files.read_splits(spark, str(tmp_path / "s.csv")).first() == (5, "train")
    (tmp_path / "p.csv").write_text("model,head,k,score,value\nm,h,-1,auroc,0.5\nm,h,-1,auroc,0.7\nn,h,-1,auroc,0.1\n")
    assert files.published_score(spark, str(tmp_path / "p.csv"), model="m", score="auroc").first().value == pytest.approx(0.6)
    assert files.published_score(spark, str(tmp_path / "p.csv"), model="q").first().value is None
    t = spark.createDataFrame([(1, "a|b"), (2, None)], "n long, s string")
    files.write_markdown(t, str(tmp_path / "t.md"), "A table", "tab-a")
    assert "| 1 | a\\|b |" in (tmp_path / "t.md").read_text()
    with pytest.raises(ValueError, match="more than 1"):
        files.write_markdown(t, str(tmp_path / "u.md"), "x", "y", most_rows=1)
    files.write_record(t, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
