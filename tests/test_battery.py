"""The battery as a whole, nuisance covariates, result tables, index levels and registry on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecgauge.functions.scalars import pool
from vecgauge.operators import confounds, registry, scores, scoring, validation
from vecgauge.operators import result_tables as tables
from vecgauge.operators import timeline as tl
from vecgauge.sources import files


@pytest.fixture(scope="module")
def planted(spark):
    """Three groups in eight dimensions, and a covariate that is one of them."""
    rng = np.random.default_rng(30)
    label = rng.integers(0, 3, 240)
    x = 6 * np.eye(3, 8)[label] + rng.normal(size=(240, 8))
    z = rng.normal(size=240) * 1.6
    x[:, 7] = z + 0.1 * rng.normal(size=240)
    split = ["train" if i % 5 < 3 else "val" if i % 5 == 3 else "test" for i in range(240)]
    space = spark.createDataFrame([(i, int(label[i]), x[i].tolist(), split[i]) for i in range(240)], "id long, label long, vec array<double>, split string").cache()
    rows = [(i, float(z[i]) if i % 11 else None, float(rng.normal()), "abc"[label[i]]) for i in range(235)]
    return space, spark.createDataFrame(rows, "id long, load double, decoy double, kind string").cache(), x, z, label


def test_design_uses_training_rows_only(planted):
    space, covariates, *_ = planted
    fit = "split = 'train'"
    z = {r.id: r.z for r in confounds.design_matrix(space, covariates.drop("kind"), fit).collect()}
    raw = covariates.toPandas().set_index("id").reindex(range(240))
    train = np.array([i % 5 < 3 for i in range(240)])
    for j, name in enumerate(("load", "decoy")):
        v = raw[name].to_numpy(float)
        m = np.nanmean(v[train])
        v = np.where(np.isnan(v), m, v)
        assert np.allclose([z[i][j] for i in range(240)], (v - m) / v[train].std())
    shifted = covariates.withColumn("load", F.when(F.col("id") % 5 < 3, F.col("load")).otherwise(99.0)).drop("kind")
    again = {r.id: r.z for r in confounds.design_matrix(space.where(fit), shifted, fit).collect()}
    assert set(again) == {i for i in z if i % 5 < 3} and all(np.allclose(v, z[i]) for i, v in again.items())
    with pytest.raises(ValueError, match="kind"):
        confounds.design_matrix(space, covariates)


def test_residuals_against_least_squares(planted):
    space, covariates, x, *_ = planted
    two = covariates.select("id", "load", "decoy")
    got = {r.id: r.vec for r in confounds.residualised(space, two, "split = 'train'").collect()}
    z = {r.id: r.z for r in confounds.design_matrix(space, two, "split = 'train'").collect()}
    design = np.column_stack([np.ones(240), np.array([z[i] for i in range(240)])])
    train = np.array([i % 5 < 3 for i in range(240)])
    want = x - design @ np.linalg.lstsq(design[train], x[train], rcond=None)[0]
    assert np.allclose(np.array([got[i] for i in range(240)]), want)
    constant = confounds.residualised(space, two.select("id", F.lit(4.0).alias("load")), None)
    assert np.allclose(np.array([r.vec for r in constant.orderBy("id").collect()]), x - x.mean(0))


def test_components_by_covariate(planted):
    space, covariates, *_ = planted
    found = confounds.component_association(space, covariates, "split = 'train'").cache()
    table = {r.covariate: r for r in confounds.by_covariate(found).collect()}
    assert table["load"].top_pc_r2 > 0.9 and table["decoy"].variance_weighted_r2 < 0.1 and table["kind"].variance_weighted_r2 > 0.4
    per = confounds.by_component(found, ["load", "decoy", "kind"], 3).orderBy("pc").collect()
    assert len(per) == 3 and {r.dominant_covariate for r in per} >= {"load", "kind"}
    assert all(r.dominant_r2 == max(r.r2__load, r.r2__decoy, r.r2__kind) for r in per)
    assert confounds.component_association(space.limit(0), covariates).count() == 0


def test_score_space_joins_the_battery(planted):
    space, covariates, *_ = planted
    row, curve = scoring.score_space(space, covariates, "load", {"n_clusters": 3, "anisotropy": 0.1, "intrinsic_dim": 8.0}, "raw", True, [2, 3, 4], 3, 3, 3)
    r = row.first()
    assert r.chosen_k == 3 and r.k_error == 0 and r.ari_at_true_k > 0.9 and r.gate_ran and r.gate_k_at_max_margin == 3 and r.gate_margin_at_comparison_k is None
    assert r.decode_confound_r2_linear > 0.9 and r.decode_decoy_max_r2_nonlinear < 0.3 and r.pcr_decoy_max_variance_weighted_r2 is not None and r.mean_cosine_post_prep is None
    assert math.isclose(r.rankme_minus_intrinsic_dim, r.rankme - 8, abs_tol=1e-4)
    assert sorted(c.k for c in curve.collect()) == [2, 3, 4] and {"mean_ari", "strength_std", "null_p95", "scaling"} <= set(curve.columns)
    none = scoring.truth_row(space.withColumn("label", F.lit(None).cast("long")), 3, 4)
    assert none == {"n_true_clusters": 3, "k_error": None, "ari_at_chosen_k": None, "ari_at_true_k": None}
    assert scoring.gate_row(None)["gate_ran"] is False


def test_run_clustering(planted):
    space, *_ = planted
    out = scoring.run_clustering(space, "raw", [2, 3, 4], 3)
    labels = out["labels"].toPandas().set_index("id")
    truth = planted[4]
    assert len({(truth[i], labels.cluster[i]) for i in range(240)}) <= 5 and labels.confidence.between(0.3, 1).all()
    assert {r.split for r in out["metrics"].collect()} == {"train", "val"} and out["sizes"].agg(F.sum("n")).first()[0] == 240


def test_result_tables(spark):
    names = "cell_id string, scaling string, separation double, structure string, gate_ran boolean, gate_any_k_beats_null boolean, gate_max_margin double, gate_k_at_max_margin long, chosen_k long, ari_at_true_k double, silhouette double, strength_at_chosen_k double"
    rows = [
        ("separation-2.0-s0", "spherical", 2.0, "blobs", True, True, 0.2, 4, 4, 0.5, 0.1, 0.8), ("separation-2.0-s1", "spherical", 2.0, "blobs", True, True, 0.05, 3, 5, 0.7, 0.3, 0.9),
        ("separation-2.0-s2", "spherical", 2.0, "blobs", False, None, None, None, 4, None, float("nan"), 0.7), ("base-s0", "spherical", 4.0, "blobs", False, None, None, None, None, 1.0, 0.4, None),
        ("base-s0", "raw", 4.0, "blobs", True, True, 0.9, 4, 4, 1.0, 0.4, 1.0), ("continuum-2.0-s0", "spherical", 2.0, "continuum", True, False, -0.01, 2, 2, None, 0.2, 0.5),
    ]
    scored = spark.createDataFrame(rows, names)
    sep = {r.separation: r for r in tables.separation_table(scored).collect()}
    assert (sep[2.0].verdict, sep[2.0].margin, sep[2.0].k_at_max_margin, sep[2.0].chosen_k, sep[2.0].ari_at_true_k, sep[2.0].silhouette) == ("mixed", 0.125, "3, 4", "4, 4, 5", 0.6, 0.2)
    assert (sep[4.0].verdict, sep[4.0].k_at_max_margin, sep[4.0].chosen_k) == ("-", "-", "-")
    cont = {(r.separation, r.structure): r.verdict for r in tables.continuum_table(scored).collect()}
    assert cont == {(2.0, "blobs"): "mixed", (2.0, "continuum"): "CONTINUOUS"}
    subset = {(r.cell_id, r.scaling): (r.sweep, r.runs) for r in scored.select("cell_id", "scaling", tables.sweep_of(F.col("cell_id")).alias("sweep"), tables.runs_null_gate(F.col("cell_id"), F.col("scaling")).alias("runs")).collect()}
    assert subset[("base-s0", "spherical")] == ("base", True) and subset[("base-s0", "raw")] == ("base", False) and subset[("separation-2.0-s1", "spherical")] == ("separation", True)
    ids = spark.createDataFrame([("cone-only-0.6-s2",), ("n-patients-500-s0",), ("intrinsic-dim-8-s1",)], "c string")
    got = [(r.s, r.g) for r in ids.select(tables.sweep_of(F.col("c")).alias("s"), tables.runs_null_gate(F.col("c"), F.lit("raw")).alias("g")).collect()]
    assert got == [("cone-only", True), ("n-patients", False), ("intrinsic-dim", False)]


def test_index_levels_and_refusals(spark):
    events = spark.createDataFrame([(1, None, "A/x", 1.0), (1, "2020-01-02 00:00:00", "A/y", float("nan")), (2, "2020-01-01 00:00:00", "B/z", None)], "person_id long, t string, code string, numeric_value double").withColumn("time", F.col("t").cast("timestamp_ntz")).drop("t")
    labels = spark.createDataFrame([(1, "2020-05-01 00:00:00", "a"), (1, "2020-05-01 00:00:00", "b"), (9, "2020-05-01 00:00:00", "a"), (2, "2020-06-01 00:00:00", "b"), (2, None, "a")], "patient_id long, t string, task string").withColumn("prediction_time", F.col("t").cast("timestamp_ntz"))
    index, dropped = tl.build_index("perlabel", events, labels)
    assert index.count() == 2 and [r.person_id for r in dropped.collect()] == [9]
    assert tl.build_index("perlabel-scout", events, labels, ("a",))[0].count() == 1
    assert tl.build_index("lastevent", events)[0].count() == 2
    for level, given, said in (("shared", events, "outcome window"), ("other", events, "unknown"), ("lastevent", None, "events"), ("perlabel", events, "labels")):
        with pytest.raises(ValueError, match=said):
            tl.build_index(level, given)
    assert [(r.pos, r.code, r.value) for r in tl.person_events(events, 1).collect()] == [(1, "A/x", 1.0), (2, "A/y", None)]
    assert tl.model_events(events).where("event.value is null").count() == 2
    numbered = tl.numbered_index(spark.createDataFrame([(i % 37, None) for i in range(37)], "person_id long, cutoff timestamp_ntz").repartition(6))
    assert [(r.pos, r.person_id) for r in numbered.orderBy("pos").collect()] == [(i + 1, i) for i in range(37)]
    batches = tl.index_batches(numbered.select("person_id", "cutoff"), 10).orderBy("batch").collect()
    assert [(b.batch, b.n_anchors, b.first_pos) for b in batches] == [(0, 10, 1), (1, 10, 11), (2, 10, 21), (3, 7, 31)]
    assert tl.numbered_index(numbered.select("person_id", "cutoff").limit(0)).count() == 0


def test_masked_pooling(spark):
    states = [[1.0, 2.0], [3.0, 4.0], [50.0, 60.0]]
    rows = spark.createDataFrame([(states, [1, 1, 0]), (states, [0, 0, 0]), (states, [1, 1, 1])], "h array<array<double>>, m array<int>")
    got = rows.select(pool(F.col("h"), F.col("m"), "last").alias("a"), pool(F.col("h"), F.col("m"), "mean").alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [([3.0, 4.0], [2.0, 3.0]), ([1.0, 2.0], [0.0, 0.0]), ([50.0, 60.0], [18.0, 22.0])]
    with pytest.raises(ValueError, match="pooling"):
        pool(F.col("h"), F.col("m"), "first")


def test_base_codes_and_registry(spark):
    tokens = spark.createDataFrame([("LAB/1 || 2.0 - 4.0",), ("LAB/1 || high || x",), ("[SEP]",), ("RX/2",), (None,)], "token string")
    assert sorted(r.code for r in scores.known_base_codes(tokens).collect()) == ["LAB/1", "RX/2"]
    passes = spark.createDataFrame([("gpt", "base", 512), ("gpt", "base", 512), ("gpt", "base", 1024), (None, "base", 1)], "family string, size string, context long")
    cells = registry.cells(passes)
    assert cells.count() == 5
    grouped = {r.extraction_key: r.members for r in registry.poolings_by_extraction(cells).collect()}
    assert grouped == {"gpt-base-512": "gpt-base-512-last gpt-base-512-mean", "gpt-base-1024": "gpt-base-1024-last gpt-base-1024-mean"}
    rows = spark.createDataFrame([("gpt-base-512-last", 1), ("unknown", 2)], "cell_id string, v int")
    out = registry.with_identity(rows, cells, "d", "lastevent", "raw")
    assert out.columns[:4] == ["dataset", "anchor", "cell_id", "scaling"] and out.columns[-1] == "v" and out.count() == 1


def test_completion_and_records(spark, tmp_path):
    index = spark.createDataFrame([(1, 5), (1, None), (2, 5), (2, 5)], "p long, c long")
    measured = spark.createDataFrame([("a", 1, 5), ("a", 1, None), ("a", 2, 5), ("a", 3, 5), ("b", 1, 5)], "g string, p long, c long")
    got = {r.g: (r.n_expected, r.n_found, r.n_missing, r.verdict) for r in validation.completion(index, measured, ["p", "c"], ["g"]).collect()}
    assert got == {"a": (3, 3, 0, "PASS"), "b": (3, 1, 2, "FAIL")}
    files.write_record(measured, str(tmp_path / "record"))
    assert files.read_record(spark, str(tmp_path / "record")).where("g = 'a'").count() == 4
    measured.write.parquet(str(tmp_path / "rows"))
    assert files.parquet_rows(spark, str(tmp_path / "rows")) == 5
