"""Feature table and attributes at event time: small cases with known answers."""

from datetime import datetime as t

import pytest

from vecgauge.operators.asof_attributes import attributes_at, change_history, pivot_attributes
from vecgauge.operators.entity_features import entity_vectors, expand_features, long_features, merge_vectors

EVENTS = "person_id long, time timestamp_ntz, code string, numeric_value double, recorded_at timestamp_ntz, idx string, n long"
PANEL = "code string, panel_pos long"
AS_OF = "2025-01-01 00:00:00"
PREFIXES = {"payer": "PAYER/", "smoking": "SMOKING/"}


def events(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], EVENTS)


def panel(spark):
    return spark.createDataFrame([("A/1", 0), ("B/2", 1), ("b/2 ", 5), (None, 2), ("", 3)], PANEL)


def test_features_count_events_once_and_keep_undated(spark):
    rows = [
        (1, t(2024, 12, 31), "A/1", 2.0, t(2025, 1, 1)),
        (1, t(2024, 12, 31), " a/1\t", 3.0, t(2025, 1, 2)),  # the same event, corrected later
        (1, None, "A/1", float("nan"), None),
        (1, t(2025, 1, 1), "A/1", 9.0, None),  # not before the date
        (1, t(2024, 12, 30, 1), "b/2", None, None),
        (2, None, "B/2", 1.5, None),
        (None, t(2020, 1, 1), "A/1", 1.0, None),
        (3, t(2020, 1, 1), None, 1.0, None),
        (3, t(2020, 1, 1), " \t", 1.0, None),
        (3, t(2020, 1, 1), "OTHER", 1.0, None),
    ]
    vectors = entity_vectors(events(spark, rows), panel(spark), AS_OF)
    got = {(r.person_id, r.code): (r.n_events, r.days_ago, r.total) for r in long_features(vectors, panel(spark), AS_OF).collect()}
    assert got == {(1, "A/1"): (2, 1, 3.0), (1, "B/2"): (1, 1, 0.0), (2, "B/2"): (1, -1, 1.5)}
    wide = {r.person_id: r.asDict() for r in expand_features(vectors, panel(spark), AS_OF).collect()}
    assert wide[2] == {"person_id": 2, "n_0": 0, "days_0": None, "total_0": 0.0, "n_1": 1, "days_1": None, "total_1": 1.5}


def test_vectors_of_parts_merge(spark):
    rows = [(1, t(2024, 1, d), "A/1", float(d), None) for d in range(1, 11)]
    whole = entity_vectors(events(spark, rows), panel(spark), AS_OF)
    parts = merge_vectors(*[entity_vectors(events(spark, rows[i::3]), panel(spark), AS_OF) for i in range(3)])
    assert whole.collect() == parts.collect()


def test_features_of_nothing(spark):
    vectors = entity_vectors(events(spark, []), panel(spark), AS_OF)
    assert long_features(vectors, panel(spark), AS_OF).count() == 0
    assert expand_features(vectors, panel(spark), AS_OF).count() == 0


def at(spark, rows, moments, chunk_days=7):
    history = change_history(events(spark, [(p, when, code, None, rec) for p, when, code, rec in rows]), PREFIXES)
    asked = spark.createDataFrame(moments, "ref_kind string, ref_id long, person_id long, moment timestamp_ntz, fact string")
    out = attributes_at(history, asked, list(PREFIXES), chunk_days)
    return {(r.ref_id, r.attribute): r.code for r in out.collect()}, out


def test_only_what_was_known(spark):
    rows = [
        (1, None, "PAYER/OLD", None),  # undated and always known
        (1, t(2020, 1, 1), "PAYER/A", t(2020, 1, 5)),
        (1, t(2020, 1, 1), "payer/a", t(2020, 1, 9)),  # the same event, recorded later
        (1, t(2020, 2, 1), "PAYER/B", None),
        (1, t(2020, 1, 15), "PAYER/LATE", t(2021, 1, 1)),
        (1, t(2020, 1, 1), "SMOKING/N", t(2019, 1, 1)),  # entered before its time
    ]
    moments = [
        ("a", 1, 1, t(2019, 12, 31), "x"), ("a", 2, 1, t(2020, 1, 4), "x"), ("a", 3, 1, t(2020, 1, 5), "x"), ("a", 4, 1, t(2020, 2, 1), "x"),
        ("a", 5, 1, None, "x"), ("a", 6, 9, t(2020, 1, 1), "x"), ("a", 7, None, t(2020, 1, 1), "x"), ("a", 8, 1, t(2020, 1, 20), "x"),
    ]
    for days in (1, 7, 10_000):
        got, out = at(spark, rows, moments, days)
        assert [got[i, "payer"] for i in range(1, 9)] == ["PAYER/OLD", "PAYER/OLD", "PAYER/A", "PAYER/B", "PAYER/B", None, None, "PAYER/A"]
        assert [got[i, "smoking"] for i in (1, 2, 5)] == [None, "SMOKING/N", "SMOKING/N"]
    wide = {r.ref_id: (r.payer, r.smoking) for r in pivot_attributes(out, list(PREFIXES)).collect()}
    assert wide[4] == ("PAYER/B", "SMOKING/N") and wide[6] == (None, None)


def test_ties_latest_known_then_greatest_code(spark):
    rows = [(1, t(2020, 1, 1), "PAYER/Z", t(2020, 1, 2)), (1, t(2020, 1, 1), "PAYER/A", t(2020, 1, 3)), (1, t(2020, 1, 1), "PAYER/B", t(2020, 1, 3))]
    got, _ = at(spark, rows, [("a", 1, 1, t(2020, 1, 2), "x"), ("a", 2, 1, t(2020, 1, 3), "x")])
    assert got[1, "payer"] == "PAYER/Z" and got[2, "payer"] == "PAYER/B"


@pytest.mark.parametrize("moments", [[], [("a", 1, 1, None, "x")]])
def test_attributes_of_nothing(spark, moments):
    got, _ = at(spark, [], moments)
    assert set(got.values()) <= {None} and len(got) == 2 * len(moments)
