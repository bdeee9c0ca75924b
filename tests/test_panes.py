from datetime import datetime, timedelta, timezone

import pytest

from quern.operators import panes

T0 = datetime(2024, 3, 1, 10, tzinfo=timezone.utc)
SCHEMA = "id long, session_id string, entry_id string, received_at timestamp, occurred_at timestamp, pane string"


def logs(spark, rows):
    return spark.createDataFrame([(i, s, e, None if r is None else T0 + timedelta(seconds=r), None if o is None else T0 + timedelta(seconds=o), "x") for i, s, e, r, o in rows], SCHEMA)


def test_first_arrival_ties_nulls_and_resends(spark):
    df = logs(spark, [(2, "a", "e", 5, 1), (1, "a", "e", 5, 2), (3, "a", "e", None, 3), (4, "a", None, 1, 1), (5, "a", None, 1, 1), (6, None, "e", 1, 1), (7, None, "e", 1, 1), (8, "b", "f", None, None)])
    assert sorted(r.id for r in panes.first_arrivals(df, "occurred_at").collect()) == [1, 4, 5, 6, 7, 8]


def test_panes_limits(spark):
    end = 3600
    df = logs(spark, [(i, "a", str(i), end + b, 10) for i, b in enumerate([-5, 300, 301, 86400, 86401])] + [(9, "a", "z", None, 20), (10, "a", "y", 5, None), (11, None, "q", 4, 3600)])
    got = {(r.session_id, r.pane - int(T0.timestamp())): (r.on_time, r.late, r.dropped) for r in panes.panes(panes.first_arrivals(df, "occurred_at"), ["session_id"]).collect()}
    assert got == {("a", 0): (3, 2, 1), (None, 3600): (1, 0, 0)}


def test_windows_recompose_panes(spark):
    df = logs(spark, [(i, "a", str(i), h * 3600 + 10, h * 3600) for i, h in enumerate([0, 0, 1, 4])])
    p = panes.panes(df, ["session_id"])
    got = {r.window_start - int(T0.timestamp()): r.on_time for r in panes.windows(p, ["session_id"], size=7200, slide=3600).collect()}
    assert got == {-3600: 2, 0: 3, 3600: 1, 10800: 1, 14400: 1}
    with pytest.raises(ValueError):
        panes.windows(p, ["session_id"], size=5400, slide=1800)


def test_before_the_epoch_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "1", datetime(1960, 1, 1, tzinfo=timezone.utc), datetime(1959, 12, 31, 23, 59, 59, tzinfo=timezone.utc), "x")], SCHEMA)
    assert panes.panes(df, ["session_id"]).first().pane == int(datetime(1959, 12, 31, 23, tzinfo=timezone.utc).timestamp())
    assert panes.panes(df.limit(0), ["session_id"]).count() == 0


def test_revisions_grow_and_stop(spark):
    end = 3600
    df = logs(spark, [(1, "a", "1", 10, 5), (2, "a", "2", end + 900, 6), (3, "a", "3", end + 950, 7), (4, "a", "4", end + 90000, 8)])
    got = sorted((r.emitted_at - int(T0.timestamp()) - end, r.records) for r in panes.revisions(df, ["session_id"]).collect())
    assert got == [(300, 1), (3900, 3)]
