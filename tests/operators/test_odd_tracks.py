"""Queries on tracks that the driver's small tables do not have: no downbeats, a curve of zeros, two beats."""

import duckdb
import pytest

from pulsegrid.jobs import registry
from pulsegrid.operators import select as K


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Users 0 to 11: sixty events each; those of odd users are no purchases, which leaves their downbeat curve at 0; user 12
    has two beats only, two hours apart."""
    folder = tmp_path_factory.mktemp("odd")
    duckdb.sql(f"""copy (select row_number() over () - 1 event_id, * from (
      select timestamp '2024-01-01' + to_hours(cast((i * 37 + u * 11 + i * i % 7) % 720 as int)) ts, u user_id, case when u % 2 = 0 and i % 3 = 0 then 'purchase' else 'view' end event_type, 20.0 + (i * 53 + u * 17) % 90 "value", '' props
      from range(12) a(u), range(60) b(i) union all select timestamp '2024-01-01' + to_hours(cast(h as int)), 12, 'view', 90.0, '' from (values (4), (6)) c(h))) to '{folder}/events.parquet' (format parquet)""")
    return str(folder)


def rows_of_sql(name, folder, cols):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet'")
    want = con.sql(registry.SQL[name])
    return sorted(tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall())


def test_gate_report_of_tracks_without_downbeats(spark, odd):
    df = registry.QUERIES["q5_gate_report"](spark, odd)
    got = sorted(tuple(r) for r in df.collect())
    assert got == rows_of_sql("q5_gate_report", odd, df.columns)
    by = {r[0]: r[1].split(",") for r in got}
    assert "bars_of_four" in by[1] and "bars_of_four" in by[5] and "first_bar" in by[12]


def test_rules_of_measures_that_are_not_there(spark):
    metrics = spark.createDataFrame([(1, 120.0, None, None), (2, 120.0, True, True), (3, 120.0, False, False)], "track_id int, bpm double, bars_regular boolean, one_beat_linear boolean")
    limits = spark.createDataFrame([(t, True, True) for t in (1, 2, 3)], "track_id int, need_regular_bars boolean, reject_one_beat boolean")
    assert {r.track_id: r.failed for r in K.gate_report(metrics, limits).collect()} == {1: "bars_of_four", 2: "one_beat_drift", 3: "bars_of_four"}


def test_constant_grids_of_tracks_without_downbeats(spark, odd):
    """Scores by a curve of zeros are 0, not an error, and two beats two frames apart have a tempo."""
    got = {r.track_id: r for r in registry.QUERIES["c7_refine_constant"](spark, odd).collect()}
    assert set(got) == set(range(13)) and got[12].bpm == 1500.0
    df = registry.QUERIES["a19_downbeat_phase_scores"](spark, odd)
    assert sorted(tuple(r) for r in df.collect()) == rows_of_sql("a19_downbeat_phase_scores", odd, df.columns)
