"""The entry module: names agree, it imports without the corpus operators, SQL gives the same rows."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["w1_local_peaks", "a6_interval_stats", "a8_median_interval_bpm", "j2_nearest_match", "k8_probe_decision", "m14_event_style", "s4_read_tracker_output"]


def plain(v):
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", SAMPLE)
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    order = [want.columns.index(c) for c in cols]
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, (tuple(plain(r[i]) for i in order) for r in want.fetchall())))


def test_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_imports_without_the_corpus_operators():
    code = "import sys; sys.modules['pulsegrid.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op')] and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
