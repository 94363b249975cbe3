"""Streams give the batch results whatever the chunks' sizes and order."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import decode as D
from pulsegrid.operators import select as K
from pulsegrid.operators import stats as A
from pulsegrid.streaming import tracks as R

PCM = "track_id int, chunk_no long, start_sample long, pcm array<float>, is_last boolean"


def chunked(size, n=400):
    rng = np.random.default_rng(3)
    out = []
    for t in (1, 2):
        x = rng.normal(size=n).astype("f4")
        k = -(-n // size)
        out += [(t, i, i * size, [float(v) for v in x[i * size : (i + 1) * size]], i == k - 1) for i in range(k)]
    return out


def run(spark, df, make, tmp):
    """Write the rows as files, one chunk in three to each, and stream them file by file."""
    for k in (2, 0, 1):
        df.where(F.col("chunk_no") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")
    q = make(stream).writeStream.format("memory").queryName("out_" + tmp.name.replace("-", "_")).outputMode("append").option("checkpointLocation", f"{tmp}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out_" + tmp.name.replace("-", "_")).collect()


@pytest.mark.parametrize("size", [16, 50])
def test_phase_energy(spark, tmp_path, size):
    df = spark.createDataFrame(chunked(size), PCM)
    want = {(r.track_id, r.frame): r.energy for r in D.phase_energy(df, 20, 64.0, 4.0).collect()}
    got = {(r.track_id, r.frame): r.energy for r in run(spark, df, lambda s: R.stream_phase_energy(s, 20, 64.0, 4.0), tmp_path)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_resample(spark, tmp_path):
    df = spark.createDataFrame(chunked(37), PCM)
    flat = df.select("track_id", F.posexplode("pcm").alias("p", "v"), "start_sample").select("track_id", (F.col("start_sample") + F.col("p")).alias("sample"), F.col("v").cast("double").alias("x"))
    for i, ratio in enumerate((0.6, 1.7)):
        want = {(r.track_id, r.i): r.x for r in K.resample_linear(flat, ratio).collect()}
        (tmp_path / str(i)).mkdir()
        got = {(r.track_id, r.i): r.x for r in run(spark, df, lambda s, ratio=ratio: R.stream_resample(s, ratio), tmp_path / str(i))}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_admission(spark, tmp_path):
    df = spark.createDataFrame(chunked(40), PCM)
    got = run(spark, df, lambda s: R.stream_admission(s, 100, 150, 0.01, 25), tmp_path)
    assert {t: sum(r.n for r in got if r.track_id == t and r.kind == "signal") for t in (1, 2)} == {1: 150, 2: 150}
    one = sorted((r.start, r.kind, r.n, r.last_active) for r in got if r.track_id == 1)
    assert one == [(0, "silence", 25, -1), (25, "signal", 20, 19), (45, "signal", 40, 59), (85, "signal", 40, 99), (125, "signal", 40, 139), (165, "signal", 10, 149)]


def test_a_lost_chunk_does_not_stop_its_track(spark, tmp_path):
    df = spark.createDataFrame(chunked(40), PCM)
    lost = df.where("not (track_id = 1 and chunk_no = 1)")
    got = run(spark, lost, lambda s: R.stream_admission(s, 0, 10_000, 0.01, most_held=6), tmp_path)
    assert {t: sum(r.n for r in got if r.track_id == t) for t in (1, 2)} == {1: 360, 2: 400}
    assert all(r.late_chunk is None for r in got)
    (tmp_path / "waits").mkdir()  # without a bound it waits, and chunk 0 is all that is known to be in order
    got = run(spark, lost, lambda s: R.stream_admission(s, 0, 10_000, 0.01), tmp_path / "waits")
    assert {t: sum(r.n for r in got if r.track_id == t) for t in (1, 2)} == {1: 40, 2: 400}


def test_a_late_chunk_is_told(spark, tmp_path):
    rows = chunked(40)
    for late in (False, True):
        spark.createDataFrame([r for r in rows if (r[0] == 1 and r[1] == 1) == late], PCM).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(PCM).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    held = R.stream_admission(stream.withColumn("is_last", F.lit(False)), 0, 10_000, 0.01, most_held=3)
    q = held.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("late").collect()
    assert [(r.track_id, r.late_chunk, r.n) for r in got if r.late_chunk is not None] == [(1, 1, None)]
    assert {t: sum(r.n for r in got if r.track_id == t and r.n) for t in (1, 2)} == {1: 360, 2: 400}


@pytest.mark.parametrize("size", [13, 64])
def test_window_merge_equals_the_batch_merge(spark, tmp_path, size):
    """Windows cut from the whole signal and merged by A3, and one padded window of the rest."""
    length, hop, per, border, n = 48, 16, 8, 1, 400
    infer = lambda x: np.abs(x).reshape(-1, 8).mean(1) * np.arange(1, 7)
    df = spark.createDataFrame(chunked(size, n), PCM)
    want, rows = {}, []
    for t in (1, 2):
        x = np.concatenate([np.array(r.pcm, float) for r in df.where(f"track_id = {t}").orderBy("chunk_no").collect()])
        starts = range(0, n - length + 1, hop)
        rows += [(t, o // per, infer(x[o : o + length]).tolist()) for o in starts]
        rest = starts[-1] + hop
        padded = infer(np.concatenate([x[rest:], np.zeros(length - (n - rest))]))
        for i, v in enumerate(padded):
            want[t, rest // per + i] = v
    merged = A.merge_windows(spark.createDataFrame(rows, "track_id int, start long, values array<double>"), border).collect()
    for r in merged:
        want[r.track_id, r.frame] = max(want.get((r.track_id, r.frame), 0.0), r.value)
    got = {(r.track_id, r.frame): r.value for r in run(spark, df, lambda s: R.stream_window_merge(s, length, hop, per, infer, border), tmp_path)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tempo_anchor(spark, tmp_path):
    # peaks, autocorr, comb, beats of a window
    given = [(120, 0, 120, 0), (0, 0, 121, 0), (124.5, 0, 0, 0), (150, 0, 90, 0), (0, 150, 151, 90), (0, 0, 0, 0), (None, 0, 153, 0)]
    rows = [(1, i, *[None if v is None else float(v) for v in e], i == 6) for i, e in enumerate(given)]
    df = spark.createDataFrame(rows, "track_id int, chunk_no long, peaks double, autocorr double, comb double, beats double, is_last boolean")
    got = sorted((r.step, r.action, round(r.reference, 3), r.support) for r in run(spark, df, R.stream_tempo_anchor, tmp_path))
    assert got == [(0, "init", 120.0, 2), (1, "blend", 120.3, 1), (2, "switch", 124.5, 1), (3, "hold", 124.5, 1), (4, "switch", 150.5, 2), (5, "init", 0.0, 0), (6, "blend", 151.25, 1)]


def test_windows_and_envelope(spark, tmp_path):
    df = spark.range(0, 600).select(F.lit(1).alias("track_id"), F.timestamp_seconds("id").alias("ts"), ((F.col("id") % 7) / 7.0).alias("value"), F.col("id").alias("chunk_no"))
    rows = df.orderBy("chunk_no").coalesce(1)
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for i, make in enumerate((lambda s: R.stream_windows(s, "20 seconds", "10 seconds", "5 seconds"), lambda s: R.stream_envelope(s, "10 seconds", "5 seconds"))):
        q = make(stream).writeStream.format("memory").queryName(f"w{i}").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp{i}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = spark.table(f"w{i}").collect()
        assert len(got) >= 55
        assert i or all(abs(r.value - 6 / 7) < 1e-9 for r in got if r.n == 20)


class _Handle:
    """A state of one key that counts calls to its map."""

    def __init__(self):
        self.own, self.held, self.calls = [], {}, 0

    def getValueState(self, *_):
        own = self.own
        return SimpleNamespace(exists=lambda: bool(own), get=lambda: own[-1], update=own.append, clear=own.clear)

    def getMapState(self, *_):
        def call(f):
            def counted(*a):
                self.calls += 1
                return f(*a)

            return counted

        held = self.held
        return SimpleNamespace(containsKey=call(held.__contains__), getValue=call(held.__getitem__), removeKey=call(held.pop), updateValue=call(held.__setitem__), keys=call(lambda: list(held)), clear=call(held.clear))


def test_chunks_in_their_turn_do_not_touch_the_map():
    """r5_stream_tempo_anchor: two state calls a chunk and more before; chunks ahead still wait, and come out in order."""
    step = lambda own, x, last: ([(float(x[0]),)], own)
    handle, p = _Handle(), R.InOrder(step, (0.0,), "track_id int, value double", None, None)
    p.init(handle)

    def feed(*ns, last=None):
        rows = pd.DataFrame({"chunk_no": ns, "pcm": [[float(n)] for n in ns], "is_last": [n == last for n in ns]})
        return [v for out in p.handleInputRows((1,), iter([rows]), None) for v in out["value"]]

    assert feed(0, 2, 1, 3) == [0.0, 1.0, 2.0, 3.0] and handle.calls == 0
    assert feed(6, 5) == [] and sorted(handle.held) == [(5,), (6,)]
    assert feed(5, 4) == [4.0, 5.0, 6.0] and not handle.held
    before = handle.calls
    assert feed(8, 7, last=8) == [7.0, 8.0] and handle.calls == before and not handle.own
