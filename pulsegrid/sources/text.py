"""Text sources: annotations, tracker output and run logs; and the event table as CSV."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(stem, line) of text files; the stem is the file's name without folders and extension."""
    reader = spark.read.option("pathGlobFilter", f"*{suffix}") if suffix else spark.read
    text = reader.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    return text.select(F.regexp_extract("file", r"^(.*?)(\.[^.]*)?$", 1).alias("stem"), "line")


def annotations(rows: DataFrame) -> DataFrame:
    """One beat time in seconds a line (first field); blank lines and what is no number are dropped."""
    t = F.expr("try_cast(split(trim(line), '[ \\t]+')[0] as double)")
    return rows.select("stem", t.alias("time_s")).where("time_s is not null")


def paired(audio: DataFrame, notes: DataFrame) -> DataFrame:
    """S3: audio whose stem has an annotation."""
    return audio.join(notes.select("stem").distinct(), "stem", "left_semi")


def tracker_output(rows: DataFrame) -> DataFrame:
    """Lines (stem, line_no, line) `label n t1 t2 ...`; the last line of a label wins, others are skipped."""
    parts = F.split(F.trim("line"), r"\s+")
    known = rows.withColumn("_p", parts).withColumn("label", F.get("_p", F.lit(0))).where(F.col("label").isin("beats", "downbeats"))
    last = known.withColumn("_r", F.row_number().over(W.partitionBy("stem", "label").orderBy(F.desc("line_no")))).where("_r = 1")
    n = F.expr("try_cast(get(_p, 1) as int)")
    times = F.posexplode(F.slice("_p", F.lit(3), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))))
    return last.select("stem", "label", times.alias("i", "t")).select("stem", "label", "i", F.col("t").cast("double").alias("time_s"))


NUMBER, SIGNED = "([0-9.]+)", "([0-9.eE+-]+)"
#: Lines of analyzer logs with their fields in order; (type, name) of each.
LOG_LINES = [
    (rf"Estimated BPM:\s*{NUMBER}", ["bpm"]),
    (rf"Tempo anchor:\s*peaks={NUMBER}\s+autocorr={NUMBER}\s+comb={NUMBER}\s+beats={NUMBER}\s+chosen={NUMBER}", ["anchor_peaks", "anchor_autocorr", "anchor_comb", "anchor_beats", "anchor_chosen"]),
    (rf"BPM debug: peak_median_bpm={NUMBER}", ["peak_median_bpm"]),
    (r"BPM debug: peak_hist_top=(.+)", ["peak_hist_top"]),
    (
        rf"BPM debug: peak_hist_dom top1_bpm={NUMBER} top1_w={NUMBER} top2_bpm={NUMBER} top2_w={NUMBER} top1_ratio={NUMBER} top_gap={NUMBER} top_range_bpm={NUMBER}",
        ["peak_top1_bpm", "peak_top1_w", "peak_top2_bpm", "peak_top2_w", "peak_top1_ratio", "peak_top_gap", "peak_top_range_bpm"],
    ),
    (rf"BPM debug: comb_dom top1_bpm={NUMBER} top1_w={NUMBER} top2_bpm={NUMBER} top2_w={NUMBER} top1_ratio={NUMBER} top_gap={NUMBER}", ["comb_top1_bpm", "comb_top1_w", "comb_top2_bpm", "comb_top2_w", "comb_top1_ratio", "comb_top_gap"]),
    (rf"DBN quality:\s*qpar={SIGNED}\s+qmax={SIGNED}\s+qkur={SIGNED}", ["qpar", "qmax", "qkur"]),
    (
        rf"DBN quality gate:\s*low=(\d+)\s+drop_ref=(\d+)\s+drop_global=(\d+)\s+drop_fit=(\d+)\s+downbeat_ok=(\d+)\s+downbeat_cv={SIGNED}\s+downbeat_count=(\d+)\s+used=([a-z_]+)\s+pre_override=([a-z_]+)\s+pre_bpm={SIGNED}",
        ["gate_low", "gate_drop_ref", "gate_drop_global", "gate_drop_fit", "gate_downbeat_ok", "gate_downbeat_cv", "gate_downbeat_count", "gate_used", "gate_pre_override", "gate_pre_bpm"],
    ),
    (r"First downbeat feature_frame:\s*(\d+)\s*\(s ([0-9.]+)\)(?:\s*\(sample_frame ([0-9]+)\))?", ["downbeat_frame", "downbeat_s", "downbeat_sample"]),
    (r"first beat peak: .*sample_frame=(\d+)\s*\(s ([0-9.]+)\)", ["beat_peak_sample", "first_beat_peak_s"]),
    (r"first beat floor: .*sample_frame=(\d+)\s*\(s ([0-9.]+)\)", ["beat_floor_sample", "first_beat_floor_s"]),
    (rf"max beat activation \(first 2s\):\s*{NUMBER}", ["max_beat_first2s"]),
]
TEXT_FIELDS = ["peak_hist_top", "gate_used", "gate_pre_override"]
COUNT_FIELDS = ["gate_low", "gate_drop_ref", "gate_drop_global", "gate_drop_fit", "gate_downbeat_ok", "gate_downbeat_count"]
HELPERS = ["downbeat_frame", "downbeat_s", "downbeat_sample", "beat_peak_sample", "beat_floor_sample"]


def run_logs(rows: DataFrame, sample_rate: float = 44100.0) -> DataFrame:
    """One row a log with the fields of the first line of each kind, and gate_override.

    What is absent is null; counts of the gate are 0 and its names and the histogram text '' then. The first downbeat is
    its sample over the rate where the line has one, else its seconds.
    """
    found = [F.min(F.when(F.col("line").rlike(p), F.struct(F.col("line_no"), F.array(*[F.regexp_extract("line", p, i + 1) for i in range(len(names))]).alias("v"))))["v"].alias(names[0]) for p, names in LOG_LINES]
    got = rows.groupBy("stem").agg(*found)
    fields = {n: F.get(names[0], F.lit(i)) for _, names in LOG_LINES for i, n in enumerate(names)}
    text = {n: F.coalesce(F.trim(fields[n]), F.lit("")) for n in TEXT_FIELDS}
    counts = {n: F.coalesce(fields[n].try_cast("long"), F.lit(0).cast("long")) for n in COUNT_FIELDS}
    numbers = {n: c.try_cast("double") for n, c in fields.items() if n not in (*TEXT_FIELDS, *COUNT_FIELDS)}
    first = F.coalesce(numbers["downbeat_sample"] / sample_rate, numbers["downbeat_s"])
    override = (text["gate_used"] == "downbeats_override").cast("int")
    return got.select("stem", *[c.alias(n) for n, c in (numbers | counts | text).items() if n not in HELPERS], first.alias("first_downbeat_s"), override.alias("gate_override"))


def log_beats(rows: DataFrame) -> DataFrame:
    """(stem, kind, i, sample_frame, time_s) of the first line that lists all beats, and of that for downbeats."""
    pair = r"(\d+)\(([0-9.]+)\)"
    kind = F.regexp_extract("line", r"^(Beats|Downbeats) \(all sample frames\):", 1)
    listed = rows.select("stem", "line_no", F.lower(kind).alias("kind"), F.col("line")).where("kind <> ''")
    first = listed.groupBy("stem", "kind").agg(F.min(F.struct("line_no", "line"))["line"].alias("line"))
    rest = F.regexp_extract("line", r"^[^:]*:(.*)$", 1)
    both = F.arrays_zip(F.regexp_extract_all(rest, F.lit(pair), F.lit(1)).alias("f"), F.regexp_extract_all(rest, F.lit(pair), F.lit(2)).alias("t"))
    return first.select("stem", "kind", F.posexplode(both).alias("i", "p")).select("stem", "kind", "i", F.col("p")["f"].cast("long").alias("sample_frame"), F.col("p")["t"].cast("double").alias("time_s"))


def slice_pcm(pcm: DataFrame, start_s: float, duration_s: float, rate: float) -> DataFrame:
    """Samples floor(start * rate) to ceil((start + duration) * rate), the end left out, of chunks (track_id,
    start_sample, pcm). Start and duration count as 0 where negative; a track that is shorter gives what it has."""
    start = max(start_s, 0.0)
    first, last = math.floor(start * rate), math.ceil((start + max(duration_s, 0.0)) * rate)
    near = pcm.where((F.col("start_sample") + F.size("pcm") > first) & (F.col("start_sample") < last))
    flat = near.select("track_id", "start_sample", F.posexplode("pcm").alias("i", "x")).select("track_id", (F.col("start_sample") + F.col("i")).alias("sample"), F.col("x").cast("double").alias("x"))
    return flat.where((F.col("sample") >= first) & (F.col("sample") < last))


EVENT_COLUMNS = ["index", "frame", "bpm", "energy", "peak", "style"]


def events_csv(events: DataFrame) -> DataFrame:
    """A line for each event: six decimals for doubles, the style as an integer."""
    six = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
    return events.select("track_id", F.concat_ws(",", F.col("index").cast("string"), F.col("frame").cast("string"), six("bpm"), six("energy"), six("peak"), F.col("style").cast("string")).alias("line"))


def write_events(events: DataFrame, path: str, buckets: int = 256) -> None:
    """CSV files, in folders by a hash of the track; files of a folder hold whole tracks, in order."""
    six = {c: F.format_string("%.6f", F.col(c).cast("double")) for c in ("bpm", "energy", "peak")}
    bucket = F.pmod(F.xxhash64("track_id"), F.lit(buckets)).alias("bucket")
    rows = events.select(bucket, "track_id", *EVENT_COLUMNS).withColumns(six).repartition("bucket").sortWithinPartitions("bucket", "track_id", "index")
    rows.write.partitionBy("bucket").option("header", True).csv(path)


def activation_window(frames: DataFrame, start: int, end: int, fps: float, floor: float = 0.05, most: int | None = None) -> DataFrame:
    """Frames of a range with time, floored and combined probabilities; ``most`` rows by track and frame."""
    at = lambda c: F.greatest(F.col(c), F.lit(floor))
    rows = frames.where((F.col("frame") >= start) & (F.col("frame") < end)).select(
        "track_id", "frame", (F.col("frame") / fps).alias("time_s"), "beat", "downbeat", at("beat").alias("beat_floor"), at("downbeat").alias("downbeat_floor"), F.greatest(F.col("beat") - F.col("downbeat"), F.lit(floor)).alias("combined")
    )
    return rows.orderBy("track_id", "frame").limit(most) if most else rows


def click_track(tracks: DataFrame, rate: float, pulse: int, accent: int = 4) -> DataFrame:
    """Samples of click tracks (track_id, bpm, n): a linear taper every beat, every ``accent``-th at full gain."""
    step = F.round(F.lit(rate * 60.0) / F.col("bpm")).cast("long")
    s = tracks.select("track_id", step.alias("_s"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("sample"))
    into = F.pmod("sample", "_s")
    gain = F.when(F.pmod(F.floor(F.col("sample") / F.col("_s")), F.lit(accent)) == 0, 1.0).otherwise(0.7)
    x = F.when(into < pulse, gain * (1 - into / pulse)).otherwise(0.0)
    return s.select("track_id", "sample", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)).alias("x"))


def tremolo(tracks: DataFrame, rate: float, tone: float, depth: float) -> DataFrame:
    """A sine whose loudness follows a slow sine of the track's tempo."""
    s = tracks.select("track_id", "bpm", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("sample"))
    t = F.col("sample") / rate
    slow = 1 - depth * (0.5 + 0.5 * F.sin(2 * 3.141592653589793 * F.col("bpm") / 60 * t))
    return s.select("track_id", "sample", (0.5 * slow * F.sin(2 * 3.141592653589793 * tone * t)).alias("x"))


def mix(a: DataFrame, b: DataFrame, gain: float = 1.0) -> DataFrame:
    """Sum of two sample tables, clamped."""
    both = a.unionByName(b.withColumn("x", F.col("x") * gain)).groupBy("track_id", "sample").agg(F.sum("x").alias("x"))
    return both.withColumn("x", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("x"))))
