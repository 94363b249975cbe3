"""Adapters from the driver's tables to the library's data model, each with the same rows in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = "unix_millis(cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp))"  # the same in any session time zone
    return table(spark, sf_dir, "events").withColumn("ms", F.expr(f"unix_millis(cast(ts as timestamp)) - {zero}"))


def by_track(rows: DataFrame, n_rows: int, each: int) -> DataFrame:
    """``rows`` dealt by track in parts of about ``each`` rows, which no later step merges: what is grouped or sorted by track
    next needs no other shuffle, and a task's share does not grow with the table."""
    return rows.repartition(max(-(-n_rows // each), rows.sparkSession.sparkContext.defaultParallelism), "track_id")


def dense(cells: DataFrame, n_frames: int) -> DataFrame:
    """Frames 0..n_frames - 1 of every track in ``cells`` (one row a frame, dealt by track); what is missing is 0.0.

    A cell lays out the frames from its own to the next cell's, the first from 0 and the last to the end, so there is no
    grid to join: Spark takes a grid for as small as the list of tracks it comes from, and would broadcast it.
    """
    order = W.partitionBy("track_id").orderBy("frame")
    inside = lambda c: F.greatest(F.lit(0).cast("long"), F.least(c, F.lit(n_frames).cast("long")))
    ends = cells.withColumns({"_from": F.when(F.row_number().over(order) == 1, F.lit(0).cast("long")).otherwise(inside(F.col("frame"))), "_to": inside(F.coalesce(F.lead("frame").over(order), F.lit(n_frames)))})
    rows = ends.withColumn("_f", F.explode(F.when(F.col("_from") < F.col("_to"), F.sequence("_from", F.col("_to") - 1))))
    own = F.col("track_id").isNotNull() & (F.col("frame") == F.col("_f"))
    return rows.select("track_id", F.col("_f").alias("frame"), *[F.coalesce(F.when(own, F.col(c)), F.lit(0.0)).alias(c) for c in ("beat", "downbeat", "energy")])


def signal_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames(track_id, frame, beat, downbeat, energy): one track a user, one frame an hour, 720 frames."""
    e = _events(spark, sf_dir)
    rows = e.select(F.col("user_id").alias("track_id"), F.expr("cast(floor(ms / 3600000) as long)").alias("frame"), F.round(F.col("value") * 100).cast("long").alias("cents"), (F.col("event_type") == "purchase").alias("bought"))
    cells = (
        by_track(rows, e.count(), 50_000)
        .groupBy("track_id", "frame")
        .agg(F.sum("cents").alias("c"), F.sum(F.when(F.col("bought"), F.col("cents")).otherwise(0)).alias("p"), F.count("*").alias("n"))
        .select("track_id", "frame", F.least(F.col("c") / 20000.0, F.lit(1.0)).alias("beat"), F.least(F.col("p") / 20000.0, F.lit(1.0)).alias("downbeat"), (F.col("n") / 10.0).alias("energy"))
    )
    return dense(cells, 720)


USER_SQL = """cells as (select user_id track_id, cast(floor(((epoch_us(ts) // 1000) - 1704067200000) / 3600000) as bigint) frame,
  least(sum(cast(round(value * 100) as bigint)) / 20000.0, 1.0) beat,
  least(sum(case when event_type = 'purchase' then cast(round(value * 100) as bigint) else 0 end) / 20000.0, 1.0) downbeat,
  count(*) / 10.0 energy from events group by 1, 2),
frames as (select t.track_id, g.frame, cast(coalesce(c.beat, 0) as double) beat, cast(coalesce(c.downbeat, 0) as double) downbeat, cast(coalesce(c.energy, 0) as double) energy
  from (select distinct track_id from cells) t cross join (select cast(range as bigint) frame from range(720)) g
  left join cells c on c.track_id = t.track_id and c.frame = g.frame)"""


def signal_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames of one track a supplier, one frame a day since its first shipment; sparse, without energy."""
    li = table(spark, sf_dir, "lineitem")
    rows = by_track(li.select(F.col("l_suppkey").alias("track_id"), "l_quantity", F.col("l_shipdate").cast("date").alias("d")), li.count(), 500_000)
    days = rows.groupBy("track_id", "d").agg(F.least(F.sum("l_quantity") / 200.0, F.lit(1.0)).cast("double").alias("beat"))
    first = F.min("d").over(W.partitionBy("track_id"))
    return days.select("track_id", F.datediff("d", first).cast("long").alias("frame"), "beat")


SUPPLIER_SQL = """li as (select l_suppkey track_id, l_quantity, cast(l_shipdate as date) d from lineitem),
firsts as (select track_id, min(d) d0 from li group by 1),
frames as (select li.track_id, cast(date_diff('day', d0, d) as bigint) frame, cast(least(sum(l_quantity) / 200.0, 1.0) as double) beat
  from li join firsts using (track_id) group by 1, 2)"""


def beats_from_events(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """beats(track_id, beat_index, sample_frame): one track a user, one beat an event, 1000 samples a second."""
    order = W.partitionBy("user_id").orderBy("ms", "event_id")
    return _events(spark, sf_dir).where(where).select(F.col("user_id").alias("track_id"), (F.row_number().over(order) - 1).cast("long").alias("beat_index"), F.col("ms").alias("sample_frame"))


def beats_sql(name: str = "beats", where: str = "true") -> str:
    return f"""{name} as (select user_id track_id, cast(row_number() over (partition by user_id order by (epoch_us(ts) // 1000), event_id) - 1 as bigint) beat_index,
  (epoch_us(ts) // 1000) - 1704067200000 sample_frame from events where {where})"""


REFERENCE = "event_type in ('purchase', 'signup')"
DETECTED = "event_type not in ('purchase', 'signup')"


def pcm_from_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pcm(track_id, chunk_no, start_sample, sample_rate, pcm): one track a label, one chunk of 64 samples a vector."""
    n = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("track_id"), n.alias("chunk_no"), (64 * n).cast("long").alias("start_sample"), F.lit(64.0).alias("sample_rate"), F.col("embedding").alias("pcm"))


def samples(pcm: DataFrame) -> DataFrame:
    """samples(track_id, sample, x) of chunked pcm."""
    return pcm.select("track_id", "start_sample", F.posexplode("pcm").alias("i", "v")).select("track_id", (F.col("start_sample") + F.col("i")).alias("sample"), F.col("v").cast("double").alias("x"))


PCM_SQL = """vec as (select label track_id, row_number() over (partition by label order by vec_id) - 1 chunk_no, embedding from embeddings),
samples as (select track_id, cast(64 * chunk_no + i.k as bigint) sample, cast(embedding[i.k + 1] as double) x from vec cross join (select range k from range(64)) i)"""
