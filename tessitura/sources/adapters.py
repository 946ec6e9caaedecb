"""The driver's tables as tables of detections, pitch sets and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACKS, SLICE_US = 16, 100_000


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events, 30 days made into 300 seconds on 16 tracks."""
    k = F.get_json_object("props", "$.k").cast("int")
    t_us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 8640")
    role = F.expr("CASE event_type WHEN 'click' THEN 'melody' WHEN 'view' THEN 'chord' WHEN 'purchase' THEN 'bass' WHEN 'signup' THEN 'onset' ELSE 'unknown' END")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = events.select("event_id", F.pmod("user_id", F.lit(TRACKS)).alias("track_id"), t_us.alias("t_us"), (F.lit(36) + F.pmod(k, F.lit(48))).alias("midi"), role.alias("role"), F.col("value").alias("amp"), (F.pmod(F.col("event_id") * 7919, F.lit(1000)) / F.lit(1000.0)).alias("confidence"), k.alias("k"))
    return out.withColumn("slice_idx", F.expr(f"t_us div {SLICE_US}"))


def pitch_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One set of notes per order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    midi = (F.lit(48) + F.pmod("l_partkey", F.lit(36))).cast("int")
    return lines.groupBy(F.col("l_orderkey").alias("set_id")).agg(F.array_sort(F.collect_list(midi)).alias("midis"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as frames of 64 samples, a track per label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null and size(embedding) = 64")
    return e.select(F.col("label").alias("track_id"), F.col("vec_id").alias("frame_idx"), F.col("embedding").cast("array<double>").alias("samples"))
