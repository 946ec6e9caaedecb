"""Order in time within a track, without a track in one task.

A track's time is cut into buckets. What needs the row before, after or around another is
done in each bucket, and one row for each bucket carries over what lies beyond it. Rows
without track or time have no place and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_US = 10_000_000


def _bucketed(rows: DataFrame, at: str, bucket_us: int) -> DataFrame:
    return rows.withColumn("_bucket", F.floor(F.col(at) / F.lit(bucket_us)))


def numbered(rows: DataFrame, order: list[str], into: str, bucket_us: int = BUCKET_US) -> DataFrame:
    """Rows with their number in their track, from 1; order begins with a time."""
    rows = _bucketed(rows, order[0], bucket_us)
    sizes = rows.groupBy("track_id", "_bucket").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy("track_id").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("track_id", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    here = F.row_number().over(W.partitionBy("track_id", "_bucket").orderBy(*order))
    return rows.join(before, ["track_id", "_bucket"]).withColumn(into, F.col("_before") + here).drop("_bucket", "_before")


def following(rows: DataFrame, at: str, into: str, bucket_us: int = BUCKET_US) -> DataFrame:
    """Rows with the time of the next one in their track, null for the last; of rows of a time the next has the same."""
    rows = _bucketed(rows, at, bucket_us)
    heads = rows.groupBy("track_id", "_bucket").agg(F.min(at).alias("_low"))
    heads = heads.select("track_id", "_bucket", F.lead("_low").over(W.partitionBy("track_id").orderBy("_bucket")).alias("_ahead"))
    here = F.lead(at).over(W.partitionBy("track_id", "_bucket").orderBy(at))
    return rows.join(heads, ["track_id", "_bucket"]).withColumn(into, F.coalesce(here, F.col("_ahead"))).drop("_bucket", "_ahead")


def held_by(points: DataFrame, spans: DataFrame, at: str = "t_us", carried: tuple[str, ...] = (), bucket_us: int = BUCKET_US) -> DataFrame:
    """Points with start_us and end_us, and columns carried, of the span that holds them; spans of a track don't overlap.

    As-of: a span has a mark in each bucket that it reaches, and a point takes the last mark before it in its bucket.
    """
    last = F.floor((F.col("end_us") - 1) / F.lit(bucket_us))
    marks = spans.where("end_us > start_us").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_us") / F.lit(bucket_us)), last)))
    marks = marks.select("track_id", "_bucket", F.greatest("start_us", F.col("_bucket") * bucket_us).alias("_at"), F.lit(0).alias("_point"), F.struct("start_us", "end_us", *carried).alias("_span"))
    rows = _bucketed(points, at, bucket_us).select("track_id", "_bucket", F.col(at).alias("_at"), F.lit(1).alias("_point"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_row"))
    by = W.partitionBy("track_id", "_bucket").orderBy("_at", "_point").rowsBetween(W.unboundedPreceding, 0)
    found = rows.unionByName(marks, allowMissingColumns=True).withColumn("_span", F.last("_span", ignorenulls=True).over(by))
    found = found.where((F.col("_point") == 1) & (F.col("_at") < F.col("_span.end_us")))
    return found.select(*[F.col("_row").getField(c).alias(c) for c in points.columns], *[F.col("_span").getField(c).alias(c) for c in ("start_us", "end_us", *carried)])
