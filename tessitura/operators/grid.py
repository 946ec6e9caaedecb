"""Beat grids: how well onsets keep them, and tempi from the intervals between onsets.

Tracks with a null time take no part; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions import scalars
from tessitura.operators import timeline
from tessitura.sources import shared

WEIGHTS = {"bar_alignment": 0.30, "bar_coverage": 0.20, "beat_alignment": 0.15, "bpm_preference": 0.35}


def beat_to_us(beat: Column, bpm: Column, first_us: Column) -> Column:
    return first_us + beat * (F.lit(60e6) / bpm)


def bar_start_us(bar: Column, bpm: Column, first_us: Column, per_bar: int = 4) -> Column:
    return beat_to_us((bar - 1) * per_bar, bpm, first_us)


def bar_distance(beat: Column, per_bar: int = 4) -> Column:
    """Beats to the nearest start of a bar."""
    return F.abs(beat - F.rint(beat / per_bar) * per_bar)


def every(rows: DataFrame, k: int, order: list[str]) -> DataFrame:
    """Each k-th row of a track, from the first; order begins with a time."""
    return timeline.numbered(rows, order, "_k").where((F.col("_k") - 1) % k == 0).drop("_k")


def scores(onsets: DataFrame, grids: DataFrame, duration_us: int, step: float = 0.5, prefer: tuple[float, float] = (70.0, 130.0), per_bar: int = 4) -> DataFrame:
    """track_id, bpm, first_us, the four parts of a score and total, for each grid of a track that has onsets.

    The onsets meet the tempi of their track and then the grids of a tempo, of which there are
    bounded lists; a track is so spread over as many tasks as it has tempi. A bar is
    covered by the onset nearest to it, found by rounding, so bars and onsets are never paired.
    """
    key = ["track_id", "bpm", "first_us"]
    tempi = grids.select("track_id", "bpm").distinct()
    rows = onsets.select("track_id", "t_us").join(tempi, "track_id").join(grids.select(*key), ["track_id", "bpm"])
    rows = rows.withColumn("beat", (F.col("t_us") - F.col("first_us")) / (F.lit(60e6) / F.col("bpm")))
    far = bar_distance(F.col("beat"), per_bar)
    on_bar = F.when(far < 0.3, 1.0).when(far < 0.6, 0.7).when(F.abs(far - per_bar / 2) < 0.3, 0.5).otherwise(0.0)
    bars = F.greatest(F.lit(1), F.floor(F.lit(float(duration_us)) / (F.lit(60e6 * per_bar) / F.col("bpm"))))
    bar = F.rint(F.col("beat") / per_bar).cast("int")
    near = F.when((F.abs(F.col("beat") - bar * per_bar) < 0.6) & (bar >= 0) & (bar < bars), bar)
    out = rows.groupBy(*key).agg(F.avg(on_bar).alias("bar_alignment"), (F.count_distinct(near) / F.first(bars)).alias("bar_coverage"), F.greatest(F.lit(0.0), 1 - 2 * F.avg(F.abs(F.col("beat") - F.rint(F.col("beat") / step) * step))).alias("beat_alignment"))
    low, high = prefer
    off = F.when(F.col("bpm") < low, (low - F.col("bpm")) / low).when(F.col("bpm") > high, (F.col("bpm") - high) / high).otherwise(0.0)
    out = out.withColumn("bpm_preference", F.greatest(F.lit(0.0), 1 - off * 3))
    return out.withColumn("total", sum(F.lit(w) * F.col(c) for c, w in WEIGHTS.items()))


def best(scored: DataFrame) -> DataFrame:
    """The grid of highest total of each track, of equals that of lowest tempo, then earliest first beat."""
    by = W.partitionBy("track_id").orderBy(F.desc(F.round("total", 9)), "bpm", "first_us")
    return scored.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")


def gaps(onsets: DataFrame) -> DataFrame:
    """track_id and gap_us between an onset and the next."""
    rows = timeline.following(onsets.select("track_id", "t_us"), "t_us", "_next")
    return rows.select("track_id", (F.col("_next") - F.col("t_us")).alias("gap_us")).where("gap_us is not null")


def histogram(values: DataFrame, value: str, bins: int, wider: float = 0.5) -> DataFrame:
    """track_id, bin (from 0), low, width and n of every bin of equal width on a track's range, the last closed; a range of one value is widened on either side, as bins need a width."""
    ends = values.groupBy("track_id").agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    ends = ends.select("track_id", F.when(flat, F.col("_lo") - wider).otherwise(F.col("_lo")).alias("lo"), F.when(flat, F.col("_hi") + wider).otherwise(F.col("_hi")).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("int")
    n = values.join(ends, "track_id").groupBy("track_id", at.alias("bin")).agg(F.count("*").alias("n"))
    every_bin = ends.select("track_id", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return every_bin.join(n, ["track_id", "bin"], "left").select("track_id", "bin", (F.col("lo") + F.col("bin") * width).alias("low"), width.alias("width"), F.coalesce("n", F.lit(0)).alias("n"))


def interval_tempi(onsets: DataFrame, low: float = 40.0, high: float = 200.0, bins: int = 100, most: int = 5) -> DataFrame:
    """track_id, bpm, n (intervals at its peak) and place, from 1, of the likeliest tempi.

    Inner peaks of over two in a histogram of intervals, the highest first, of equals the
    faster; the median where there is none; after each its half and its double if in
    range, each tempo once. 120 for under three onsets, 120, 90 and 100 for under three
    intervals in range, with an n of 0.
    """
    counts = onsets.groupBy("track_id").agg(F.count("t_us").alias("_onsets"))
    valid = gaps(onsets).where(F.col("gap_us").between(60e6 / high, 60e6 / low))
    sums = counts.join(valid.groupBy("track_id").agg(F.count("*").alias("_valid"), F.median("gap_us").alias("_median")), "track_id", "left").fillna(0, ["_valid"])
    by = W.partitionBy("track_id").orderBy("bin")
    peaks = histogram(valid, "gap_us", bins, 500_000.0).withColumns({"_a": F.lag("n").over(by), "_b": F.lead("n").over(by)})
    peaks = peaks.where((F.col("n") > F.col("_a")) & (F.col("n") > F.col("_b")) & (F.col("n") > 2)).select("track_id", (F.lit(60e6) / (F.col("low") + F.col("width") / 2)).alias("bpm"), "n")
    peaks = peaks.withColumn("_k", F.row_number().over(W.partitionBy("track_id").orderBy(F.desc("n"), F.desc("bpm")))).where(F.col("_k") <= most)
    found = sums.where("_valid >= 3").join(peaks, "track_id", "left")
    found = found.select("track_id", F.coalesce("bpm", F.lit(60e6) / F.col("_median")).alias("b"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), F.coalesce("_k", F.lit(1)).alias("_k"))
    b = F.col("b")
    variants = F.array_compact(F.array(b, F.when(b / 2 >= low, b / 2), F.when(b * 2 <= high, b * 2)))
    found = found.select("track_id", "n", "_k", F.posexplode(variants).alias("_j", "bpm"))
    few = F.when(F.col("_onsets") < 3, F.array(F.lit(120.0))).otherwise(F.array(F.lit(120.0), F.lit(90.0), F.lit(100.0)))
    rest = sums.where("_valid < 3").select("track_id", F.lit(0).cast("long").alias("n"), F.lit(1).alias("_k"), F.posexplode(few).alias("_j", "bpm"))
    once = found.unionByName(rest).groupBy("track_id", "bpm").agg(F.min(F.struct("_k", "_j")).alias("at"), F.max("n").alias("n"))
    return once.select("track_id", "bpm", "n", F.row_number().over(W.partitionBy("track_id").orderBy("at")).alias("place"))


def _tempi(onsets: DataFrame, initial: DataFrame, low: float, high: float, prefer: tuple[int, int], heard: DataFrame | None, correlated: DataFrame | None) -> DataFrame:
    """track_id and the tempi to try: the initial one, its half and double, a raster, what was heard (give or take five) and three that agree with themselves, with what is related to them by 2 and 3/2."""
    b = F.col("bpm")
    octaves = F.transform(scalars.tempo_octaves(b, *map(float, prefer)), lambda x: x.cast("double"))
    raster = F.array(*[F.lit(float(x)) for x in range(prefer[0], prefer[1] + 1, 5)])
    out = initial.select("track_id", F.explode(F.concat(F.array(F.rint(b), F.rint(b / 2), F.rint(b * 2)), raster)).alias("bpm"))
    if heard is not None:
        near = F.transform(F.sequence(F.lit(-5), F.lit(5)), lambda d: F.rint(b) + d)
        out = out.unionByName(heard.select("track_id", F.explode(F.concat(octaves, near)).alias("bpm")))
    if correlated is not None:
        first = correlated.withColumn("_k", F.row_number().over(W.partitionBy("track_id").orderBy(F.desc("strength"), "bpm"))).where("_k <= 3")
        out = out.unionByName(first.select("track_id", F.explode(octaves).alias("bpm")))
    return out.where(F.col("bpm").between(low, high)).distinct()


def best_grid(onsets: DataFrame, initial: DataFrame, duration_us: int, low: float = 40.0, high: float = 200.0, prefer: tuple[int, int] = (70, 130), per_bar: int = 4, heard: DataFrame | None = None, correlated: DataFrame | None = None) -> DataFrame:
    """The best of all grids of a track, with the parts of its score, over tempi and phases; onsets come with initial, heard and correlated (track_id, bpm; the last with strength).

    Tempi and grids, which are read more than once, are checkpointed. Phases put one of the first 30 onsets on a beat of the first bar, or are one of 20 quarters of a
    beat; whole milliseconds. Of over 50 onsets each third is scored. Of equal grids that of
    lowest tempo, then the earliest.
    """
    marks = timeline.numbered(onsets.select("track_id", "t_us"), ["t_us"], "_n")
    many = marks.groupBy("track_id").agg((F.count("*") > 50).alias("_many"))
    tempi = shared.cut(_tempi(onsets, initial, low, high, prefer, heard, correlated).join(many, "track_id"))
    beat = F.lit(60e6) / F.col("bpm")
    back = marks.where("_n <= 30").join(tempi, "track_id").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(per_bar - 1))))
    back = back.withColumn("at", F.col("t_us") - F.col("_k") * beat).where((F.col("at") >= 0) & (F.col("at") <= beat * per_bar))
    steps = tempi.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("at", F.col("_k") * beat / 4)
    phase = (F.rint(F.col("at") / 1000) * 1000).cast("long").alias("first_us")
    grids = shared.cut(back.select("track_id", "bpm", phase).unionByName(steps.select("track_id", "bpm", phase)).distinct())
    heard_by = marks.join(many, "track_id").where("not _many or (_n - 1) % 3 = 0").select("track_id", "t_us")
    return best(scores(heard_by, grids, duration_us, prefer=tuple(map(float, prefer)), per_bar=per_bar))


def best_phase(onsets: DataFrame, tempi: DataFrame, duration_us: int, per_bar: int = 4, steps: int = 100) -> DataFrame:
    """The best first beat for a given tempo of each track (track_id, bpm), with the parts of its score; a track without onsets begins at 0.

    Phases are ``steps`` points over two bars, the first 30 onsets, and these up to three bars
    earlier; whole milliseconds. Of equal ones the earliest.
    """
    bar = F.lit(60e6 * per_bar) / F.col("bpm")
    even = tempi.select("track_id", "bpm", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("_k")).withColumn("at", F.col("_k") * (bar * 2 / (steps - 1)))
    first = timeline.numbered(onsets.select("track_id", "t_us"), ["t_us"], "_n").where("_n <= 30 and t_us >= 0").join(tempi.select("track_id", "bpm"), "track_id")
    early = first.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("at", F.col("t_us") - F.col("_k") * bar)
    early = early.where((F.col("_k") == 0) | F.col("at").between(F.lit(0), bar * 2))
    phase = (F.rint(F.col("at") / 1000) * 1000).cast("long").alias("first_us")
    grids = even.select("track_id", "bpm", phase).unionByName(early.select("track_id", "bpm", phase)).distinct()
    found = best(scores(onsets, grids, duration_us, per_bar=per_bar))
    return tempi.select("track_id", "bpm").join(found, ["track_id", "bpm"], "left").fillna(0, ["first_us"])


def found_grid(onsets: DataFrame, duration_us: int, low: float = 40.0, high: float = 200.0, prefer: tuple[int, int] = (70, 130), per_bar: int = 4, aligned: float = 0.3, bins: int = 100, heard: DataFrame | None = None, correlated: DataFrame | None = None) -> DataFrame:
    """The grid of each track with onsets: tempo from intervals, brought into the range preferred, then the best grid; where that is under ``aligned`` on bars, that from half its tempo if its bars fit better."""
    b = F.col("bpm")
    folded = F.when((b > prefer[1]) & (b / 2 >= prefer[0]), b / 2).when((b < prefer[0]) & (b * 2 <= prefer[1]), b * 2).otherwise(b)
    first = interval_tempi(onsets, low, high, bins).where("place = 1").select("track_id", folded.alias("bpm"))
    how = {"low": low, "high": high, "prefer": prefer, "per_bar": per_bar, "heard": heard, "correlated": correlated}
    found = shared.cut(best_grid(onsets, first, duration_us, **how))
    doubted = found.where(F.col("bar_alignment") < aligned)
    again = best_grid(onsets.join(doubted.select("track_id"), "track_id", "left_semi"), doubted.select("track_id", (b / 2).alias("bpm")), duration_us, **how)
    names = [c for c in found.columns if c != "track_id"]
    both = found.join(again.select("track_id", F.struct(*names).alias("again")), "track_id", "left")
    better = F.coalesce(F.col("again.bar_alignment") > F.col("bar_alignment"), F.lit(False))
    return both.select("track_id", *[F.when(better, F.col(f"again.{c}")).otherwise(F.col(c)).alias(c) for c in names])
