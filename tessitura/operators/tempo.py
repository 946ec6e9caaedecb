"""Tempo and downbeat from onsets, per track."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.operators import spectra
from tessitura.sources import shared

#: The least part of a beat is a microsecond over at most this; tempi of up to two decimals below 655 are so exact, others within 1e-10 microseconds a beat or so.
FINEST = 1 << 16
#: The bits of a time, in microseconds, within which onsets meet each other; those above which phases of a node are summed in bins; the level of the node of all later onsets.
LEAF, LARGE, ALL = 13, 20, 63
#: Bins of phases of the largest nodes.
BINS = 512


def autocorrelation(onsets: DataFrame, bin_us: int, max_lag: int) -> DataFrame:
    """track_id, lag, strength: how onset counts per bin agree with themselves lag bins later, over lag 0.

    An equi-join on the bins that each lag reaches, so the work grows with max_lag and not
    with the square of a track. Lags at which nothing meets have no row.
    """
    bins = onsets.groupBy("track_id", F.expr(f"t_us div {bin_us}").alias("bin")).agg(F.count("*").alias("x"))
    power = bins.groupBy("track_id").agg(F.sum(F.col("x") * F.col("x")).alias("power"))
    early = bins.select("track_id", F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"), "bin", F.col("x").alias("y")).withColumn("bin", F.col("bin") + F.col("lag"))
    met = early.join(bins, ["track_id", "bin"]).groupBy("track_id", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("met"))
    return met.join(power, "track_id").select("track_id", "lag", (F.col("met") / F.col("power")).alias("strength"))


def best_lag(correlation: DataFrame) -> DataFrame:
    """The strongest lag of each track, of equals the shortest."""
    return correlation.groupBy("track_id").agg(F.max(F.struct("strength", (-F.col("lag")).alias("early"))).alias("b")).select("track_id", (-F.col("b.early")).alias("lag"), F.col("b.strength").alias("strength"))


def first_downbeat(onsets: DataFrame, bpm: float, window_us: int = 2_000_000) -> DataFrame:
    """track_id, downbeat_us: the onset within the window whose beat grid the later onsets keep best.

    A later onset within 0.15 beats of the grid adds 1 less its distance; of equal scores the
    earliest onset wins; without an onset in the window it is the track's first.

    Times are whole microseconds and so are counted in whole parts of a beat (FINEST), and onsets are not
    paired: those after the window are one node of a track, those within it are in the nodes
    of a tree by their time, where a grid asks the right half of each node that has it in its left one, and only
    times of one leaf (LEAF) meet. Distances that are the limit to the last digit, which
    rounding decides, are looked up by their phase. Distinct times are checkpointed.
    """
    beat = (Fraction(60_000_000) / Fraction(str(float(bpm)))).limit_denominator(FINEST)
    turn, parts = beat.numerator, beat.denominator
    reach = (3 * turn - 1) // 20  # less than 0.15 beats
    counts = shared.cut(onsets.groupBy("track_id", F.col("t_us").cast("long").alias("t_us")).agg(F.count("*").alias("n")))
    first = counts.groupBy("track_id").agg(F.min("t_us").alias("first"))
    marks = counts.where("t_us is not null").join(first, "track_id").select("track_id", "t_us", "n", (F.col("t_us") - F.col("first")).alias("since"), F.pmod(F.col("t_us") * parts, F.lit(turn)).alias("phase"), F.length(F.bin(window_us - 1 - F.col("first"))).alias("bits"))
    early = marks.where(F.col("t_us") < window_us).withColumn("leaf", F.shiftright("since", LEAF))
    terms = _grid_sums(marks, early, window_us, turn, reach)
    later = early.select("track_id", "leaf", "t_us", "phase", "n")
    met = early.select("track_id", "leaf", F.col("t_us").alias("at"), F.col("phase").alias("from")).join(later, ["track_id", "leaf"]).where("t_us >= at")
    around = F.pmod(F.col("phase") - F.col("from"), F.lit(turn))
    off = F.least(around, turn - around)
    terms = terms.unionByName(met.select("track_id", "at", F.when(off <= reach, F.col("n") * (turn - off)).otherwise(0).alias("term")))
    if 3 * turn % 20 == 0:
        limit = 3 * turn // 20
        ends = F.array(*[F.pmod(F.col("phase") + d, F.lit(turn)) for d in (-limit, limit)])
        met = early.select("track_id", F.col("t_us").alias("at"), F.explode(ends).alias("phase")).join(marks, ["track_id", "phase"]).where("t_us >= at")
        beats = ((F.col("t_us") - F.col("at")) / F.lit(1e6)) / F.lit(60.0 / bpm)
        terms = terms.unionByName(met.where(F.abs(beats - F.rint(beats)) < 0.15).select("track_id", "at", (F.col("n") * (turn - limit)).alias("term")))
    scored = terms.repartition("track_id", "at").groupBy("track_id", "at").agg(F.round(F.sum("term") / F.lit(float(turn)), 6).alias("score"))
    best = scored.groupBy("track_id").agg(F.max(F.struct("score", (-F.col("at")).alias("early"))).alias("b")).select("track_id", (-F.col("b.early")).alias("found"))
    return first.join(best, "track_id", "left").select("track_id", F.coalesce("found", "first").alias("downbeat_us"))


def _grid_sums(marks: DataFrame, early: DataFrame, window_us: int, turn: int, reach: int) -> DataFrame:
    """track_id, at and term, the sums over the marks of a node that lie within reach of the grid from ``at``, of turn less their distance.

    A sum is made of running counts and running sums of phases at both ends of the reach and
    before its middle. Phases run on past one turn, so that no reach is cut; those of a large
    node are summed in bins, so that none is one task.
    """
    node = ["track_id", "level", "node"]
    levels = F.concat(F.when(F.col("bits") > LEAF, F.sequence(F.lit(LEAF), F.col("bits") - 1)).otherwise(F.array().cast("array<int>")), F.array(F.lit(ALL)))
    rows = early.withColumn("level", F.explode(levels))
    rows = rows.withColumn("asks", (F.col("level") == ALL) | (F.expr("shiftright(since, level) & 1") == 0))
    rows = rows.withColumn("node", F.when(F.col("level") == ALL, F.lit(0).cast("long")).otherwise(F.expr("shiftright(since, level + 1)")))
    late = marks.where(F.col("t_us") >= window_us).withColumns({"level": F.lit(ALL), "asks": F.lit(False), "node": F.lit(0).cast("long")})
    rows = rows.select(*node, "asks", "t_us", "phase", "n").unionByName(late.select(*node, "asks", "t_us", "phase", "n"))
    x = F.col("phase")
    middle = F.when(x <= reach, x + turn).otherwise(x)
    ask = lambda k, place: F.struct(F.lit(k).alias("ask"), place.alias("x"))
    asked = F.array(ask(1, middle + reach), ask(2, middle - 1), ask(3, middle - reach - 1))
    given = F.when(x <= 2 * reach, F.array(ask(0, x), ask(0, x + turn))).otherwise(F.array(ask(0, x)))
    rows = rows.withColumn("p", F.explode(F.when(F.col("asks"), asked).otherwise(given)))
    bins = F.when(F.col("level") == ALL, BINS).when(F.col("level") > LARGE, F.least(F.lit(BINS), F.expr(f"shiftleft(1, least(level - {LARGE}, 16))"))).otherwise(1)
    rows = rows.select(*node, "t_us", F.col("p.ask").alias("ask"), F.col("p.x").alias("x"), F.when(F.col("asks"), 0).otherwise(F.col("n")).alias("n"), bins.alias("bins"))
    rows = rows.withColumn("bin", F.floor(F.col("x") * F.col("bins") / (2 * turn)).cast("int"))
    rows = rows.repartition(*node, "bin")  # Spark takes the union as dealt by track, but its two parts may be cut apart by their sizes
    sums = rows.where("bins > 1").groupBy(*node, "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("nx"))
    below = W.partitionBy(*node).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*node, "bin", F.sum("n").over(below).alias("n_below"), F.sum("nx").over(below).alias("nx_below"))
    upto = W.partitionBy(*node, "bin").orderBy("x", "ask").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.join(sums, [*node, "bin"], "left")
    n = F.sum("n").over(upto) + F.coalesce("n_below", F.lit(0))
    nx = F.sum(F.col("n") * F.col("x")).over(upto) + F.coalesce("nx_below", F.lit(0))
    rows = rows.select("track_id", F.col("t_us").alias("at"), "ask", "x", n.alias("n"), nx.alias("nx")).where("ask > 0")
    n, nx, x = F.col("n"), F.col("nx"), F.col("x")
    term = F.when(F.col("ask") == 1, (turn + x - reach) * n - nx).when(F.col("ask") == 2, 2 * nx - 2 * (x + 1) * n).otherwise((x + reach + 1 - turn) * n - nx)
    return rows.select("track_id", "at", term.alias("term"))


def tempogram(curve: DataFrame, value: str, per_second: float, low: int = 60, high: int = 160, window: float = 8.0, hop: float = 4.0) -> DataFrame:
    """track_id, start (seconds), bpm and strength of overlapping windows of a curve (track_id, frame_idx without gaps).

    In each window the whole tempo whose lag the curve agrees with best, of equals the slowest;
    120 and 0 where it agrees with none. A frame is sent to the windows that hold it, and a
    window is one bounded array. Windows lie wholly before the track's last frame.
    """
    size, step = int(window * per_second), int(hop * per_second)
    rows = curve.where("track_id is not null and frame_idx is not null").select("track_id", F.col("frame_idx").cast("long").alias("i"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x"))
    ends = rows.groupBy("track_id").agg(F.min("i").alias("lo"), (F.max("i") - F.min("i") + 1).alias("n"))
    rows = rows.join(ends, "track_id").withColumn("i", F.col("i") - F.col("lo"))
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("i") - size) / step) + 1)
    rows = rows.withColumn("w", F.explode(F.sequence(first, F.greatest(first, F.floor(F.col("i") / step))))).where((F.col("w") * step < F.col("n") - size) & (F.col("w") * step <= F.col("i")))
    windows = rows.groupBy("track_id", "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("xs"))
    tempi = np.arange(low, high + 1)
    lags = (per_second * 60 / tempi).astype(int)

    def told(x: np.ndarray) -> list[dict]:
        power = (x * x).sum(1)
        there = (lags > 0) & (lags < x.shape[1])
        r = {lag: (x[:, : x.shape[1] - lag] * x[:, lag:]).sum(1) for lag in set(lags[there].tolist())}
        strength = np.zeros((len(x), len(tempi)))
        for k in np.flatnonzero(there):
            strength[:, k] = r[lags[k]]
        strength = np.round(np.where(power > 0, 1 / np.where(power > 0, power, 1), 1)[:, None] * strength, 12)
        best = strength.argmax(1)
        most = strength[np.arange(len(x)), best]
        return [{"bpm": float(tempi[k]) if s > 0 else 120.0, "strength": float(max(s, 0.0))} for k, s in zip(best, most, strict=True)]

    kind = pa.struct([("bpm", pa.float64()), ("strength", pa.float64())])
    found = spectra.each(windows, "xs", "best", told, "struct<bpm: double, strength: double>", kind)
    return found.select("track_id", (F.col("w") * step / F.lit(float(per_second))).alias("start"), "best.bpm", "best.strength")


def steady_tempo(curve: DataFrame, tempi: DataFrame, least: float = 0.2) -> DataFrame:
    """track_id, bpm and confidence of each track of a curve: the median of its tempogram's tempi stronger than ``least``, and how little they differ; 120 and 0 without one."""
    sure = tempi.where(F.col("strength") > least).groupBy("track_id").agg(F.median("bpm").alias("bpm"), F.greatest(F.lit(0.0), 1 - F.stddev_pop("bpm") / 30).alias("confidence"))
    return curve.where("track_id is not null").select("track_id").distinct().join(sure, "track_id", "left").select("track_id", F.coalesce("bpm", F.lit(120.0)).alias("bpm"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def correlation(curve: DataFrame, value: str, max_lag: int, chunk: int = 4096) -> DataFrame:
    """track_id, n and r: how a track's curve (frame_idx without gaps) agrees with itself at lags 0 to max_lag, over lag 0, an array.

    Chunks of a track are summed apart, each with the ``max_lag`` values after it.
    """
    rows = curve.where("track_id is not null and frame_idx is not null").select("track_id", F.col("frame_idx").cast("long").alias("i"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x"))
    c = F.floor(F.col("i") / chunk)
    low = F.floor((F.col("i") - max_lag) / chunk)
    spread = rows.withColumn("c", F.explode(F.sequence(low, c)))
    kind = rows.schema["track_id"].dataType.simpleString()

    def sums(table: pa.Table) -> pa.Table:
        c = table.column("c")[0].as_py()
        x = np.zeros(chunk + max_lag)
        at = table.column("i").to_numpy() - c * chunk
        x[at] = table.column("x").to_numpy()
        r = [float(x[:chunk] @ x[lag : lag + chunk]) for lag in range(max_lag + 1)]
        one = table.column("track_id")[:1]
        return pa.table({"track_id": one, "n": pa.array([int((at < chunk).sum())], pa.int64()), "r": pa.array([r], pa.list_(pa.float64()))})

    parts = spread.groupBy("track_id", "c").applyInArrow(sums, f"track_id {kind}, n long, r array<double>")
    total = parts.groupBy("track_id").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("r")[k]) for k in range(max_lag + 1)]).alias("r"))
    return total.select("track_id", "n", F.when(F.col("r")[0] > 0, F.transform("r", lambda v: v / F.col("r")[0])).otherwise(F.col("r")).alias("r"))


def correlated_tempi(curve: DataFrame, value: str, per_second: float, low: float = 60.0, high: float = 150.0, height: float = 0.1, distance: int = 5, most: int = 10) -> DataFrame:
    """track_id, bpm and strength of the highest peaks of a curve's correlation with itself, at lags of tempi in a range."""
    first, last = int(per_second * 60 / high), int(per_second * 60 / low)
    rows = correlation(curve, value, last).withColumn("r", F.slice("r", F.lit(1), F.least(F.lit(last), F.col("n") - 1).cast("int")))

    def found(x: np.ndarray) -> list[list[dict]]:
        out = []
        for r in x:
            at = spectra.peaks(r[first:], height, distance) + first
            at = at[np.argsort(-r[at], kind="stable")][:most]
            out.append([{"bpm": 60 * per_second / int(k), "strength": float(r[k])} for k in at if k])
        return out

    kind = pa.list_(pa.struct([("bpm", pa.float64()), ("strength", pa.float64())]))
    rows = spectra.each(rows, "r", "found", found, "array<struct<bpm: double, strength: double>>", kind)
    return rows.select("track_id", F.explode("found").alias("f")).select("track_id", "f.bpm", "f.strength")
