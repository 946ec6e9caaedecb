"""Sound from notes: windows of sines, added where they overlap, in blocks of samples.

Notes have track_id, slice_idx, role, midi, freq, amp, confidence and harmonics (an array of
structs freq, amp); a slice begins ``hop`` samples after the one before, from slice 0. A window reaches a few
blocks of ``hop`` samples, and a block is the sum of what reaches it; so no track is in one
row. Notes with a null frequency or amplitude are silent; rows with a null track or slice are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.operators import spectra

# Role -> (most notes of a slice, part in the mix).
STEMS = {"bass": (4, 0.9), "chord": (6, 0.7), "melody": (3, 1.0)}
FULL = 0.9 * 32767


def rendered(notes: DataFrame, rate: float, window: int, hop: int, order: tuple[str, ...] = ("midi",)) -> DataFrame:
    """track_id, stem, block and values (``hop`` doubles): the lowest notes of each role in a slice, as sines under a Hann window, added up; harmonics from half the rate on are left out."""
    place = F.row_number().over(W.partitionBy("track_id", "slice_idx", "role").orderBy(*order))
    most = F.create_map(*[x for role, (n, _) in STEMS.items() for x in (F.lit(role), F.lit(n))])
    rows = notes.where(F.col("role").isin(*STEMS) & F.col("track_id").isNotNull() & F.col("slice_idx").isNotNull() & F.col("freq").isNotNull() & F.col("amp").isNotNull())
    rows = rows.withColumn("_k", place).where(F.col("_k") <= F.element_at(most, F.col("role")))
    own = F.array(F.struct(F.col("freq").cast("double").alias("freq"), F.col("amp").cast("double").alias("amp")))
    over = F.transform(F.filter("harmonics", lambda h: h["freq"] < rate / 2), lambda h: F.struct(h["freq"].cast("double").alias("freq"), h["amp"].cast("double").alias("amp")))
    waves = F.coalesce(F.concat(own, over), own)
    loud = F.coalesce("confidence", F.lit(1.0))
    waves = F.transform(waves, lambda w: F.struct(w["freq"].alias("freq"), (w["amp"] * loud).alias("amp")))
    slices = rows.groupBy("track_id", F.col("role").alias("stem"), F.col("slice_idx").cast("long").alias("slice_idx")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_k", waves.alias("w")))), lambda s: s["w"])).alias("waves"))
    parts = -(-window // hop)
    shape = spectra.window("hann", window)

    def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(window) / rate
        for batch in batches:
            flat = batch.column(3).flatten()
            freq, amp = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            ends = np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
            values = np.zeros((len(batch), parts * hop))
            for k, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
                values[k, :window] = (amp[a:b, None] * np.sin(2 * np.pi * freq[a:b, None] * t)).sum(0) * shape
            rows = pa.array(np.repeat(np.arange(len(batch)), parts))
            block = np.repeat(batch.column(2).to_numpy(zero_copy_only=False), parts) + np.tile(np.arange(parts), len(batch))
            blocks = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), hop).cast(pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(block, pa.int64()), blocks], names=["track_id", "stem", "block", "values"])

    kind = slices.schema["track_id"].dataType.simpleString()
    pieces = slices.select("track_id", "stem", "slice_idx", "waves").mapInArrow(sound, f"track_id {kind}, stem string, block long, values array<double>")
    return added(pieces)


def added(pieces: DataFrame) -> DataFrame:
    """The sum of the values of each track_id, stem and block, of which there are a few."""
    zero = F.transform(F.col("all")[0], lambda x: F.lit(0.0))
    total = F.aggregate("all", zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return pieces.groupBy("track_id", "stem", "block").agg(F.collect_list("values").alias("all")).select("track_id", "stem", "block", total.alias("values"))


def mixed(stems: DataFrame) -> DataFrame:
    """Stems with a mix of them, ``combined``."""
    part = F.create_map(*[x for role, (_, p) in STEMS.items() for x in (F.lit(role), F.lit(p))])
    scaled = stems.withColumn("_part", F.element_at(part, F.col("stem"))).withColumn("values", F.transform("values", lambda v: v * F.col("_part")))
    return stems.unionByName(added(scaled.withColumn("stem", F.lit("combined"))))


def as_samples(stems: DataFrame) -> DataFrame:
    """track_id, stem, block and samples (16 bits, cut towards zero), the loudest of a stem at nine tenths; a silent stem stays."""
    peak = stems.groupBy("track_id", "stem").agg(F.max(F.array_max(F.transform("values", lambda v: F.abs(v)))).alias("_peak"))
    scaled = F.transform("values", lambda v: F.when(F.col("_peak") > 0, v / F.col("_peak") * FULL).otherwise(v).cast("short"))
    return stems.join(peak, ["track_id", "stem"]).select("track_id", "stem", "block", scaled.alias("samples"))


def resynthesised(notes: DataFrame, rate: float, window: int, hop: int, order: tuple[str, ...] = ("midi",)) -> DataFrame:
    """track_id, stem (bass, chord, melody and combined), block and samples; blocks that nothing reaches are silent and have no row."""
    return as_samples(mixed(rendered(notes, rate, window, hop, order)))


def with_silence(blocks: DataFrame, slices: DataFrame, window: int, hop: int) -> DataFrame:
    """Blocks of every stem, with those of zeros, up to the end of the last of the slices (track_id, n)."""
    last = F.floor((F.col("n") * hop + window - 1) / F.lit(hop)).cast("long")
    stems = F.explode(F.array(*map(F.lit, [*STEMS, "combined"])))
    places = slices.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")).withColumn("stem", stems)
    return places.join(blocks, ["track_id", "stem", "block"], "left").select("track_id", "stem", "block", F.coalesce("samples", F.array_repeat(F.lit(0).cast("short"), hop)).alias("samples"))
