"""Onsets and notes from the spectra of frames.

Frames have track_id, frame_idx (from any number on, without gaps in a track) and samples.
What needs the frame before is done in buckets of frames, into which the last frame of the
bucket before is copied; greatest values, means and deviations are one row for each track.
Null and empty samples have no strength and no notes; empty tables give empty ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions import scalars
from tessitura.operators import peaks, signal, spectra

#: Frames of a track that are looked at together.
FRAMES = 1024
#: Share of each of the greatest flux, rise in energy and rise in high content in an onset's strength.
ONSET = {"flux": 0.4, "energy_rise": 0.3, "hfc_rise": 0.3}
#: The same for the envelope that tempo is told by, of the energy under the window.
ENVELOPE = {"flux": 0.6, "windowed_rise": 0.4}
NOTE = "midi: int, freq: double, amp: double, energy: double, confidence: double, harmonics: array<struct<freq: double, amp: double, number: int>>"


def with_last(rows: DataFrame, value: str, into: str, size: int = FRAMES) -> DataFrame:
    """Rows with a value of the frame before in their track; null for the first."""
    bucket = F.floor(F.col("frame_idx") / size)
    copies = F.when(F.pmod(F.col("frame_idx"), F.lit(size)) == size - 1, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))
    by = W.partitionBy("track_id", "_bucket").orderBy("frame_idx")
    spread = rows.withColumn("_bucket", F.explode(copies)).withColumn(into, F.lag(value).over(by))
    return spread.where(F.floor(F.col("frame_idx") / size) == F.col("_bucket")).drop("_bucket")


def strengths(frames: DataFrame, samples: str, kind: str = "hanning") -> DataFrame:
    """Frames with flux, energy_rise, windowed_rise and hfc_rise: what bins have gained, and what energy (of the plain and of the windowed frame) and high content have, since the frame before; 0 for the first."""

    def measured(x: np.ndarray) -> list[dict]:
        y = x * spectra.window(kind, x.shape[1])
        mags = np.abs(np.fft.rfft(y))
        energies = (x * x).sum(1), (y * y).sum(1), mags @ (np.arange(mags.shape[1]) + 1.0)
        return [{"mags": m.tolist(), "energy": a, "windowed": b, "hfc": c} for m, a, b, c in zip(mags, *(e.tolist() for e in energies), strict=True)]

    fields = [("mags", pa.list_(pa.float64())), *((k, pa.float64()) for k in ("energy", "windowed", "hfc"))]
    rows = frames.select("track_id", "frame_idx", F.col(samples).alias("samples")).where("track_id is not null and frame_idx is not null and size(samples) > 0")
    rows = spectra.each(rows, "samples", "now", measured, "struct<mags: array<double>, energy: double, windowed: double, hfc: double>", pa.struct(fields)).drop("samples")
    rows = with_last(rows, "now", "last")
    gain = signal.total(F.zip_with("now.mags", "last.mags", lambda x, y: F.greatest(x - y, F.lit(0.0))))
    rise = lambda k: F.when(F.col("last").isNull(), 0.0).otherwise(F.greatest(F.col(f"now.{k}") - F.col(f"last.{k}"), F.lit(0.0)))
    return rows.select("track_id", "frame_idx", F.when(F.col("last").isNull(), 0.0).otherwise(gain).alias("flux"), rise("energy").alias("energy_rise"), rise("windowed").alias("windowed_rise"), rise("hfc").alias("hfc_rise"))


def combined(measured: DataFrame, weights: dict[str, float], into: str = "strength") -> DataFrame:
    """track_id, frame_idx and the weighted sum of some columns, each over its greatest in the track where that is positive."""
    most = measured.groupBy("track_id").agg(*[F.max(k).alias(f"_{k}") for k in weights])
    parts = [F.when(F.col(f"_{k}") > 0, F.col(k) / F.col(f"_{k}")).otherwise(F.col(k)) * F.lit(w) for k, w in weights.items()]
    return measured.join(most, "track_id").select("track_id", "frame_idx", sum(parts[1:], parts[0]).alias(into))


def onset_envelope(frames: DataFrame, samples: str) -> DataFrame:
    """track_id, frame_idx and strength by which tempo is told."""
    return combined(strengths(frames, samples), ENVELOPE)


def onsets(frames: DataFrame, samples: str, rate: float, hop: int, over: float = 0.1, gap_ms: float = 30.0, prominence: float = 0.01, weights: dict[str, float] | None = None) -> DataFrame:
    """track_id, frame_idx, t_us and strength (over the track's greatest) of the frames at which something begins.

    Peaks of the combined strength that reach its mean and ``over`` of its deviation,
    ``gap_ms`` apart at least, of a prominence.
    """
    curve = combined(strengths(frames, samples), weights or ONSET)
    level = curve.groupBy("track_id").agg((F.avg("strength") + F.lit(over) * F.stddev_pop("strength")).alias("height"), F.max("strength").alias("most"))
    rows = curve.join(level, "track_id")
    found = peaks.picked(rows, "strength", "height", max(1, int(gap_ms / 1000 * rate / hop)), prominence)
    at = F.rint(F.col("frame_idx") * F.lit(hop * 1e6 / rate)).cast("long")
    return found.join(rows, ["track_id", "frame_idx"]).select("track_id", "frame_idx", at.alias("t_us"), F.when(F.col("most") > 0, F.col("strength") / F.col("most")).otherwise(F.col("strength")).alias("strength"))


def frame_at(samples: Column, seconds: Column, rate: float, size: int) -> Column:
    """The ``size`` samples around a time, from the start on where it is early, with zeros where the signal ends."""
    start = F.greatest(F.lit(0), F.floor(seconds * F.lit(rate)).cast("int") - size // 2)
    there = F.slice(samples, start + 1, F.lit(size))
    return F.concat(there, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(there)))


def harmonic_matches(freq: np.ndarray, fundamental: np.ndarray, tolerance: float = 0.03, most: int = 8) -> np.ndarray:
    """Number, from 1, of the harmonic that each frequency (columns) is of each fundamental (rows); 0 for none."""
    ratio = freq[None, :] / fundamental[:, None]
    n = np.rint(ratio)
    fits = (n >= 1) & (n <= most) & (np.abs(ratio - n) / np.maximum(n, 1) < tolerance)
    return np.where(fits, n, 0).astype(np.int64)


def harmonic_scores(freq: np.ndarray, amp: np.ndarray, fundamental: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, energy, harmonic numbers) of fundamentals: amplitudes over their numbers, a fifth more with the fundamental itself, a tenth for each two numbers in a row."""
    numbers = harmonic_matches(freq, fundamental)
    hit = numbers > 0
    score = np.where(hit, amp / np.maximum(numbers, 1), 0.0).sum(1) * np.where((numbers == 1).any(1), 1.2, 1.0)
    there = np.stack([(numbers == n).any(1) for n in range(1, 10)], 1)
    return score * (1 + 0.1 * (there[:, 1:] & there[:, :-1]).sum(1)), np.where(hit, amp, 0.0).sum(1), numbers


def notes_of(freq: np.ndarray, amp: np.ndarray, low: float, most: int, least: float) -> list[dict]:
    """Notes of a frame's peaks, strongest first: peaks and their undertones are tried in order of score (of equals the lower); one that shares over half of its peaks with those before is left out, as one under ``least`` of the best is. From the lowest note up."""
    if not len(freq):
        return []
    tried = np.unique(np.concatenate([freq, *(freq / n for n in (2, 3, 4, 5))]))
    tried = tried[(tried >= low) | np.isin(tried, freq)]
    score, energy, numbers = harmonic_scores(freq, amp, tried)
    score = np.round(score, 9)
    used, out = np.zeros(len(freq), bool), []
    for k in np.lexsort((tried, -score)):
        hit = numbers[k] > 0
        sure = score[k] / score.max() if score[k] > 0 else 0.0
        if not hit.any() or sure <= 0 or (hit & used).sum() > hit.sum() * 0.5 or sure < least:
            continue
        own = np.flatnonzero(numbers[k] == 1)
        own_amp = float(amp[own[0]]) if len(own) else 0.0
        midi = int(np.rint(69 + 12 * np.log2(tried[k] / 440.0)))
        over = [{"freq": float(freq[j]), "amp": float(amp[j]), "number": int(numbers[k][j])} for j in np.flatnonzero(numbers[k] > 1)]
        out.append({"midi": midi, "freq": float(freq[own[0]]) if len(own) else float(tried[k]), "amp": own_amp or float(energy[k]) / 3, "energy": float(energy[k]), "confidence": float(sure), "harmonics": over})
        used |= hit
        if len(out) >= most:
            break
    return sorted(out, key=lambda n: n["midi"])


def detected_notes(frames: DataFrame, mags: str, rate: float, low: float, high: float, height: float = 0.02, most: int = 6, least: float = 0.2, distance: int = 3, prominence: float = 0.01, most_peaks: int = 20) -> DataFrame:
    """frames with notes (an array of structs) of their magnitudes from ``low`` to under ``high`` Hz, by a sieve of harmonics.

    Magnitudes are those of the lower half of a transform of frames of one length, at ``rate``. A
    silent or empty band has no note, a frame without magnitudes null.
    """

    def found(x: np.ndarray) -> list[list[dict]]:
        hz = np.arange(x.shape[1]) * (rate / (2 * (x.shape[1] - 1)))
        band = slice(*np.searchsorted(hz, [low, high]).tolist())
        out = []
        for row in x:
            top = row[band].max(initial=0.0)
            at = spectra.peaks(row[band] / top, height, distance, prominence) + band.start if top > 0 else np.zeros(0, np.int64)
            at = at[np.argsort(-row[at], kind="stable")][:most_peaks]
            out.append(notes_of(hz[at], row[at], low, most, least))
        return out

    harmonic = pa.struct([("freq", pa.float64()), ("amp", pa.float64()), ("number", pa.int32())])
    kind = pa.struct([("midi", pa.int32()), *((k, pa.float64()) for k in ("freq", "amp", "energy", "confidence")), ("harmonics", pa.list_(harmonic))])
    return spectra.each(frames, mags, "notes", found, f"array<struct<{NOTE}>>", pa.list_(kind))


def note_rows(frames: DataFrame, role: str) -> DataFrame:
    """A row for each note of detected_notes(), with its name and role; columns of the names of these are replaced."""
    made = ["notes", "name", "role", *frames.schema["notes"].dataType.elementType.names]
    rows = frames.select(*[F.col(f"`{c}`") for c in frames.columns if c not in made], F.explode("notes").alias("_note")).select("*", "_note.*").drop("_note")
    return rows.withColumns({"name": scalars.note_name(F.col("midi")), "role": F.lit(role)})


TONE = "freq: double, amp: double, midi: int, harmonics: array<struct<freq: double, amp: double, number: int>>"


def claimed_tones(freq: np.ndarray, amp: np.ndarray, most: int, tolerance: float = 0.03) -> list[dict]:
    """Tones of a frame's peaks, from the lowest on: a peak that is a harmonic of a tone so far is its, of several the lowest's, else a tone of its own, ``most`` at most."""
    out: list[dict] = []
    for k in np.argsort(freq, kind="stable"):
        f, a = float(freq[k]), float(amp[k])
        for tone in out:
            n = int(np.rint(f / tone["freq"]))
            if f > tone["freq"] > 0 and n >= 2 and abs(f / tone["freq"] - n) / n < tolerance:
                tone["harmonics"].append({"freq": f, "amp": a, "number": n})
                break
        else:
            if len(out) < most:
                out.append({"freq": f, "amp": a, "midi": int(np.rint(69 + 12 * np.log2(f / 440.0))) if f > 0 else 0, "harmonics": []})
    return out


def tones(frames: DataFrame, mags: str, rate: float, low: float, high: float, height: float = 0.02, most: int = 10, distance: int = 3, prominence: float = 0.01) -> DataFrame:
    """frames with tones (an array of structs): peaks from ``low`` to under ``high`` Hz, over the whole frame's greatest magnitude, with the harmonics that they claim. A silent frame has none."""

    def found(x: np.ndarray) -> list[list[dict]]:
        hz = np.arange(x.shape[1]) * (rate / (2 * (x.shape[1] - 1)))
        band = slice(*np.searchsorted(hz, [low, high]).tolist())
        out = []
        for row in x:
            top = row.max(initial=0.0)
            at = spectra.peaks(row[band] / top, height, distance, prominence) + band.start if top >= 1e-10 else np.zeros(0, np.int64)
            out.append(claimed_tones(hz[at], row[at], most))
        return out

    harmonic = pa.struct([("freq", pa.float64()), ("amp", pa.float64()), ("number", pa.int32())])
    kind = pa.list_(pa.struct([("freq", pa.float64()), ("amp", pa.float64()), ("midi", pa.int32()), ("harmonics", pa.list_(harmonic))]))
    return spectra.each(frames, mags, "tones", found, f"array<struct<{TONE}>>", kind)


def dominant(tones_: Column, most: int = 10) -> Column:
    """An array of exactly ``most`` structs (freq, amp): tones of most harmonics and greatest amplitude first, of equals the lower, then zeros."""
    ranked = F.array_sort(F.transform(tones_, lambda t, i: F.struct((-(F.size(t["harmonics"]) * 2 + t["amp"])).alias("less"), i.alias("i"), t["freq"].alias("freq"), t["amp"].alias("amp"))))
    first = F.transform(F.slice(ranked, 1, most), lambda r: F.struct(r["freq"].alias("freq"), r["amp"].alias("amp")))
    return F.concat(first, F.array_repeat(F.struct(F.lit(0.0).alias("freq"), F.lit(0.0).alias("amp")), F.lit(most) - F.size(first)))


def frames_at(blocks: DataFrame, times: DataFrame, rate: float, size: int) -> DataFrame:
    """times (track_id, t_us, other columns) with the ``size`` samples around each as ``frame``, from the start on where it is early, with zeros past the end.

    blocks (track_id, frame_idx from 0, samples) cut a track in turns of ``size`` samples, the last one
    shorter or filled; a time meets the two blocks that it reaches, in equi-joins.
    """
    start = F.greatest(F.lit(0), F.floor(F.col("t_us") * F.lit(rate) / 1e6) - size // 2).cast("long")
    rows = times.where("t_us is not null").withColumn("_start", start).withColumn("_block", F.floor(F.col("_start") / size))
    for name, shift in (("_one", 0), ("_two", 1)):
        block = (F.col("frame_idx") - shift).cast("long").alias("_block")
        rows = rows.join(blocks.select("track_id", block, F.col("samples").cast("array<double>").alias(name)), ["track_id", "_block"], "left")
    none = F.array().cast("array<double>")
    there = F.slice(F.concat(F.coalesce("_one", none), F.when(F.size("_one") == size, F.coalesce("_two", none)).otherwise(none)), F.pmod(F.col("_start"), F.lit(size)).cast("int") + 1, F.lit(size))
    rows = rows.withColumn("frame", there).withColumn("frame", F.concat("frame", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("frame"))))
    return rows.select(*times.columns, "frame")


def melody_notes(blocks: DataFrame, onset_times: DataFrame, rate: float, size: int = 8192) -> DataFrame:
    """A row for each melody note at an onset (track_id, t_us); onsets without one have none."""
    rows = spectra.spectrum(frames_at(blocks, onset_times, rate, size), "frame", "mags", "hann", 2).drop("frame")
    return note_rows(detected_notes(rows, "mags", rate, 300.0, 2000.0, 0.03, 3, 0.25).drop("mags"), "melody")


def chord_notes(slices: DataFrame, frame: str, rate: float) -> DataFrame:
    """A row for each bass and chord note of the frames of slices."""
    rows = spectra.spectrum(slices, frame, "mags", "hann", 2).drop(frame)
    bass = note_rows(detected_notes(rows, "mags", rate, 50.0, 200.0, 0.02, 2, 0.2).drop("mags"), "bass")
    return bass.unionByName(note_rows(detected_notes(rows, "mags", rate, 130.0, 500.0, 0.02, 6, 0.2).drop("mags"), "chord"))
