"""Column functions: pitch, names, beats and grids. Rounding is half-even throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
GRID_DURATIONS = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0]


def midi_to_freq(midi: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (midi - 69) / F.lit(12.0))


def freq_to_midi(freq: Column) -> Column:
    """Nearest note; 0 for frequencies that are not positive."""
    return F.when(freq <= 0, F.lit(0)).otherwise(F.rint(F.lit(69) + F.lit(12) * F.log2(freq / 440.0)).cast("int"))


def pitch_class(midi: Column) -> Column:
    return F.pmod(midi, F.lit(12))


def note_name(midi: Column) -> Column:
    names = F.array(*map(F.lit, NOTE_NAMES))
    return F.concat(F.element_at(names, pitch_class(midi) + 1), (F.floor(midi / 12) - 1).cast("string"))


def time_to_beat(seconds: Column, bpm: float, first: float = 0.0) -> Column:
    return (seconds - first) / F.lit(60.0 / bpm)


def bar_of(beat: Column, per_bar: int = 4) -> Column:
    """1-based bar; a pickup before the first beat is bar 0."""
    return F.when(beat < 0, F.lit(0)).otherwise(F.floor(beat / per_bar).cast("int") + 1)


def beat_in_bar(beat: Column, per_bar: int = 4) -> Column:
    return F.when(beat < 0, F.lit(1.0)).otherwise(F.pmod(beat, F.lit(float(per_bar))) + 1.0)


def bar_beat_text(bar: Column, beat: Column) -> Column:
    """``bar.beat``, with two digits of the fraction where it is over a hundredth."""
    whole = F.floor(beat).cast("int")
    part = beat - whole
    return F.when(part > 0.01, F.format_string("%d.%d.%02d", bar, whole, F.floor(part * 100).cast("int"))).otherwise(F.format_string("%d.%d", bar, whole))


def snapped(beat: Column, step: float = 0.5) -> Column:
    return F.rint(beat / step) * step


def grid_duration(beats: Column, per_bar: int = 4) -> Column:
    """A written duration: capped at 1.5 bars, at least a sixteenth, the nearest of the fixed values within 30 percent, else as it is."""
    longest = 1.5 * per_bar
    cap = max(v for v in GRID_DURATIONS if v <= longest)
    values = F.array(*map(F.lit, GRID_DURATIONS))
    nearest = F.array_min(F.transform(values, lambda v: F.struct(F.abs(v - beats).alias("far"), v.alias("value"))))
    kept = F.when(nearest["far"] / beats < 0.3, nearest["value"]).otherwise(beats)
    return F.when(beats > longest, F.lit(cap)).when(beats < 0.25, F.lit(0.25)).otherwise(kept)


def tempo_octaves(bpm: Column, low: float, high: float) -> Column:
    """Tempi related to bpm by 2, 3/2 and their inverses, within a range, rounded, distinct, in order."""
    all_ = F.array(bpm, bpm / 2, bpm * 2, bpm / 1.5, bpm * 1.5, bpm * 2 / 3, bpm * 3 / 2)
    return F.array_sort(F.array_distinct(F.transform(F.filter(all_, lambda x: (x >= low) & (x <= high)), lambda x: F.rint(x).cast("int"))))


def harmonic_number(freq: Column, fundamental: Column, tolerance: float = 0.03) -> Column:
    """Which harmonic of the fundamental a frequency is, from the second on, else null."""
    ratio = freq / fundamental
    n = F.rint(ratio)
    return F.when((fundamental > 0) & (freq > fundamental) & (n >= 2) & (F.abs(ratio - n) / n < tolerance), n.cast("int"))
