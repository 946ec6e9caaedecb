"""Readers of note names, of which each treats flats and errors in its own way. A null name counts as one that can't be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.functions.scalars import NOTE_NAMES

# Fixed values.
BASE = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
OFFSETS = {"C": 0, "C#": 1, "Db": 1, "D": 2, "D#": 3, "Eb": 3, "E": 4, "F": 5, "F#": 6, "Gb": 6, "G": 7, "G#": 8, "Ab": 8, "A": 9, "A#": 10, "Bb": 10, "B": 11}


def _map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def midi_of_sharp_name(name: Column) -> Column:
    """By names with sharps in either case; a sharp that has no name of its own is the note above its letter; 0 for flats and what can't be read."""
    note, octave = (F.regexp_extract(name, r"^([^0-9][^0-9-]*)(-?[0-9]{1,4})$", k) for k in (1, 2))
    note = F.upper(note)
    names = F.array(*map(F.lit, NOTE_NAMES))
    known = F.array_position(names, note)
    letter = F.array_position(names, F.substring(note, 1, 1))
    place = F.when(known > 0, known - 1).when((F.substring(note, 2, 1) == "#") & (letter > 0), F.pmod(letter, F.lit(12)))
    return F.coalesce((octave.try_cast("int") + 1) * 12 + place.cast("int"), F.lit(0))


def pitch_and_octave(name: Column) -> Column:
    """A struct of pitch (a flat as ``-``) and octave of a strict name, else null."""
    letter, sign, octave = (F.regexp_extract(F.trim(name), r"^([A-G])([#b]?)(-?[0-9]{1,4})$", k) for k in (1, 2, 3))
    found = F.struct(F.concat(letter, F.when(sign == "b", "-").otherwise(sign)).alias("pitch"), octave.try_cast("int").alias("octave"))
    return F.when(octave != "", found)


def midi_of_name(name: Column) -> Column:
    """By strict names with sharps and flats; 0 for what can't be read."""
    p = pitch_and_octave(name)
    pitch = p["pitch"]
    step = F.when(pitch.endswith("#"), 1).when(pitch.endswith("-"), -1).otherwise(0)
    return F.coalesce((p["octave"] + 1) * 12 + _map(BASE)[F.substring(pitch, 1, 1)] + step, F.lit(0))


def freq_of_name(name: Column) -> Column:
    """By the name at the beginning of a text; a name without offset counts as C; 0 for what can't be read."""
    note, octave = (F.regexp_extract(name, r"^([A-G][#b]?)(-?[0-9]{1,4})", k) for k in (1, 2))
    midi = (octave.try_cast("int") + 1) * 12 + F.coalesce(_map(OFFSETS)[note], F.lit(0))
    return F.coalesce(F.lit(440.0) * F.pow(F.lit(2.0), (midi - 69) / F.lit(12.0)), F.lit(0.0))
