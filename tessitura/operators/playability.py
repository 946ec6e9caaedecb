"""What a hand can play, row-local."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hand_span(midis: Column, span: int, most: int = 5, prefer: str = "outer") -> Column:
    """The notes, distinct and in order, that one hand reaches: at most ``most`` within ``span`` semitones.

    A single note and what fits already stay. Else each note starts a window of what is in
    reach; too many in it are cut to the lowest, the highest, or (``outer``) both ends with
    evenly spaced notes between; the window of most notes wins, then the lower or higher
    mean, or the one with the chord's own ends; of equals the lowest.
    """
    notes = F.array_sort(F.array_distinct(midis))
    low, high = F.array_min(midis), F.array_max(midis)

    def cut(w: Column) -> Column:
        n = F.size(w)
        if prefer == "lowest":
            few = F.slice(w, 1, most)
        elif prefer == "highest":
            few = F.slice(w, F.greatest(n - most + 1, F.lit(1)), F.lit(most))
        else:
            middle = F.slice(w, F.lit(2), F.greatest(n - 2, F.lit(0)))
            step = F.greatest(F.lit(1), F.floor((n - 2) / (most - 1)).cast("int"))
            spaced = F.slice(F.filter(middle, lambda _, j: F.pmod(j, step) == 0), 1, most - 2)
            few = F.array_sort(F.concat(F.slice(w, 1, 1), spaced, F.slice(w, -1, 1)))
        return F.when(n > most, few).otherwise(w)

    def score(w: Column) -> Column:
        n = F.size(w)
        mean = F.aggregate(w, F.lit(0), lambda a, x: a + x) / n
        if prefer == "lowest":
            return n * 100 - mean
        if prefer == "highest":
            return n * 100 + mean
        return (n * 100 + F.when(F.array_contains(w, low), 50).otherwise(0) + F.when(F.array_contains(w, high), 30).otherwise(0)).cast("double")

    windows = F.transform(notes, lambda s: cut(F.filter(notes, lambda x: (x >= s) & (x <= s + span))))
    best = F.array_max(F.transform(windows, lambda w, i: F.struct(score(w).alias("score"), (-i).alias("early"), w.alias("notes"))))["notes"]
    fits = (high - low <= span) & (F.size(notes) <= most)
    return F.when((F.size(midis) <= 1) | fits, notes).otherwise(best)
