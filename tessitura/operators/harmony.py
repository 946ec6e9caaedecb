"""Chords: the best of roots x templates, scored once for each set of pitch classes and looked up, so that nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import scalars

# Quality -> intervals from the root, in order of preference.
FULL_TEMPLATES = {
    "maj": [0, 4, 7], "min": [0, 3, 7], "dim": [0, 3, 6], "aug": [0, 4, 8], "sus2": [0, 2, 7], "sus4": [0, 5, 7],
    "maj7": [0, 4, 7, 11], "min7": [0, 3, 7, 10], "7": [0, 4, 7, 10], "dim7": [0, 3, 6, 9], "min7b5": [0, 3, 6, 10], "minMaj7": [0, 3, 7, 11], "aug7": [0, 4, 8, 10],
    "add9": [0, 4, 7, 14], "madd9": [0, 3, 7, 14], "9": [0, 4, 7, 10, 14], "min9": [0, 3, 7, 10, 14], "maj9": [0, 4, 7, 11, 14], "11": [0, 4, 7, 10, 14, 17], "13": [0, 4, 7, 10, 14, 21],
    "6": [0, 4, 7, 9], "min6": [0, 3, 7, 9], "5": [0, 7],
}
SHORT_TEMPLATES = {
    "maj": [0, 4, 7], "min": [0, 3, 7], "dim": [0, 3, 6], "aug": [0, 4, 8], "sus2": [0, 2, 7], "sus4": [0, 5, 7],
    "maj7": [0, 4, 7, 11], "min7": [0, 3, 7, 10], "7": [0, 4, 7, 10], "dim7": [0, 3, 6, 9], "min7b5": [0, 3, 6, 10],
    "6": [0, 4, 7, 9], "min6": [0, 3, 7, 9], "add9": [0, 4, 7, 14], "9": [0, 4, 7, 10, 14], "5": [0, 7],
}
ROOT_TEMPLATES = {
    "major": [0, 4, 7], "minor": [0, 3, 7], "dim": [0, 3, 6], "aug": [0, 4, 8], "sus2": [0, 2, 7], "sus4": [0, 5, 7],
    "maj7": [0, 4, 7, 11], "min7": [0, 3, 7, 10], "dom7": [0, 4, 7, 10], "7": [0, 4, 7, 10], "dim7": [0, 3, 6, 9], "hdim7": [0, 3, 6, 10],
    "add9": [0, 4, 7, 14], "9": [0, 4, 7, 10, 14], "6": [0, 4, 7, 9], "min6": [0, 3, 7, 9],
}
FULL_BONUS = {"maj": 0.10, "min": 0.10, "dim": 0.08, "aug": 0.08, "sus2": 0.07, "sus4": 0.07, "5": 0.05, "7": 0.05, "maj7": 0.05, "min7": 0.05}
SHORT_BONUS = {"maj": 0.10, "min": 0.10, "5": 0.05, "7": 0.05, "maj7": 0.05, "min7": 0.05}
DISSONANT = [1, 2, 6, 10, 11]


def _bits(pcs: list[int]) -> int:
    return sum(1 << x for x in {p % 12 for p in pcs})


def _templates(templates: dict[str, list[int]], bonus: dict[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(q).alias("quality"), F.lit(_bits(pcs)).alias("bits"), F.lit(len({p % 12 for p in pcs})).alias("n"), F.lit(bonus.get(q, 0.0)).alias("bonus")) for k, (q, pcs) in enumerate(templates.items())])


def pitch_bits(midis: Column) -> Column:
    """The pitch classes of some notes as the bits of a number."""
    return F.aggregate(midis, F.lit(0), lambda a, m: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), scalars.pitch_class(m))))


def _count(bits: Column) -> Column:
    return F.bit_count(bits)


def _table(spark: SparkSession, templates: Column, score, bass: bool) -> DataFrame:
    """For each set of pitch classes (bits from 1 to 4095) and root the best template, of equals the first: what a row needs to look up, whatever the rows.

    score(template, notes as bits from the root on, whether the root is the lowest note).
    """

    def best(root: Column, low: bool) -> Column:
        notes = F.call_function("shiftright", "bits", root).bitwiseOR(F.call_function("shiftleft", "bits", F.lit(12) - root)).bitwiseAND(4095)
        return F.array_max(F.transform(templates, lambda t: F.struct(score(t, notes, low).alias("score"), (-t["ord"]).alias("early"), t["quality"].alias("quality"))))

    roots = F.sequence(F.lit(0), F.lit(11))
    bits = spark.range(1, 4096).select(F.col("id").cast("int").alias("bits"))
    return bits.select(F.col("bits").alias("_bits"), F.transform(roots, lambda r: best(r, False)).alias("_plain"), *([F.transform(roots, lambda r: best(r, True)).alias("_bass")] if bass else []))


def _named(rows: DataFrame, midis: str, table: DataFrame, least: float, into: str) -> DataFrame:
    """rows with a struct of name, root, quality and score, where there are two notes and the score is above least; of equal roots that of the lowest note."""
    names = F.array(*map(F.lit, scalars.NOTE_NAMES))
    notes = F.array_sort(F.array_distinct(F.array_compact(midis)))
    rows = rows.withColumns({"_notes": notes, "_bits": pitch_bits(notes)}).join(F.broadcast(table), "_bits", "left")  # 4095 rows
    low = scalars.pitch_class(F.element_at("_notes", 1))

    def tried(note: Column, i: Column) -> Column:
        root = scalars.pitch_class(note)
        t = F.when(root == low, F.element_at("_bass", root + 1)).otherwise(F.element_at("_plain", root + 1))
        return F.struct(t["score"].alias("score"), (-i).alias("early"), root.alias("root"), t["quality"].alias("quality"))

    rows = rows.withColumn("_best", F.when(F.size("_notes") > 0, F.array_max(F.transform("_notes", tried))))
    root, quality = F.col("_best.root"), F.col("_best.quality")
    suffix = F.when(quality == "maj", F.lit("")).when(quality == "min", F.lit("m")).otherwise(quality)
    found = F.struct(F.concat(F.element_at(names, root + 1), suffix).alias("name"), root.alias("root"), quality.alias("quality"), F.col("_best.score").alias("score"))
    return rows.withColumn(into, F.when((F.size("_notes") >= 2) & (F.col("_best.score") > least), found)).drop("_best", "_bits", "_notes", "_plain", "_bass")


def chord(rows: DataFrame, midis: str, into: str = "chord", least: float = 0.3) -> DataFrame:
    """Name, root, quality and score by matched notes and preferences; null for fewer than two notes or a low score, and for null or empty sets."""

    def score(t: Column, notes: Column, low: bool) -> Column:
        matched = _count(notes.bitwiseAND(t["bits"]))
        return F.when(matched >= 2, matched / t["n"] + (0.15 if low else 0.0) + t["bonus"]).otherwise(0.0)

    return _named(rows, midis, _table(rows.sparkSession, _templates(SHORT_TEMPLATES, SHORT_BONUS), score, True), least, into)


def strict_chord(rows: DataFrame, midis: str, into: str = "chord", least: float = 0.3) -> DataFrame:
    """As chord(), of more templates, less what the template misses and what it has no place for."""
    third, near = _bits([0, 3, 4]), _bits([2, 5, 9])

    def score(t: Column, notes: Column, low: bool) -> Column:
        matched = _count(notes.bitwiseAND(t["bits"]))
        missing, extra = t["bits"].bitwiseAND(F.bitwise_not(notes)), notes.bitwiseAND(F.bitwise_not(t["bits"]))
        less = _count(missing) * 20 - _count(missing.bitwiseAND(1 << 7)) * 10 + _count(missing.bitwiseAND(third)) * 20 + _count(extra) * 10 - _count(extra.bitwiseAND(near)) * 5
        s = F.greatest(F.lit(0.0), matched / t["n"] - less / F.lit(100.0)) + (0.15 if low else 0.0) + t["bonus"]
        return F.when(matched >= 2, s).otherwise(0.0)

    return _named(rows, midis, _table(rows.sparkSession, _templates(FULL_TEMPLATES, FULL_BONUS), score, True), least, into)


def chord_root(rows: DataFrame, midis: str) -> DataFrame:
    """root, type and confidence over all twelve roots, of equals the lowest; 0, unknown and 0 for null or empty sets."""

    def score(t: Column, notes: Column, low: bool) -> Column:
        matched = _count(notes.bitwiseAND(t["bits"]))
        return (matched * 10 - (_count(notes) - matched) * 3 + notes.bitwiseAND(1) * 5 + F.when(t["ord"] < 2, 2).otherwise(0)) / F.lit(10.0)

    best = F.array_max(F.transform("_plain", lambda t, r: F.struct(t["score"].alias("score"), (-r).alias("low"), t["quality"].alias("quality"))))
    table = _table(rows.sparkSession, _templates(ROOT_TEMPLATES, {}), score, False).select("_bits", best.alias("_best"))
    rows = rows.withColumn("_bits", pitch_bits(F.array_compact(midis))).join(F.broadcast(table), "_bits", "left")  # 4095 rows
    found = F.coalesce(F.col("_best.score") > 0, F.lit(False))
    out = {"root": F.when(found, -F.col("_best.low")).otherwise(0), "type": F.when(found, F.col("_best.quality")).otherwise("unknown"), "confidence": F.when(found, F.col("_best.score") / (_count(F.col("_bits")) + 1)).otherwise(0.0)}
    return rows.withColumns(out).drop("_best", "_bits")


def intervals(midis: Column) -> Column:
    """The distinct intervals above the lowest note, within an octave, in order; none without notes."""
    notes = F.array_compact(midis)
    low = F.array_min(notes)
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(notes, lambda m: F.pmod(m - low, F.lit(12))))), F.array().cast("array<int>"))


def shown(name: Column, score: Column, sure: float = 0.8, likely: float = 0.5, width: int = 12) -> Column:
    """A chord's name left-justified, with a mark of doubt; ``-`` without one."""
    mark = F.when(score >= sure, "").when(score >= likely, "?").otherwise("??")
    return F.format_string(f"%-{width}s", F.when(name.isNull(), F.lit("-")).otherwise(F.concat(name, mark)))


def tension(midis: Column) -> Column:
    """Share of dissonant pairs among the notes; 0 for fewer than two."""
    n = F.size(midis)
    rest = lambda x, i: F.transform(F.slice(midis, i + 2, n), lambda y: F.pmod(F.abs(x - y), F.lit(12)).isin(*DISSONANT).cast("int"))
    hits = F.aggregate(F.flatten(F.transform(midis, rest)), F.lit(0), lambda a, x: a + x)
    return F.when(n < 2, 0.0).otherwise(hits / (n * (n - 1) / 2))
