"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are reduced to lower-cased words with one space between. An item of
length m may differ in ``m * share`` characters; with that error budget k it is split
into k + 1 pieces, one of which an occurrence must hold unchanged. An automaton of all
pieces finds them in one pass of each text, and Myers' bit-parallel distance verifies
the text around a hit, at whose best end the distance counts.

Items of fewer than ``SHORT`` characters have no budget: they match unchanged, and where
they have fewer than ``BARE`` (a name, a number) only as whole words. Items in scripts
without spaces are one long word, and are treated as any others.

Items are read in blocks of at most about ``BLOCK`` characters, each a pass over the texts, so
what is sent to the tasks is bounded however many items there are.

Defined cases: items without a letter or digit match nothing, nor do null texts; equal items each give their rows; repeated documents each
give their rows, an item counts once per document, at its least distance; empty tables
give an empty result. Other columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import common

WORD = re.compile(r"\w+")
#: Characters of the benchmark in a block.
BLOCK = 4_000_000
SHORT, BARE = 40, 20
FOUND = "item_id long, distance int, allowed int, match_start long, match_end long"


def reduced(text: str | None) -> str:
    return " ".join(WORD.findall(text.lower())) if text else ""


def budget(item: str, share: float) -> int:
    """Errors that an item of this length may have."""
    return max(1, int(len(item) * share)) if len(item) >= SHORT else 0


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str, masks: dict[str, int] | None = None, from_start: bool = False) -> tuple[int, int]:
    """(least distance of item to a substring of text, or to a beginning of it, end of the first such)."""
    if not item:
        return 0, 0
    masks, edge = masks or char_masks(item), int(from_start)
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(d | plus))
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | edge) & full
        down = (down << 1) & full
        plus = down | (full & ~(x | up))
        minus = up & x
        if score < best:
            best, end = score, j
    return best, end


def char_masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """Items (id, reduced text) and the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        import ahocorasick

        self.items, self.share = items, share
        self.budgets = [budget(x, share) for _, x in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, x) in enumerate(items):
            for at, piece in pieces(x, self.budgets[k]):
                where.setdefault(piece, []).append((k, at + len(piece)))
        self.masks: dict[int, dict[str, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, places)
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best occurrence of each item in a reduced text."""
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        if not self.items:
            return []
        for last, places in self.automaton.iter(text):
            for k, end in places:
                if k in best and best[k][0] == 0:
                    continue
                item, allowed = self.items[k][1], self.budgets[k]
                begin = last + 1 - end
                if begin >= 0 and text.startswith(item, begin):
                    if len(item) >= BARE or f" {item} " == f" {text} "[begin : begin + len(item) + 2]:
                        best[k] = (0, begin, begin + len(item))
                    continue
                if not allowed:
                    continue
                if (k, begin // (allowed + 1)) in tried:
                    continue
                tried.add((k, begin // (allowed + 1)))
                low = max(0, begin - 2 * allowed - 1)
                window = text[low : begin + len(item) + 2 * allowed + 1]
                if len(window) < len(item) - allowed:
                    continue
                masks = self.masks.setdefault(k, char_masks(item)) if k not in self.masks else self.masks[k]
                distance, stop = myers(item, window, masks)
                if distance <= allowed and (k not in best or distance < best[k][0]):
                    length = myers(item[::-1], window[:stop][::-1], from_start=True)[1]
                    best[k] = (distance, low + stop - length, low + stop)
        return [(k, *best[k]) for k in sorted(best)]


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.05) -> DataFrame:
    """doc_id, item_id, distance, allowed, match_start and match_end (in the reduced text) of each item that a document holds.

    Of places at equal distance the first is given, and of these the shortest.
    """
    spark = docs.sparkSession
    docs = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // BLOCK))
    out = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        known = [(r["item_id"], x) for r in rows if (x := reduced(r["text"]))]
        shared = spark.sparkContext.broadcast(known)
        out.append(docs.mapInArrow(_search(shared, share), f"doc_id long, {FOUND}"))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def _search(shared, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        matcher = Matcher(shared.value, share)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc, matcher.items[k][0], d, matcher.budgets[k], a, b) for k, d, a, b in matcher.find(reduced(text))]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                names = ["doc_id", "item_id", "distance", "allowed", "match_start", "match_end"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, share: float = 0.05) -> DataFrame:
    """docs without the rows that hold an item; rows are told apart by doc_id and text, so null ids are judged as well."""
    row = F.xxhash64("doc_id", "text")
    bad = leaks(docs.select(row.alias("doc_id"), "text"), benchmark, share).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, row == bad["_bad"], "left_anti")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
