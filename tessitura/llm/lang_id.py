"""Language identification, word first with back-off to character n-grams.

A word that the model knows is scored by its log frequency in each language. An unseen
word falls back to its character n-grams (the word marked ``<word>``), the longest
length first: the first length of which it has a known n-gram decides, by the mean of
the log frequencies. A text's language has the highest sum over all its words.

All training documents are counted, and all their words and n-grams are known, whatever
their frequency. Those of at least the relative frequency ``least`` (of its length's
n-grams), so at most ``1 / least`` a table, are broadcast, which keeps hot ones out of
any shuffle; a text's other words are looked up by joins on a hash, and of those that no
training text has, the n-grams. ``least`` changes no result.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without
any training text every text is ``und``; ties go to the first language by name; repeated
rows each keep a row; an empty table gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import common

LONGEST = 4
#: N-grams that start in a piece: a longer word is taken in pieces that overlap by n - 1 letters.
PIECE = 64


def gram_keys(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, name of the n-gram) of all n-grams of the words, each marked ``<word>``."""
    marked = [(k, f"<{w}>"[at : at + PIECE + n - 1]) for k, w in enumerate(w.decode("utf-8", "replace") for w in words) for at in range(0, max(1, len(w) + 3 - n), PIECE)]
    if not marked:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.array([w for _, w in marked])
    points = text.view(np.uint32).reshape(len(text), -1).astype(np.uint64)
    if points.shape[1] < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    windows = points.shape[1] - n + 1
    key = np.zeros((len(text), windows), np.uint64)
    for i in range(n):
        key = common.mix(key * np.uint64(0x100000001B3) + points[:, i : i + windows] + np.uint64(1))
    whole = points[:, n - 1 :] != 0
    return np.repeat(np.array([k for k, _ in marked]), windows).reshape(whole.shape)[whole], key.view(np.int64)[whole]


class Tally:
    """Counts of (lang, word), given out once they pass a bounded number."""

    LIMIT = 300_000

    def __init__(self) -> None:
        self.counts: dict[str, Counter] = {}

    def rows(self, at_end: bool = False) -> Iterator[pa.RecordBatch]:
        if at_end or sum(map(len, self.counts.values())) > self.LIMIT:
            for lang, c in self.counts.items():
                yield pa.record_batch([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "times"])
            self.counts = {}


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    tally = Tally()
    for batch in batches:
        for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tally.counts.setdefault(lang, Counter()).update(common.letter_runs(text.lower()))
            yield from tally.rows()
    yield from tally.rows(True)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Sums by batch; a batch has a bounded number of words."""
    for batch in batches:
        lang, word, times = batch.columns
        for one in lang.unique().to_pylist():
            chosen = pc.equal(lang, one)
            words, weight = word.filter(chosen).to_pylist(), times.filter(chosen).to_numpy()
            for n in range(1, LONGEST + 1):
                of, key = gram_keys(words, n)
                key, at = np.unique(key, return_inverse=True)
                total = np.bincount(at, weight[of], len(key)).astype(np.int64)
                yield pa.record_batch([pa.array([one] * len(key), pa.string()), pa.array(np.full(len(key), n, np.int32)), pa.array(key), pa.array(total)], names=["lang", "n", "gram", "times"])


def word_keys(words: list[bytes]) -> np.ndarray:
    """What Spark's xxhash64 says of binary words."""
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)).view(np.int64)


class Model:
    """Log frequencies by language: of frequent words and of frequent n-grams as sorted keys with a row each; of all others as tables (key or n and gram, s0, s1, ...), which stay where they are."""

    def __init__(self, langs: list[str], words: np.ndarray, rows: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], rare_words: DataFrame | None = None, rare_grams: DataFrame | None = None):
        self.langs, self.words, self.rows, self.tables, self.rare_words, self.rare_grams = langs, words, rows, tables, rare_words, rare_grams

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rare_words": None, "rare_grams": None}

    def scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(rows of some words, which of them are frequent); zeros for the others."""
        key = word_keys(words)
        at = np.minimum(np.searchsorted(self.words, key), max(0, len(self.words) - 1))
        hit = self.words[at] == key if len(self.words) else np.zeros(len(key), bool)
        out = np.zeros((len(words), len(self.langs)))
        out[hit] = self.rows[at[hit]]
        return out, hit


def train(docs: DataFrame, least: float = 5e-7) -> Model:
    """A model of docs (text, lang); rows without either are left out."""
    docs = docs.where("text is not null and lang is not null").select("text", "lang")
    words = common.stored(docs.mapInArrow(_count_words, "lang string, word binary, times long").groupBy("lang", "word").agg(F.sum("times").alias("times")))
    grams = words.mapInArrow(_count_grams, "lang string, n int, gram long, times long").groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    grams = common.stored(grams)
    totals = {(0, r["lang"]): r["times"] for r in words.groupBy("lang").agg(F.sum("times").alias("times")).collect()}
    totals |= {(r["n"], r["lang"]): r["times"] for r in grams.groupBy("n", "lang").agg(F.sum("times").alias("times")).collect()}
    langs = sorted({lang for _, lang in totals})
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0)), [])
    total = np.array([[totals.get((n, lang), 0) for lang in langs] for n in range(LONGEST + 1)], float)
    per = [F.sum(F.when(F.col("lang") == lang, F.col("times")).otherwise(0)).alias(f"c{k}") for k, lang in enumerate(langs)]
    by_lang = words, grams
    words = common.stored(words.groupBy("word").agg(F.sum("times").alias("times"), *per))
    grams = common.stored(grams.groupBy("n", "gram").agg(F.sum("times").alias("times"), *per))
    common.dropped(*by_lang)
    distinct = [words.count(), *[0] * LONGEST]
    for r in grams.groupBy("n").count().collect():
        distinct[r["n"]] = r["count"]
    under = total + 0.5 * np.array(distinct)[:, None] + 1

    def of(n: np.ndarray) -> list:
        return [F.element_at(F.array(*[F.lit(float(x)) for x in n[:, k]]), F.col("n") + 1) for k in range(len(langs))]

    def logs(table: DataFrame, *key: str) -> DataFrame:
        return table.select(*key, "often", *[F.log((F.col(f"c{k}") + 0.5) / x).alias(f"s{k}") for k, x in enumerate(of(under))])

    floor = F.element_at(F.array(*[F.lit(float(least * t.sum())) for t in total]), F.col("n") + 1)
    words = logs(words.withColumn("n", F.lit(0)).withColumn("often", F.col("times") >= floor).withColumn("key", F.xxhash64("word")), "key")
    grams = logs(grams.withColumn("often", F.col("times") >= floor), "n", "gram")
    names = [f"s{k}" for k in range(len(langs))]
    known, kept = words.where("often").toPandas().drop_duplicates("key").sort_values("key"), grams.where("often").toPandas()
    tables = []
    for n in range(1, LONGEST + 1):
        own = kept[kept["n"] == n].sort_values("gram")
        tables.append((own["gram"].to_numpy(np.int64), own[names].to_numpy(float)))
    return Model(langs, known["key"].to_numpy(np.int64), known[names].to_numpy(float), tables, words.where("not often").drop("often"), grams.where("not often").drop("often"))


def _rare_scores(found: DataFrame, model: Model, shared: Broadcast) -> DataFrame:
    """(_id, x0, x1, ...): the sums over the words that are not frequent of each row of found (_id, _rare, _times)."""
    names = [f"s{k}" for k in range(len(model.langs))]
    spans = ", ".join(f"{x} double" for x in names)

    def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """Of each word and length, how many of its n-grams are frequent and their sums; and each that is not."""
        for whole in batches:
            for batch in (whole.slice(k, 1000) for k in range(0, len(whole), 1000)):
                words = batch.column(0).to_pylist()
                for n, (known, rows) in enumerate(shared.value.tables, 1):
                    of, key = gram_keys(words, n)
                    at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
                    hit = known[at] == key if len(known) else np.zeros(len(key), bool)
                    times = np.bincount(of[hit], minlength=len(words))
                    there = np.flatnonzero(times)
                    sums = [np.bincount(of[hit], rows[at[hit], k], len(words)).astype(float)[there] for k in range(len(names))]
                    none = of[~hit]
                    at = np.concatenate((there, none))
                    columns = [pa.array([words[k] for k in at], pa.binary()), pa.array(np.full(len(at), n, np.int32)), pa.array([None] * len(there) + key[~hit].tolist(), pa.int64()), pa.array(np.concatenate((times[there], np.ones(len(none), np.int64))))]
                    yield pa.record_batch([*columns, *(pa.array(np.concatenate((x, np.zeros(len(none))))) for x in sums)], names=["word", "n", "gram", "hits", *names])

    distinct = found.select(F.explode("_rare").alias("word")).distinct().withColumn("key", F.xxhash64("word"))
    distinct = common.stored(distinct.join(model.rare_words, "key", "left"))
    grams = common.stored(distinct.where("s0 is null").select("word").mapInArrow(gram_rows, f"word binary, n int, gram long, hits long, {spans}"))
    looked = grams.where("gram is not null").groupBy("word", "n", "gram").agg(F.sum("hits").alias("hits")).join(model.rare_grams, ["n", "gram"])
    looked = looked.select("word", "n", "hits", *[(F.col(x) * F.col("hits")).alias(x) for x in names])
    sums = grams.where("gram is null").drop("gram").unionByName(looked).groupBy("word", "n").agg(F.sum("hits").alias("hits"), *[F.sum(x).alias(x) for x in names])
    best = sums.groupBy("word").agg(F.max_by(F.struct(*[(F.col(x) / F.col("hits")).alias(x) for x in names]), "n").alias("s")).select(F.xxhash64("word").alias("key"), "s.*")
    known = common.stored(distinct.where("s0 is not null").select("key", *names).unionByName(best))
    common.dropped(distinct, grams)
    each = found.select("_id", F.explode(F.arrays_zip("_rare", "_times")).alias("w")).select("_id", F.xxhash64("w._rare").alias("key"), F.col("w._times").alias("times"))
    return each.join(known, "key").groupBy("_id").agg(*[F.sum(F.col(x) * F.col("times")).alias(f"x{k}") for k, x in enumerate(names)])


class _Memory(dict):
    """Word -> row of ``rows``, its scores; a bounded number of words."""

    LIMIT, STEP = 200_000, 100_000

    def __init__(self, model: Model):
        self.model, self.words = model, []
        self.rows = np.zeros((self.LIMIT + self.STEP, len(model.langs)))
        self.hit = np.zeros(self.LIMIT + self.STEP, bool)

    def totals(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, list[bytes], list[int]]]:
        """Of each text the sum of the scores of its frequent words, its other words and how often each is there; some words at a time."""
        out = [(np.zeros(self.rows.shape[1]), [], []) for _ in texts]
        parts = [(k, t[at : at + self.STEP]) for k, t in enumerate(texts) for at in range(0, len(t), self.STEP)]
        low = n = 0
        for end in range(len(parts) + 1):
            size = len(parts[end][1]) if end < len(parts) else 0
            if end == len(parts) or n + size > self.STEP:
                self.add(parts[low:end], out)
                low, n = end, 0
            n += size
        return out

    def add(self, parts: list[tuple[int, list[bytes]]], out: list[tuple[np.ndarray, list[bytes], list[int]]]) -> None:
        if len(self) > self.LIMIT:
            self.clear()
            self.words = []
        new = list({w for _, t in parts for w in t if w not in self})
        if new:
            here = slice(len(self), len(self) + len(new))
            self.rows[here], self.hit[here] = self.model.scores(new)
            self.update(zip(new, range(here.start, here.stop), strict=True))
            self.words += new
        for k, t in parts:
            at = np.fromiter(map(self.__getitem__, t), np.int64, len(t))
            sums, rare, times = out[k]
            sums += self.rows[at].sum(axis=0)
            at, n = np.unique(at[~self.hit[at]], return_counts=True)
            rare += map(self.words.__getitem__, at.tolist())
            times += n.tolist()


def _words(text: str) -> list[bytes]:
    """The words of a text; none where it has no letter."""
    words = common.letter_runs(text.lower())
    return words if any(w[0] < 128 for w in words) or any(map(str.isalpha, text)) else []


def predict(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs, with its text or without, with lang_pred and score (posterior of the per-word evidence, tempered by text length), which replace columns of these names."""
    docs = docs.drop("lang_pred", "score")
    names, langs = [c for c in docs.columns if keep_text or c != text], model.langs
    own = [F.col(f"`{c}`") for c in names]
    if not langs:
        return docs.select(*own, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = docs.select(F.struct(*own).alias("_row"), F.col(f"`{text}`").alias("_text"))
    schema = whole.select("_row", F.lit(0).cast("long").alias("_id"), F.lit(0).cast("long").alias("_n"), F.array(F.lit(0.0)).alias("_sums"), F.expr("cast(null as array<binary>) as _rare"), F.expr("cast(null as array<int>) as _times")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        memory, at = _Memory(shared.value), TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in (whole.slice(k, 1000) for k in range(0, len(whole), 1000)):
                words = [_words(t) if t else [] for t in batch.column(1).to_pylist()]
                sums, rare, times = zip(*memory.totals(words), strict=True)
                columns = [pa.array(range(at, at + len(batch)), pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array([x.tolist() for x in sums], pa.list_(pa.float64())), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))]
                yield pa.record_batch([batch.column(0), *columns], names=["_row", "_id", "_n", "_sums", "_rare", "_times"])
                at += len(batch)

    found = common.stored(whole.mapInArrow(run, schema))  # written once, so that the numbers of its rows hold
    rare = _rare_scores(found, model, shared)
    found = found.drop("_rare", "_times").join(rare, "_id", "left")
    found = found.withColumn("_sums", F.array(*[F.col("_sums")[k] + F.coalesce(f"x{k}", F.lit(0.0)) for k in range(len(langs))])).withColumn("_best", F.array_max("_sums"))
    lang = F.element_at(F.array(*map(F.lit, langs)), F.array_position("_sums", F.col("_best")).cast("int"))
    rest = F.aggregate("_sums", F.lit(0.0), lambda total, x: total + F.exp((x - F.col("_best")) / F.sqrt(F.greatest("_n", F.lit(1)))))
    return found.select("_row.*", F.when(F.col("_n") > 0, lang).otherwise("und").alias("lang_pred"), F.when(F.col("_n") > 0, 1 / rest).otherwise(0.0).alias("score"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep_text=False)
