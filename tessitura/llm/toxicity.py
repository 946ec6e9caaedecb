"""Toxicity by a linear-chain conditional random field over words.

Words are tagged toxic or not. The field's weights are those of a word and its
beginnings (4 to 6 letters), and of the transitions between tags; forward-backward gives
each word's marginal, and a logistic curve over the marginals gives the document's score.
Runs of words whose marginal is at least a half are the offending spans, as character
offsets in the text.

Labels are per document, so the tokens' labels for training come from them: in toxic
documents those words are labelled of which a feature is far more frequent, by document
(copies counted once), in toxic than in clean documents. Training reads a bounded sample of labelled documents:
``sample`` toxic and ``background`` clean ones, least hash of the id first, of each the first ``longest``
characters, and of a class as many as hold ``most`` characters in all. The background is the larger, so
that words of a language with few documents are told from those that clean texts hold too.
Scoring reads all of every text; its work goes by chunks with 64 words of context on
both sides, beyond which the chain's messages agree to rounding.

Defined cases: a null or empty text has no words and gets the score of a text without
toxic words; with only one class of labels, or none, every score is 0; of several labels
of a document the toxic one counts; repeated rows each keep a row; an empty table gives
an empty result; columns named score, predicted, spans are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import common

RUN = re.compile(rb"[a-z\x80-\xff]+")
CHUNK, MARGIN = 512, 64
#: Chunks of which the slopes are taken at a time, so that fitting needs no more of the driver's memory for more words than the words themselves.
ROWS = 256
ROUNDS, RATE, DECAY = 50, 0.5, 1e-5
#: Marginals from which on a word counts for its document.
CLEAR = 0.2
#: A labelling feature's least documents, and times that it is more frequent in toxic ones.
SEEN, TIMES = 3, 10.0


def features(word: bytes) -> list[str]:
    word = word.decode("utf-8", "replace")
    return ["=" + word] + [word[:n] for n in (4, 5, 6) if len(word) >= n]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    moves: np.ndarray  # [from, to], log
    start: float
    curve: np.ndarray

    def emission(self, word: bytes) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))


def messages(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward, odds) of sequences, one a row, longest first; both messages are scaled to sum 1."""
    rows, steps = emissions.shape
    x, a = np.exp(np.clip(emissions, -40, 40)), np.exp(moves)
    ahead, back = np.zeros((rows, steps, 2)), np.full((rows, steps, 2), 0.5)
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # rows longer than the step
    for c in range(steps):
        r = active[c]
        if c:
            p = ahead[:r, c - 1]
            u, v = p[:, 0] * a[0, 0] + p[:, 1] * a[1, 0], (p[:, 0] * a[0, 1] + p[:, 1] * a[1, 1]) * x[:r, c]
        else:
            u, v = np.ones(r), np.exp(start) * x[:r, 0]
        s = u + v
        ahead[:r, c, 0], ahead[:r, c, 1] = u / s, v / s
    for c in range(steps - 2, -1, -1):
        r = active[c + 1]
        u, v = back[:r, c + 1, 0], back[:r, c + 1, 1] * x[:r, c + 1]
        p, q = a[0, 0] * u + a[0, 1] * v, a[1, 0] * u + a[1, 1] * v
        s = p + q
        back[:r, c, 0], back[:r, c, 1] = p / s, q / s
    return ahead, back, x


def marginals(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: float) -> np.ndarray:
    ahead, back, _ = messages(emissions, lengths, moves, start)
    joint = ahead * back
    return joint[..., 1] / np.maximum(joint.sum(axis=-1), 1e-300)


def chain(emissions: list[np.ndarray], moves: np.ndarray, start: float) -> list[np.ndarray]:
    """Marginals of the words of each text."""
    out = [np.zeros(len(e)) for e in emissions]
    cuts = sorted(((k, at) for k, e in enumerate(emissions) for at in range(0, len(e), CHUNK)), key=lambda x: -_span(len(emissions[x[0]]), x[1])[2])
    width = CHUNK + 2 * MARGIN
    for some in range(0, len(cuts), 200):
        part = cuts[some : some + 200]
        spans = [_span(len(emissions[k]), at) for k, at in part]
        grid = np.zeros((len(part), spans[0][2]))
        for r, ((k, _), (low, _, n)) in enumerate(zip(part, spans, strict=True)):
            grid[r, :n] = emissions[k][low : low + n]
        lengths = np.array([n for _, _, n in spans])
        p = marginals(grid, lengths, moves, start)
        assert grid.shape[1] <= width
        for r, ((k, at), (low, end, _)) in enumerate(zip(part, spans, strict=True)):
            out[k][at:end] = p[r, at - low : end - low]
    return out


def _span(n: int, at: int) -> tuple[int, int, int]:
    low, end = max(0, at - MARGIN), min(n, at + CHUNK)
    return low, end, min(n, end + MARGIN) - low


def summary(p: np.ndarray) -> list[float]:
    """What the document's curve reads: the clear marginals, so that many faint ones of a long text add up to nothing."""
    return [1.0, float(np.log(p[p >= CLEAR].sum() + 1e-2)), float(p.max()) if len(p) else 0.0]


class Words:
    """The words of some texts by number, and the features of each."""

    def __init__(self, texts: list[str]):
        self.number: dict[bytes, int] = {}
        self.texts = [np.array([self.number.setdefault(w, len(self.number)) for w in common.letter_runs(t.lower())], np.int64) for t in texts]
        self.index: dict[str, int] = {}
        self.features = [[self.index.setdefault(f, len(self.index)) for f in features(w)] for w in self.number]

    def documents(self, chosen: list[int]) -> np.ndarray:
        """How many of the chosen texts hold each feature."""
        n = np.zeros(len(self.index), np.int64)
        for k in chosen:
            n[list({f for w in np.unique(self.texts[k]) for f in self.features[w]})] += 1
        return n


def distinct_texts(words: Words) -> list[int]:
    """Texts without the copies of earlier ones: those that share much of a sketch of their word triples."""
    seen: Counter = Counter()
    out = []
    for k, w in enumerate(words.texts):
        triples = common.mix(common.mix(w[:-2].astype(np.uint64) * np.uint64(31) + w[1:-1].astype(np.uint64)) * np.uint64(31) + w[2:].astype(np.uint64)) if len(w) > 2 else w.astype(np.uint64)
        sketch = [int(h) for h in np.unique(triples)[:16]]
        if not sketch or sum(h in seen for h in sketch) <= len(sketch) // 4:
            out.append(k)
        seen.update(sketch)
    return out


def token_labels(words: Words, toxic: list[int], chosen: list[int]) -> list[np.ndarray]:
    """1 for the words of toxic documents that give them away; the chosen texts are counted."""
    clean, bad = (words.documents([k for k in chosen if toxic[k] == y]) for y in (0, 1))
    n0, n1 = (sum(toxic[k] == y for k in chosen) + 1 for y in (0, 1))
    told = (bad >= SEEN) & ((bad + 0.5) / n1 >= TIMES * (clean + 0.5) / n0)
    gives = np.array([any(told[f] for f in fs) for fs in words.features], float)
    return [gives[w] * y for w, y in zip(words.texts, toxic, strict=True)]


class Block:
    """Some rows (words by number, labels), longest first, of which the field's slopes are taken at a time."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], of_word: np.ndarray, none: int):
        self.lengths, self.none = np.array([len(w) for w, _ in rows], np.int64), none
        self.mask = np.arange(self.lengths[0]) < self.lengths[:, None]
        self.y = np.zeros(self.mask.shape, np.int8)
        self.y[self.mask] = np.concatenate([t for _, t in rows])
        flat = of_word[np.concatenate([w for w, _ in rows])]
        self.some = np.flatnonzero((flat != none).any(axis=1))
        self.flat = flat[self.some]
        sides = [self.mask & (self.y == 0), self.mask & (self.y == 1)]
        self.held = np.array([float((sides[i][:, :-1] & sides[j][:, 1:]).sum()) for i in (0, 1) for j in (0, 1)])

    def slopes(self, weights: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the weights and of bias, start and moves, without decay and without what the labels' moves hold."""
        own = np.full(int(self.lengths.sum()), other[0])
        own[self.some] += weights[self.flat].sum(axis=1)
        emissions = np.zeros(self.mask.shape)
        emissions[self.mask] = own
        ahead, back, x = messages(emissions, self.lengths, other[2:].reshape(2, 2), other[1])
        p = ahead[..., 1] * back[..., 1]
        p = p / np.maximum(p + ahead[..., 0] * back[..., 0], 1e-300)
        a = np.exp(other[2:])
        to = (back[:, 1:, 0], back[:, 1:, 1] * x[:, 1:])
        each = [ahead[:, :-1, i] * to[j] * a[2 * i + j] for i in (0, 1) for j in (0, 1)]
        whole = np.maximum(each[0] + each[1] + each[2] + each[3], 1e-300)
        error = (self.y - p)[self.mask]
        slope = np.bincount(self.flat.reshape(-1), np.repeat(error[self.some], 4), self.none + 1)
        return slope, np.array([error.sum(), (self.y[:, 0] - p[:, 0]).sum(), *(-(e / whole)[self.mask[:, 1:]].sum() for e in each)])


def fit(texts: list[str], toxic: list[int]) -> Model:
    """A field and a curve from documents labelled 0 or 1. Features of toxic words get a weight."""
    words = Words(texts)
    labels = token_labels(words, toxic, distinct_texts(words))
    used = np.zeros(len(words.index), np.int64)
    for w, y in zip(words.texts, labels, strict=True):
        for x in w[y > 0]:
            used[words.features[x]] += 1
    names = [f for f, k in words.index.items() if used[k] >= 3]
    place = {words.index[f]: k for k, f in enumerate(names)}
    none = len(names)
    of_word = np.array([([place.get(f, none) for f in fs] + [none] * 4)[:4] for fs in words.features] or [[none] * 4])
    rows = sorted(((w[at : at + CHUNK], y[at : at + CHUNK]) for w, y in zip(words.texts, labels, strict=True) for at in range(0, len(w), CHUNK)), key=lambda r: -len(r[0]))
    blocks = [Block(rows[at : at + ROWS], of_word, none) for at in range(0, len(rows), ROWS)]
    n, held = sum(int(b.lengths.sum()) for b in blocks), sum((b.held for b in blocks), np.zeros(4))
    weights, other = np.zeros(none + 1), np.zeros(6)  # bias, start, moves
    other[0] = -7.0
    speed, speed2 = np.zeros(none + 1), np.zeros(6)
    for _ in range(ROUNDS):
        weights[none] = 0
        slope, slope2 = -DECAY * n * weights, np.append(np.zeros(2), held) - DECAY * n * other
        for b in blocks:
            more, more2 = b.slopes(weights, other)
            slope, slope2 = slope + more, slope2 + more2
        speed, speed2 = speed + slope**2, speed2 + slope2**2
        weights += RATE * slope / np.sqrt(speed + 1e-9)
        other += RATE * slope2 / np.sqrt(speed2 + 1e-9)
    model = Model({f: float(weights[k]) for k, f in enumerate(names)}, float(other[0]), other[2:].reshape(2, 2).copy(), float(other[1]), np.zeros(3))
    emission = np.array([model.emission(w) for w in words.number] or [0.0])
    found = chain([emission[w] for w in words.texts], model.moves, model.start)
    model.curve = logistic(np.array([summary(p) for p in found]), np.array(toxic, float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1.0) -> np.ndarray:
    """Weights by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w)), x.T @ (y - p) - decay * w)
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = 500, background: int = 1000, longest: int = 200_000, most: int = 20_000_000) -> Model | None:
    """A model of the labelled documents (doc_id, text) and labels (doc_id, toxic); None with fewer than two classes."""
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    lengths = docs.where("text is not null").groupBy("doc_id").agg(F.max(F.least(F.length("text"), F.lit(longest))).alias("_n"))
    usable = lengths.join(marks, "doc_id")
    chosen: list[tuple] = []
    for k, rows in ((0, background), (1, sample)):
        held = 0
        for r in usable.where(F.col("_toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect():
            held += r["_n"]
            if held <= most:
                chosen.append((r["doc_id"], k))
    ids = docs.sparkSession.createDataFrame(chosen, f"doc_id {dict(docs.dtypes)['doc_id']}, _toxic int")
    kept = docs.where("text is not null").select("doc_id", F.substring("text", 1, longest).alias("text")).join(F.broadcast(ids), "doc_id")  # sample + background rows
    rows = kept.groupBy("doc_id", "_toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    toxic = [int(r["_toxic"]) for r in rows]
    model = fit([r["text"] for r in rows], toxic) if 0 < sum(toxic) < len(toxic) else None
    del rows
    common.tidy()  # the driver keeps it else, whatever comes after
    return model


class _Emissions(dict):
    LIMIT = 150_000

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        e = self[word] = self.model.emission(word)
        return e


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score, predicted (1 from the threshold on) and spans (start, end of each toxic run)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted", "spans")
    names = docs.columns
    at = names.index(text)
    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.expr("cast(null as array<struct<start: int, end: int>>)").alias("spans")).schema
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = shared.value
        memory = _Emissions(model) if model else None
        for batch in batches:
            texts = [common.lower(t) if t else "" for t in batch.column(at).to_pylist()]
            scores, spans = [0.0] * len(texts), [[] for _ in texts]
            low, n = 0, 0
            for k in range(len(texts) + 1):
                if model and (k == len(texts) or n > 500_000):
                    emissions = [np.fromiter(map(memory.__getitem__, w := common.letter_runs(t)), float, len(w)) for t in texts[low:k]]
                    for i, p in enumerate(chain(emissions, model.moves, model.start), low):
                        scores[i] = float(1 / (1 + np.exp(-np.clip(np.dot(model.curve, summary(p)), -30, 30))))
                        if len(p) and p.max() >= 0.5:
                            spans[i] = runs(texts[i], p >= 0.5)
                    low, n = k, 0
                n += len(texts[k]) if k < len(texts) else 0
            columns = {name: batch.column(k) for k, name in enumerate(names)}
            columns |= {"score": pa.array(scores), "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32()), "spans": pa.array(spans, kind)}
            yield pa.RecordBatch.from_pydict(columns)
        del memory
        common.tidy()

    return docs.mapInArrow(run, schema)


def runs(text: str, bad: np.ndarray) -> list[dict[str, int]]:
    """Offsets, in characters, of the runs of marked words."""
    out: list[dict[str, int]] = []
    before, raw = False, text.encode("utf-8", "replace")
    for m, b in zip(RUN.finditer(raw), bad, strict=True):
        if b and before:
            out[-1]["end"] = m.end()
        elif b:
            out.append({"start": m.start(), "end": m.end()})
        before = b
    place = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [{"start": int(place[x["start"]]) - 1, "end": int(place[x["end"] - 1])} for x in out]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op9_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()), common.read(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
