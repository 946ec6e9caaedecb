"""Best-fit packing of tokenized documents into sequences by swap-based local search.

Documents are tokenized once; what they come to is a table of pieces (at most ``size``
tokens each). The search then needs only how many pieces there are of each length: at
most ``size`` counts, whatever the corpus. Bins that hold the same lengths are one class
with a count. The classes start from a best-fit fill, longest first, and a local search
exchanges one piece for one, two for one, or moves one, between bins of underfull
classes, in bulk, as long as squared fill grows, until bins empty or no exchange helps. Pieces find
their bin by their rank among the pieces of their length, in an equi-join with the classes.

Defined cases: a null text counts as empty and gives one piece, the separator; only
documents longer than ``size`` are cut; repeated rows each give their pieces, and ties in
length go by doc_id and piece; other columns are left alone; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import common

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: An ASCII word's tokens keep to these parts, by the tokenizer's own pattern.
ASCII_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[!-/:-@\[-`{-~]+")
PLAIN = re.compile(rb"[!-@\[-~]+")
#: ASCII and Latin-1 letters in UTF-8, then punctuation that begins with no apostrophe.
LETTERS_THEN_MARKS = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*)?")


class WordIds(dict):
    """Word -> its token ids as little-endian unsigned 32-bit numbers, with a memory of bounded size.

    No token spans ASCII white space, so a text's ids are those of its words in turn. A new
    word is cut into parts that no token spans; the last token of a part, and no other, is
    marked as a word's end, so that many parts are encoded at a time and told apart.
    Words that are met first, which are mostly frequent, stay when the memory is full.
    """

    LIMIT, KEEP = 600_000, 300_000
    _known: dict[str, WordIds] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> WordIds:
        """The one of this Python worker."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def encoded(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of some texts, each a list of words."""
        found = [list(map(self.get, t)) for t in texts]
        holes = [(t, ids, at) for t, ids in zip(texts, found, strict=True) if (at := list(_nones(ids)))]
        if holes:
            new = self.learned({t[k] for t, _, at in holes for k in at})
            for t, ids, at in holes:
                for k in at:
                    ids[k] = new[t[k]]
        return list(map(b"".join, found))

    def learned(self, new: set[bytes]) -> dict[bytes, bytes]:
        if len(self) > self.LIMIT:
            kept = list(islice(self.items(), self.KEEP))
            self.clear()
            self.update(kept)
        parts = {w: self.parts(w) for w in new}
        unseen = list({x for some in parts.values() if some for x in some if x not in self})
        for at in range(0, len(unseen), 1000):
            self.add(unseen[at : at + 1000])
        whole = [w for w, some in parts.items() if some is None]
        out = dict(zip(whole, map(self.bytes_of, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in whole], add_special_tokens=False)), strict=True)) if whole else {}
        out |= {w: self[some[0]] if len(some) == 1 else b"".join(map(self.__getitem__, some)) for w, some in parts.items() if some}
        self.update(out)
        return out

    @staticmethod
    def parts(word: bytes) -> list[bytes] | None:
        """Parts that no token spans, of one run of letters, digits or marks each; None where that can't be told."""
        if b"<|" in word:
            return None
        if m := LETTERS_THEN_MARKS.fullmatch(word):
            return [m[1], m[2]] if m[2] else [word]
        return ASCII_PARTS.findall(word) if PLAIN.fullmatch(word) else None

    @staticmethod
    def bytes_of(encoding) -> bytes:
        return np.array(encoding.ids, "<u4").tobytes()

    def add(self, parts: list[bytes]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(parts).decode()], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(parts) and cuts[-1] == len(ids):
            b = ids.tobytes()
            self.update(zip(parts, [b[4 * x : 4 * y] for x, y in pairwise([0, *cuts.tolist()])], strict=True))
        else:  # a tokenizer of another make
            self.update(zip(parts, map(self.bytes_of, self.tokenizer.encode_batch_fast([w.decode() for w in parts], add_special_tokens=False)), strict=True))


def _nones(values: list) -> Iterator[int]:
    at = -1
    try:
        while True:
            at = values.index(None, at + 1)
            yield at
    except ValueError:
        return


def lowered(text: bytes | None) -> bytes:
    """A text with A-Z lower-cased, as the tokenizer does, unless it may hold the name of a special token, which has its case."""
    return (text or b"") if text is None or b"<|" in text else text.translate(common.LOWER)


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, separator: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        ids = WordIds.of(tokenizer)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for at in range(0, len(batch), 500):
                some = batch.slice(at, 500)
                texts = [lowered(t).split() for t in some.column(1).to_pylist()]
                for doc, b in zip(some.column(0).to_pylist(), ids.encoded(texts), strict=True):
                    b += end
                    for k, start in enumerate(range(0, len(b) // 4, size)):
                        cut = b[4 * start : 4 * (start + size)]
                        for column, x in zip(out, (doc, k, start, len(cut) // 4, zlib.crc32(cut)), strict=True):
                            column.append(x)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), common.text_bytes()).mapInArrow(run, PIECES)


def best_fit(counts: dict[int, int], size: int) -> Counter:
    """Classes of bins: sorted tuple of (length, how many of it) -> number of bins. Longest lengths first, into the least room that holds them."""
    by_room: dict[int, Counter] = defaultdict(Counter)
    for length in sorted(counts, reverse=True):
        left, room = counts[length], length
        while left and room < size:
            for content in list(by_room[room]):
                if not left:
                    break
                n = min(left, by_room[room][content])
                by_room[room][content] -= n
                if not by_room[room][content]:
                    del by_room[room][content]
                by_room[room - length][_with(content, length)] += n
                left -= n
            room += 1
        fit = size // length
        if left // fit:
            by_room[size - fit * length][((length, fit),)] += left // fit
        if left % fit:
            by_room[size - left % fit * length][((length, left % fit),)] += 1
    return sum(by_room.values(), Counter())


def _with(content: tuple, length: int, n: int = 1) -> tuple:
    c = Counter(dict(content))
    c[length] += n
    return tuple(sorted((k, v) for k, v in c.items() if v))


def _fill(content: tuple) -> int:
    return sum(k * v for k, v in content)


class _Open:
    """The exchanges that underfull classes of bins offer a giver, in arrays: for each class and each of its lengths (or none) that goes back."""

    def __init__(self, size: int, bins: Counter):
        self.size, self.bins, self.tried = size, bins, {}
        self.restart([])

    def restart(self, classes: list[tuple]) -> None:
        self.classes, self.at, self.n = [], {}, 0
        self.of, self.back, self.fill = (np.zeros(1024, np.int64) for _ in range(3))
        self.count = np.zeros(1024, np.int64)
        for content in classes:
            self.add(content)

    def add(self, content: tuple) -> None:
        """Offers of a class from now on."""
        backs = [0, *(k for k, _ in content)]
        while self.n + len(backs) > len(self.of):
            self.of, self.back, self.fill, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.of, self.back, self.fill, self.count))
        here = slice(self.n, self.n + len(backs))
        self.of[here], self.back[here], self.fill[here] = len(self.classes), backs, _fill(content)
        self.at[content] = len(self.classes)
        self.count[len(self.classes)] = self.bins[content]
        self.classes.append(content)
        self.n += len(backs)

    def change(self, content: tuple, n: int) -> None:
        """n more or less bins of a class, which is looked at anew if it comes up."""
        self.bins[content] += n
        if _fill(content) == self.size or not content:
            return
        if content in self.at and self.bins[content] > n:
            self.count[self.at[content]] = self.bins[content]
            return
        self.add(content)
        if len(self.classes) > 2 * (1000 + sum(1 for c in self.at if self.bins[c])):
            first, seen = {c: k for c, k in self.at.items() if self.bins[c]}, self.tried
            starts = np.searchsorted(self.of[: self.n], np.arange(len(self.classes)))
            live = sorted(first, key=first.get)
            self.restart(live)
            at = np.array([starts[first[c]] for c in live])
            new = np.append(np.searchsorted(self.of[: self.n], np.arange(len(live))), self.n)
            self.tried = {c: int(new[np.searchsorted(at, k)]) for c, k in seen.items() if self.bins[c]}

    def best(self, giver: tuple) -> tuple | None:
        """(taker, lengths given, lengths taken back) that fills the taker most, among the offers that the giver has not tried."""
        since = self.tried.get(giver, 0)
        of, back, fill = (x[since : self.n] for x in (self.of, self.back, self.fill))
        there = self.count[of] > (of == self.at[giver])
        of, back, fill = of[there], back[there], fill[there]
        have = [k for k, n in giver for _ in range(min(n, 2))]
        outs = [(x,) for x in sorted(set(have))] + sorted({(x, y) for i, x in enumerate(have) for y in have[i + 1 :]})
        low, found = np.maximum(0, _fill(giver) - fill), None
        room, most = self.size - fill, 0
        for out in outs:
            gain = sum(out) - back
            gain[(gain <= low) | (gain > room)] = 0
            if len(out) == 2:
                gain[back == 0] = 0
            k = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[k] > most:
                most, found = int(gain[k]), (self.classes[of[k]], out, (int(back[k]),) if back[k] else ())
        if found is None:
            self.tried[giver] = self.n
        return found


def local_search(bins: Counter, size: int) -> Counter:
    """bins after exchanges between underfull bins, each of which makes the sum of squared fills grow.

    The emptiest class gives: it moves a piece to a bin that has room, or changes one or
    two of its pieces for a smaller one of a fuller bin. It goes on until no class has an
    exchange to offer, or no bin can empty as the room left is less than a bin. A class that
    found none looks again only at offers that came up since. Classes number a few for each
    length, whatever the corpus.
    """
    bins = Counter({k: v for k, v in bins.items() if v})
    offers = _Open(size, bins)
    givers: list[tuple[int, tuple]] = []
    stuck: list[tuple[int, tuple]] = []
    room = sum(n * (size - _fill(content)) for content, n in bins.items())
    for content in sorted(c for c in bins if _fill(c) < size):
        offers.add(content)
        givers.append((_fill(content), content))
    heapq.heapify(givers)
    while room >= size:
        if not givers:  # those that found nothing, again with what came up since
            givers, stuck = [x for x in stuck if bins[x[1]] and offers.tried[x[1]] < offers.n], []
            heapq.heapify(givers)
            if not givers:
                break
        fill, giver = heapq.heappop(givers)
        if not bins[giver]:
            continue
        found = offers.best(giver)
        if found is None:
            stuck.append((fill, giver))
            continue
        taker, out, back = found
        n = min(bins[giver], bins[taker]) if taker != giver else bins[giver] // 2
        a, b = giver, taker
        for k in out:
            a, b = _with(a, k, -1), _with(b, k)
        for k in back:
            a, b = _with(a, k), _with(b, k, -1)
        for content, more in ((giver, -n), (taker, -n), (a, n), (b, n)):
            offers.change(content, more)
        for content in {a, b}:
            if content and _fill(content) < size:
                heapq.heappush(givers, (_fill(content), content))
        room -= n * size * (not a)
        heapq.heappush(givers, (fill, giver))
    return Counter({k: v for k, v in bins.items() if k and v})


#: Pieces of one length that are ranked in a task.
RANKED = 50_000


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """pieces (any columns, with doc_id, piece and length from 1 to size) with sequence_id and offset, which replace columns of these names."""
    spark = pieces.sparkSession
    salts = max(64, pieces.count() // RANKED)
    rows = pieces.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("row"), F.col("length").cast("long").alias("length"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int").alias("salt"), F.struct("doc_id", "piece").alias("key"))
    each = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    bins = local_search(best_fit(counts, size), size)
    slots, first, used = [], 0, Counter()
    for content, n in sorted(bins.items()):
        at = 0
        for length, times in content:
            slots.append((length, used[length], used[length] + n * times, first, at, times))
            used[length] += n * times
            at += length * times
        first += n
    slots = spark.createDataFrame(slots or [], "length long, lo long, hi long, first long, at long, times long")
    before = "coalesce(sum(n) over (partition by length order by salt rows between unbounded preceding and 1 preceding), 0)"
    starts = each.select("length", "salt", F.expr(before).alias("before"))
    ranked = rows.join(starts, ["length", "salt"]).withColumn("rank", F.expr("before + row_number() over (partition by length, salt order by key) - 1"))
    placed = ranked.join(F.broadcast(slots), "length").where("rank >= lo and rank < hi")  # a few rows for each length
    kept = [F.col("row").getField(c).alias(c) for c in pieces.columns if c not in ("sequence_id", "offset")]
    return placed.select(*kept, F.expr("first + (rank - lo) div times").alias("sequence_id"), F.expr("at + length * pmod(rank - lo, times)").alias("offset"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.read(spark, sf_dir, "documents")
    pieces = common.stored(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
    return pack(pieces)
