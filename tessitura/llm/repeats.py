"""Suffix-array de-duplication by common-prefix interval trees.

Removes each byte that a ``k``-byte string covers which also starts earlier (smaller
doc_id, or the same document and an earlier start). The corpus' suffixes are sampled by
content: of the 20-byte grams of every k-byte window the least by hash is its anchor, so
equal windows have the same anchor at the same place. An anchor's context is the stretch
of the windows that have it. Then, with nothing but anchors that occur more than once:

1. equal contexts are grouped, in one packed shuffle by anchor; all but the first are
   covered. A task sends on only the first of each that it has gathered, so a passage in
   very many documents is no hot group;
2. the different contexts of an anchor make an enhanced suffix array: suffixes from the
   anchor on in order, with the lengths of common prefixes. A stack scan gives its
   interval tree; at each interval the members are parted by their left extensions, whose
   diversity tells the maximal repeats. A repeat's group has all its occurrences, and all
   but the first are covered, each as far to the left as it goes along with an earlier one;
3. the contexts of an anchor with more than ``HOT`` are first split, by the bytes to the
   left of it and once more by those to its right: two that share k bytes around an anchor
   share half of what is beyond it on one side at least. Groups that are still too large are
   split by half of what is left, until they share all k bytes. At each step those that agree
   in all that can still matter are one from there on: all but the first are covered (a
   pre-aggregated minimum). So no task gets more than ``HOT`` contexts at a time, and what
   agrees is not split again.

Exact copies of a whole text are settled before that. Broadcast are bitmaps of at most
``2 ** MAX_BITS`` bits, which prune less where they fill up.

Defined cases: a null text counts as empty; texts under k bytes lose nothing; a null
doc_id comes after all others; repeated rows (equal id and text) are one document and get
the same result; of different texts with one doc_id the order is that of a hash; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import common
from tessitura.llm.ngram_join import bitmap_of, in_bitmap

GRAM = 20
MAX_BITS = 27
#: Bytes that are worked on at a time; places within take 20 bits at most.
BLOCK = 1 << 19
HOT = 1000
LAST = (1 << 63) - 1
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Anchors:
    """The anchors of some texts: arrays, one entry for each anchor."""

    powers = np.cumprod(np.append(np.uint64(1), np.full(BLOCK, _STEP)))
    back = np.cumprod(np.append(np.uint64(1), np.full(BLOCK, np.uint64(pow(int(_STEP), -1, 1 << 64)))))

    def __init__(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, k: int):
        self.raw, n = raw, len(raw)
        none = np.zeros(0, np.int64)
        self.text = self.first = self.last = self.place = none
        self.name = self.context = none.view(np.uint64)
        if n < k:
            return
        self.sums = np.append(np.uint64(0), np.cumsum(_BYTE[np.frombuffer(raw, np.uint8)] * self.powers[:n]))
        grams = common.mix((self.sums[GRAM:] - self.sums[: n - GRAM + 1]) * self.back[: n - GRAM + 1])
        low = (grams >> np.uint64(20) << np.uint64(20)) | np.arange(len(grams), dtype=np.uint64)
        width, span = k - GRAM + 1, 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        at = (low & np.uint64(BLOCK - 1)).astype(np.int64)
        long = ends - starts >= k
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, starts[long], 1)
        np.add.at(edge, ends[long] - k + 1, -1)
        at[np.cumsum(edge)[: len(at)] == 0] = -1
        cut = np.flatnonzero(np.diff(at, prepend=-2))
        stop = np.append(cut[1:], len(at)) - 1
        good = at[cut] >= 0
        self.first, self.last = cut[good], stop[good]
        self.place = at[self.first]
        self.text = np.searchsorted(starts, self.first, side="right") - 1
        self.name = grams[self.place]
        self.context = self.hashes(self.first, self.last + k, self.place - self.first)

    def hashes(self, start: np.ndarray, end: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Names of stretches of the texts."""
        return common.mix(common.mix((self.sums[end] - self.sums[start]) * self.back[start]) + more.astype(np.uint64) * _STEP + (end - start).astype(np.uint64))


def blocks(batches: Iterator[pa.RecordBatch], k: int, firsts: np.ndarray) -> Iterator[tuple[Anchors, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, id, row and offset of their texts) of some texts at a time; long texts come in parts that share k - 1 bytes."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def take() -> tuple:
        raw = b"".join(x[3] for x in held)
        ends = np.cumsum([len(x[3]) for x in held])
        starts = ends - np.array([len(x[3]) for x in held])
        ids, rows, offsets = (np.array([x[c] for x in held], np.int64) for c in range(3))
        return Anchors(raw, starts, ends, k), ids, rows, offsets - starts

    for batch in batches:
        ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i in np.flatnonzero(in_bitmap(firsts, ids)):
            text = batch.column(2)[int(i)].as_py() or b""
            for at in range(0, max(1, len(text) - k + 1), BLOCK - k):
                part = text[at : at + BLOCK - 1] if len(text) >= BLOCK else text
                if held and size + len(part) >= BLOCK:
                    yield take()
                    held, size = [], 0
                held.append((int(ids[i]), int(rows[i]), at, part))
                size += len(part)
                if len(text) < BLOCK:
                    break
    if held:
        yield take()
    common.tidy()


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return n - ((int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")).bit_length() + 7) // 8


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of each node of the interval tree, by a stack scan of the common prefixes of neighbours."""
    stack = [(0, 0)]
    for i, p in enumerate([*prefixes, 0], 1):
        low = i - 1
        while stack[-1][0] > p:
            length, low = stack.pop()
            yield length, low, i - 1
        if stack[-1][0] < p:
            stack.append((p, low))


def repeats(lefts: list[bytes], rights: list[bytes], k: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """The repeats of k bytes or more through an anchor: (bytes from the anchor on, members, bytes before the anchor in common with the next member).

    lefts are the bytes before the anchor, from it backwards; rights those from it on.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    prefixes = [common_prefix(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    for length, low, high in intervals(prefixes):
        members = sorted(order[low : high + 1], key=lefts.__getitem__)
        extent = [common_prefix(lefts[a], lefts[b]) for a, b in zip(members, members[1:], strict=False)]
        at = 0
        for i in range(len(members)):
            if i == len(extent) or extent[i] + length < k:
                if i > at:
                    yield length, members[at : i + 1], extent[at:i]
                at = i + 1


def follows(members: list[int], extent: list[int]) -> list[tuple[int, int]]:
    """(member, bytes before the anchor that it has in common with an earlier member) of each member that has one; members are numbered in text order."""
    best: dict[int, int] = {}
    for line, steps in ((members, extent), (members[::-1], extent[::-1])):
        stack: list[list[int]] = []  # earlier members so far, with what the line has in common since
        for i, m in enumerate(line):
            shared = steps[i - 1] if i else 0
            while stack and stack[-1][0] > m:
                shared = min(shared, stack.pop()[1])
            if stack:
                best[m] = max(best.get(m, 0), shared)
            stack.append([m, shared])
    return list(best.items())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPAN = "id long, row long, start long, end long"
#: What is shuffled of an anchor's context: name, context, id, row, start and number of windows; and of a covered stretch.
HEAD, STRETCH = ["<u8", "<u8", "<i8", "<i8", "<u4", "<u2"], ["<i8", "<i8", "<u4", "<u4"]
#: Anchors that a task gathers before it sends the first of each context.
GATHER = 200_000


def _first_of_each(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the first of each name, context and number of windows, all that come after the first in the corpus) of columns as HEAD has them; repeated rows are one."""
    name, context, id_, row, start, n = columns
    order = np.lexsort((start, row, id_, n, context, name))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in (name, context, n):
        new[1:] |= c[order][1:] != c[order][:-1]
    first = order[new]
    own = first[np.cumsum(new) - 1]
    later = order[(id_[order] != id_[own]) | (row[order] != row[own]) | (start[order] != start[own])]
    return first, later


def _stretches(id_: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(id, row, start, end) of contexts, those of one text that touch as one; a text's contexts end in the order in which they start."""
    order = np.lexsort((start, row, id_))
    id_, row, start = id_[order], row[order], start[order].astype(np.int64)
    end = start + n[order].astype(np.int64) - 1 + k
    cut = np.ones(len(order), bool)
    cut[1:] = (id_[1:] != id_[:-1]) | (row[1:] != row[:-1]) | (start[1:] > end[:-1])
    return id_[cut], row[cut], start[cut], end[np.append(cut[1:], True)] if len(end) else end


class Finder:
    """The steps of one search; ``docs`` has doc_id and text."""

    def __init__(self, docs: DataFrame, k: int = 100):
        self.spark, self.k = docs.sparkSession, k
        text = F.coalesce("text", F.lit(""))
        self.ids = {"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "row": F.xxhash64(text)}
        self.docs = docs.select(*[c.alias(n) for n, c in self.ids.items()], text.cast("binary").alias("text"))
        self.size = size = common.total_bytes(docs)
        self.parts = common.parts_for(size)
        self.bits = max(self.parts.bit_length() + 3, min(MAX_BITS, max(16, size.bit_length())))
        same = docs.select(*[c.alias(n) for n, c in self.ids.items()], F.md5(text.cast("binary")).alias("same"))
        self.same, self.tables = common.stored(same), []
        self.firsts = self.shared(bitmap_of(self.same.groupBy("same").agg(F.min("id").alias("id")).select("id"), self.bits))

    def shared(self, what):
        return self.spark.sparkContext.broadcast(what)

    def bitmap(self, keys: DataFrame):
        return self.shared(bitmap_of(keys, self.bits))

    def kept(self, table: DataFrame) -> DataFrame:
        """A table in the shared folder that spans() reads, for result() to delete."""
        self.tables.append(table)
        return table

    def frequent(self):
        """A bitmap of the anchors that occur more than once, by all documents."""
        k, firsts, log_p = self.k, self.firsts, self.parts.bit_length() - 1

        def scatter(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            out = common.Scatter(["<u4"])
            for found, *_ in blocks(batches, k, firsts.value):
                if (b := out.add(*common.upper(found.name, log_p))) is not None:
                    yield b
            if (b := out.take()) is not None:
                yield b

        return self.shared(common.repeated(self.docs.mapInArrow(scatter, common.Scatter.SCHEMA), self.bits, log_p))

    def occurrences(self) -> DataFrame:
        """What the anchors that occur more than once tell: id, row, start and end of contexts that start earlier too, with no name; and of the first of each context of an anchor with several, with its name and m, their number.

        One packed shuffle by anchor. A task sends only the first of each context that it has gathered; what it knows to be covered goes apart, dealt by text and joined to stretches.
        """
        k, firsts, frequent = self.k, self.firsts, self.frequent()
        parts = common.parts_for(self.size, least=16)

        def scatter(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            heads, spans = common.Scatter(HEAD), common.Scatter(STRETCH)
            held: list[list[np.ndarray]] = []

            def given(at_end: bool) -> Iterator[pa.RecordBatch]:
                if held:
                    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                    held.clear()
                    first, later = _first_of_each(columns)
                    name = columns[0][first]
                    yield from sent(False, heads.add(common.mix(name) & np.uint64(parts - 1), *(c[first] for c in columns)))
                    id_, row, start, end = _stretches(*(c[later] for c in columns[2:]), k)
                    yield from sent(True, spans.add(common.mix(id_.view(np.uint64) ^ row.view(np.uint64)) & np.uint64(parts - 1), id_, row, start, end))
                if at_end:
                    yield from sent(False, heads.take())
                    yield from sent(True, spans.take())

            def sent(covered: bool, b: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
                if b is not None:
                    yield pa.record_batch([*b.columns, pa.array(np.full(len(b), covered))], names=["p", "chunk", "covered"])

            for found, ids, rows, offsets in blocks(batches, k, firsts.value):
                kept = np.flatnonzero(common.in_upper(frequent.value, found.name))
                text = found.text[kept]
                held.append([found.name[kept], found.context[kept], ids[text], rows[text], found.first[kept] + offsets[text], (found.last - found.first)[kept] + 1])
                if sum(len(x[0]) for x in held) >= GATHER:
                    yield from given(False)
            yield from given(True)

        def settle(table: pa.Table) -> pa.Table:
            chunk, covered = table.column("chunk"), table.column("covered")
            known = common.gathered(chunk.filter(covered).to_pylist(), STRETCH)
            columns = common.gathered(chunk.filter(pc.invert(covered)).to_pylist(), HEAD)
            first, later = _first_of_each(columns)
            more = _stretches(*(c[later] for c in columns[2:]), k)
            name, _, id_, row, start, n = (c[first] for c in columns)
            _, at, m = np.unique(name, return_inverse=True, return_counts=True)
            some = np.flatnonzero(m[at] > 1)
            start = start.astype(np.int64)
            spans = [np.concatenate((x, y)).astype(np.int64) for x, y in zip(known, more, strict=True)]
            heads = [id_[some], row[some], start[some], start[some] + n[some] - 1 + k]
            none = pa.nulls(len(spans[0]), pa.int64())
            names = [pa.concat_arrays([none, pa.array(x.view(np.int64))]) for x in (name[some], m[at[some]])]
            return pa.table([*names, *(pa.array(np.concatenate((x, y)).astype(np.int64)) for x, y in zip(spans, heads, strict=True))], names=["name", "m", "id", "row", "start", "end"])

        chunks = self.docs.mapInArrow(scatter, common.Scatter.SCHEMA + ", covered boolean")
        return chunks.groupBy("p").applyInArrow(settle, "name long, m long, id long, row long, start long, end long")

    def spans(self) -> DataFrame:
        """SPAN rows of what is covered; they may overlap. Whole copies are not among them."""
        k, firsts = self.k, self.firsts
        found = self.kept(common.released(self.occurrences()))
        later = found.where("name is null").select("id", "row", "start", "end")
        heads = found.where("name is not null")
        many = heads.where(F.col("m") > HOT).select("name").distinct()
        any_hot, hot = not many.isEmpty(), self.bitmap(many)
        places = self.bitmap(heads.select(F.expr("id ^ row ^ (start * 1000003)").alias("place")))

        def take(batches: Iterator[pa.RecordBatch], many: bool) -> Iterable[pa.RecordBatch]:
            for found, ids, rows, offsets in blocks(batches, k, firsts.value):
                id_, row, start = ids[found.text], rows[found.text], found.first + offsets[found.text]
                at = np.flatnonzero(in_bitmap(places.value, id_ ^ row ^ (start * np.int64(1000003))))
                at = at[in_bitmap(hot.value, found.name[at].view(np.int64)) == many]
                raw = [found.raw[a:b] for a, b in zip(found.first[at].tolist(), (found.last[at] + k).tolist(), strict=True)]
                name, left = found.name[at].view(np.int64), (found.place - found.first)[at].astype(np.int32)
                yield pa.record_batch([pa.array(name), pa.array(id_[at]), pa.array(row[at]), pa.array(start[at]), pa.array(left), pa.array(raw, pa.binary())], names=["name", "id", "row", "start", "left", "raw"])

        taken = lambda many: self.docs.mapInArrow(lambda batches: take(batches, many), "name long, id long, row long, start long, left int, raw binary")
        small = taken(False)  # goes right into its shuffle
        if any_hot:
            for more, covered in self.split(self.kept(common.stored(taken(True).drop("name")))):
                small, later = small if more is None else small.unionByName(more), later.unionByName(covered)
        self.contexts = small.repartition("name").sortWithinPartitions("name", "id", "row", F.expr("start + left"))
        return later.unionByName(self.contexts.mapInArrow(_by_anchor(k, _covered), SPAN))

    def split(self, rows: DataFrame) -> Iterator[tuple[DataFrame | None, DataFrame]]:
        """Of contexts of anchors that have too many, step by step: (contexts by groups of at most HOT, or None; spans that are settled).

        A group that shares l bytes to the left of its anchor and r to the right has, with
        ``rest`` bytes left to share, no use for more than l + rest and r + rest. Those that
        agree in that are one from there on; all but the first are covered.
        """
        columns, alike, rest = ["id", "row", "start", "left", "raw"], ["l", "r", "left", "raw"], self.k - GRAM
        rows = rows.withColumns({"l": F.lit(0), "r": F.lit(0)})
        while rest:
            step = (rest + 1) // 2
            rest -= step
            sides = F.explode(F.array(F.struct((F.col("l") + step).alias("l"), "r"), F.struct("l", (F.col("r") + step).alias("r"))))
            rows = rows.select(*columns, sides.alias("to")).select(*columns, "to.*").where(f"left >= l and octet_length(raw) >= left + {GRAM} + r")
            rows = rows.selectExpr("*", f"greatest(0, left - l - {rest}) as low", f"least(octet_length(raw), left + {GRAM} + r + {rest}) as high").where(f"high - low >= {self.k}")
            rows = self.kept(common.stored(rows.selectExpr("id", "row", "start + low as start", "left - low as left", "substring(raw, low + 1, high - low) as raw", "l", "r")))
            heads = self.kept(common.stored(rows.groupBy(*alike).agg(F.min(F.struct("id", "row", "start")).alias("head"))))
            covered = rows.join(heads, alike).where(F.struct("id", "row", "start") > F.col("head"))
            covered = covered.selectExpr("id", "row", "start", "start + octet_length(raw) as end")
            if not rest:
                yield None, covered
                return
            heads = heads.select("head.*", *alike).withColumn("name", F.xxhash64("l", "r", F.expr(f"substring(raw, left - l + 1, l + {GRAM} + r)")))
            n = heads.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
            rows = self.kept(common.stored(heads.join(n, "name")))
            yield rows.where(F.col("n") <= HOT).select("name", *columns), covered
            rows = rows.where(F.col("n") > HOT).drop("n", "name")
            if rows.isEmpty():
                return

    def groups(self) -> DataFrame:
        """The maximal repeats through the anchors of spans(), before result() deletes the tables that they are read from: name of the group, length, id, row and start of each occurrence."""
        return self.contexts.mapInArrow(_by_anchor(self.k, _groups), "name long, length int, id long, row long, start long")

    def result(self, docs: DataFrame, fn, schema) -> DataFrame:
        """What fn makes of Arrow batches of docs and _spans (packed pairs of offsets of what is removed, or null) and _copy (of an earlier whole text).

        Only texts that lose something are shuffled: a bitmap of their ids lets the others pass.
        """
        found = common.released(self.spans())
        common.dropped(*self.tables)
        spans = found.repartition("id", "row").sortWithinPartitions("id", "row", "start").mapInArrow(_packed, "id long, row long, _spans binary")
        low = self.same.groupBy("same").agg(F.min("id").alias("_low"), F.count("*").alias("n")).where("n > 1").select("same", "_low")
        copies = self.same.join(low, "same").where("id > _low").select("id", "row").distinct()
        copies = copies.select(F.col("id").alias("_id"), F.col("row").alias("_row"), F.lit(None).cast("binary").alias("_spans"), F.lit(True).alias("_copy"))
        marks = spans.select(F.col("id").alias("_id"), F.col("row").alias("_row"), "_spans", F.lit(False).alias("_copy")).unionByName(copies)
        marks = common.stored(marks.groupBy("_id", "_row").agg(F.first("_spans", ignorenulls=True).alias("_spans"), F.max("_copy").alias("_copy")))
        common.dropped(found, self.same)
        losing = self.bitmap(marks.select("_id"))
        known = docs.withColumn("_id", self.ids["id"])

        def part(batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = in_bitmap(losing.value, batch.column(batch.num_columns - 1).to_numpy())
                yield batch.filter(pa.array(hit == wanted))

        def unmarked(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [*batch.columns[:-1], pa.nulls(len(batch), pa.binary()), pa.array(np.zeros(len(batch), bool))]
            return pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "_spans", "_copy"])

        rest = known.mapInArrow(lambda batches: fn(map(unmarked, part(batches, False))), schema)
        some = known.mapInArrow(lambda batches: part(batches, True), known.schema).withColumn("_row", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
        some = some.join(marks, ["_id", "_row"], "left").select(*[F.col(f"`{c}`") for c in docs.columns], "_spans", F.coalesce("_copy", F.lit(False)).alias("_copy"))
        return rest.unionByName(some.mapInArrow(fn, schema))


def _by_anchor(k: int, what):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        at, group = None, []
        for batch in batches:
            out: list[tuple] = []
            for name, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != at:
                    if len(group) > 1:
                        out += what(at, group, k)
                    at, group = name, []
                if not group or group[-1][:3] != row[:3]:  # rows of one document
                    group.append(row)
            if out:
                yield batch_of(out)
        if len(group) > 1 and (out := list(what(at, group, k))):
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 if len(out[0]) == 4 else [pa.int64(), pa.int32(), *[pa.int64()] * 3]
        names = ["id", "row", "start", "end"] if len(out[0]) == 4 else ["name", "length", "id", "row", "start"]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _sides(group: list) -> tuple[list[bytes], list[bytes]]:
    return [raw[:left][::-1] for _, _, _, left, raw in group], [raw[left:] for _, _, _, left, raw in group]


def _covered(name: int, group: list, k: int) -> Iterator[tuple]:
    found: dict[int, list[tuple[int, int]]] = {}
    for length, members, extent in repeats(*_sides(group), k):
        for m, before in follows(members, extent):
            if before + length >= k:
                place = group[m][2] + group[m][3]
                found.setdefault(m, []).append((place - before, place + length))
    for m, spans in found.items():
        for a, b in merged(spans):
            yield group[m][0], group[m][1], a, b


def _groups(name: int, group: list, k: int) -> Iterator[tuple]:
    """Repeats whose members do not all go on alike to the left."""
    for length, members, extent in repeats(*_sides(group), k):
        before = min(extent)
        key = int.from_bytes(hashlib.blake2b(group[members[0]][4][group[members[0]][3] - before : group[members[0]][3] + length], digest_size=8).digest(), "little", signed=True)
        for m in members:
            yield key, before + length, group[m][0], group[m][1], group[m][2] + group[m][3] - before


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """One row per text, of spans that come by text and start."""
    at, spans = None, []

    def end(out: list[tuple]) -> None:
        if at is not None:
            out.append((*at, np.array(spans, "<i8").tobytes()))

    for batch in batches:
        out: list[tuple] = []
        for id_, row, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (id_, row):
                end(out)
                at, spans = (id_, row), []
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        if out:
            yield _pack(out)
    out = []
    end(out)
    if out:
        yield _pack(out)


def _pack(out: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["id", "row", "_spans"])


def pairs_of(packed: bytes | None, copy: bool, n: int, k: int) -> list[tuple[int, int]]:
    """The spans to remove of a text of n bytes."""
    if copy and n >= k:
        return [(0, n)]
    return [(int(a), int(b)) for a, b in np.frombuffer(packed or b"", "<i8").reshape(-1, 2)]


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the characters that they cover in part."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def digests(docs: DataFrame, k: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, packed, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode("utf-8", "replace")
                spans = pairs_of(packed, copy, len(raw), k)
                out.append((doc, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(raw, spans)).hexdigest()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return Finder(rows, k).result(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(docs: DataFrame, k: int = 100) -> DataFrame:
    """docs with texts less what repeats, in whole characters; texts of which nothing is left are dropped. Columns named _id, _row, _spans and _copy are not allowed."""
    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            texts, there = [], []
            for text, packed, copy in zip(*(batch.column(c).to_pylist() for c in (at, len(names), len(names) + 1)), strict=True):
                raw = (text or "").encode("utf-8", "replace")
                spans = whole_characters(raw, pairs_of(packed, copy, len(raw), k))
                left = kept_bytes(raw, spans).decode("utf-8", "replace") if spans else text
                texts.append(left)
                there.append(not spans or bool(left.strip()))
            columns = {n: pa.array(texts, pa.string()) if n == "text" else batch.column(c) for c, n in enumerate(names)}
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(there, pa.bool_()))
        common.tidy()

    out = Finder(docs, k).result(docs, run, schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in names else out


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.read(spark, sf_dir, "documents"))
