"""Exact Jaccard self-join of documents on n-gram sets by prefix-tree join.

Each text becomes the set of hashes of its n-word windows, in one global order: rarer
n-grams first (by levels of document frequency, counted over all documents), then by
hash. Two sets that are similar enough share an n-gram of their prefixes in that order,
so the first level of the prefix tree is dealt over the cluster: one group per prefix
n-gram. What meets there is tried in three steps, so that no group of copies is ever
expanded into all its pairs:

1. each set against one other, the least of those that it met; links give classes;
2. each set against the nearest, by the bound below, of the other classes;
3. pairs of a group that are still in different classes.

A pair first has to pass a bound on the symmetric difference, from parity bitmaps of
about one bit per n-gram; then the sets of each anchor's partners are put in a trie in
the global order and the anchor traverses it: partners with a common beginning share
their partial overlap, and a subtree ends where the lengths that remain cannot reach
the threshold.

The only data broadcast are bitmaps of at most ``2 ** MAX_BITS`` bits per frequency
level and one of candidate documents. Where they fill up, they only prune less.

Defined cases: a null text, or one without words, has an empty set and links with
nothing; with fewer words than n, the whole sequence is the one n-gram; equal sets are
one class before any join; repeated rows each keep a row; a row without id is never an
anchor and takes its class from equal texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import common

#: Levels of document frequency, and how many bits fewer their bitmaps' places have, as fewer n-grams reach them.
LEVELS, FEWER = (4, 32, 1024), (0, 3, 8)
MAX_BITS = 26
#: Sets in a trie, and sets on either side of a block of pairs.
BLOCK = 512


class Frequency:
    """The level of document frequency of an n-gram, from one bitmap per level."""

    def __init__(self, maps: list[np.ndarray]):
        self.maps = maps

    def level(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint8)
        for m in self.maps:
            out += common.in_upper(m, h)
        return out


def in_bitmap(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = common.mix(ids.astype(np.uint64)) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap_of(ids: DataFrame, bits: int = MAX_BITS, keys: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> np.ndarray:
    """A bitmap of the ids of a one-column table, or of the keys in its batches: a task gives out one map, of fixed size, at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        mine: dict[int, np.ndarray] = {}
        held: list[np.ndarray] = []

        def enter() -> None:
            at = np.concatenate(held)
            at = np.sort(at.astype(np.uint32) if bits <= 32 else at)  # the same place again sets the same bit
            page = at >> at.dtype.type(15)
            cuts = np.flatnonzero(np.diff(page.astype(np.int64), prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
                seen = np.zeros(32768, np.uint8)
                seen[at[a:b] & at.dtype.type(32767)] = 1
                seen = np.packbits(seen, bitorder="little")
                mine[int(page[a])] = mine[int(page[a])] | seen if int(page[a]) in mine else seen
            held.clear()

        for batch in batches:
            own = keys(batch) if keys else batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            held.append(common.mix(own) & np.uint64((1 << bits) - 1))
            if sum(map(len, held)) > 1_000_000:
                enter()
        if held:
            enter()
        if mine:
            yield pa.record_batch([pa.array(list(mine), pa.int32()), pa.array([x.tobytes() for x in mine.values()], pa.binary())], names=["page", "bits"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        seen = np.zeros(4096, np.uint8)
        for x in table.column("bits").to_pylist():
            seen |= np.frombuffer(x, np.uint8)
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([seen.tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in ids.where(F.col(ids.columns[0]).isNotNull()).mapInArrow(run, "page int, bits binary").groupBy("page").applyInArrow(merge, "page int, bits binary").collect():  # as many bits in all
        out[r["page"] * 4096 : (r["page"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def set_key(grams: np.ndarray) -> int:
    """A signed 64-bit name of a sorted set."""
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def needed(nx: int | np.ndarray, ny: int | np.ndarray, num: int, den: int) -> int | np.ndarray:
    """Least size of the intersection for den * intersection >= num * union."""
    return -(-num * (nx + ny) // (num + den))


def parity(grams: np.ndarray) -> bytes:
    """A bitmap of at least one bit per n-gram: for each value of its low bits, whether their number is odd."""
    size = max(64, 1 << (len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ_at_least(x: bytes, y: bytes) -> int:
    """A lower bound on the size of the symmetric difference of the sets of two parity bitmaps."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def may_link(nx: int, x: bytes, ny: int, y: bytes, num: int, den: int) -> bool:
    least = needed(nx, ny, num, den)
    return least <= min(nx, ny) and differ_at_least(x, y) <= nx + ny - 2 * least


class Trie:
    """Sets as sequences in the global order; nodes hold what a run of n-grams has in common."""

    def __init__(self) -> None:
        self.root = [np.zeros(0, np.uint64), {}, [], 1 << 60, 0]  # label, children, sets that end here, least size, longest rest

    def add(self, name: int, seq: np.ndarray) -> None:
        node, n, rest = self.root, len(seq), seq
        while True:
            node[3], node[4] = min(node[3], n), max(node[4], len(rest))
            if not len(rest):
                node[2].append((name, n))
                return
            child = node[1].get(int(rest[0]))
            if child is None:
                node[1][int(rest[0])] = [rest, {}, [(name, n)], n, 0]
                return
            label = child[0]
            m = min(len(label), len(rest))
            other = np.flatnonzero(label[:m] != rest[:m])
            same = int(other[0]) if len(other) else m
            if same < len(label):
                below = [label[same:], child[1], child[2], child[3], child[4]]
                child[0], child[1], child[2], child[4] = label[:same], {int(label[same]): below}, [], child[4] + len(label) - same
            rest, node = rest[same:], child

    def similar(self, seq: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
        """(set, size of the intersection) of the sets that are similar enough to seq."""
        by_value = np.argsort(seq)
        values, nx, found = seq[by_value], len(seq), []
        stack = [(child, 0, -1) for child in self.root[1].values()]
        while stack:
            (label, children, ends, least_n, longest), shared, last = stack.pop()
            least = int(needed(nx, least_n, num, den))
            if shared + min(len(label) + longest, nx - 1 - last) < least:
                continue
            at = np.minimum(np.searchsorted(values, label), nx - 1)
            hit = at[values[at] == label]
            if len(hit):
                shared, last = shared + len(hit), max(last, int(by_value[hit[-1]]))
            found += [(name, shared) for name, n in ends if shared >= needed(nx, n, num, den)]
            if shared + min(longest, nx - 1 - last) >= least:
                stack += [(child, shared, last) for child in children.values()]
        return found


def sets_of(n: int, batches: Iterator[pa.RecordBatch], keep: np.ndarray | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, sorted n-gram hashes) of each document, or of those in the bitmap ``keep``."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        if keep is not None:
            kept = pa.array(in_bitmap(keep, ids.fill_null(0).to_numpy(zero_copy_only=False)))
            ids, texts = ids.filter(kept), texts.filter(kept)
        ids = ids.to_pylist()
        for first, h, counts in common.texts_hashes(texts.to_pylist()):
            ends = np.cumsum(counts)
            for k, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True), first):
                yield ids[k], np.unique(common.shingle_hashes(h[a:b], n))
    common.tidy()


class Join:
    """The steps of one self-join; ``num / den`` is the least similarity."""

    def __init__(self, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100):
        self.spark, self.num, self.den, self.sets = docs.sparkSession, num, den, partial(sets_of, n)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes())
        size = common.total_bytes(docs)
        self.parts = common.parts_for(size)
        self.bits = max(self.parts.bit_length() + 3 + max(FEWER), min(MAX_BITS, max(16, size.bit_length())))

    def meta(self) -> DataFrame:
        """doc_id, n, key and parity bitmap of each document; key is null where the set is empty."""
        sets = self.sets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            rows: list[tuple] = []
            for i, s in sets(batches):
                rows.append((i, len(s), set_key(s) if len(s) else None, parity(s) if len(s) else None))
                if len(rows) == 5000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n", "key", "parity"])

        return self.docs.mapInArrow(run, "doc_id long, n long, key long, parity binary")

    def frequency(self) -> Frequency:
        """Counts all n-grams of all documents; what comes to the driver is one bitmap per level."""
        sets, log_p, bits = self.sets, self.parts.bit_length() - 1, self.bits

        def scatter(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            out = common.Scatter(["<u4"])
            for _, s in sets(batches):
                if (b := out.add(s >> np.uint64(64 - log_p), (s >> np.uint64(32 - log_p)) & np.uint64(0xFFFFFFFF))) is not None:
                    yield b
            if (b := out.take()) is not None:
                yield b

        def count(key: tuple, table: pa.Table) -> pa.Table:
            (v,) = common.gathered(table.column("chunk").to_pylist(), ["<u4"])
            v = np.sort(v)
            first = np.flatnonzero(np.diff(v.astype(np.int64), prepend=-1))
            times = np.diff(np.append(first, len(v)))
            maps = []
            for level, fewer in zip(LEVELS, FEWER, strict=True):
                seen = np.zeros(1 << (bits - fewer - log_p), np.uint8)
                seen[v[first[times >= level]] >> np.uint32(32 - bits + fewer + log_p)] = 1
                maps.append(np.packbits(seen, bitorder="little").tobytes())
            return pa.table({"p": pa.array([key[0].as_py()] * len(LEVELS), pa.int32()), "level": pa.array(range(len(LEVELS)), pa.int32()), "bits": pa.array(maps, pa.binary())})

        maps = [np.zeros(1 << (bits - fewer - 3), np.uint8) for fewer in FEWER]
        for r in self.docs.mapInArrow(scatter, common.Scatter.SCHEMA).groupBy("p").applyInArrow(count, "p int, level int, bits binary").toLocalIterator():
            here = np.frombuffer(r["bits"], np.uint8)
            maps[r["level"]][r["p"] * len(here) : (r["p"] + 1) * len(here)] = here
        return Frequency(maps)

    def groups(self) -> DataFrame:
        """(gid, key, low): the sets that share a prefix n-gram, where there are two at least, and the least of them. Equal groups are one."""
        sets, log_p, num, den, frequency = self.sets, self.parts.bit_length() - 1, self.num, self.den, self.frequency_

        def scatter(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            out, levels = common.Scatter(["<u8", "<i8"]), frequency.value
            for i, s in sets(batches):
                if i is None or not len(s):
                    continue
                long = len(s) + num * len(s) // -den + 1  # n less the least overlap, and one
                level = levels.level(s)
                rare = s[level == 0]
                if len(rare) < long:
                    rare = s[np.argsort(level, kind="stable")]
                head = rare[:long]
                if (b := out.add(head >> np.uint64(64 - log_p), head, np.full(len(head), set_key(s)))) is not None:
                    yield b
            if (b := out.take()) is not None:
                yield b

        def meet(table: pa.Table) -> pa.Table:
            token, key = common.gathered(table.column("chunk").to_pylist(), ["<u8", "<i8"])
            order = np.lexsort((key, token))
            token, key = token[order], key[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            token, key = token[new], key[new]
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            count = np.diff(np.append(first, len(token)))
            name = np.add.reduceat(common.mix(common.mix(key.view(np.uint64))), first) if len(first) else np.zeros(0, np.uint64)
            several = np.flatnonzero(count > 1)
            name, at = np.unique(name[several], return_index=True)
            first, count = first[several[at]], count[several[at]]
            rows = np.repeat(first - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum()) if len(count) else np.zeros(0, np.int64)
            return pa.table({"gid": pa.array(np.repeat(name, count).view(np.int64)), "key": pa.array(key[rows]), "low": pa.array(np.repeat(key[first], count))})

        return self.docs.mapInArrow(scatter, common.Scatter.SCHEMA).groupBy("p").applyInArrow(meet, "gid long, key long, low long")

    def passing(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) of keys, those that the bitmaps allow."""
        num, den = self.num, self.den
        one = self.reps.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
        two = self.reps.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                ok = [may_link(nx, x, ny, y, num, den) for nx, x, ny, y in zip(*(batch.column(c).to_pylist() for c in ("na", "pa", "nb", "pb")), strict=True)]
                kept = pa.array(ok, pa.bool_())
                yield pa.record_batch([batch.column(c).filter(kept) for c in ("a", "b")], names=["a", "b"])

        return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b), those that link: the a of each b in tries, which b traverses."""
        sets, num, den, frequency = self.sets, self.num, self.den, self.frequency_
        keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        ids = common.stored(keys.join(self.reps.select("key", F.col("doc_id").alias("rep")), "key"))
        keep = self.spark.sparkContext.broadcast(bitmap_of(ids.select("rep")))

        def load(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            levels, rows, held = frequency.value, [], 0
            for i, s in sets(batches, keep.value):
                if i is None or not len(s):
                    continue
                rows.append((i, set_key(s), s[np.argsort(levels.level(s), kind="stable")].tobytes()))
                held += 8 * len(s)
                if held > 8 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["rep", "key", "grams"])

        loaded = self.docs.mapInArrow(load, "rep long, key long, grams binary").join(ids, ["rep", "key"], "left_semi").select("key", "grams")
        blocks = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        of_a = pairs.join(blocks, "b").select("b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), F.col("a").alias("key"), F.lit(1).alias("kind"))
        of_b = blocks.select("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("b").alias("key"), F.lit(0).alias("kind"))
        rows = of_a.unionByName(of_b).join(loaded, "key").select("b", "block", "kind", "key", "grams")

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            at, anchor, trie = None, None, Trie()
            found: list[tuple[int, int]] = []

            def end() -> None:
                if anchor is not None:
                    found.extend((a, at[0]) for a, _ in trie.similar(anchor, num, den))

            for part in batches:
                for b, block, kind, key, grams in zip(*(part.column(c).to_pylist() for c in ("b", "block", "kind", "key", "grams")), strict=True):
                    if at != (b, block):
                        end()
                        at, anchor, trie = (b, block), None, Trie()
                    seq = np.frombuffer(grams, np.uint64)
                    if kind == 0:
                        anchor = seq
                    else:
                        trie.add(key, seq)
                if found:
                    yield links(found)
                    found = []
            end()
            if found:
                yield links(found)

        def links(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

        return rows.repartition("b", "block").sortWithinPartitions("b", "block", "kind", "key").mapInArrow(probe, "a long, b long").distinct()

    def across(self, groups: DataFrame, classes: DataFrame, nearest: bool = False) -> DataFrame:
        """Pairs of a group whose sets are in different classes and may link; large groups in blocks against blocks.

        With ``nearest`` only one for each set of a block, that with the least bound on their difference.
        """
        num, den = self.num, self.den
        rows = groups.join(classes, "key", "left").select("gid", "key", F.coalesce("component", "key").alias("component"))
        mixed = rows.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("lo <> hi")
        rows = rows.join(mixed.select("gid", "blocks"), "gid").join(self.reps.select("key", "n", "parity"), "key")
        mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
        rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("gid", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "key", "component", "n", "parity")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            at, held = None, []
            found: set[tuple[int, int]] = set()

            def end() -> None:
                best: dict[int, tuple[int, int]] = {}
                for k, (side, x, c, n, bits) in enumerate(held):
                    for side2, y, c2, n2, bits2 in held[k + 1 :]:
                        if c != c2 and (at[1] == at[2] or side != side2) and (min(x, y), max(x, y)) not in found and may_link(n, bits, n2, bits2, num, den):
                            if nearest:
                                far = differ_at_least(bits, bits2)
                                best[x], best[y] = min(best.get(x, (far, y)), (far, y)), min(best.get(y, (far, x)), (far, x))
                            else:
                                found.add((max(x, y), min(x, y)))
                found.update((max(x, y), min(x, y)) for x, (_, y) in best.items())

            for part in batches:
                for gid, i, j, *row in zip(*(part.column(c).to_pylist() for c in ("gid", "i", "j", "mine", "key", "component", "n", "parity")), strict=True):
                    if at != (gid, i, j):
                        end()
                        at, held = (gid, i, j), []
                    held.append(row)
                if len(found) > 100_000:
                    yield links(found)
                    found.clear()
            end()
            if found:
                yield links(found)

        def links(found: set[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

        return rows.repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j", "key").mapInArrow(run, "a long, b long").distinct()

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id and n_same (rows with an equal set) of each document."""
        meta = common.stored(self.meta())
        self.reps = common.stored(meta.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.count("*").alias("n_same")))
        self.frequency_ = self.spark.sparkContext.broadcast(self.frequency())
        groups = common.stored(self.groups())
        first = groups.where("low < key").groupBy("key").agg(F.min("low").alias("b")).select(F.col("key").alias("a"), "b")
        links = common.stored(self.verified(common.stored(self.passing(first))))
        classes = common.stored(common.components(links).select(F.col("node").alias("key"), "component"))
        members = groups.select("gid", "key").distinct()
        for nearest in (True, False):
            rest = common.stored(self.across(members, classes, nearest))
            if rest.isEmpty():
                break
            links = links.unionByName(common.stored(self.verified(rest)))
            classes = common.stored(common.components(links).select(F.col("node").alias("key"), "component"))
        named = self.reps.select("key", "doc_id", "n_same").join(classes, "key", "left").select("key", "doc_id", "n_same", F.coalesce("component", "key").alias("component"))
        lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        named = named.join(lowest, "component").select("key", "component_id", "n_same")
        out = meta.select("doc_id", F.col("n").alias("n_shingles"), "key").join(named, "key", "left")
        return out.select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_same", F.lit(1)).alias("n_same"))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    return Join(docs, n, num, den).result()


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.read(spark, sf_dir, "documents"))


#: By a plain self-join on all shingles; for tables without repeated doc_ids.
SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), lists AS MATERIALIZED (
  SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS l FROM words
), same AS (
  SELECT doc_id, CASE WHEN len(l) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY l) END AS n_same FROM lists
), sets AS MATERIALIZED (
  SELECT doc_id, unnest(l) AS s FROM lists
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), edges AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT a AS doc_id, a AS low FROM edges
  UNION
  SELECT e.b, r.low FROM reached r JOIN edges e ON e.a = r.doc_id
), least AS (
  SELECT doc_id, min(low) AS low FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.low, d.doc_id) AS component_id, n_same::BIGINT AS n_same
FROM same d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id)
"""
