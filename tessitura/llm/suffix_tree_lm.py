"""Language-model scoring by a probabilistic suffix tree over words.

Symbols are the words of a text and its end. The tree's states are contexts of up to
``depth`` words. A context with its next symbol is kept where it was seen ``seen`` times,
whatever the size of the corpus; so what is learned grows with the text, as tables by
hash. A context becomes a state if its next-symbol distribution diverges from that of its
longest proper suffix by ``divergence`` nats.

A state's distribution is smoothed by its suffix's: with c(s) tokens after s, of them
C(s) in kept pairs, P(w|s) = (c(s,w) + (c(s) - C(s) + mass) P(w|suffix)) / (c(s) + mass),
where c(s,w) is 0 for pairs not kept. The root is (c + 1) / (N + V + 1), which leaves
room for one unknown word; so each state's probabilities add up to 1. A token is scored
in the longest suffix of what stands before it that is a state.

log P is a sum: the root's, what each context leaves to its suffix, and for a kept pair
what it gains over that. So an n-gram has one value, as pair and as context, and the
values of a text's n-grams add up wherever they are found. N-grams that make up ``least``
of the training tokens, at most ``1 / least`` a level, are broadcast so that no group of
the shuffle is hot; all others are looked up by a packed shuffle, if a bitmap of fixed
size does not rule them out. Neither ``least`` nor the bitmap changes a score.

Texts are read five times: a reading that counts names the n-grams of the next level, so
that this one shuffles only what may be seen twice; two more score.

Records stay packed from counting to scores. An n-gram is counted where its suffix is and
valued where its context is; with a broadcast suffix or context it goes by its own key,
and such contexts are summed up in parts. Shuffles are deleted once their table is written.

Defined cases: a null text is empty and has one token, its end; without training texts
N = V = 0 and every token has probability 1; repeated rows each keep a row; a null
doc_id counts as not held out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import common
from tessitura.llm.ngram_join import MAX_BITS, bitmap_of, in_bitmap

END = np.uint64(0x5851F42D4C957F2D)
#: Tokens that a task gathers before it counts them.
FLUSH = 600_000
#: Records that chunks hold: (key, times); with its log10 probability; with what it gains as a pair; (key, what it adds to a score, to the base).
WORD, ENTRY, HEAD, VALUE = ["<u8", "<u8"], ["<u8", "<u8", "<f8"], ["<u8", "<u8", "<f8", "<f8"], ["<u8", "<f8", "<f8"]
#: (context, key, times, log10 probability in the suffix); (context, kept, kept0, far); (row, known words, base, score).
GRAM, SUMS, SCORES = ["<u8", "<u8", "<u8", "<f8"], ["<u8", "<f8", "<f8", "<f8"], ["<u8", "<u4", "<f8", "<f8"]


class Index:
    """Sorted keys, found by their upper bits: as they are hashes, few share these. It is made where it is first asked, and kept."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.first = keys, None

    def __len__(self) -> int:
        return len(self.keys)

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "first": None}

    def _make(self) -> None:
        bits = max(8, (2 * len(self.keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        n = np.bincount((self.keys >> self.shift).view(np.int64), minlength=1 << bits)
        self.first, self.more = np.zeros((1 << bits) + 1, np.int32), n > 1
        np.cumsum(n, out=self.first[1:])

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys) or not len(keys):
            return np.full(len(keys), -1, np.int64)
        if self.first is None:
            self._make()
        slot = (keys >> self.shift).view(np.int64)
        at = self.first.take(slot)
        out = np.where(self.keys.take(at, mode="clip") == keys, at, np.int64(-1))
        todo = np.flatnonzero(self.more.take(slot) & (out < 0))
        at, end, want = at[todo], self.first[slot[todo] + 1], keys[todo]
        while len(todo):
            at += 1
            same = self.keys.take(at, mode="clip") == want
            out[todo[same]] = at[same]
            more = ~same & (at + 1 < end)
            todo, at, end, want = todo[more], at[more], end[more], want[more]
        return out


def places(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key, or -1."""
    if not len(sorted_keys) or not len(keys):
        return np.full(len(keys), -1, np.int64)
    if 4 * len(keys) < len(sorted_keys) or keys.dtype != np.uint64:
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == keys, at, -1)
    return Index(sorted_keys).places(keys)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys, where in it each distinct one starts)."""
    order = np.argsort(keys)
    keys = keys[order]
    return order, np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])


def joined(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The key of an n-gram, by the keys of all but its last and all but its first word; a word's key is its hash."""
    return common.mix(common.mix(context) * np.uint64(0x100000001B3) + suffix)


def token_blocks(batches: Iterator[pa.RecordBatch], size: int = FLUSH) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """(rows, their token hashes in turn, lengths) of some texts at a time; a row is (doc_id, held out, text bytes)."""
    rows, tokens, lengths, n = [], [], [], 0
    for batch in batches:
        docs, outs, texts = (c.to_pylist() for c in batch.columns)
        for first, h, counts in common.texts_hashes(texts):
            ends = np.cumsum(counts + 1)
            all_ = np.empty(len(h) + len(counts), np.uint64)
            all_[ends - 1] = END
            word = np.ones(len(all_), bool)
            word[ends - 1] = False
            all_[word] = h
            rows += zip(docs[first : first + len(counts)], outs[first : first + len(counts)], texts[first : first + len(counts)], strict=True)
            tokens.append(all_)
            lengths.append(counts + 1)
            n += len(all_)
            if n > size:
                yield rows, np.concatenate(tokens), np.concatenate(lengths)
                rows, tokens, lengths, n = [], [], [], 0
    if rows:
        yield rows, np.concatenate(tokens), np.concatenate(lengths)
    common.tidy()


def climb(tokens: np.ndarray, lengths: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level n, (key of the n-gram that ends at each token, whether it is within the text)."""
    inside = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    levels = [(tokens, inside >= 0)]
    for n in range(2, depth + 2):
        key = levels[-1][0]
        levels.append((joined(np.append(np.uint64(0), key[:-1]), key), inside >= n - 1))
    return levels


def _side(keys: np.ndarray, parts: int) -> np.ndarray:
    """The group of a shuffle that each key belongs to."""
    return common.mix(keys) & np.uint64(parts - 1)


def _dealt(chunks: DataFrame, parts: int, kinds: list[str], to: list[str], of: Callable[..., tuple[np.ndarray, ...]] | None = None) -> DataFrame:
    """(p, chunk) of the records in ``chunk``, by the key that comes first; ``of`` makes other records of them."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        out = common.Scatter(to)
        for batch in batches:
            for chunk in batch.column(0):
                columns = common.gathered([chunk.as_py()], kinds)
                key, *more = of(*columns) if of else columns
                if (b := out.add(_side(key, parts), key, *more)) is not None:
                    yield b
        if (b := out.take()) is not None:
            yield b

    return chunks.select("chunk").mapInArrow(deal, common.Scatter.SCHEMA)


def _collected(chunks: DataFrame, kinds: list[str]) -> list[np.ndarray]:
    """The records in ``chunk``, by key. They fit the driver."""
    with common.cleared(chunks.sparkSession):
        columns = common.gathered([r["chunk"] for r in chunks.select("chunk").collect()], kinds)
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _released(df: DataFrame) -> DataFrame:
    with common.cleared(df.sparkSession):
        return common.released(df)


def _bitmap(chunks: DataFrame, kinds: list[str]) -> np.ndarray:
    """A bitmap of the keys of records in ``chunk``."""
    with common.cleared(chunks.sparkSession):
        return bitmap_of(chunks.select("chunk"), keys=lambda batch: common.gathered(batch.column(0).to_pylist(), kinds)[0])


def _packed(table: dict, *columns: np.ndarray, kinds: list[str], each: int = 1 << 13, **names) -> None:
    """Adds records to the rows of a table, few in a row: Parquet writes and reads a hundred rows at a time, whatever their size."""
    for at in range(0, len(columns[0]), each):
        for name, value in names.items():
            table[name].append(value)
        table["chunk"].append(b"".join(c[at : at + each].astype(k, copy=False).tobytes() for c, k in zip(columns, kinds, strict=True)))


class _Names:
    """What names the n-grams of a task's texts, so that their groups find which may be seen twice: each block sends an n-gram twice at most."""

    def __init__(self, parts: int, kind: int):
        self.out, self.log_p, self.kind = common.Scatter(["<u4"], 4 << 20), parts.bit_length() - 1, kind

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, times = np.unique(keys, return_counts=True)
        return _sent(self.out.add(*common.upper(np.repeat(keys, np.minimum(times, 2)), self.log_p)), self.kind)

    def rest(self) -> Iterator[pa.RecordBatch]:
        return _sent(self.out.take(), self.kind)


#: Whose a row of a group is: records, what was learned of the level below, names of the n-grams of the level above.
RECORDS, LEARNED, NAMES = 0, 1, 2
SENT = "side int, p int, chunk binary"


def _sent(b: pa.RecordBatch | None, side: int) -> Iterator[pa.RecordBatch]:
    if b is not None:
        yield pa.record_batch([pa.array(np.full(len(b), side, np.int32)), *b.columns], names=["side", "p", "chunk"])


def _twice(table: DataFrame, bits: int, parts: int) -> Broadcast:
    """A bitmap of the n-grams that may be seen twice, by the groups' shares (p, bits) in a table."""
    with common.cleared(table.sparkSession):
        found = common.joined_bits(table.where("bits is not null").select("p", "bits"), bits, parts.bit_length() - 1)
    return table.sparkSession.sparkContext.broadcast(found)


def _counted(docs: DataFrame, parts: int, bits: int) -> DataFrame:
    """(total, distinct, chunk, p, bits) of all words; chunks hold WORD, bits are a group's of the pairs of words that may be seen twice."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        out, names = common.Scatter(["<u8", "<u4"]), _Names(parts, NAMES)
        for _, tokens, lengths in token_blocks(batches):
            keys, times = np.unique(tokens, return_counts=True)
            yield from _sent(out.add(_side(keys, parts), keys, times), RECORDS)
            key, ok = climb(tokens, lengths, 1)[1]
            yield from names.add(key[ok])
        yield from _sent(out.take(), RECORDS)
        yield from names.rest()

    def add(group: tuple, table: pa.Table) -> pa.Table:
        (keys, times), _, names = _sides(table, ["<u8", "<u4"], WORD)
        order, cuts = grouped(keys)
        keys, times = keys[order[cuts]], np.add.reduceat(times.take(order), cuts, dtype=np.int64) if len(cuts) else times
        out = {"total": [int(times.sum())], "distinct": [len(keys)], "chunk": [None]}
        _packed(out, keys, times, kinds=WORD, total=0, distinct=0)
        out["bits"] = [common.repeated_here(names, bits - parts.bit_length() + 1) if names else None, *[None] * (len(out["chunk"]) - 1)]
        out["p"] = [group[0].as_py()] * len(out["chunk"])
        return pa.table({k: out[k] for k in schema.names}, schema=schema)

    schema = pa.schema([("total", pa.int64()), ("distinct", pa.int64()), ("chunk", pa.binary()), ("p", pa.int32()), ("bits", pa.binary())])
    return docs.where("not held_out").mapInArrow(scatter, SENT).groupBy("p").applyInArrow(add, "total long, distinct long, chunk binary, p int, bits binary")


def _occurrences(docs: DataFrame, n: int, parts: int, below: Broadcast | None, twice: Broadcast, head: Broadcast, last: bool) -> DataFrame:
    """(side, p, chunk) of what n-grams occur in training texts, as (context, suffix, times), without those that occur once; ``below`` is a bitmap of those of n - 1 words that are kept, ``twice`` of those of n words that may be seen twice.

    The reading before found the latter, so that this one shuffles no others; it names those of n + 1 words for the next.
    An n-gram goes where its suffix is, if that is not in the head.
    """

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        out, often, names = common.Scatter(["<u8", "<u8", "<u4"]), head.value[0], _Names(parts, NAMES)
        for _, tokens, lengths in token_blocks(batches):
            levels = climb(tokens, lengths, n - 1 if last else n)
            parts_key, (key, ok) = levels[n - 2][0], levels[n - 1]
            if below is not None:
                there = in_bitmap(below.value, parts_key)
                ok = ok & there & np.append(False, there[:-1])
            at = np.flatnonzero(ok)
            at = at[common.in_upper(twice.value, key[at])]
            if not last:
                longer, inside = levels[n]
                more = at[inside[at]]
                there = np.zeros(len(key), bool)
                there[at] = True
                more = more[there[more - 1]]
            order, cuts = grouped(key[at])
            times, at = np.diff(cuts, append=len(at)), at[order[cuts]]
            key, suffix = key[at], parts_key[at]
            yield from _sent(out.add(_side(np.where(often.places(suffix) >= 0, key, suffix), parts), parts_key[at - 1], suffix, times), RECORDS)
            if not last:
                yield from names.add(longer[more])
        yield from _sent(out.take(), RECORDS)
        yield from names.rest()

    return docs.where("not held_out").mapInArrow(scatter, SENT)


def _both(chunks: DataFrame, learned: DataFrame) -> DataFrame:
    chunks = chunks if "side" in chunks.columns else chunks.withColumn("side", F.lit(RECORDS))
    return chunks.unionByName(learned.withColumn("side", F.lit(LEARNED)), allowMissingColumns=True).groupBy("p")


def _sides(table: pa.Table, kinds: list[str], learned: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[bytes]]:
    """The records of a group: the first as they are, what was learned by key; and the chunks of names."""
    sides: tuple[list[bytes], ...] = ([], [], [])
    for chunk, which in zip(table.column("chunk").to_pylist(), table.column("side").to_pylist(), strict=True):
        if chunk is not None:
            sides[which].append(chunk)
    columns = common.gathered(sides[LEARNED], learned)
    order = np.argsort(columns[0])
    return common.gathered(sides[RECORDS], kinds), [c.take(order) for c in columns], sides[NAMES]


def _added(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Each of the sorted keys once, with the sums of its columns."""
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return [keys[cuts], *(np.add.reduceat(c, cuts) if len(cuts) else c for c in columns)]


def _looked_up(head: list[np.ndarray], own: list[np.ndarray], keys: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether each key is in the head, its value there or among a group's own; NaN without)."""
    out, at, mine = np.full(len(keys), np.nan), head[0].places(keys), places(own[0], keys)
    out[mine >= 0] = own[column][mine[mine >= 0]]
    out[at >= 0] = head[column][at[at >= 0]]
    return at >= 0, out


def _weights(c: np.ndarray, kept: np.ndarray, kept0: np.ndarray, far: np.ndarray, divergence: float, mass: float) -> np.ndarray:
    """What contexts leave to their suffixes; NaN for those that are no states."""
    rest, rest0 = np.maximum(0.0, 1 - kept / c), np.maximum(1e-12, 1 - kept0)
    far = far / c - kept / c * np.log(c) + np.where(rest > 0, rest * np.log(np.where(rest > 0, rest, 1.0) / rest0), 0.0)
    return np.where(far >= divergence, (c * rest + mass) / (c + mass), np.nan)


def _sums(context: np.ndarray, times: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """(context, what is kept after it, its share in the suffix, how far they are apart, place of each n-gram's)."""
    own, at = np.unique(context, return_inverse=True)
    far = times * (np.log(times) - before * np.log(10))
    return own, *(np.bincount(at, x, len(own)) for x in (times, 10.0**before, far)), at


def _grams(occurrences: DataFrame, level: DataFrame, parts: int, bits: int, seen: int, head: Broadcast) -> DataFrame:
    """(hot, p, chunk, bits): GRAM of the n-grams that were seen so often, where their context is if that is not in the head; of contexts in the head SUMS, as hot; a group's bits of what may be seen twice a level above."""

    def count(group: tuple, table: pa.Table) -> pa.Table:
        (context, suffix, times), own, names = _sides(table, ["<u8", "<u8", "<u4"], ENTRY)
        keys = joined(context, suffix)
        order, cuts = grouped(keys)
        times = np.add.reduceat(times[order], cuts, dtype=np.uint64) if len(cuts) else times
        kept = times >= seen
        first, times = order[cuts][kept], times[kept].astype(float)
        _, before = _looked_up(head.value, own, suffix[first], 2)
        there = ~np.isnan(before)
        keys, context, times, before = keys[first][there], context[first][there], times[there], before[there]
        hot = head.value[0].places(context) >= 0
        batches = []
        for which, kinds, to, columns in ((False, GRAM, np.where(hot, keys, context), (context, keys, times, before)), (True, SUMS, *(lambda x: (x[0], x[:4]))(_sums(context[hot], times[hot], before[hot])))):
            out = common.Scatter(kinds, 1 << 62)
            out.add(_side(to, parts), *columns)
            if (b := out.take()) is not None:
                batches.append(pa.record_batch([pa.array(np.full(len(b), which)), *b.columns, pa.nulls(len(b), pa.binary())], schema=schema))
        if names:
            batches.append(pa.record_batch([pa.nulls(1, pa.bool_()), pa.array([group[0].as_py()], pa.int32()), pa.nulls(1, pa.binary()), pa.array([common.repeated_here(names, bits - parts.bit_length() + 1)], pa.binary())], schema=schema))
        return pa.Table.from_batches(batches, schema=schema)

    schema = pa.schema([("hot", pa.bool_()), *common.Scatter.ARROW, ("bits", pa.binary())])
    return _both(occurrences, level).applyInArrow(count, "hot boolean, p int, chunk binary, bits binary")


def _states(sums: DataFrame, head: Broadcast, divergence: float, mass: float) -> DataFrame:
    """Chunks of (context, weight) of contexts in the head."""

    def add(table: pa.Table) -> pa.Table:
        context, *parts = common.gathered(table.column("chunk").to_pylist(), SUMS)
        own, at = np.unique(context, return_inverse=True)
        c = head.value[1][head.value[0].places(own)].astype(float)
        out = {"chunk": []}
        _packed(out, own, _weights(c, *(np.bincount(at, x, len(own)) for x in parts), divergence, mass), kinds=["<u8", "<f8"])
        return pa.table(out, schema=pa.schema([("chunk", pa.binary())]))

    return sums.groupBy("p").applyInArrow(add, "chunk binary")


def _valued(grams: DataFrame, level: DataFrame, n: int, head: Broadcast, weights: Broadcast, floor: float, divergence: float, mass: float, last: bool) -> DataFrame:
    """(kind, level, chunk): HEAD of n-grams that reach the floor; of the others ENTRY, if a level follows, and VALUE, with that of contexts below."""

    def value(table: pa.Table) -> pa.Table:
        (context, keys, times, before), own, _ = _sides(table, GRAM, ENTRY)
        often, c = _looked_up(head.value, own, context, 1)
        there = ~np.isnan(c)
        context, keys, times, before, often, c = (x[there] for x in (context, keys, times.astype(float), before, often, c))
        weight = np.full(len(keys), np.nan)
        weight[often] = weights.value[1][weights.value[0].places(context[often])] if often.any() else 0.0
        states, *parts, at = _sums(context[~often], times[~often], before[~often])
        first = np.zeros(len(states), np.int64)
        first[at] = np.flatnonzero(~often)
        left = _weights(c[first], *parts, divergence, mass)
        weight[~often] = left[at]
        p0, state = 10.0**before, ~np.isnan(weight)
        logp = np.where(state, np.log10(np.where(state, times / (c + mass) + weight * p0, 1.0)), before)
        pair = np.where(state, logp - before - np.log10(np.where(state, weight, 1.0)), 0.0)
        top = times >= floor
        out = {"kind": [], "level": [], "chunk": []}
        _packed(out, *(x[top] for x in (keys, times, logp, pair)), kinds=HEAD, kind=0, level=n)
        if not last:
            _packed(out, *(x[~top] for x in (keys, times, logp)), kinds=ENTRY, kind=1, level=n)
        changes = ~top & (np.abs(pair) > 1e-12)  # the others change no score
        _packed(out, keys[changes], pair[changes], np.zeros(changes.sum()), kinds=VALUE, kind=2, level=n)
        left = np.log10(np.where(np.isnan(left), 1.0, left))
        changes = left != 0
        _packed(out, states[changes], left[changes], np.zeros(changes.sum()), kinds=VALUE, kind=2, level=n - 1)
        return pa.table(out, schema=pa.schema([("kind", pa.int32()), ("level", pa.int32()), ("chunk", pa.binary())]))

    return _both(grams, level).applyInArrow(value, "kind int, level int, chunk binary")


class Tree:
    """The frequent n-grams of each level by sorted key: what they gain as pairs, what they leave to their suffix as contexts, each with 0 at the end for all others; and a bitmap of each level's others, but for words."""

    def __init__(self, keys: list[np.ndarray], pairs: list[np.ndarray], left: list[np.ndarray], others: list[np.ndarray | None], total: int, unit: float):
        self.keys, self.others, self.total, self.unit = [Index(k) for k in keys], others, total, unit
        self.pairs, self.left = ([np.append(x, 0.0) for x in xs] for xs in (pairs, left))

    def score(self, tokens: np.ndarray, lengths: np.ndarray, missed: list | None = None, levels: Iterable[int] = ()) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, place of the word or -1) of each token, without what n-grams that are not frequent add; ``missed`` gets their tokens and keys, for each of the levels (from 0)."""
        out, found = np.zeros(len(tokens)), None
        if tokens.dtype != np.uint64:  # rounded to floats, as by np.append of an int: the words that they stand for
            known = self.keys[0].keys
            at = places(known, tokens)
            tokens = np.where(at >= 0, known[at], tokens.astype(np.uint64)) if len(known) else tokens.astype(np.uint64)
        ends = np.cumsum(lengths)[:-1] - 1
        for n, (key, ok) in enumerate(climb(tokens, lengths, len(self.left))):
            at = self.keys[n].places(key)
            at[~ok] = -1
            out += self.pairs[n].take(at)
            if n < len(self.left):
                left = self.left[n].take(at[:-1])
                left[ends] = 0.0  # the next text has it not before it
                out[1:] += left
            if n in levels:
                missed.append(self.rare(n, key, ok & (at < 0)))
            found = at if found is None else found
        return out, found

    def rare(self, n: int, key: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, keys) of the n-grams that may be among those that are not frequent."""
        rare = np.flatnonzero(ok)
        rare = rare if self.others[n] is None else rare[in_bitmap(self.others[n], key[rare])]
        return rare, key[rare]

    def missed(self, tokens: np.ndarray, lengths: np.ndarray, levels: Iterable[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """What score() gives as missed, without the score."""
        found = climb(tokens, lengths, max(levels))
        rare = [self.rare(n, *found[n]) for n in levels]
        return [(at[new], key[new]) for n, (at, key) in zip(levels, rare, strict=True) for new in [self.keys[n].places(key) < 0]]


def train(docs: DataFrame, depth: int = 2, least: float = 1e-6, divergence: float = 0.02, mass: float = 10.0, seen: int = 2, size: int | None = None) -> tuple[Tree, DataFrame]:
    """By the rows of docs (doc_id, held_out, text as bytes) that are not held out: a tree, and the values (level, chunk) of all its other n-grams, packed as VALUE. ``size``: bytes of all texts, if known."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    size = common.total_bytes(docs) if size is None else size
    parts = common.parts_for(size, 16 << 20, 16)
    bits = max(parts.bit_length() + 3, min(MAX_BITS, max(16, size.bit_length())))
    words = _released(_counted(docs, parts, bits))
    twice = _twice(words, bits, parts)
    sums = words.agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).first()
    total, distinct = sums["total"] or 0, sums["distinct"] or 0
    unit = float(np.log10(total + distinct + 1))
    floor = max(1.0, least * total)
    words = words.where("chunk is not null").select("chunk")
    top = lambda key, times: (key[times >= floor], times[times >= floor])
    low = lambda key, times: (key[times < floor], times[times < floor])
    key, times = _collected(_dealt(words, 1, WORD, WORD, top), WORD)  # at most 1 / least, as of each level
    logs = np.log10(times + 1.0)
    keys, pairs, lefts, others = [key], [logs - unit], [np.zeros(len(key))], [None]
    head = send([Index(key), times, logs - unit])
    level = _dealt(words, parts, WORD, ENTRY, lambda key, times: (*low(key, times), np.log10(low(key, times)[1] + 1.0) - unit))
    values = _dealt(words, 1, WORD, VALUE, lambda key, times: (low(key, times)[0], *2 * (np.log10(low(key, times)[1] + 1.0),))).select(F.lit(1).alias("level"), "chunk")
    below = None
    for n in range(2, depth + 2):
        grams = _released(_grams(_occurrences(docs, n, parts, below, twice, head, n > depth), level, parts, bits, seen, head))
        if n <= depth:
            twice = _twice(grams, bits, parts)
        weights = _collected(_states(grams.where("hot"), head, divergence, mass), ["<u8", "<f8"])
        at = places(keys[-1], weights[0])
        lefts[-1][at] = np.where(np.isnan(weights[1]), 0.0, np.log10(np.where(np.isnan(weights[1]), 1.0, weights[1])))
        made = _released(_valued(grams.where("not hot").select("p", "chunk"), level, n, head, send([Index(weights[0]), weights[1]]), floor, divergence, mass, n > depth))
        common.dropped(grams)
        key, times, logp, pair = _collected(made.where("kind = 0"), HEAD)
        keys.append(key)
        pairs.append(pair)
        lefts.append(np.zeros(len(key)))
        values = values.unionByName(made.where("kind = 2").select("level", "chunk"))
        if n <= depth:
            head = send([Index(key), times, logp])
            level = _dealt(made.where("kind = 1"), parts, ENTRY, ENTRY)
            below = send(_bitmap(made.where("kind = 1"), ENTRY) | _bits(key))
    for n in range(2, depth + 2):
        others.append(_bitmap(values.where(F.col("level") == n), VALUE))
    return Tree(keys, pairs, lefts[:-1], others, total, unit), values


def _bits(keys: np.ndarray) -> np.ndarray:
    """A bitmap of keys on the driver, as bitmap_of() makes it."""
    out = np.zeros(1 << (MAX_BITS - 3), np.uint8)
    at = common.mix(keys) & np.uint64((1 << MAX_BITS) - 1)
    np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
    return out


def _row_key(doc: int | None, text: bytes | None) -> int:
    return xxhash.xxh3_64_intdigest(text or b"", seed=(doc or 0) & 0xFFFFFFFFFFFFFFFF)


def score(docs: DataFrame, tree: Tree, values: DataFrame, size: int | None = None) -> DataFrame:
    """By a trained tree and the values of its other n-grams: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Texts are read twice, for every other level each, so that a shuffle holds the lookups of half of them. ``size``: bytes of all texts, if known.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tree)
    parts = common.parts_for(common.total_bytes(docs) if size is None else size, 32 << 20, 16)

    def run(levels: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
        def texts(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            tree, out = shared.value, common.Scatter(["<u8", "<u8"])
            for rows, tokens, lengths in token_blocks(batches, 500_000):
                keys = np.array([_row_key(doc, text) for doc, _, text in rows], np.uint64)
                if levels[0]:
                    missed = tree.missed(tokens, lengths, levels)
                else:
                    logs, place = tree.score(tokens, lengths, missed := [], levels)
                    known = place >= 0
                    base = tree.pairs[0].take(place)
                    starts = np.cumsum(lengths) - lengths
                    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array(keys.view(np.int64)), pa.array(lengths), pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(logs, starts))]
                    yield pa.record_batch([*columns, pa.array(_side(keys, parts).astype(np.int32)), pa.nulls(len(rows), pa.binary())], schema=schema)
                at, rare = (np.concatenate(c) for c in zip(*missed, strict=True))
                order = np.argsort(at, kind="stable")  # a row's own together, which compress well
                rare, of = rare[order], np.repeat(keys, lengths)[at[order]]
                if (b := out.add(_side(rare, parts), rare, of)) is not None:
                    yield chunks(b)
            if (b := out.take()) is not None:
                yield chunks(b)

        return texts

    kept = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, logs double"
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("logs", pa.float64()), *common.Scatter.ARROW])

    def chunks(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([*(pa.nulls(len(b), k) for k in schema.types[:-2]), *b.columns], schema=schema)

    def look_up(table: pa.Table) -> pa.Table:
        (gram, of), (key, value, base), _ = _sides(table, ["<u8", "<u8"], VALUE)
        key, value, base = _added(key, value, base)
        place = places(key, gram)
        found = np.flatnonzero(place >= 0)
        of, place = of.take(found), place.take(found)
        order, cuts = grouped(of)
        place = place.take(order)
        out = common.Scatter(SCORES, 1 << 62)
        if len(cuts):
            row = of[order[cuts]]
            known, base, logs = (np.add.reduceat(x.take(place), cuts) for x in ((base > 0).astype(np.uint32), base, value))
            out.add(_side(row, parts), row, known, base, logs)
        rows = table.filter(table.column("row").is_valid()).select(schema.names).cast(schema)
        return rows if (b := out.take()) is None else pa.concat_tables([rows, pa.Table.from_batches([chunks(b)])])

    def add_up(table: pa.Table) -> pa.Table:
        row, known, base, logs = common.gathered(table.column("chunk").to_pylist(), SCORES)
        row, at = np.unique(row, return_inverse=True)
        known, base, logs = (np.bincount(at, x, len(row)) for x in (known, base, logs))
        return pa.table({"row": row.view(np.int64), "rare_known": known.astype(np.int64), "rare_base": base, "rare_logs": logs})

    found = []
    for levels in (list(range(len(tree.keys))[k::2]) for k in (0, 1)):
        if levels:
            texts = docs.mapInArrow(run(levels), f"{kept}, p int, chunk binary")
            learned = _dealt(values.where((F.col("level") - 1).isin(levels)), parts, VALUE, VALUE)
            found.append(_released(_both(texts, learned).applyInArrow(look_up, f"{kept}, p int, chunk binary")))
    rows = found[0].where("n_tokens is not null")
    sums = found[0].where("chunk is not null").select("p", "chunk")
    for more in found[1:]:
        sums = sums.unionByName(more.where("chunk is not null").select("p", "chunk"))
    sums = sums.groupBy("p").applyInArrow(add_up, "row long, rare_known long, rare_base double, rare_logs double")
    same = rows.groupBy("row").agg(F.count("*").alias("same"), F.sum(F.col("n_tokens") - F.col("n_known")).alias("rare"))
    add = lambda name: (F.coalesce(name, F.lit(0.0)) / F.col("same") - F.col("rare") / F.col("same") * F.lit(tree.unit))
    rare = same.join(sums, "row", "left").select("row", add("rare_logs").alias("add"), add("rare_base").alias("add_base"), F.expr("coalesce(rare_known, 0) div same").alias("add_known"))
    out = rows.join(rare, "row")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("add_known")).alias("n_known"), F.lit(tree.total).cast("long").alias("train_tokens"), (F.col("base") + F.col("add_base")).alias("base_score"), (F.col("logs") + F.col("add")).alias("score"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def op4_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), common.text_bytes())
    size = common.total_bytes(docs)
    return score(docs, *train(docs, size=size), size=size)
