"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

A vector is turned by three rounds of random signs and a fast Hadamard transform; its
hash is the signed axis that it is then nearest to. ``width`` such hashes make the bucket
of a table, and a vector also enters the buckets where one of them is its second choice,
the closest calls first (multiprobe). Vectors that share a bucket are compared in
double precision, in blocks, so a large bucket is many tasks.

Equal vectors are one before anything else. A pair that shares several buckets counts
only in that of the least name, whichever side is asked; so links are summed per vector where they are found, and only the
sums and the components of a block, as links to their least member, leave a task: no
group is given out as all its pairs. Names begin with the number of their table, so a pair
asks for the tables before its own one after the other, for all pairs of many blocks at a
time, and most share the first.

The width grows with the logarithm of the number of vectors, so that unrelated vectors
per bucket stay few; the tables grow with it, to keep what a pair at the threshold is
found by. Pairs that share no bucket are missed: tests measure recall against all pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing; vectors of different length do not link; equal vectors link; repeated
ids each keep a row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import common

#: Rows on either side of a block of comparisons.
BLOCK = 1024
#: Chance that one hash agrees for a pair at the threshold, by which the tables are numbered.
AGREE = 0.55
#: Numbers that are turned at a time, so that they stay near the processor.
TURNED = 1 << 17
#: The bit of a bucket's name at which its table begins.
TABLE_AT = 52
#: Above all names.
NONE = np.iinfo(np.int64).max
#: Rows that are compared at a time, and linked pairs that are told apart at a time.
ROWS, PAIRS = 4096, 1 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the columns, whose length is a power of two; writes over x."""
    d, n = x.shape
    other, h = np.empty_like(x), 1
    while h < d:
        pair, out = x.reshape(d // (2 * h), 2, h * n), other.reshape(d // (2 * h), 2, h * n)
        np.add(pair[:, 0], pair[:, 1], out=out[:, 0])
        np.subtract(pair[:, 0], pair[:, 1], out=out[:, 1])
        x, other = other, x
        h *= 2
    x /= math.sqrt(d)
    return x


@lru_cache(4096)
def signs(seed: int, d: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (3, d))


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """The columns, padded to a power of two, turned."""
    x = x.copy()
    for s in signs(seed, len(x)):
        x *= s[:, None]
        x = hadamard(x)
    return x


def axes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest signed axis, second, how much farther the second is) of each column."""
    x = np.ascontiguousarray(x.T)
    size, rows = np.abs(x), np.arange(len(x))
    first = size.argmax(axis=1)
    most = size[rows, first]
    size[rows, first] = -1
    second = size.argmax(axis=1)
    return 2 * first + (x[rows, first] < 0), 2 * second + (x[rows, second] < 0), most - size[rows, second]


def table_buckets(x: np.ndarray, t: int, width: int, probes: int) -> np.ndarray:
    """Bucket names [row, probe] of unit vectors in a table; the first probe is the vector's own. The upper bits of a name are its table."""
    n, d = x.shape
    out = np.zeros((n, probes), np.uint64)
    padded = 1 << max(1, (d - 1).bit_length())
    each = max(1, TURNED // padded)
    for at in range(0, n, each):
        part = x[at : at + each]
        rows, columns = np.arange(len(part)), np.zeros((padded, len(part)))
        columns[:d] = part.T
        best, other, gap = (np.stack(c, axis=1) for c in zip(*(axes(rotated(columns, 1000 * t + k)) for k in range(width)), strict=True))
        order = np.argsort(gap, axis=1, kind="stable")
        for p in range(probes):
            code = best.copy()
            if p:
                code[rows, order[:, p - 1]] = other[rows, order[:, p - 1]]
            name = np.full(len(part), t * 64 + d * 65536 + 1, np.uint64)
            for k in range(width):
                name = common.mix(name * np.uint64(0x100000001B3) + code[:, k].astype(np.uint64))
            out[at : at + each, p] = np.uint64(t << TABLE_AT) + (name >> np.uint64(64 - TABLE_AT))
    return out


def buckets(x: np.ndarray, width: int, tables: int, probes: int) -> np.ndarray:
    """Bucket names [row, table, probe] of unit vectors."""
    return np.stack([table_buckets(x, t, width, probes) for t in range(tables)], axis=1)


def _vectors(vec_id: str, vector: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)  # null components as NaN
            keys, raw = [], []
            for low, high in zip(np.append(0, ends[:-1]), ends, strict=True) if len(ends) else ():
                x = flat[low:high]
                good = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                b = x.tobytes() if good else None
                raw.append(b)
                keys.append(xxhash.xxh3_64_intdigest(b) - (1 << 63) if good else None)
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.int64()), pa.array(raw, pa.binary())], names=[vec_id, "key", "raw"])

    return run


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bucket_rows(width: int, tables: int, probes: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            key, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(b) for b in raw])
            for size in np.unique(sizes):
                for rows in np.array_split(np.flatnonzero(sizes == size), max(1, int((sizes == size).sum()) // 2000)):
                    names = buckets(_unit([raw[i] for i in rows], kind), width, tables, probes)
                    yield pa.record_batch([pa.array(np.repeat(key[rows], tables * probes)), pa.array(names.reshape(-1).view(np.int64))], names=["key", "bucket"])

    return run


def _least_label(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that links (a, b) reach, for each index."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pairs(x: np.ndarray, block: np.ndarray, first: np.ndarray, second: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows (a, b) of sorted blocks, some blocks at a time; a row is of the first side of its block, of the second, or both."""
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    found, n = [], 0
    for low, high in zip(starts.tolist(), np.append(starts[1:], len(block)).tolist(), strict=True):
        if first[low] and second[low]:
            here = x[low:high]
            a, b = np.nonzero(here @ here.T >= least)
            a, b = a[a < b], b[a < b]
        else:
            one, two = np.flatnonzero(first[low:high]), np.flatnonzero(second[low:high])
            a, b = np.nonzero(x[low + one] @ x[low + two].T >= least)
            a, b = one[a], two[b]
        if len(a):
            found.append(((a + low).astype(np.int32), (b + low).astype(np.int32)))
            n += len(a)
        if n >= PAIRS:
            yield tuple(np.concatenate(c) for c in zip(*found, strict=True))
            found, n = [], 0
    if found:
        yield tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _in_least(x: np.ndarray, bucket: np.ndarray, a: np.ndarray, b: np.ndarray, width: int, probes: int) -> np.ndarray:
    """Which pairs lie in the least bucket that they share. Names begin with their table, so a pair asks for one table after the other up to its own, and most share the first."""
    new, left = np.zeros(len(a), bool), np.arange(len(a), dtype=np.int32)
    own = (bucket >> TABLE_AT).astype(np.int16)[a]
    place, t = np.zeros(len(x), np.int32), 0
    while len(left):
        there = np.zeros(len(x), bool)
        there[a[left]] = there[b[left]] = True
        used = np.flatnonzero(there)
        place[used] = np.arange(len(used))
        names = np.ascontiguousarray(table_buckets(x[used], t, width, probes).view(np.int64).T)
        kept = []
        for at in range(0, len(left), 200_000):
            part = left[at : at + 200_000]
            p, q = names[:, place[a[part]]], names[:, place[b[part]]]
            lowest = np.full(len(part), NONE)
            for name in p:
                hit = np.logical_or.reduce([name == other for other in q])
                np.minimum(lowest, np.where(hit, name, NONE), out=lowest)
            new[part[lowest == bucket[a[part]]]] = True
            kept.append(part[(own[part] > t) & (lowest == NONE)])
        left, t = np.concatenate(kept), t + 1
    return new


def _compare(least: float, width: int, probes: int, kind: str):
    def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """(key, links of it, key of a linked vector) of what is new in whole blocks, many of them at a time: most are of two or three rows."""
        raw, size = table.column("raw").to_pylist(), pc.binary_length(table.column("raw")).to_numpy()
        columns = {c: table.column(c).to_numpy() for c in ("bucket", "i", "j", "mine", "key", "n")}
        for length in np.unique(size):
            rows = np.flatnonzero(size == length)
            bucket, i, j, mine, key, n = (c[rows] for c in columns.values())
            x = _unit([raw[k] for k in rows], kind)
            for a, b in _pairs(x, _blocks(bucket, i, j), mine == i, mine == j, least):
                new = _in_least(x, bucket, a, b, width, probes) & (key[a] != key[b])
                a, b = a[new], b[new]
                count = np.zeros(len(rows), np.int64)
                np.add.at(count, a, n[b])
                np.add.at(count, b, n[a])
                low, found = _least_label(len(rows), a, b), np.flatnonzero(count)
                yield pa.record_batch([pa.array(key[found]), pa.array(count[found]), pa.array(key[low[found]])], names=["key", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) < ROWS and sum(h.nbytes for h in held) < common.BATCH_BYTES:
                continue
            table = pa.Table.from_batches(held)
            block = _blocks(*(table.column(c).to_numpy() for c in ("bucket", "i", "j")))
            last = int(np.searchsorted(block, block[-1])) if len(block) else 0
            yield from links(table.slice(0, last))
            held = table.slice(last).to_batches()
        if held:
            yield from links(pa.Table.from_batches(held))

    return run


def _blocks(*columns: np.ndarray) -> np.ndarray:
    """The number, from 0, of each sorted row's block."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.cumsum(np.append(0, np.any([np.diff(c) != 0 for c in columns], axis=0)))


def near_duplicates(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.9, probes: int = 3) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector."""
    types = dict(table.dtypes)
    kind = "<f4" if types[vector] == "array<float>" else "<f8"  # as the table has them, without loss
    table = table.select(vec_id, F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>"))
    rows = common.stored(table.mapInArrow(_vectors(vec_id, vector, kind), f"`{vec_id}` {types[vec_id]}, key long, raw binary"))
    reps = common.stored(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min(vec_id).alias("low"), F.first("raw").alias("raw")))
    size = reps.agg(F.count("*").alias("n"), F.max(F.octet_length("raw")).alias("bytes")).first()
    width = max(1, math.ceil(math.log(8 * size["n"] + 1) / math.log(2 * max(2, (size["bytes"] or 16) // int(kind[2])))))
    tables = math.ceil(4 / AGREE**width / probes) + 2
    probes = min(probes, width + 1)
    placed = common.stored(reps.select("key", "raw").mapInArrow(_bucket_rows(width, tables, probes, kind), "key long, bucket long"))
    blocks = placed.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    members = placed.join(blocks, "bucket").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "key")
    members = members.join(reps.select("key", "n", "raw"), "key").select("bucket", "i", "j", "mine", "key", "n", "raw")
    found = members.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "key")
    found = common.stored(found.mapInArrow(_compare(least, width, probes, kind), "key long, links long, other long"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    classes = common.components(found.select(F.col("key").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("key"), "component")
    named = reps.select("key", "n", "low").join(links, "key", "left").join(classes, "key", "left").withColumn("component", F.coalesce("component", "key"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select(vec_id, "key").join(named, "key", "left")
    component = F.coalesce("component_id", vec_id)
    return out.select(vec_id, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col(vec_id)).alias("kept"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "embeddings"))


#: By all pairs; for vectors without null components.
SQL = """
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND isfinite(a.norm) AND isfinite(b.norm) AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
), reached AS (
  SELECT vec_id, vec_id AS low FROM vectors
  UNION
  SELECT l.b, r.low FROM reached r JOIN links l ON l.a = r.vec_id
), least AS (
  SELECT vec_id, min(low) AS low FROM reached GROUP BY vec_id
), degrees AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, low AS component_id, low = vec_id AS kept FROM least LEFT JOIN degrees USING (vec_id)
"""
