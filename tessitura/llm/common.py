"""What the operators of this subpackage share: words, packed shuffles, tables in the shared folder, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to lower case, every other byte as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Bytes of an Arrow batch that a Python worker gets, so that a batch of long texts is no memory's end.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a folder; also bounds the session's batches, which else hold thousands of long texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes; null has none."""
    return text.translate(LOWER).split() if text else []


#: All but ASCII letters and the bytes of other characters to blanks.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def lower(text: str) -> str:
    """Lower-cased, each character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def letter_runs(text: str) -> list[bytes]:
    """The runs of letters of a lower-cased text, as UTF-8; characters beyond ASCII count as letters."""
    return text.encode("utf-8", "replace").translate(LETTERS).split()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit values that spreads their bits."""
    out = h >> np.uint64(31)
    out ^= h  # in place: memory that is new is dear
    out *= np.uint64(0x9E3779B97F4A7C15)
    h = out >> np.uint64(29)
    h ^= out
    return h


#: Bytes of texts that are hashed at a time.
BLOCK = 1 << 15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: 0 for blanks, 1 for all other bytes.
SOLID = bytes((~SPACE).tolist())
_BYTE = np.random.default_rng(5).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """Powers of an odd number and of its inverse, as many as were asked for."""

    there = back = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.there):
            inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
            cls.there, cls.back = (np.cumprod(np.append(np.uint64(1), np.full(n, x))) for x in (_STEP, inverse))
        return cls.there, cls.back


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(unsigned 64-bit hash, start) of each lower-cased word of some UTF-8 bytes."""
    if not raw:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = raw.translate(LOWER)
    solid = np.frombuffer(b"".join((b"\0", low.translate(SOLID), b"\0")), np.uint8)
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edges[::2], edges[1::2]
    powers, back = Powers.upto(len(low))
    terms = _BYTE.take(np.frombuffer(low, np.uint8))
    terms *= powers[: len(low)]
    sums = np.empty(len(low) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(terms, out=sums[1:])
    sums = sums[edges]
    h = sums[1::2] - sums[::2]
    h *= back[start]
    h += (end - start).view(np.uint64)
    return mix(h), start


def texts_hashes(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, hashes of the words of some texts in turn, how many words each has); long texts come whole, hashed in parts."""
    low, held, size = 0, [], 0

    def take(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h, start = word_hashes(b" ".join(parts))
        ends = np.cumsum([len(x) + 1 for x in parts])
        return h, np.diff(np.searchsorted(start, ends), prepend=0)

    for k, text in enumerate(texts):
        text = text or b""
        if held and size + len(text) > BLOCK:
            yield low, *take(held)
            low, held, size = k, [], 0
        if len(text) > BLOCK:
            h = np.concatenate([word_hashes(part)[0] for part in cut_at_blanks(text)])
            yield k, h, np.array([len(h)])
            low = k + 1
            continue
        held.append(text)
        size += len(text)
    if held:
        yield low, *take(held)


def cut_at_blanks(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about BLOCK bytes that cut no word."""
    at = 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and not SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of a text; with fewer words the whole sequence is one; none without words."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = out * np.uint64(0x100000001B3) + mix(h[j : len(h) - n + 1 + j])
    return mix(out + np.uint64(n))


def text_bytes(name: str = "text") -> Column:
    return F.col(name).cast("binary")


def total_bytes(df: DataFrame, name: str = "text") -> int:
    """Bytes of a text column over all rows."""
    return df.agg(F.sum(F.octet_length(F.col(name))).alias("n")).first()["n"] or 0


def parts_for(n_bytes: int, each: int = 16 << 20, least: int = 16) -> int:
    """A power of two of shuffle groups, so that each gets the share of about ``each`` bytes of text."""
    return 1 << max(least.bit_length() - 1, (max(1, n_bytes // each) - 1).bit_length())


def tidy() -> None:
    """Gives a Python worker's free memory back, which else stays with it from task to task."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        return (libc := ctypes.CDLL("libc.so.6")).malloc_trim and libc
    except (OSError, AttributeError):
        return None


_LIBC = _libc()


class Scatter:
    """Packs records into one binary row per group of a shuffle, column after column.

    A group is named by a number ``p``; what a task has gathered is given out once it
    passes ``flush`` bytes, so a task never holds more, nor more than a few copies of it.
    """

    SCHEMA = "p int, chunk binary"
    ARROW = pa.schema([("p", pa.int32()), ("chunk", pa.binary())])

    def __init__(self, dtypes: list[str], flush: int = 8 << 20):
        self.dtypes, self.flush, self.held, self.n = [np.dtype(d) for d in dtypes], flush, [], 0
        self.width = 4 + sum(d.itemsize for d in self.dtypes)

    def add(self, p: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch | None:
        self.held.append((p.astype(np.int32), *(c.astype(d, copy=False) for c, d in zip(columns, self.dtypes, strict=True))))
        self.n += len(p)
        return self.take() if self.n * self.width >= self.flush else None

    def take(self) -> pa.RecordBatch | None:
        if not self.n:
            return None
        p, *columns = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        order = np.argsort(p.astype(np.int16) if 0 <= p.min() and p.max() < 1 << 15 else p, kind="stable")  # short numbers are sorted by their digits
        p, columns = p[order], [c.take(order) for c in columns]
        cuts = np.flatnonzero(np.diff(p, prepend=p[0] - 1))
        ends = np.append(cuts[1:], len(p))
        chunks = [b"".join([c[a:b] for c in columns]) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
        out = pa.record_batch([pa.array(p[cuts]), pa.array(chunks, pa.binary())], schema=self.ARROW)
        del columns, chunks, order
        tidy()
        return out


def repeated(chunks: DataFrame, bits: int, log_p: int) -> np.ndarray:
    """A bitmap by their upper bits of the keys that were scattered twice: p is a key's upper ``log_p`` bits, the one column its next 32."""

    def several(key: tuple, table: pa.Table) -> pa.Table:
        seen = repeated_here(table.column("chunk").to_pylist(), bits - log_p)
        return pa.table({"p": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([seen], pa.binary())})

    return joined_bits(chunks.groupBy("p").applyInArrow(several, "p int, bits binary"), bits, log_p)


def repeated_here(chunks: list[bytes], bits: int) -> bytes:
    """A group's share of what repeated() gives."""
    (v,) = gathered(chunks, ["<u4"])
    v = np.sort(v)
    seen = np.zeros(1 << bits, np.uint8)
    seen[v[1:][v[1:] == v[:-1]] >> np.uint32(32 - bits)] = 1
    return np.packbits(seen, bitorder="little").tobytes()


def joined_bits(shares: DataFrame, bits: int, log_p: int) -> np.ndarray:
    """A bitmap by the groups' shares (p, bits)."""
    out, each = np.zeros(1 << (bits - 3), np.uint8), 1 << (bits - log_p - 3)
    for r in shares.collect():  # 2 ** bits bits in all
        out[r["p"] * each : (r["p"] + 1) * each] = np.frombuffer(r["bits"], np.uint8)
    return out


def upper(keys: np.ndarray, log_p: int) -> tuple[np.ndarray, np.ndarray]:
    """What repeated() takes of keys."""
    return keys >> np.uint64(64 - log_p), (keys >> np.uint64(32 - log_p)) & np.uint64(0xFFFFFFFF)


def in_upper(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def gathered(chunks: Iterable[bytes], dtypes: list[str]) -> list[np.ndarray]:
    """The columns that Scatter packed, of all chunks of a group."""
    tidy()
    kinds = [np.dtype(d) for d in dtypes]
    width = sum(k.itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for chunk in chunks:
        n, at = len(chunk) // width, 0
        for k, kind in enumerate(kinds):
            out[k].append(np.frombuffer(chunk, kind, n, at))
            at += n * kind.itemsize
    return [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, kinds, strict=True)]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in a session of one machine that names none."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="shared-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", str(16 << 20)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def released(df: DataFrame) -> DataFrame:
    """df stored; the shuffles that went before are cleared from the disks."""
    df = stored(df)
    df.sparkSession._jvm.System.gc()
    return df


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes the shuffles of what is run as soon as it ends, which else wait for the driver to find them unused."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def dropped(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, of tables that no later result reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): the smallest node that links reach.

    Alternates large-star and small-star steps until no edge changes; each step is a
    grouped minimum and an equi-join, so a node with very many links is no single group.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        grown = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = grown.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        new = stored(grown.join(low, "u").select(pair.alias("e")).select("e.*").where("u > v").distinct())
        dropped(edges)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
