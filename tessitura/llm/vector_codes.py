"""Codes of vectors: product quantisation whose codebooks are found by exponion search.

Components become integers and vectors are cut into equal parts. Each position has a
codebook; a round gives every part its nearest entry and then moves the entries to the
means of their parts. All distances are exact integers.

A part starts at the entry that it had in the round before and walks along that entry's
neighbours, sorted by their distance. An entry that is as near to the part as the start
is no further from the start than twice that distance (triangle inequality); so the walk
ends where the squared distance between entries passes four times the squared distance
of the part, and no nearer or equal entry is left out. Of equal distances the lowest
index wins, also among equal entries.

Rows stay where they are; a round writes them with their codes into the shared folder, and
tasks send one sum for each entry that they met, which are as many as the codebooks are large.

Defined cases: rows whose vector is null or holds null or non-finite components are
dropped; a null id counts as the largest; of equal ids the lesser vector comes first;
repeated rows each keep a row; with fewer rows than entries each row gives one; the
vector of the smallest id sets the width, and vectors of another width have no code and no
error; a width that can't be cut into the parts, or components too large for exact
64-bit distances, are errors; other columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import common

#: Parts that are searched at a time.
BLOCK = 1 << 16
#: Labels whose sums are sent to every task; with more they are joined.
FEW = 50_000


class Codebooks:
    """Entries (parts, entries, width) and each entry's neighbours by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.parts, self.n, self.width = entries.shape
        self.flat = entries.reshape(-1, self.width)
        apart = ((entries[:, :, None] - entries[:, None]) ** 2).sum(3).reshape(-1, self.n)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each of some vectors' parts (vectors, parts, width), from their starts on."""
        shape, x = x.shape[:2], x.reshape(-1, self.width)
        first = np.tile(np.arange(self.parts) * self.n, shape[0])
        best = start.reshape(-1).astype(np.int64)
        row = first + best
        far = ((x - self.flat[row]) ** 2).sum(1)
        reach, live = 4 * far, np.arange(len(x))
        for rank in range(self.n):
            live = live[self.apart[row[live], rank] <= reach[live]]
            if not len(live):
                break
            entry = self.order[row[live], rank]
            away = ((x[live] - self.flat[first[live] + entry]) ** 2).sum(1)
            better = (away < far[live]) | ((away == far[live]) & (entry < best[live]))
            at = live[better]
            far[at], best[at] = away[better], entry[better]
        return best.reshape(shape), far.reshape(shape)

    def moved(self, sums: Iterable[tuple[int, int, int, list[int]]]) -> Codebooks:
        """Entries at the floor of the mean of what was given to them, from (part, entry, count, sums)."""
        entries = self.entries.copy()
        for part, entry, count, total in sums:
            entries[part, entry] = [x // count for x in total]
        return Codebooks(entries)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _blocks(batch: pa.RecordBatch, books: Codebooks) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with their vectors and codes; rows of another width have none."""
    size = books.parts * books.width
    most = math.isqrt((2**63 - 1) // (16 * size))
    for at in range(0, len(batch), step := max(1, BLOCK // books.parts)):
        some = batch.slice(at, step)
        fits = np.array([x == size for x in some.column("q").value_lengths().to_pylist()], bool)
        x = some.column("q").filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(x) and (x.max() > most or x.min() < -most):
            raise ValueError(f"components times their scale have to be at most {most} for exact distances of {size} components")
        yield some, fits, x.reshape(-1, books.parts, books.width)


def _codes(some: pa.RecordBatch, fits: np.ndarray, parts: int) -> np.ndarray:
    found = some.column("code").filter(pa.array(fits)).fill_null(b"\0" * parts)
    return np.frombuffer(b"".join(found.to_pylist()), np.uint8).reshape(-1, parts)


def assigned(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the code and error that some codebooks give them, from the code that they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, fits, x in _blocks(batch, books):
                code, far = books.nearest(x, _codes(some, fits, books.parts))
                codes, errors = np.full(len(some), None), np.full(len(some), None)
                codes[fits] = [r.tobytes() for r in code.astype(np.uint8)]
                errors[fits] = far.sum(1)
                new = [pa.array(codes, pa.binary()), pa.array(errors, pa.int64())]
                yield pa.record_batch([some.column(c) for c in ("id", "label", "q")] + new, names=["id", "label", "q", "code", "error"])

    return run


def gathered(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sum and number of a task's parts for each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(books.entries), np.zeros(books.entries.shape[:2], np.int64)
        for batch in batches:
            for some, fits, x in _blocks(batch, books):
                at = np.broadcast_to(np.arange(books.parts), x.shape[:2]), _codes(some, fits, books.parts)
                np.add.at(total, at, x)
                np.add.at(count, at, 1)
        part, entry = np.nonzero(count)
        sums = pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), sums], names=["part", "entry", "n", "sums"])

    return run


def quantised(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code as a byte per part, error) of each kept vector, and the codebooks; at most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte per part")
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    kept = table.where(v.isNotNull() & finite).select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").alias("label"), ints.alias("q"))
    kinds = dict(kept.dtypes)
    first = [r["q"] for r in kept.select("id", "q").orderBy(F.asc_nulls_last("id"), "q").limit(entries).collect()]
    rows = kept.withColumns({"code": F.lit(None).cast("binary"), "error": F.lit(None).cast("long")})
    if not first:
        return rows.select("id", "label", "code", "error"), None
    if not first[0] or len(first[0]) % parts:
        raise ValueError(f"vectors of {len(first[0])} components can't be cut into {parts} equal parts")
    first = np.array([q for q in first if len(q) == len(first[0])], np.int64)
    books = Codebooks(np.ascontiguousarray(first.reshape(len(first), parts, -1).swapaxes(0, 1)))
    schema = f"id {kinds['id']}, label {kinds['label']}, q array<long>, code binary, error long"
    rows = common.stored(rows)
    for _ in range(rounds):
        new = common.stored(rows.mapInArrow(assigned(books), schema))
        common.dropped(rows)
        rows = new
        sums = rows.mapInArrow(gathered(books), "part int, entry int, n long, sums array<long>")
        sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(books.width)]).alias("sums"))
        books = books.moved((r["part"], r["entry"], r["n"], r["sums"]) for r in sums.collect())  # a row for each entry
    out = common.stored(rows.mapInArrow(assigned(books), schema).drop("q"))
    common.dropped(rows)
    return out, books


def op11_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = quantised(common.read(spark, sf_dir, "embeddings"))
    totals = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if books is not None:
        totals = common.stored(totals)
        totals = F.broadcast(totals) if totals.count() <= FEW else totals
    rows = rows.join(totals, F.col("label").eqNullSafe(F.col("of")), "left")
    return rows.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books and books.sha256()).cast("string").alias("codebooks_sha256"))


def _sql_round(k: int) -> str:
    away = " + ".join(f"(x[{j}] - y[{j}]) * (x[{j}] - y[{j}])" for j in range(1, 5))
    mean = ", ".join(f"(sum(x[{j}])::BIGINT - ((sum(x[{j}])::BIGINT % count(*)) + count(*)) % count(*)) // count(*)" for j in range(1, 5))
    return f"""a{k} AS MATERIALIZED (SELECT rid, part, min(far * 64 + entry) AS least FROM (SELECT rid, part, entry, {away} AS far FROM cut JOIN c{k} USING (part)) GROUP BY ALL),
  m{k} AS (SELECT part, least % 64 AS entry, [{mean}] AS z FROM a{k} JOIN cut USING (rid, part) GROUP BY ALL),
  c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(z, y) AS y FROM c{k} LEFT JOIN m{k} USING (part, entry)),"""


#: By all entries; for vectors of 64 components.
SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, q) - 1 AS rid, * FROM (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
    FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)),
  cut AS MATERIALIZED (SELECT rid, part, q[part * 4 + 1 : part * 4 + 4] AS x FROM kept, (SELECT unnest(range(16)) AS part)),
  c0 AS (SELECT part, rid AS entry, x AS y FROM cut WHERE rid < 64),
  {_sql_round(0)} {_sql_round(1)} {_sql_round(2)}
  book AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2),
  r AS (SELECT rid, string_agg(printf('%02x', least % 64), '' ORDER BY part) AS code, sum(least // 64)::BIGINT AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN r USING (rid), book
"""
