"""Periodic runs of words by longest common extensions from a harmonic grid.

A run is a stretch of words with a smallest period that no neighbouring word extends. A run
of period q and of at least max(6, 4 q) words holds a point of every grid of step
max(6, 4 q) - q whose word is that of q words on; so n words have about n / 3q points
for a period and n log n in all. From all points that agree with their partner the
extension to either side is found by binary search over prefix hashes, for all of them at
once. Hashes never call equal words different, so an extension is at least as long as
it should be; one comparison of the words themselves tells whether it is right, and where it
is not, the extension is counted word by word. Stretches that several points or multiples of
a period lead to are one run, of the least period.

Documents are handled where they are, many short ones at a time, long ones in slices of
points; nothing is shuffled.

Defined cases: null and empty texts have no words and no run; a row whose id is null is like any
other; repeated rows each keep a row; other columns are left alone; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import common

#: Words of documents that are looked at together, and points of the grid at a time.
WORDS, POINTS = 1 << 16, 1 << 19
RUN = "n_runs long, start long, length long, period long, runs_sha256 string, collapsed_sha256 string"


class WordNumbers(dict):
    """A number for each word, from 0 on."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(text: bytes | None, numbers: WordNumbers) -> np.ndarray:
    parts = [np.array(list(map(numbers.__getitem__, part.split())), np.int32) for part in common.cut_at_blanks(text or b"")]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


class Block:
    """Words of some documents one after the other, with prefix hashes."""

    def __init__(self, docs: list[np.ndarray]):
        self.n = np.array([len(x) for x in docs], np.int64)
        self.at = np.cumsum(self.n) - self.n
        self.words = np.concatenate(docs)
        self.powers = common.Powers.upto(len(self.words) + 1)[0]
        values = common.mix(self.words.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        self.sums = np.append(np.uint64(0), np.cumsum(values * self.powers[: len(values)]))

    def grid(self, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, period, point) of all points whose word is that of a period on."""
        longest = np.where(self.n >= max(least, times), self.n // times, 0)
        doc = np.repeat(np.arange(len(self.n)), longest)
        period = np.arange(len(doc)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
        step = np.maximum(least, times * period) - period
        points = np.maximum(0, self.n[doc] - period) // step
        ends = np.cumsum(points)
        for low in range(0, int(ends[-1]) if len(ends) else 0, POINTS):
            first, last = np.searchsorted(ends, [low, min(low + POINTS, ends[-1]) - 1], "right")
            here = slice(first, last + 1)
            before = ends[here] - points[here]
            some = np.minimum(ends[here], low + POINTS) - np.maximum(before, low)
            k = np.repeat(np.arange(first, last + 1), some)
            number = np.arange(low, low + len(k)) - np.repeat(before, some)
            at = self.at[doc[k]] + (number + 1) * step[k] - 1
            same = self.words[at] == self.words[at + period[k]]
            yield doc[k[same]], period[k[same]], at[same]

    def agree(self, a: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (self.sums[a + m] - self.sums[a]) * self.powers[b - a] == self.sums[b + m] - self.sums[b]

    def extended(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, side: int) -> np.ndarray:
        """By hashes, how many words from a and b on (side 1) or before them (side -1) agree, ``most`` at most."""
        m = np.zeros(len(a), np.int64)
        for bit in reversed(range(int(most.max(initial=0)).bit_length())):
            more = m + (1 << bit)
            back = more if side < 0 else 0
            fits = more <= most
            there = np.where(fits, more, 0)
            back = np.where(fits, back, 0)
            m = np.where(fits & self.agree(a - back, b - back, there), more, m)
        return m

    def counted(self, at: int, period: int, low: int, end: int) -> tuple[int, int]:
        """(start, end) of the stretch of a period around a point, word by word."""

        def steps(a: np.ndarray, b: np.ndarray) -> int:
            n, size = 0, 64
            while n < len(a):
                differ = np.flatnonzero(a[n : n + size] != b[n : n + size])
                if len(differ):
                    return n + int(differ[0])
                n, size = n + size, size * 2
            return len(a)

        w, to = self.words, at + period
        return at - steps(w[low:at][::-1], w[low + period : to][::-1]), to + steps(w[at : end - period], w[to:end])

    def repeats(self, start: int, end: int, period: int) -> bool:
        return bool((self.words[start : end - period] == self.words[start + period : end]).all())

    def runs(self, least: int = 6, times: int = 4) -> np.ndarray:
        """Rows (document, start, period, length), sorted, of all runs of at least max(least, times * period) words."""
        found = []
        for doc, period, at in self.grid(least, times):
            low, to = self.at[doc], at + period
            start = at - self.extended(at, to, at - low, -1)
            end = to + self.extended(at, to, low + self.n[doc] - to, 1)
            long = end - start >= np.maximum(least, times * period)
            found.append(np.unique(np.stack([doc, start, end, period, at], 1)[long], axis=0))
        rows = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
        rows = rows[np.lexsort(rows.T[::-1])]
        first = np.flatnonzero((np.diff(rows[:, :3], axis=0, prepend=-1) != 0).any(1))
        sure, doubt = [], []
        for a, b in zip(first, np.append(first, len(rows))[1:], strict=True):
            doc, start, end, period, _ = rows[a].tolist()
            right = self.repeats(start, end, period)
            if right:
                sure.append((doc, start, end, period))
            doubt += [r for r in rows[a:b].tolist() if not right or r[3] % period]
        for doc, _, _, period, at in doubt:  # hashes that agree by chance or design
            low = int(self.at[doc])
            start, end = self.counted(at, period, low, low + int(self.n[doc]))
            if end - start >= max(least, times * period):
                sure.append((doc, start, end, period))
        least_period: dict[tuple, int] = {}
        for *place, period in sure:
            least_period[tuple(place)] = min(period, least_period.get(tuple(place), period))
        out = sorted((doc, start - int(self.at[doc]), period, end - start) for (doc, start, end), period in least_period.items())
        return np.array(out, np.int64).reshape(-1, 4)


def _blocks(texts: Iterable[bytes | None]) -> Iterator[tuple[list[np.ndarray], list[bytes]]]:
    """Documents as numbers of words, with the words, as many as are looked at together."""
    docs, numbers, size = [], WordNumbers(), 0
    for text in texts:
        docs.append(numbered(text, numbers))
        size += len(docs[-1])
        if size >= WORDS or len(docs) >= WORDS // 16:
            yield docs, list(numbers)
            docs, numbers, size = [], WordNumbers(), 0
    if docs:
        yield docs, list(numbers)


def _collapsed(doc: np.ndarray, runs: list[list[int]], words: list[bytes]) -> str:
    """Hash of the words that no run holds after its first period, joined by blanks."""
    if runs:
        change = np.zeros(len(doc) + 1, np.int64)
        for start, period, length in runs:
            change[start + period] += 1
            change[start + length] -= 1
        doc = doc[np.cumsum(change[:-1]) == 0]
    sha = hashlib.sha256()
    for at in range(0, len(doc), WORDS):
        sha.update(b" " * (at > 0) + b" ".join(map(words.__getitem__, doc[at : at + WORDS].tolist())))
    return sha.hexdigest()


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, times: int = 4, every: bool = False) -> DataFrame:
    """Per document its id, number of runs, the longest one (of these the first, then the least period), and the hashes of all runs and of the words left; with ``every`` also runs, an array of (start, length, period)."""
    if times < 2 or least < 2:
        raise ValueError("a run repeats its period at least once")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, texts = [], batch.column(1)
            for numbers, words in _blocks(t.as_py() for t in texts):
                runs = Block(numbers).runs(least, times)
                cuts = np.searchsorted(runs[:, 0], np.arange(len(numbers) + 1))
                for doc, a, b in zip(numbers, cuts[:-1], cuts[1:], strict=True):
                    mine = runs[a:b, 1:].tolist()
                    best = min(((-length, start, period) for start, period, length in mine), default=(None,) * 3)
                    lines = "".join(f"{start},{length},{period}\n" for start, period, length in mine)
                    shas = hashlib.sha256(lines.encode()).hexdigest(), _collapsed(doc, mine, words)
                    out.append((len(mine), best[1], best[0] and -best[0], best[2], *shas, [{"start": s, "length": n, "period": p} for s, p, n in mine] if every else None))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))] * every
            new = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=False)]
            yield pa.record_batch([batch.column(0), *new], names=[str(k) for k in range(1 + len(new))])
            common.tidy()

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), common.text_bytes(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, {RUN}" + ", runs array<struct<start: long, length: long, period: long>>" * every)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, a tenth of which repeat some of their words to the end, as op12's contract says."""
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    rows = rows.withColumn("w", F.when(F.expr("h % 10 = 0"), F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')")))
    rows = rows.withColumns({"n": F.expr("size(w)"), "g": F.expr("h div 10")}).withColumn("a", F.expr("g % greatest(n, 1)"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    text = F.expr("concat_ws(' ', transform(sequence(0, n - 1), i -> w[int(if(i < a, i, a + (i - a) % p))]))")
    return rows.select("doc_id", F.when(F.expr("n > 0"), text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(planted(common.read(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: By pairs of equal words at each distance.
SQL = r"""
WITH split AS (SELECT row_number() OVER () AS rid, doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w, doc_id::VARCHAR AS s FROM documents),
  crc AS (SELECT *, len(w) AS n, xor(list_reduce(flatten([[(ascii(s[i]) >> k) & 1 FOR k IN range(8)] FOR i IN range(1, len(s) + 1)]), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295), 4294967295) AS h FROM split),
  a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN h // 10 % n END AS a, 3 + h // 10 % 8 AS k FROM crc),
  p AS (SELECT *, 1 + (n - a) // k AS p FROM a),
  doc AS MATERIALIZED (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w ELSE [w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] FOR i IN range(n)] END AS w FROM p),
  word AS MATERIALIZED (SELECT rid, n, unnest(range(n)) AS i, unnest(w) AS w FROM doc),
  pair AS (SELECT rid, x.i, y.i - x.i AS q FROM word x JOIN word y USING (rid, w) WHERE y.i > x.i AND (y.i - x.i) * 4 <= x.n),
  island AS (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS g FROM pair),
  stretch AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY rid, q, g),
  run AS MATERIALIZED (SELECT rid, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
  of AS (SELECT rid, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM run GROUP BY rid),
  best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length DESC, start, period) = 1),
  kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM run) USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM doc LEFT JOIN of USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""
