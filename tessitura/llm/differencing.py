"""Packing of tokenized documents into windows by multiway differencing (Karmarkar-Karp).

A partial partition is a set of k windows with their sums. At first each piece is one; the two
whose largest and least windows are furthest apart are merged again and again, the
largest window of one with the least of the other, so that their imbalances cancel, until
one is left with near-equal windows. Where one of them is above the capacity, k
rises by the share that it is above, and it starts over.

Near-equal windows are all a little short. So the emptiest ones are taken apart: their
pieces are cut to what the others lack, which makes these exactly full, and what is
left over goes to windows of powers of two. No window is padded then.

Each task packs its documents in blocks of so many last pieces; what comes before the last
piece of a document is full windows. Nothing is shuffled, and a window's number holds its
task's, so a task that is run again gives the same.

Defined cases: a null text counts as empty and gives one piece, the separator; repeated rows
each give their pieces; a row whose id is null is like any other; other columns are left
alone; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import common

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Last pieces that are packed together, and bytes of a text that are encoded together.
PIECES, BYTES = 1 << 14, 1 << 20

BLANK = rb"[ \t-\r]"
#: The tokenizer's own pattern where all characters beyond ASCII are letters: what no token spans.
PARTS = re.compile(rb" ?[A-Za-z\x80-\xff]+| ?[!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[!-/:-@\[-`{-~]+|" + BLANK + rb"+(?![^ \t-\r])|" + BLANK + rb"+")
#: Control characters, and characters beyond ASCII that are no Latin-1 letters.
OTHER = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f\xc2\xc4-\xff]|\xc3[\x97\xb7]")
#: A space that a token may begin with, and none spans.
CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")


def byte_of_character() -> dict[str, int]:
    """How vocabularies of byte-level tokenizers write bytes: visible Latin-1 characters as they are, the others from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteIds(dict):
    """Part of a text that no token spans -> its token ids as little-endian unsigned 32-bit numbers, with a memory of bounded size.

    Parts are merged by tiktoken, from the vocabulary of the tokenizer's own file, where its
    merges are in the order of their ids and so mean the same; what the pattern above doesn't
    tell is left to the tokenizer.
    """

    LIMIT, KEEP = 600_000, 300_000
    _known: dict[str, ByteIds] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.merges = merged == sorted(set(merged))
        if self.merges:
            byte = byte_of_character()
            ranks = {bytes(map(byte.__getitem__, token)): k for token, k in model["vocab"].items() if all(c in byte for c in token) and token.encode() not in self.special}
            self.merge = tiktoken.Encoding("parts", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @classmethod
    def of(cls, path: str) -> ByteIds:
        """The one of this Python worker."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def __missing__(self, part: bytes) -> bytes:
        self[part] = ids = array("I", self.merge(part.decode())).tobytes() if self.merges else self.whole(part)
        return ids

    def whole(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def encoded(self, text: bytes) -> bytes:
        """The ids of a text."""
        if any(t in text for t in self.special):
            return self.whole(text)
        if not OTHER.search(text):
            ids = b"".join(map(self.__getitem__, PARTS.findall(text)))
        else:
            out = []
            for some in CUT.sub(b"\xff ", text).split(b"\xff"):
                if OTHER.search(some):
                    if some not in self:
                        self[some] = self.whole(some)
                    out.append(self[some])
                else:
                    out += map(self.__getitem__, PARTS.findall(some))
            ids = b"".join(out)
        if len(self) > self.LIMIT:
            kept = list(islice(self.items(), self.KEEP))
            self.clear()
            self.update(kept)
        return ids


def sliced(text: bytes) -> Iterator[bytes]:
    """A text in slices of about BYTES that no token spans."""
    at = 0
    while len(text) - at > BYTES and (found := CUT.search(text, at + BYTES)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def differenced(lengths: list[int], k: int) -> list[tuple[int, list[int]]]:
    """(sum, numbers of pieces) of k near-equal windows, fullest first."""
    joined: list[tuple[int, int]] = []

    def both(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
        joined.append((a[1], b[1]))
        return a[0] + b[0], len(lengths) + len(joined) - 1

    def imbalance(windows: list[tuple[int, int]]) -> int:  # negative sums, fullest first; windows without pieces are not listed
        return windows[0][0] - (windows[-1][0] if len(windows) == k else 0)

    heap = [(-n, j, [(-n, j)]) for j, n in enumerate(lengths)]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        if len(b) == 1:
            insort(a, both(a.pop(), b[0]) if len(a) == k else b[0])
        else:
            p, q = max(0, k - len(b)), max(0, k - len(a))
            a = sorted(a[:p] + b[:q] + [both(x, y) for x, y in zip(a[p:], b[q:][::-1], strict=True)])
        heapq.heappush(heap, (imbalance(a), number, a))
        number += 1
    out = []
    for total, node in heap[0][2] if heap else []:
        found, todo = [], [node]
        while todo:
            node = todo.pop()
            if node < len(lengths):
                found.append(node)
            else:
                todo += joined[node - len(lengths)]
        out.append((-total, sorted(found)))
    return out


def windows(lengths: list[int], size: int) -> list[tuple[int, list[int]]]:
    """Near-equal windows of at most ``size``, as few as differencing finds room in; no length is above ``size``."""
    k = max(1, -(-sum(lengths) // size))
    while True:
        found = differenced(lengths, k)
        if not found or found[0][0] <= size:
            return found
        k += max(1, k * (found[0][0] - size) // size)


def filled(lengths: list[int], size: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(piece, first token of it, tokens, window, offset): windows that are full, and of powers of two."""
    found = windows(lengths, size)
    full = sum(lengths) // size
    spare = [(j, at, n) for _, some in found[full:] for j in some for at, n in [(0, lengths[j])]][::-1]

    def take(window: int, at: int, n: int) -> Iterator[tuple[int, int, int, int, int]]:
        while n:
            j, start, left = spare.pop()
            m = min(n, left)
            if m < left:
                spare.append((j, start + m, left - m))
            yield j, start, m, window, at
            at, n = at + m, n - m

    for window, (total, some) in enumerate(found[:full]):
        at = 0
        for j in some:
            yield j, 0, lengths[j], window, at
            at += lengths[j]
        yield from take(window, total, size - total)
    rest = sum(n for *_, n in spare)
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            yield from take(full, 0, 1 << bit)
            full += 1


class _Task:
    """The pieces of a task, of which last ones wait until a block of them is there."""

    def __init__(self, size: int, block: int):
        self.size, self.block, self.next = size, block, TaskContext.get().partitionId() << 40
        self.out: list[tuple] = []
        self.last: list[tuple] = []

    def document(self, doc_id: int | None, full: list[int], rest: bytes) -> None:
        tokens = len(full) * self.size + len(rest) // 4
        for k, crc in enumerate(full):
            self.out.append((doc_id, k * self.size, self.size, crc, tokens, self.next, 0))
            self.next += 1
        if rest:
            self.last.append((doc_id, len(full) * self.size, rest, tokens))
            if len(self.last) >= self.block:
                self.pack()

    def pack(self) -> None:
        window = -1
        for j, first, n, window, at in filled([len(rest) // 4 for _, _, rest, _ in self.last], self.size):
            doc_id, start, rest, tokens = self.last[j]
            self.out.append((doc_id, start + first, n, zlib.crc32(rest[4 * first : 4 * (first + n)]), tokens, self.next + window, at))
        self.next += window + 1
        self.last = []

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [()] * 7
        self.out = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])


def packed(docs: DataFrame, tokenizer: str, size: int = 1024, separator: int = 0, block: int = PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task = ByteIds.of(tokenizer), _Task(size, block)
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full, rest = [], b""
                for part in sliced(text or b""):
                    full, rest = _windowed(full, rest + ids.encoded(part), size)
                task.document(doc_id, *_windowed(full, rest + end, size))
            yield task.batch()
        task.pack()
        yield task.batch()
        common.tidy()

    return docs.select(F.col("doc_id").cast("long"), common.text_bytes()).mapInArrow(run, SCHEMA)


def _windowed(full: list[int], b: bytes, size: int) -> tuple[list[int], bytes]:
    """Checksums of full windows, and the ids after them."""
    cut = len(b) // (4 * size) * 4 * size
    return (full if not cut else full + [zlib.crc32(b[at : at + 4 * size]) for at in range(0, cut, 4 * size)]), b[cut:]


def op13_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
