"""Packing by differencing: token ids, windows and pieces."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from tessitura.llm import differencing
from tessitura.llm.differencing import ByteIds, differenced, filled, windows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(11)
    parts = ["the", "Zeit", "don't", "it's", "'tis", "''s", "l'été", "naïve×2", "÷", "œuvre", "12345", "a1b2", "...", "?!", "%%%", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "　", "\x00", "\x7f", "\x1c", "x" * 40, "日本語", "😀", "<|", "endoftext", "<|endoftext|>", "|>", "_", "ß", "Ü", "¼", "ª", "µ"]
    out = [None, "", " ", "\n", "a", "  a", "a  ", "a   b", "   b", "x  <|endoftext|> y"]
    return out + ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 60))) for _ in range(1500)]


def test_ids_are_the_tokenizer_s():
    ids = ByteIds(PATH)
    assert ids.merges
    for text in filter(None, texts()):
        assert ids.encoded(text.encode()) == np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    ids.LIMIT, ids.KEEP = 50, 20
    assert all(ids.encoded(t.encode()) == ids.whole(t.encode()) and len(ids) <= 51 + len(t) for t in texts()[10:300])


def test_slices_join_to_the_same_ids(monkeypatch):
    monkeypatch.setattr(differencing, "BYTES", 30)
    ids = ByteIds.of(PATH)
    for text in filter(None, texts()):
        raw = text.encode()
        parts = list(differencing.sliced(raw))
        assert b"".join(parts) == raw and b"".join(map(ids.encoded, parts)) == ids.whole(raw)


def test_differencing_by_the_definition():
    """Against whole tuples of k windows, merged largest with least."""
    rng = random.Random(12)
    for _ in range(150):
        k, lengths = rng.randint(1, 6), [rng.randint(1, 30) for _ in range(rng.randint(1, 25))]
        parts = [[n] + [0] * (k - 1) for n in lengths]
        while len(parts) > 1:
            parts.sort(key=lambda p: min(p) - max(p))
            a, b, *parts = parts
            parts.append([x + y for x, y in zip(sorted(a), sorted(b, reverse=True), strict=True)])
        got = differenced(lengths, k)
        assert sorted(j for _, some in got for j in some) == list(range(len(lengths))) and all(n == sum(lengths[j] for j in some) for n, some in got) and len(got) <= k
        if len(set(lengths)) == len(lengths) and k == 2:
            assert sorted(n for n, _ in got) == sorted(n for n in parts[0] if n)
    assert differenced([8, 7, 6, 5, 4], 2) == [(16, [1, 3, 4]), (14, [0, 2])] and differenced([], 3) == []


def test_the_count_rises_until_all_fits():
    assert [n for n, _ in windows([6, 6, 6], 9)] == [6, 6, 6]
    rng = random.Random(13)
    for _ in range(50):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(0, 300))]
        found = windows(lengths, 100)
        assert all(n <= 100 for n, _ in found) and sum(n for n, _ in found) == sum(lengths) and len(found) <= 1.5 * sum(lengths) / 100 + 2


def check(pieces, docs, size):
    """Every id of every document in one piece, windows without a gap and without padding."""
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append(r)
    assert set(by_doc) == set(docs)
    for doc, rows in by_doc.items():
        b, at = docs[doc], 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(b) // 4 and r["ids_crc32"] == zlib.crc32(b[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(b) // 4
    for rows in by_window.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size and at & (at - 1) == 0


@pytest.mark.parametrize("block", [1 << 14, 40])
def test_pieces_hold_every_id_once_without_padding(spark, block):
    rng = random.Random(14)
    some = [*texts()[:400], " ".join(rng.choice(["alpha", "beta,", "gamma"]) for _ in range(9000))]
    rows = [(k, t, 1.0, "x") for k, t in enumerate(some)]
    source = spark.createDataFrame(rows, "doc_id long, text string, length double, `a.b` string").repartition(3).persist()
    ids, end = ByteIds.of(PATH), np.zeros(1, "<u4").tobytes()
    want = {k: (ids.whole(t.encode()) if t else b"") + end for k, t in enumerate(some)}
    check(differencing.packed(source, PATH, block=block).collect(), want, 1024)
    check(differencing.packed(source, PATH, size=64, block=block).collect(), want, 64)
    again = spark.createDataFrame([(7, "a b", 0), (7, "a b", 0), (None, None, 0)], "doc_id long, text string, length int")
    got = differencing.packed(again, PATH).collect()
    assert sum(r["length"] for r in got) == 7 and {(r["doc_id"], r["doc_tokens"]) for r in got} == {(7, 3), (None, 1)}
    assert differencing.packed(source.limit(0), PATH).count() == 0


def test_full_windows_take_few_cuts():
    rng = random.Random(15)
    lengths = [rng.randint(1, 1023) for _ in range(2000)]
    out = list(filled(lengths, 1024))
    fill = defaultdict(int)
    for _, _, n, window, _ in out:
        fill[window] += n
    assert len(out) < len(lengths) + 1.2 * sum(lengths) / 1024 and all(n & (n - 1) == 0 for n in fill.values()) and sum(n < 1024 for n in fill.values()) <= 10
