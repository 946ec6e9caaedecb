"""Periodic runs against a search of all periods and starts."""

import hashlib
import random
import zlib

import numpy as np

from tessitura.llm import periodic_runs
from tessitura.llm.periodic_runs import Block


def plain_runs(words, least=6, times=4):
    """Sorted (start, length, period) by definition."""
    n, best = len(words), {}
    for q in range(n, 0, -1):
        start = 0
        while start + q < n:
            if words[start] != words[start + q]:
                start += 1
                continue
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - start >= max(least, times * q):
                best[start, end + q] = q
            start = end
    return sorted((s, e - s, q) for (s, e), q in best.items())


def plain(text):
    words = (text or "").encode().split()
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(((-n, s, q) for s, n, q in runs), default=None)
    first = (top[1], -top[0], top[2]) if top else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(runs), *first, sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2]))).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def texts():
    rng = random.Random(6)
    out = [None, "", " \n ", "a", "a a a a a", "a a a a a a", "A a A a A a A a", " ".join("ab" * 4), " ".join("abc" * 4) + " a", " ".join("aab" * 9 + "aabaab" + "cc" * 6)]
    for k in range(120):
        words = [rng.choice("ab" if k % 2 else "abcdefghé") for _ in range(rng.randint(0, 60))]
        for _ in range(k % 4):
            at, q = rng.randint(0, len(words)), rng.randint(1, 5)
            words[at:at] = (words[at : at + q] or ["x"]) * rng.randint(2, 9)
        out.append(rng.choice([" ", "\t\n", "  "]).join(words))
    return out + [" ".join("xy" * 3000), " ".join(f"w{k % 700}" for k in range(3000))]


def test_runs_equal_the_definition(spark):
    rows = [(k, t, "x", 1.0) for k, t in enumerate(texts())] + [(None, "b b b b b b b", "x", 1.0), (3, "a", "x", 1.0), (3, "a", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, `n.runs` double").repartition(2)
    got = periodic_runs.periodic_runs(docs, every=True)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    found = got.collect()
    assert sorted([tuple(r)[:7] for r in found], key=key) == sorted([(i, *plain(t)) for i, t, *_ in rows], key=key)
    by_id = {r["doc_id"]: [(x["start"], x["length"], x["period"]) for x in r["runs"]] for r in found}
    assert all(by_id[k] == sorted(plain_runs((t or "").split()), key=lambda r: (r[0], r[2])) for k, t, *_ in rows if k is not None and k != 3)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_slices_of_points_change_nothing(monkeypatch):
    docs = [np.array([hash(w) % 1000 for w in (t or "").split()], np.int32) for t in texts()]
    want = Block(docs).runs()
    monkeypatch.setattr(periodic_runs, "POINTS", 7)
    assert (Block(docs).runs() == want).all() and len(want) > 50


def test_other_bounds():
    rng = np.random.default_rng(7)
    for least, times in ((2, 2), (9, 3)):
        for _ in range(60):
            doc = rng.integers(0, 2, 40)
            got = [(s, n, q) for _, s, q, n in Block([doc.astype(np.int32)]).runs(least, times).tolist()]
            assert sorted(got) == plain_runs(doc.tolist(), least, times)


def test_hashes_that_agree_wrongly_are_found_out(monkeypatch):
    """The Thue-Morse word defeats sums of powers modulo 2 ** 64; a hash that always agrees defeats more."""
    word = [bin(k).count("1") % 2 for k in range(1 << 12)]
    doc = np.array(word + word[: 1 << 11] + [1 - x for x in word], np.int32)
    assert len(Block([doc]).runs()) == 0
    monkeypatch.setattr(Block, "agree", lambda self, a, b, m: np.ones(len(a), bool))
    rng = random.Random(8)
    for _ in range(40):
        doc = [rng.choice("ab") for _ in range(50)]
        got = [(s, n, q) for _, s, q, n in Block([np.array([ord(c) for c in doc], np.int32)]).runs().tolist()]
        assert sorted(got) == plain_runs(doc)


def test_planted_texts_follow_the_contract(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([None, "", "  "]) if k % 11 == 0 else "\t".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, 40)))) for k in range(400)] + [(None, "a b")]
    got = {r["doc_id"]: r["text"] for r in periodic_runs.planted(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()}
    for k, text in rows:
        words, h = (text or "").split(), zlib.crc32(str(k).encode())
        n, g = len(words), h // 10
        if k is None or h % 10 or not n:
            assert got[k] == text
            continue
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert got[k] == " ".join(words[i if i < a else a + (i - a) % p] for i in range(n))
