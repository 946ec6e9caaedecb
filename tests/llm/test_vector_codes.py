"""Exponion codes against all distances in plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tessitura.llm import vector_codes


def plain(rows, parts=16, entries=64, rounds=2):
    """(id -> [(code, error)], hash) by comparing each part with every entry."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    size = len(kept[0][1])
    w = size // parts
    cut = lambda q: [tuple(q[p * w : p * w + w]) for p in range(parts)]
    books = [[cut(q)[p] for _, q, _ in kept[:entries] if len(q) == size] for p in range(parts)]

    def nearest(q):
        return [min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p])) for p, x in enumerate(cut(q))]

    for _ in range(rounds):
        given = {}
        for _, q, _ in kept:
            if len(q) == size:
                for p, ((_, k), x) in enumerate(zip(nearest(q), cut(q), strict=True)):
                    given.setdefault((p, k), []).append(x)
        for (p, k), xs in given.items():
            books[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    out = []
    for i, q, label in kept:
        found = nearest(q) if len(q) == size else None
        out.append((i, label, "".join(f"{k:02x}" for _, k in found) if found else None, sum(d for d, _ in found) if found else None))
    return out, hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()


def same(spark, rows, kind="long", **how):
    table = spark.createDataFrame([(v, "x", i, label, [1.0]) for i, v, label in rows], f"embedding array<double>, code string, vec_id {kind}, label int, q array<double>").repartition(3)
    got, books = vector_codes.quantised(table, **how)
    want, sha = plain(rows, **how)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(((r["id"], r["label"], r["code"] and r["code"].hex(), r["error"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert (books and books.sha256()) == sha


def test_codes_equal_all_distances(spark):
    rng = random.Random(3)
    v = lambda s: [rng.gauss(0, s) for _ in range(32)]
    rows = [(k, v(1) if k % 3 else v(0.01), rng.choice([None, 1, 2])) for k in range(300)]
    rows += [(5, rows[5][1], 1), (5, v(1), None), (None, v(1), 1), (300, None, 1), (301, [*v(1)[:31], None], 1), (302, [*v(1)[:31], math.inf], 2), (303, [*v(1)[:31], math.nan], 2), (304, [1.0], 2), (305, [], 2)]
    same(spark, rows)
    same(spark, rows, parts=8, entries=200, rounds=3)


def test_ties_go_to_the_lower_entry(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(16)], 1) for k in range(200)]
    same(spark, rows)
    same(spark, [(k, [0.25] * 16, None) for k in range(100)])
    same(spark, rows[:7])


def test_tables_without_vectors(spark):
    same(spark, [])
    same(spark, [(1, None, 1), (2, [math.nan] * 16, 1)])


def test_what_cannot_be_exact_is_an_error(spark):
    table = lambda v: spark.createDataFrame([(1, v, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.quantised(table([1.0] * 17))
    with pytest.raises(Exception, match="exact distances"):
        vector_codes.quantised(table([1e15] * 16))


def test_the_walk_leaves_out_most_entries():
    rng = np.random.default_rng(5)
    books = vector_codes.Codebooks(rng.integers(-100, 100, (4, 64, 3)))
    x = rng.integers(-100, 100, (500, 4, 3))
    all_ = ((x[:, :, None] - books.entries[None]) ** 2).sum(3)
    code, far = books.nearest(x, np.zeros((500, 4), np.int64))
    again, far2 = books.nearest(x, code)
    assert (code == all_.argmin(2)).all() and (far == all_.min(2)).all() and (again == code).all() and (far2 == far).all()
    looked = (books.apart[np.arange(4) * 64 + code] <= 4 * far[:, :, None]).sum(2)
    assert looked.mean() < 32
