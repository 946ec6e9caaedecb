"""Operators that learn or compare across the corpus, against plain versions."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessitura.llm import repeats, suffix_tree_lm


def plain_removal(docs, k):
    """Of documents (id, bytes) in order: what every byte's fate is, by looking at all strings of k bytes."""
    seen, out = set(), {}
    for i, raw in sorted(docs):
        gone = bytearray(len(raw))
        for x in range(len(raw) - k + 1):
            s = raw[x : x + k]
            if s in seen:
                gone[x : x + k] = b"\1" * k
            seen.add(s)
        spans = sum(1 for x in range(len(raw)) if gone[x] and not (x and gone[x - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_equals_looking_at_all_strings(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(repeats, "HOT", 12)
    sentence = lambda n: "".join(rng.choice("abé  ñcdefg") for _ in range(n))
    passages = [sentence(rng.choice([60, 110, 150, 400])) for _ in range(8)]
    docs = []
    for i in range(120):
        text = "".join(rng.choice([sentence(rng.randrange(150)), rng.choice(passages), passages[0]]) for _ in range(rng.randrange(6)))
        if i % 7 == 0 and docs:
            text = docs[rng.randrange(len(docs))][1] or ""
        if i % 11 == 0 and len(text) > 50:
            at = rng.randrange(len(text))
            text = text[:at] + "X" + text[at + 1 :]
        docs.append((i, text, 0))
    docs += [(500, "a" * 700, 0), (501, None, 0), (502, "", 0), (503, "ab" * 300, 0), (504, "a" * 99, 0), (505, "a" * 150, 0)]
    table = spark.createDataFrame(docs + [docs[9]], "doc_id long, text string, start long").repartition(4)
    got = [tuple(r) for r in repeats.digests(table).collect()]
    want = plain_removal([(i, (t or "").encode()) for i, t, _ in docs], 100)
    assert len(got) == len(docs) + 1 and {r[0]: r[1:] for r in got} == want
    assert sum(w[1] for w in want.values()) > 5000
    kept = {r["doc_id"]: r["text"] for r in repeats.cut(table).collect()}
    assert all(len((kept.get(i) or "").encode()) >= w[0] - w[1] for i, w in want.items()) and kept[501] is None and kept[502] == ""
    assert repeats.digests(table.limit(0)).count() == 0


def test_removal_leaves_only_the_table_that_its_result_reads(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 3)
    rng, written, dropped = random.Random(9), [], []
    stored, drop = repeats.common.stored, repeats.common.dropped
    monkeypatch.setattr(repeats.common, "stored", lambda df: (written.append(out := stored(df)), out)[1])
    monkeypatch.setattr(repeats.common, "dropped", lambda *tables: (dropped.extend(t.stored_at for t in tables), drop(*tables)))
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    docs = [(i, "".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(200))) + passage[: 100 + i] + "".join(rng.choice("xyz") for _ in range(60))) for i in range(30)]
    docs.append((40, docs[7][1]))
    got = {r[0]: tuple(r[1:]) for r in repeats.digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_removal([(i, t.encode()) for i, t in docs], 100)
    assert len(written) > 6 and len({t.stored_at for t in written} - set(dropped)) == 1
    columns = {c for t in written for c in t.columns}
    assert "raw" in columns and "many" not in columns  # texts are written for anchors with too many contexts only


def test_long_texts_in_parts(spark):
    rng = random.Random(3)
    big = "".join(rng.choice("abcdefgh") for _ in range(repeats.BLOCK * 2 + 5000))
    docs = [(1, big), (2, "x" + big[repeats.BLOCK - 3000 : repeats.BLOCK + 3000] + "y"), (3, big[:150] + big[8000:8120])]
    got = {r[0]: tuple(r)[1:4] for r in repeats.digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (len(big), 0, 0), 2: (6002, 6000, 1), 3: (270, 270, 1)}


def test_interval_tree_and_repeat_groups(spark):
    assert sorted(repeats.intervals([2, 3, 0, 1])) == [(1, 3, 4), (2, 0, 2), (3, 1, 2)]
    rng = random.Random(4)
    part = "".join(rng.choice("abcdefgh") for _ in range(130))
    docs = [(i, chr(110 + i) * 30 + part + chr(110 + i) * 40) for i in range(5)]
    finder = repeats.Finder(spark.createDataFrame(docs, "doc_id long, text string"))
    finder.spans().count()
    rows = finder.groups().collect()
    by = {}
    for r in rows:
        by.setdefault(r["name"], set()).add((r["id"], r["start"], r["length"]))
    assert rows and all({x[0] for x in g} == {0, 1, 2, 3, 4} for g in by.values())


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_suffix_tree_scores(spark):
    rng = random.Random(5)
    follow = {w: rng.sample([f"w{j}" for j in range(30)], 3) for w in [f"w{i}" for i in range(30)]}

    def text():
        w = ["w0"]
        for _ in range(rng.randrange(40)):
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w) + rng.choice(["", " Rare" + str(rng.randrange(300))])

    docs = [(i, text()) for i in range(400)] + [(900, None), (901, ""), (902, "never seen\twords W1"), (7, "another text")]
    docs += [docs[3]]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = table.select("doc_id", suffix_tree_lm.held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    tree, words = suffix_tree_lm.train(rows, least=1e-4)
    got = suffix_tree_lm.score(rows, tree, words).collect()
    tokens = [[*lower(t or "").split(), None] for _, t in docs]
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    count = {}
    for t, o in zip(tokens, out):
        for w in t if not o else []:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted((i, o, len(t), sum(w in count for w in t), n, round(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in t), 6)) for (i, _), t, o in zip(docs, tokens, out))
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 0.6
    empty = suffix_tree_lm.score(rows, *suffix_tree_lm.train(rows.limit(0))).first()
    assert empty["score"] == empty["base_score"] == 0 and suffix_tree_lm.score(rows.limit(0), tree, words).count() == 0


def test_states_are_distributions(spark):
    import numpy as np

    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["a b", "b c a", "c c b"]) for _ in range(30))) for i in range(60)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", F.lit(False).alias("held_out"), F.col("text").cast("binary").alias("text"))
    tree, _ = suffix_tree_lm.train(rows, least=1e-4, divergence=0.001)
    name = lambda w: suffix_tree_lm.common.word_hashes(w)[0]
    total = 0.0
    for w in (b"a", b"b", b"c", None, b"unknown"):
        h = np.append(name(b"c a"), suffix_tree_lm.END if w is None else name(w)[0])
        logs, place = tree.score(h, np.array([3]))
        total += 10 ** (logs[-1] - (tree.unit if place[-1] < 0 else 0))
    assert abs(total - 1) < 1e-9 and any((x < 0).any() for x in tree.left)


def test_contexts_are_kept_whatever_the_size_of_the_corpus(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(["a b", "b c a", "c c b"]) for _ in range(30))) for i in range(60)] + [(100 + i, f"x{i} y{i} z{i} x{i} y{i} z{i}") for i in range(20)] + [(200, "x3 y3 z3"), (201, "x3 y4 z3")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", (F.col("doc_id") >= 200).alias("held_out"), F.col("text").cast("binary").alias("text"))
    # plain version
    tokens = [[*t.split(), None] for i, t in docs if i < 200]
    counts = [{} for _ in range(3)]
    for t in tokens:
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1):
                counts[n - 1][tuple(t[i : i + n])] = counts[n - 1].get(tuple(t[i : i + n]), 0) + 1
    total, distinct = sum(counts[0].values()), len(counts[0])
    kept = [counts[0], *({g: c for g, c in x.items() if c >= 2} for x in counts[1:])]
    weights = {}

    def p(context, w):
        if not context:
            return (counts[0].get((w,), 0) + 1) / (total + distinct + 1)
        after = {g[-1]: c for g, c in kept[len(context)].items() if g[:-1] == context}
        if not after:
            return p(context[1:], w)
        if context not in weights:
            c = counts[len(context) - 1][context]
            rest, rest0 = 1 - sum(after.values()) / c, 1 - sum(p(context[1:], x) for x in after)
            far = sum(k / c * math.log(k / c / p(context[1:], x)) for x, k in after.items()) + (rest * math.log(rest / rest0) if rest > 1e-12 else 0)
            weights[context] = ((c * rest + 10) / (c + 10) if far >= 0.02 else None, c)
        weight, c = weights[context]
        return p(context[1:], w) if weight is None else after.get(w, 0) / (c + 10) + weight * p(context[1:], w)

    want = {i: sum(math.log10(p(tuple(t[max(0, k - 2) : k]), w)) for k, w in enumerate(t)) for i, t in ((i, [*t.split(), None]) for i, t in docs)}
    for least in (1e-4, 0.02, 1.1):
        got = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(rows, *suffix_tree_lm.train(rows, least=least)).collect()}
        assert {i: round(x, 6) for i, x in got.items()} == {i: round(x, 6) for i, x in want.items()}
