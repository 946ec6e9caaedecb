"""What of the labelled documents the field is fitted on."""

import random
import tracemalloc

import numpy as np

from tessitura.llm import toxicity


def test_the_sample_is_bounded_in_rows_and_characters(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append((texts, toxic)))
    rows = [(k, f"{k} " + "x" * (50 if k % 2 else 400)) for k in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(62)] + [(3, 0), (99, 1), (None, 1)], "doc_id long, toxic int")
    toxicity.train(docs, labels, sample=10, background=20, longest=100, most=1_500)
    ((texts, toxic),) = seen
    clean = [t for t, y in zip(texts, toxic, strict=True) if not y]
    assert sum(toxic) == 10 and all(len(t) <= 100 for t in texts) and 14 <= len(clean) <= 16 and sum(map(len, clean)) <= 1_500
    toxicity.train(docs, labels, sample=500, background=1000)
    assert len(seen[1][0]) == 61 and sum(seen[1][1]) == 31


def test_fitting_takes_rows_in_blocks_and_gives_memory_back(spark, monkeypatch):
    rng = random.Random(4)
    common = [f"{a}{b}" for a in ("ka", "lo", "mir", "sten") for b in ("ba", "do", "fur", "gim", "hal")]
    toxic = [k % 3 == 0 for k in range(150)]
    texts = [" ".join("vilest" if y and rng.random() < 0.01 else rng.choice(common) for _ in range(4000)) for y in toxic]
    small = [t[:900] for t in texts[:30]]
    whole = toxicity.fit(small, [int(y) for y in toxic[:30]])
    monkeypatch.setattr(toxicity, "ROWS", 7)
    parts = toxicity.fit(small, [int(y) for y in toxic[:30]])
    assert whole.weights and whole.weights.keys() == parts.weights.keys() and all(abs(w - parts.weights[f]) < 1e-6 for f, w in whole.weights.items()) and np.allclose(whole.curve, parts.curve)
    monkeypatch.undo()
    monkeypatch.setattr(toxicity, "ROUNDS", 2)
    tracemalloc.start()
    toxicity.fit(texts, [int(y) for y in toxic])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * 150 * 4000  # bytes a word; 260 where all rows are taken at once
    given = []
    monkeypatch.setattr(toxicity.common, "tidy", lambda: given.append(1))
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: None)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    toxicity.train(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"))
    assert given
