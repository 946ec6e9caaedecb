import os
import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tessitura.llm import common, suffix_tree_lm


def test_shuffles_are_off_the_disk_once_their_table_is_written(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, k=60))) for i in range(300)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", suffix_tree_lm.held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p: os.path.getsize(p) for d in folders for p in Path(d).rglob("shuffle_*.data")}
    before, left, stored = files(), [], common.stored

    def watched(df):
        out = stored(df)
        left.append(sum(n for p, n in files().items() if p not in before))
        return out

    monkeypatch.setattr(common, "stored", watched)
    assert suffix_tree_lm.score(rows, *suffix_tree_lm.train(rows)).count() == 300
    assert len(left) == 7 and max(left) < 10_000  # a few sums


def test_places_and_groups_of_keys():
    rng = np.random.default_rng(4)
    for n in (0, 1, 50, 3000):
        known = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        known = np.unique(np.append(known, (known[:20] & ~np.uint64(0xFF)) + np.arange(len(known[:20]), dtype=np.uint64)))
        for keys in (rng.permutation(np.concatenate([known, known + np.uint64(1), known])), known[::2]):
            want = {k: i for i, k in enumerate(known.tolist())}
            assert suffix_tree_lm.places(known, keys).tolist() == [want.get(k, -1) for k in keys.tolist()]
            order, cuts = suffix_tree_lm.grouped(keys)
            found, times = np.unique(keys, return_counts=True)
            assert keys[order[cuts]].tolist() == found.tolist() and np.diff(cuts, append=len(keys)).tolist() == times.tolist()
