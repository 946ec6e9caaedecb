import pickle

import numpy as np
from pyspark.sql import functions as F

from tessitura.llm import common, suffix_tree_lm


def test_each_text_is_read_five_times(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def counted(text):
        read.add(1)
        return text

    docs = [(i, False, bytearray(f"a{i % 7} b c{i % 3} a{i % 7} b".encode())) for i in range(50)]
    rows = spark.createDataFrame(docs, "doc_id long, held_out boolean, text binary").withColumn("text", counted("text"))
    size = common.total_bytes(rows)
    assert suffix_tree_lm.score(rows, *suffix_tree_lm.train(rows, size=size), size=size).count() == 50
    assert read.value == 50 * (5 + 1)  # and once for the size: words with names of pairs, pairs with names of triples, triples, scores by two readings


def test_index_of_sorted_keys():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 3000):
        known = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        known = np.unique(np.append(known, (known[:20] & ~np.uint64(0xFF)) + np.arange(len(known[:20]), dtype=np.uint64)))
        keys = rng.permutation(np.concatenate([known, known + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)]))
        want = {k: i for i, k in enumerate(known.tolist())}
        index = suffix_tree_lm.Index(known)
        for found in (index.places(keys), index.places(keys), pickle.loads(pickle.dumps(index)).places(keys)):
            assert found.tolist() == [want.get(k, -1) for k in keys.tolist()]


def test_words_have_the_hash_of_their_bytes_wherever_they_are():
    rng = np.random.default_rng(9)
    words = [rng.integers(97, 123, k).astype(np.uint8).tobytes() + "é".encode() * (k % 2) for k in (1, 2, 7, 8, 9, 40, 5000)]
    alone = [common.word_hashes(w)[0].tolist() for w in words]
    assert all(len(h) == 1 for h in alone) and len({h[0] for h in alone}) == len(words)
    text = b"\n " + b" \t".join(w.upper() if k % 2 else w for k, w in enumerate(words)) + b"\x0b"
    h, start = common.word_hashes(text)
    assert [[x] for x in h.tolist()] == alone and [text[s : s + len(w)].lower() == w.lower() for s, w in zip(start, words, strict=True)] == [True] * len(words)
    long = b" ".join(words * 20)
    assert next(common.texts_hashes([long]))[1].tolist() == [x for (x,) in alone] * 20
