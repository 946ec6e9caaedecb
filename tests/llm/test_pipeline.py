"""The pipeline's stages, each on its own input, against plain versions."""

import random

import corpus_pipeline as pipeline
from test_corpus_operators import plain_removal
from test_quick_operators import shingles

from tessitura.llm import repeats


def tables(spark, folder):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(15)) for k in range(5)]
    passage = text(60)
    docs, toxic = [], []
    for i in range(300):
        t = text(rng.randint(10, 80))
        if i % 5 == 0:
            t += rng.choice([" zorkish ", " zorkly "]) + rng.choice(["quuxed", "zorkish"])
        elif i % 17 == 3:
            t += " " + items[i % 5][1] + " end"
        elif i % 13 == 2:
            t += " " + passage
        elif i % 11 == 1 and i % 5 != 1:
            t = docs[i - 1][1] + " more"
        docs.append((i, t, "en", "s", len(t)))
        toxic.append((i, 1, int(i % 5 == 0)))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0), docs[7]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items, passage


def test_each_stage_on_its_own_input(spark, tmp_path):
    folder = str(tmp_path)
    source, items, passage = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, [tuple(r) for r in docs.collect()]
    for name, stage in pipeline.STAGES:
        docs = pipeline.common.stored(stage(spark, docs, folder))
        after = [tuple(r) for r in docs.collect()]
        if name == "toxicity":
            assert sorted(r[0] for r in after) == sorted(r[0] for r in before if r[0] >= 300 or r[0] % 5)
        elif name == "ngram_jaccard_join":
            sets, kept = {}, {}
            for r in sorted(before, key=lambda r: r[0]):
                sets[r[0]] = shingles(r[1])
            link = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
            for i, s in sets.items():
                if not any(link(s, sets[j]) for j in kept):
                    kept[i] = s
            assert sorted(r[0] for r in after) == sorted(kept) and len(kept) < len(sets)
        elif name == "suffix_array_dedup":
            want = plain_removal([(r[0], (r[1] or "").encode()) for r in before], 100)
            got = {r[0]: len((r[1] or "").encode()) for r in after}
            assert all(got[i] == w[0] - w[1] for i, w in want.items() if w[0] > w[1]) and all(r[4] is None or r[4] == len(r[1]) for r in after)
            assert sum(passage[10:-10] in (r[1] or "") for r in after) == 1 < sum(passage[10:-10] in (r[1] or "") for r in before)
        elif name == "benchmark_decontamination":
            bad = {r[0] for r in before if any(x in (r[1] or "") for _, x in items)}
            assert {r[0] for r in after} == {r[0] for r in before} - bad and bad
        if name != "best_fit_packing":
            assert docs.columns == columns
            before = after
    assert {r[0] for r in after} == {r[0] for r in before}
    assert pipeline.run(spark, folder).count() == len(after)


def test_whole_characters():
    raw = "aéb".encode()
    assert repeats.whole_characters(raw, [(0, 2)]) == [(0, 1)] and repeats.whole_characters(raw, [(2, 4)]) == [(3, 4)]
    assert repeats.whole_characters(raw, [(0, 3)]) == [(0, 3)]
