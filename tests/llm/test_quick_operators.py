"""Operators on small fixtures and against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessitura.llm import decontaminate, embeddings, lang_id, ngram_join, packing, url_filters, warc


def edit_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_distance_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90)))
        assert decontaminate.myers(item, text)[0] == edit_in(item, text)


def test_leaks_equal_a_plain_search(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8)))
    items = [(k, " ".join(word() for _ in range(12))) for k in range(6)] + [(90, None), (91, ""), (92, "short item")]
    docs = []
    for k in range(60):
        text = " ".join(word() for _ in range(40))
        item = items[k % 6][1]
        if k % 2:
            chars = list(item)
            for _ in range(k % 9):
                chars[rng.randrange(len(chars))] = rng.choice("xyz")
            text += " " + "".join(chars).upper() + " " + word()
        docs.append((k, text, "x"))
    docs += [(100, None, "x"), (101, "", "x"), (7, docs[7][1], "x")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.leaks(d, b).collect())
    want = []
    for i, text, _ in docs:
        for k, item in items[:6]:
            x = decontaminate.reduced(item)
            if text and (n := edit_in(x, decontaminate.reduced(text))) <= decontaminate.budget(x, 0.05):
                want.append((i, k, n))
    assert got == sorted(want) and len({x[0] for x in want}) > 8
    left = decontaminate.clean(d, b)
    assert {r["doc_id"] for r in left.collect()} == {x[0] for x in docs} - {x[0] for x in want} and left.columns == d.columns
    assert decontaminate.leaks(d.limit(0), b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


def test_packing_places_every_piece_once(spark):
    rng = random.Random(3)
    docs = [(k, "".join(rng.choice(["foo ", "bar ", "é "]) for _ in range(rng.choice([0, 3, 50, 300, 2500, 5000])))) for k in range(80)] + [(200, None), (3, "again")]
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.token_pieces(spark.createDataFrame(docs, "doc_id long, text string"), path)
    rows = packing.pack(pieces).collect()
    tok, want, total = Tokenizer.from_file(path), [], 0
    for i, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for p, at in enumerate(range(0, len(ids), 2048)):
            want.append((i, p, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())))
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) <= -(-total // 2048) + 2
    assert packing.pack(pieces.limit(0)).count() == 0


def test_search_empties_a_bin_where_first_fit_cannot():
    from collections import Counter

    start = Counter({((6, 1),): 1, ((3, 2),): 1, ((4, 1),): 1, ((4, 1), (3, 1)): 1})
    after = packing.local_search(start, 10)
    count = lambda bins: sum((Counter({k: v * n for k, v in c}) for c, n in bins.items()), Counter())
    assert count(after) == count(start) and sum(after.values()) == 3 and all(sum(k * v for k, v in c) <= 10 for c in after)


def shingles(text, n=5):
    w = [x for x in (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()]
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def plain_components(nodes, links):
    label = {x: x for x in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_jaccard_join_equals_all_pairs(spark):
    rng = random.Random(4)
    docs = []
    for k in range(25):
        words = [f"w{rng.randrange(200)}" for _ in range(rng.choice([0, 2, 4, 5, 30, 120, 120, 300]))]
        for c in range(rng.choice([1, 2, 6, 12])):
            copy = list(words)
            for _ in range(rng.randrange(4) if words and c else 0):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            docs.append((len(docs), " ".join(copy), "s"))
    docs += [(1000, None, "s"), (1001, "", "s"), (1002, "A b C d", "s"), (1003, "a B c D", "s")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string, n string").repartition(5)).collect()}
    sets = {i: shingles(t) for i, t, _ in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = plain_components(sets, links)
    assert got == {i: (len(s), want[i]) for i, s in sets.items()} and len(links) > 20
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicate_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(120):
        base = rng.normal(size=64)
        for c in range([1, 1, 1, 5, 20][k % 5]):
            noise = rng.normal(size=64) * 0.3 * (c % 4)
            rows.append((len(rows), [float(v) for v in np.float32(base + noise)], 1))
    rows += [(9000, None, 1), (9001, [0.0] * 64, 1), (9002, [float("nan")] * 64, 1), (9003, [1.0] * 63 + [None], 1), (9004, [], 1), (9005, [1.0, 2.0], 1), (9006, [2.0, 4.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(table.repartition(3)).collect()}
    x = np.array([r[1] for r in rows[:-7]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    links = [(*map(int, p),) for p in zip(a, b)] + [(9005, 9006)]
    count = {r[0]: 0 for r in rows}
    for p, q in links:
        count[p] += 1
        count[q] += 1
    found, there = sum(r["n_links"] for r in got.values()), sum(count.values())
    assert all(r["n_links"] <= count[i] for i, r in got.items()) and found >= 0.95 * there
    want = plain_components(count, links)
    assert np.mean([got[i]["component_id"] == want[i] for i in want]) > 0.97
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_language_of_unseen_texts(spark):
    rng = random.Random(6)
    parts = {"aa": ["ka", "ke", "mo", "ti"], "bb": ["sch", "ung", "ein", "er"], "cc": ["ción", "os", "que", "la"]}
    text = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(k, 30), k) for i, k in enumerate(list(parts) * 40)] + [(900, None, None), (901, "", "aa"), (902, "12 34 !", "bb"), (903, text("aa", 9), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    docs = docs.withColumn("lang", F.col("score"))
    model = lang_id.train(docs.where(~lang_id.held_out()))
    out = {r["doc_id"]: r for r in lang_id.predict(docs, model).collect()}
    assert all(out[i]["lang_pred"] == k for i, t, k in rows[:120]) and out[903]["lang_pred"] == "aa"
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert {r["lang_pred"] for r in lang_id.predict(docs, lang_id.train(docs.limit(0))).collect()} == {"und"}


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("http://A.example.com/en/1?x", "a.example.com", "/en/1", "com/en/", "block"),
    ("https://example.com/en/77#t", "example.com", "/en/77", "example.com/en/7", "allow"),
    ("http://x.example.net/de/81", "x.example.net", "/de/81", "example.net/de/8", "block"),
    ("http://notexample.net/de/9", "notexample.net", "/de/9", "net/de/", "allow"),
    ("http://example.org", "example.org", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
])
def test_url_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "old")], "page_id long, url string, rule string")
    r = url_filters.judge(pages, url_filters.rules_table(spark, url_filters.RULES)).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_warc_derivatives_refer_to_their_response(spark, tmp_path):
    html = "<html><script>x<y</script><p>One &amp; two<br>three</p><!-- no --></html>"
    pages = spark.createDataFrame([(1, "http://a.b/", html, 0), (2, None, None, 0)], "page_id long, url string, html string, block int")
    out = warc.derive(warc.page_responses(pages), "page_id")
    rows = {(r["page_id"], r["warc_type"]): r for r in out.collect()}
    one, meta = rows[1, "conversion"], rows[1, "metadata"]
    assert one["block"] == "One & two\nthree" and one["refers_to"] == meta["refers_to"] and one["record_id"] in meta["block"]
    assert one["payload_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest() and "source-http-status: HTTP/1.1 200 OK" in meta["block"]
    assert rows[2, "conversion"]["block"] == "" and "WARC-Target-URI" not in rows[2, "conversion"]["record"] and len(rows) == 4
    warc.write(out.where("page_id = 1"), str(tmp_path / "w"))
    import gzip

    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    assert data.count(b"WARC/1.1\r\n") == 2 and data.endswith(b"\r\n\r\n")
    head, _, rest = data.partition(b"\r\n\r\n")
    n = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
    assert rest[n : n + 4] == b"\r\n\r\n"


def test_toxic_documents_and_their_spans(spark):
    from tessitura.llm import toxicity

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghmnop") for _ in range(rng.randint(2, 6)))
    rows, marks = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randint(3, 60))]
        if i % 4 == 0:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["zorkish", "Zorkly", "quuxed"]))
        rows.append((i, " ".join(words), 0.5))
        marks.append((i, int(i % 4 == 0)))
    rows += [(900, None, 0.0), (901, "", 0.0), (902, "é " * 700 + "Éa zorkish, b", 0.0), (0, rows[0][1], 0.0)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(marks + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs.where(~toxicity.held_out()), labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows) and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in out if r["doc_id"] < 400)
    by = {r["doc_id"]: r for r in out}
    assert by[902]["predicted"] == 1 and [rows[402][1][s["start"] : s["end"]] for s in by[902]["spans"]] == ["zorkish"]
    assert by[900]["predicted"] == by[901]["predicted"] == 0 and not by[900]["spans"]
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 1"))).collect()} == {0.0}


def test_marginals_equal_a_sum_over_all_taggings():
    import itertools

    from tessitura.llm import toxicity

    rng = np.random.default_rng(9)
    moves, start = rng.normal(size=(2, 2)), 0.3
    texts = [rng.normal(size=n) for n in (7, 4, 1)]
    for e, got in zip(texts, toxicity.chain(texts, moves, start)):
        total, toxic = 0.0, np.zeros(len(e))
        for tags in itertools.product((0, 1), repeat=len(e)):
            w = np.exp(sum(x * t for x, t in zip(e, tags)) + start * tags[0] + sum(moves[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            toxic += w * np.array(tags)
        assert np.allclose(got, toxic / total)
    long = [rng.normal(size=2000)]
    grid = toxicity.marginals(np.array(long), np.array([2000]), moves, start)[0]
    assert np.allclose(toxicity.chain(long, moves, start)[0], grid, atol=1e-9)


def test_links_do_not_depend_on_the_size_of_a_block(spark, monkeypatch):
    rng = np.random.default_rng(10)
    base = rng.normal(size=64)
    rows = [(k, [float(v) for v in base + rng.normal(size=64) * 0.2]) for k in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = {}
    for size in (1024, 8):
        monkeypatch.setattr(embeddings, "BLOCK", size)
        found[size] = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(table).collect()}
    assert found[8] == found[1024] and sum(found[8].values()) > 80_000


def test_vectors_are_hashed_once_for_many_blocks(monkeypatch):
    """What a linked pair costs must not grow with the tables: a block of its own for each pair, none hashed apart."""
    rng, calls = np.random.default_rng(11), []
    turn = embeddings.rotated
    monkeypatch.setattr(embeddings, "rotated", lambda x, seed: calls.append(seed) or turn(x, seed))
    base = rng.normal(size=(300, 64)).astype(np.float32)
    x = np.repeat(base, 2, axis=0) * np.tile([1, 2], 300)[:, None].astype(np.float32)
    raw = [v.tobytes() for v in x]
    names = embeddings.buckets(embeddings._unit(raw, "<f4"), 3, 11, 3).view(np.int64)
    calls.clear()
    rows = sorted((int(name), k) for k in range(600) for name in names[k, [0, 7]].reshape(-1))  # in two tables, so that each pair is met six times
    z = pa.array(np.zeros(len(rows), np.int32))
    batch = pa.record_batch([pa.array([r[0] for r in rows]), z, z, z, pa.array([r[1] for r in rows]), pa.array(np.ones(len(rows), np.int64)), pa.array([raw[r[1]] for r in rows], pa.binary())], names=["bucket", "i", "j", "mine", "key", "n", "raw"])
    found = pa.Table.from_batches(embeddings._compare(0.9, 3, 3, "<f4")(iter([batch.slice(0, 500), batch.slice(500)]))).to_pydict()
    assert sorted(found["key"]) == list(range(600)) and set(found["links"]) == {1}  # once each
    assert all(other == key - key % 2 for key, other in zip(found["key"], found["other"]))
    assert len(calls) < 300 / 10


def test_links_do_not_depend_on_the_rows_at_a_time(monkeypatch):
    rng = np.random.default_rng(13)
    x = np.float32(rng.normal(size=(12, 16)).repeat(10, axis=0) + rng.normal(size=(120, 16)) * 0.2)
    raw = [v.tobytes() for v in x] + [v.tobytes() for v in x[:20, :8]]
    codes = [embeddings.buckets(embeddings._unit(part, "<f4"), 1, 4, 2).view(np.int64) for part in (raw[:120], raw[120:])]
    rows = sorted((int(name), k) for k, own in enumerate([*codes[0], *codes[1]]) for name in set(own.reshape(-1).tolist()))
    z = pa.array(np.zeros(len(rows), np.int32))
    batch = pa.record_batch([pa.array([r[0] for r in rows]), z, z, z, pa.array([r[1] for r in rows]), pa.array(np.ones(len(rows), np.int64)), pa.array([raw[r[1]] for r in rows], pa.binary())], names=["bucket", "i", "j", "mine", "key", "n", "raw"])
    found = []
    for at_a_time, pairs, each in ((4096, 1 << 20, len(rows)), (1, 1, 3), (7, 20, 1), (50, 5, 10)):
        monkeypatch.setattr(embeddings, "ROWS", at_a_time)
        monkeypatch.setattr(embeddings, "PAIRS", pairs)
        count = Counter()
        for out in embeddings._compare(0.9, 1, 2, "<f4")(batch.slice(k, each) for k in range(0, len(rows), each)):
            for key, links in zip(out.column("key").to_pylist(), out.column("links").to_pylist(), strict=True):
                count[key] += links
        found.append(count)
    assert found[0] == found[1] == found[2] == found[3] and sum(found[0].values()) > 200


def test_vectors_of_floats_and_of_doubles_link_alike(spark):
    rng = np.random.default_rng(12)
    base = np.float32(rng.normal(size=(40, 24)))
    rows = [(k, [float(v) for v in np.float32(base[k % 40] * (1 + k % 3) + rng.normal(size=24) * 0.1)]) for k in range(200)]
    rows += [(900, None), (901, [0.0] * 24), (902, [1.0] * 23 + [None]), (903, [float("inf")] * 24), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0])]
    got = [sorted(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)).collect())) for kind in ("float", "double")]
    x = np.array([r[1] for r in rows[:200]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(1) - 1
    assert got[0] == got[1] and [r[1] for r in got[0]] == [*want.tolist(), 0, 0, 0, 0, 0, 1, 1]


def test_a_small_language_keeps_its_words(spark):
    rows = [(k, "kana kona zupa", "aa") for k in range(200)] + [(900, "zupar kanal", "bb"), (901, "zupar", None), (902, "kanal zupa kanal", None), (903, "x" * 63 + "zup", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = [{r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in lang_id.predict(docs, lang_id.train(docs, least=least)).collect()} for least in (0.01, 1e-9, 2.0)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows) and found[0][901][0] == "bb"
    assert len(lang_id.gram_keys([b"a" * 200], 4)[0]) == 199


def test_short_items_and_scripts_without_spaces(spark):
    chinese = "".join(chr(0x4E00 + 37 * i) for i in range(40))
    sentence = "the quick brown fox jumps over the lazy dog while nine more animals look on in silence and wait for rain"
    d = spark.createDataFrame([(1, "x" + chinese + "y"), (2, "so says Grace Hopper: yes"), (3, "gracehopper"), (4, "foreword " + sentence.replace("quick ", "") + " end"), (5, None), (6, "")], "doc_id long, text string")
    b = spark.createDataFrame([(1, chinese), (2, "Grace Hopper"), (3, sentence), (4, "?!"), (5, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["match_start"], r["match_end"]) for r in decontaminate.leaks(d, b, 0.07).collect()}
    assert set(got) == {(1, 1), (2, 2), (4, 3)} and got[1, 1] == (0, 1, 41) and got[2, 2][0] == 0
    assert got[4, 3] == (6, 9, 9 + len(sentence) - 6)


def test_search_goes_on_until_no_exchange_helps():
    rng = random.Random(5)
    counts = Counter(rng.randint(300, 1100) for _ in range(2000))
    first = packing.best_fit(dict(counts), 2048)
    after = packing.local_search(first, 2048)
    assert sum((Counter({k: v * n for k, v in content}) for content, n in after.items()), Counter()) == counts
    assert all(sum(k * v for k, v in content) <= 2048 for content in after) and sum(after.values()) < sum(first.values())
