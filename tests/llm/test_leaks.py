import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm.leaks import FMIndex, find_leaks, leaked_pairs, merged_spans, suffix_order


def test_suffix_order():
    rng = np.random.default_rng(1)
    for text in (rng.integers(1, 4, 300), np.ones(200, int), rng.integers(1, 2**40, 100), np.tile([1, 2, 3], 60), np.zeros(0, int)):
        text = np.append(text, 0)
        assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_search_and_locate():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 6, 2000), 0)
    index = FMIndex(text)
    phrases, lengths = rng.integers(1, 7, (200, 5)), rng.integers(1, 6, 200)
    phrases[:5, 0] = -1
    lo, hi = index.search(np.where(phrases == 6, -1, phrases), lengths)
    for p, n, a, b in zip(phrases, lengths, lo, hi, strict=True):
        want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_merged_spans():
    got = merged_spans(*map(np.array, ([1, 0, 0, 0, 0], [0, 1, 1, 1, 0], [3, 9, 0, 4, 2], [8, 12, 5, 7, 3])))
    assert [x.tolist() for x in got] == [[0, 0, 0, 1], [0, 1, 1, 0], [2, 0, 9, 3], [3, 7, 12, 8]]


def words(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def brute(docs, items, window=12):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            n = min(len(v), window)
            runs = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if v else set()
            if any(tuple(w[j : j + n]) in runs for j in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_table_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([8, 11, 12, 13, 40])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "..."), (103, items[0][1]), (0, items[0][1])]
    docs = []
    for d in range(200):
        w = rng.choices(vocabulary, k=rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            v = words(rng.choice(items)[1])
            a = rng.randrange(0, max(1, len(v) - 10))
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = v[a : a + rng.choice([8, 11, 12, 20, 50])]
        docs.append((d, rng.choice([" ", "  ", "\n", ", "]).join(x.upper() if rng.random() < 0.3 else x for x in w)))
    docs += [(600, "w1 other, " * 40_000 + items[0][1] + " w2" * 40_000)]  # a very long text
    docs += [(500, None), (501, ""), (502, "é"), (None, items[1][1]), (503, items[2][1]), (504, items[2][1]), (504, items[2][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, text string")
    hits = find_leaks(d, i)
    got = [(r.doc_id, r.item_id) for r in leaked_pairs(hits).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items) and len(got) > 60
    blocks = find_leaks(d, i, items_at_once=7, shard_bytes=500)
    assert {tuple(r) for r in leaked_pairs(blocks).collect()} == set(got)
    text = dict(docs)
    for r in hits.collect():
        assert 0 <= r.first_word < r.end_word <= len(words(text[r.doc_id]))
    assert find_leaks(d.limit(0), i).collect() == [] and find_leaks(d, i.limit(0)).collect() == []
