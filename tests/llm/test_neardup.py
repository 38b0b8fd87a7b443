import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm.neardup import Sets, _from_planes, _planes, classes_with_links, expanded, near_duplicates, tree_join
from quillstone.llm.words import Words


def words(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def test_words_and_shingles():
    rng = random.Random(1)
    texts = ["Hello, World 12ab", "ends", "starts", None, "", "é x K y İs", "ab" * 400_000 + " q", "a-b_c"]
    texts += ["".join(rng.choices("abAB01 .é\n", k=rng.randrange(0, 60))) for _ in range(300)]
    w = Words(pa.array(texts))
    known = {}
    for i, t in enumerate(texts):
        mine = [w.word(j) for j in range(w.first[i], w.first[i + 1])]
        assert mine == words(t)
        for j, x in zip(range(w.first[i], w.first[i + 1]), mine, strict=True):
            assert known.setdefault(x, w.hash[j]) == w.hash[j]
    assert len(set(known.values())) == len(known)
    token, first = w.shingles(2)
    for i, t in enumerate(texts):
        assert first[i + 1] - first[i] == len(set(zip(words(t), words(t)[1:])))
    keys = w.sequence_keys(1)
    by_words = {}
    for t, key in zip(texts, keys, strict=True):
        assert by_words.setdefault(tuple(words(t)), key) == key
    assert len(set(by_words.values())) == len(by_words)


def test_planes():
    x = np.array([0, 1, 255, 256, 2**44 - 1], np.uint64)
    assert (_from_planes(_planes(x, 6), 6) == x).all()


@pytest.mark.parametrize("cells", [1 << 26, 700])
def test_tree_against_brute_force(cells):
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(40)]
    sets = base + [np.setdiff1d(x, x[:2]) for x in base] + [np.union1d(x, [70]) for x in base] + base[:5]
    own = rng.integers(0, 3, len(sets))  # members that are left out

    def made(at):
        return Sets(np.concatenate([sets[i] for i in at] or [np.zeros(0, int)]), np.concatenate([[0], np.cumsum([len(sets[i]) for i in at])]).astype(int), np.array([len(sets[i]) + own[i] for i in at], int))

    probes = list(range(0, len(sets), 2))
    for t in (0.3, 0.6, 1.0):
        want = set()
        for i in probes:
            for j in range(len(sets)):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both and both >= t * (len(sets[i]) + own[i] + len(sets[j]) + own[j] - both) - 1e-9:
                    want.add((i, j))
        got = [(probes[p], q) for ps, qs, _ in tree_join(made(range(len(sets))), made(probes), t, cells) for p, q in zip(ps.tolist(), qs.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want
    assert list(tree_join(made([]), made(probes), 0.5)) == [] and list(tree_join(made(probes), made([]), 0.5)) == []


def brute(rows, k, t, least):
    sets = {(f, key): set(zip(*[words(x)[i:] for i in range(k)])) for f, key, x in rows if key is not None and len(words(x)) >= least}
    out = set()
    for (f, a), x in sets.items():
        for (g, b), y in sets.items():
            if f == g and a < b and len(x & y) >= t * len(x | y) - 1e-12:
                out.add((f, a, b))
    return out


def texts(seed=4):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(400)]
    phrases = [" ".join(rng.choices(common, k=8)) for _ in range(12)]
    rows, key = [], 0
    for f in ("x", "y"):
        for _ in range(25):
            w = (rng.choice(phrases) + " " + " ".join(rng.choices(common, k=rng.randrange(4, 40))) + " " + rng.choice(phrases)).split()
            for _ in range(rng.randrange(1, 6)):
                v = list(w)
                for _ in range(rng.randrange(0, 5)):
                    at = rng.randrange(len(v))
                    v[at : at + rng.randrange(0, 2)] = rng.choices(common, k=rng.randrange(0, 2))
                key += 1
                rows.append((f, key, rng.choice([" ", ", ", "\n"]).join(v)))
    return rows


def test_pairs_against_brute_force(spark):
    rows = texts()
    rows += [("x", 900 + i, "Same words. " * 8 + "and the end") for i in range(30)]  # a large group of copies
    extra = [("x", 1001, None), ("x", 1002, ""), ("x", 1003, "too few words"), ("x", None, rows[0][2]), (None, 1004, rows[0][2]), ("x", 1005, "long " * 30_000 + "text")]
    df = spark.createDataFrame(rows + rows[:20] + extra, "field string, id long, body string").withColumn("key", F.lit("clash")).withColumn("text", F.lit("clash"))
    for k, t, least in ((3, 0.6, 12), (5, 0.8, 5)):
        found = near_duplicates(df, "id", "body", within="field", k=k, similarity=t, least_words=least)
        got = [tuple(r) for r in expanded(found).collect()]
        want = brute(rows + [("x", 1005, extra[-1][2])], k, t, least)
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 450
    assert found.links.where("a >= b").count() == 0
    classes = {(r.within, r.key): r for r in classes_with_links(found).collect()}
    assert {classes["x", 900 + i].class_id for i in range(30)} == {900}
    links = {}
    for r in found.links.collect():
        for x in (r.a, r.b):
            links[r.within, x] = links.get((r.within, x), 0) + 1
    assert all(r.links == links.get((w, r.class_id), 0) for (w, _), r in classes.items())


def test_frequent_shingles_are_dealt_out(spark, monkeypatch):
    import quillstone.llm.neardup as m

    monkeypatch.setattr(m, "_HOT", 5)
    monkeypatch.setattr(m, "_TOGETHER", 3)
    rows = texts(6)
    df = spark.createDataFrame(rows, "field string, id long, body string")
    found = near_duplicates(df, "id", "body", within="field", k=3, similarity=0.6, least_words=12)
    assert {tuple(r) for r in expanded(found).collect()} == brute(rows, 3, 0.6, 12)


def test_empty(spark):
    df = spark.createDataFrame([], "id long, body string")
    found = near_duplicates(df, "id", "body")
    assert expanded(found).collect() == [] and classes_with_links(found).collect() == []
