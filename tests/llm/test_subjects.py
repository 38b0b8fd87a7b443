import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillstone.llm.subjects import Sentences, assign_subjects, bisecting_kmeans, describe_leaves, fit_subjects, subject_shares

NOUNS = {s: [f"{s}{a} {s}{b}" for a, b in zip("abcdefgh", "ijklmnop", strict=True)] for s in ("fire", "water", "earth")}
FRAMES = ["The {} shall check the {} at {} Hall.", "Before work begins, the {} must see that the {} is listed.", "Each {} of {} follows plan 7.2 in {}!", "Does the {} keep the {} near {}?"]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    docs, labels, truth = [], [], {}
    for i in range(n):
        subjects = rng.sample(list(NOUNS), rng.choice([1, 1, 2]))
        sentences, count = [], dict.fromkeys(NOUNS, 0)
        for _ in range(rng.randrange(4, 14)):
            s = rng.choice(subjects)
            count[s] += 1
            nouns = rng.sample(NOUNS[s], 2)
            sentences.append(rng.choice(FRAMES).format(*nouns, "".join(rng.choices("bcdfglmn", k=6)).title()))
        sentences += ["A stranger wanted copies of the tin box after the second bell."] * rng.choice([0, 0, 0, 2])
        rng.shuffle(sentences)
        docs.append((i, "SUBJECT: " + rng.choice(NOUNS["fire"]).upper() + "\n1. PURPOSE. " + rng.choice([" ", "\n"]).join(sentences)))
        total = sum(count.values())
        truth[i] = {s for s, c in count.items() if c / total >= 0.25}
        if i % 2:
            given = truth[i] if rng.random() > 0.04 else {rng.choice(list(NOUNS))}
            labels += [(i, s) for s in given]
    return docs, labels, truth


def tables(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("subject_id", F.lit("clash")).withColumn("share", F.lit(9))
    return d, spark.createDataFrame(labels, "doc_id long, subject_id string"), spark.createDataFrame([(s,) for s in NOUNS], "subject_id string")


def test_sentences():
    texts = ["A cát. Heading\nB dog! | x | y?\nno stop", None, "", "é.", "one 1.5 two. three", "same", "word.", "Закон\u2014Суд спорт."]
    s = Sentences(pa.array(texts))
    words = [s.buf[a:b].tobytes().decode() for a, b in zip(s.start, s.end, strict=True)]
    assert words == ["a", "cat", "b", "dog", "y", "e", "one", "two", "word", "закон", "суд", "спорт"]
    assert s.text.tolist() == [0, 0, 0, 3, 4, 6, 7] and s.sentence.tolist() == [0, 0, 1, 1, 2, 3, 4, 4, 5, 6, 6, 6]


def test_kmeans_separates():
    rng = np.random.default_rng(1)
    rows, term = np.arange(90).repeat(2), (np.arange(90) % 3).repeat(2) * 10 + rng.integers(0, 10, 180)
    mixture = np.eye(3)[np.arange(90) % 3]
    leaf = bisecting_kmeans(term, rows, np.full(180, 0.7), 90, 30, mixture, 40, 0.99)
    for l in set(leaf):
        assert len(set((np.arange(90) % 3)[leaf == l])) == 1


def test_held_out_documents(spark):
    docs, labels, truth = corpus()
    extra = [(1000, None), (1001, ""), (1002, "Nothing of the kind. Page left blank."), (None, docs[0][1]), (1003, docs[0][1] * 200), (0, docs[0][1])]
    d, l, a = tables(spark, docs + extra, labels + labels[:9] + [(None, "fire"), (5000, "water"), (1, "unlisted"), (2, None)])
    got = {}
    for r in assign_subjects(d, l, a).collect():
        got.setdefault(r.doc_id, set()).add(r.subject_id)
    assert not {1000, 1001, 1002} & set(got) and got[1003] == got[0] == got[None]
    right = sum(got.get(i) == truth[i] for i in range(0, 400, 2))
    assert right >= 190


def test_leaves(spark):
    docs, labels, truth = corpus()
    d, l, a = tables(spark, docs, labels)
    model = fit_subjects(d, l, a, leaves=12)
    m = model.read()
    assert len(m.sizes) <= 12 and m.sizes.sum() <= len({i for i, _ in labels}) and np.allclose(m.mixtures.sum(1), 1)
    rows = subject_shares(d, model).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.leaf)
    assert all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) > 3
    # nearly every document's leaf has its subjects in its mixture
    lacking = sum(m.mixtures[min(leaf), m.subjects.index(s)] <= 0.05 for i, leaf in by.items() for s in truth[i])
    assert lacking <= 0.1 * sum(len(truth[i]) for i in by)
    shown = describe_leaves(model, spark).collect()
    nouns = {w for n in NOUNS.values() for x in n for w in x.split()}
    assert all(set(w.split()) & nouns for r in shown for w in r.terms.split("|") if r.documents > 5)
    # the sample is bounded by documents and by bytes, and nothing that was fitted before changes the result
    few = fit_subjects(d, l, a, most_labelled=40).read()
    small = fit_subjects(d, l, a, most_bytes=20_000).read()
    assert few.sizes.sum() <= 40 and 0 < small.sizes.sum() < m.sizes.sum()
    assert fit_subjects(d, l, a, most_bytes=10).uri is None


def test_no_labels_and_empty_tables(spark):
    docs, labels, _ = corpus(20)
    d, l, a = tables(spark, docs, labels)
    assert assign_subjects(d, l.limit(0), a).collect() == []
    assert assign_subjects(d.limit(0), l, a).collect() == [] and assign_subjects(d, l, a.limit(0)).collect() == []
    model = fit_subjects(d, l, a)
    assert subject_shares(d.limit(0), model).collect() == []
