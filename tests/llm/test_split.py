import random

import pytest

from quillstone.llm.split import SplitRule, cut, split_texts

WHITE = " \t\r\n"


def brute(t, limit=2048, least=1024, overlap=200):
    out, s = [], 0
    while t:
        if len(t) - s <= limit:
            out.append((s, len(t)))
            return out
        tests = (
            lambda e: t[e - 2 : e] == "\n\n",
            lambda e: t[e - 1] == "\n",
            lambda e: t[e - 1] in WHITE and t[e - 2] in ".!?",
            lambda e: t[e - 1] in WHITE,
        )
        e = next((e for ok in tests for e in range(s + limit, s + least, -1) if ok(e)), s + limit)
        out.append((s, e))
        s = next((q for q in range(e - overlap, e) if t[q - 1] in WHITE), e - overlap)
    return out


def texts():
    rng = random.Random(5)
    for n in (0, 1, 2047, 2048, 2049, 2500, 5000, 9000, 30000):
        for weights in ((60, 1, 1, 1, 1), (90, 0.1, 0, 0.1, 0.3), (1, 0, 0, 0, 0), (3, 3, 3, 3, 3)):
            yield "".join(rng.choices(["a", " ", "\n", ".", "é\U0001f600"], weights, k=n))[:n]
    yield "x" * 10000
    yield "\n" * 6000
    yield "ab. \r\n\r\n" * 2000


def test_cut_equals_brute_force():
    for t in texts():
        assert list(zip(*[x.tolist() for x in cut(t)], strict=True)) == brute(t)


def test_windows_do_not_change_the_cuts():
    rng = random.Random(7)
    t = "".join(rng.choices("abc .\n", [20, 20, 20, 6, 1, 1], k=200_000))
    assert list(zip(*[x.tolist() for x in cut(t, SplitRule(window=9000))], strict=True)) == brute(t)


def test_other_rules_and_bad_rules():
    rng = random.Random(9)
    t = "".join(rng.choices("abc .\n", [20, 20, 20, 6, 1, 1], k=3000))
    rule = SplitRule(limit=100, least=50, overlap=20, window=400)
    assert list(zip(*[x.tolist() for x in cut(t, rule)], strict=True)) == brute(t, 100, 50, 20)
    with pytest.raises(ValueError):
        SplitRule(limit=100, least=20, overlap=50)


def test_table(spark):
    rows = [(1, "a b. " * 1000, "x"), (1, "a b. " * 1000, "y"), (2, None, "x"), (3, "", "x"), (4, "short", "x"), (None, "c\n" * 3000, "x")]
    df = spark.createDataFrame(rows, "section_key long, text string, piece_no string")
    got = {(r.section_key, r.piece_no): (r.start_pos, r.end_pos) for r in split_texts(df, "section_key", "text", only_long=True).collect()}
    assert got == {(k, i): p for k, t in ((1, "a b. " * 1000), (None, "c\n" * 3000)) for i, p in enumerate(brute(t))}
    every = split_texts(df, "section_key", "text")
    assert {r.section_key for r in every.collect()} == {1, 4, None}
    whole, texts_ = {}, dict([(1, rows[0][1]), (4, "short"), (None, rows[5][1])])
    for r in split_texts(df, "section_key", "text", with_text=True).orderBy("start_pos").collect():
        assert r.piece == texts_[r.section_key][r.start_pos : r.end_pos]
        whole[r.section_key] = r.end_pos
    assert whole == {1: 5000, 4: 5, None: 6000}
    assert split_texts(df.limit(0), "section_key", "text").collect() == []


def test_different_texts_of_a_key_are_all_cut(spark):
    rows = [(None, "a" * 3000), (None, "b " * 2000), (None, "a" * 3000), (7, "c" * 2500), (7, "d\n" * 1500)]
    got = {}
    for r in split_texts(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect():
        got.setdefault((r.k, r.text_hash), []).append((r.piece_no, r.start_pos, r.end_pos))
    assert sorted(sorted(x) for x in got.values()) == sorted([(i, *p) for i, p in enumerate(brute(t))] for t in {t for _, t in rows})
    assert [k for k, _ in got].count(None) == [k for k, _ in got].count(7) == 2
