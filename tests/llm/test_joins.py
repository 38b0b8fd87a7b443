"""Links of vectors by buckets: what meets, how much of it, and what comes of it."""

import numpy as np
import pytest

from quillstone.llm import vectors
from quillstone.llm.clusters import reciprocal_merge
from quillstone.llm.vectors import Buckets, _across, build_index, join_shape, links, tables_for, units


def test_rows_that_meet_do_not_grow_with_the_rows():
    rng = np.random.default_rng(1)
    met = []
    for rows in (10_000, 160_000):
        x = units(rng.normal(size=(rows, 64))).astype(np.float32)
        levels, last = join_shape(rows, 64)
        tables = tables_for(0.85, 64, levels, last, 1e-6)
        met.append(sum((np.bincount(Buckets(64, levels, last, t)(x)).astype(float) ** 2).sum() / rows for t in range(3)) / 3 * tables)
    assert met[1] < 4 * met[0]  # 16 times as many rows
    for rows in (10**3, 10**5, 10**7, 10**9):
        levels, last = join_shape(rows, 64)
        assert rows / ((128 ** (levels - 1)) * 2 * last) <= 1024


@pytest.mark.parametrize("rows", [3_000, 100_000, 3_000_000])
def test_links_of_just_the_cosine_meet(rows):
    rng = np.random.default_rng(2)
    x = units(rng.normal(size=(20_000, 64)))
    y = rng.normal(size=x.shape)
    y = units(y - np.einsum("ij,ij->i", x, y)[:, None] * x)
    y = 0.85 * x + np.sqrt(1 - 0.85**2) * y
    levels, last = join_shape(rows, 64)
    apart = np.ones(len(x), bool)
    for t in range(tables_for(0.85, 64, levels, last, 1e-6)):
        h = Buckets(64, levels, last, t)
        apart &= h(x.astype(np.float32)) != h(y.astype(np.float32))
    assert apart.sum() <= 1


def parts(a, b):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for x, y in zip(a, b, strict=True):
        x, y = sorted((find(x), find(y)))
        root[y] = x
    return {i: find(i) for i in root}


@pytest.mark.parametrize("n", [2, 700, 5000])
def test_labels_of_a_bucket_are_joined_as_by_all_pairs(n):
    rng = np.random.default_rng(n)
    c = rng.normal(size=(40, 8))
    x = (c[np.minimum(rng.integers(60, size=n), 39)] + 0.3 * rng.normal(size=(n, 8))).astype(np.float32)
    x[: n // 10] *= np.float32(1e-25)
    label = rng.permutation(n)[rng.integers(max(1, n // 2), size=n)].astype(np.int64)
    a, b = _across(label, x, 0.95)
    u = units(x)
    p, q = np.nonzero(u @ u.T >= 0.95)
    want = parts(label[p].tolist(), label[q].tolist())
    assert {(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)} == {(r, i) for i, r in want.items() if r != i}


def test_large_parts_and_merging_between(spark, monkeypatch):
    """Parts of more rows than a task holds are met set by set; what the first tables join has one label after."""
    monkeypatch.setattr(vectors, "PART_ROWS", 150)
    rng = np.random.default_rng(6)
    c = rng.normal(size=(30, 16))
    x = np.concatenate([rng.normal(size=(300, 16)), c[rng.integers(30, size=500)] + 0.45 * rng.normal(size=(500, 16)), c[0] + 0.5 * rng.normal(size=(900, 16))]).astype(np.float32)
    ids = rng.permutation(10 * len(x))[: len(x)].tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "key long, v array<float>")
    index = build_index(df, "key", "v", 16, link=0.85, tables=1, levels=2)
    u = units(x)
    p, q = np.nonzero(u @ u.T >= 0.85)
    want = parts([ids[i] for i in p], [ids[i] for i in q])
    for merge in (None, lambda e: reciprocal_merge(e, 0.85 - 1e-5, "single")):
        members, edges = links(index, 0.85, merge=merge)
        rows = [(r.id, r.label) for r in members.collect()]
        assert sorted(i for i, _ in rows) == sorted(ids)
        rows += [(r.a, r.b) for r in edges.collect()]
        got = parts(*zip(*rows, strict=True))
        assert {i: got[i] for i in ids} == want
