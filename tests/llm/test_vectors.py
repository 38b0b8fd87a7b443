import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm.vectors import Hash, Rotation, _labels, build_index, levels_for, links, most_similar, shares_of_chance, units


def table(spark, n=3000, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    x = np.concatenate([rng.normal(size=(n // 3, dim)), centers[rng.integers(0, 12, n - n // 3)] + 0.25 * rng.normal(size=(n - n // 3, dim))]).astype(np.float32)
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)]
    rows += [(n + 1 + i, x[5].tolist()) for i in range(40)]  # one vector under many ids
    bad = [(90001, None), (90002, [0.0] * dim), (90003, [1.0] * (dim - 1)), (90004, [float("nan")] + [1.0] * (dim - 1)), (90005, [float("inf")] + [1.0] * (dim - 1)), (None, [1.0] * dim), (90006, [])]
    df = spark.createDataFrame(rows + rows[:50] + bad, "key long, v array<float>").withColumn("cell", F.lit("clash")).withColumn("id", F.lit("clash"))
    return df, np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def test_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(0).normal(size=(50, 13))
    y = Rotation(13)(x)
    assert np.allclose(x @ x.T, y @ y.T, atol=1e-4)


@pytest.mark.parametrize("how", [{}, {"tables": 1}, {"levels": 2}, {"tables": 3, "levels": 2}, {"exact": True}])
def test_neighbours_against_brute_force(spark, how):
    df, ids, x = table(spark)
    got = {}
    for r in most_similar(df, "key", "v", 16, **how).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.neighbour, r.cosine)
    assert set(got) == set(ids.tolist())
    s = units(x) @ units(x).T
    np.fill_diagonal(s, -2)
    hits = 0
    for a, i in enumerate(ids):
        order = np.lexsort((ids, -np.round(s[a], 12)))[:5]
        assert sorted(got[i]) == [1, 2, 3, 4, 5] and len({n for n, _ in got[i].values()}) == 5 and i not in [n for n, _ in got[i].values()]
        hits += len({n for n, _ in got[i].values()} & set(ids[order].tolist()))
    assert hits >= (1 if "exact" in how else 0.95) * 5 * len(ids)
    many = [6, *range(3001, 3041)]
    for i in many:  # equal cosines go to the smaller ids
        assert [got[i][r][0] for r in range(1, 6)] == [j for j in many if j != i][:5]


def test_hashes_grow_with_the_rows():
    assert [levels_for(n, 64) for n in (0, 1_000_000, 9_000_000, 2_000_000_000)] == [1, 1, 2, 3]
    x = np.random.default_rng(1).normal(size=(20, 16))
    h = Hash(16, 3, 1)
    cell, top = h.cells(x)
    for i, c in enumerate(cell.tolist()):
        for turn, axis, t in zip(h.turns, h.axes(c), top[i], strict=True):
            y = turn(x)[i]
            assert axis // 2 == np.abs(y).argmax() and (axis % 2 == 1) == (y[axis // 2] < 0) and t == abs(y[axis // 2])
    assert shares_of_chance(2, 1, 1) == pytest.approx(2) and shares_of_chance(2, 2, 1) < 2 < shares_of_chance(2, 1, 2)


def test_merging_within_a_block_is_single_linkage():
    rng = np.random.default_rng(5)
    for n in (1, 2, 60, 300):
        x = units(rng.normal(size=(n, 4)))
        x[n // 2 :] = x[: n - n // 2] if n > 1 else x[n // 2 :]  # ties
        ids = rng.permutation(10 * n)[:n]
        label, s = ids.copy(), x @ x.T >= 0.97
        while True:
            new = np.where(s, label[None], 10 * n).min(1)
            if (new == label).all():
                break
            label = new
        assert (_labels(ids, x, 0.97) == label).all()


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1])], "key long, v array<float>")
    got = {(r.id, r["rank"]): r.neighbour for r in most_similar(df, "key", "v", 2).collect()}
    assert got == {(1, 1): 3, (1, 2): 2, (2, 1): 3, (2, 2): 1, (3, 1): 1, (3, 2): 2}
    assert most_similar(df.limit(0), "key", "v", 2).collect() == []


@pytest.mark.parametrize("levels", [1, 2])
def test_links_join_the_same_rows_as_all_pairs(spark, levels):
    df, ids, x = table(spark, seed=4)
    index = build_index(df, "key", "v", 16, link=0.85, tables=1, levels=levels)
    members, edges = links(index, 0.85)
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for r in members.collect():
        parent[find(r.id)] = find(r.label)
    for r in edges.collect():
        parent[find(r.a)] = find(r.b)
    copies = {r.id: r["first"] for r in index.copies.collect()}
    assert len(copies) == 40
    s = units(x) @ units(x).T >= 0.85
    label = np.arange(len(ids))
    while True:
        new = np.where(s, label[None], len(ids)).min(1)
        if (new == label).all():
            break
        label = new
    mine = np.array([find(copies.get(i, i)) for i in ids.tolist()])
    assert len(set(zip(mine.tolist(), label.tolist(), strict=True))) == len(set(mine.tolist())) == len(set(label.tolist()))
