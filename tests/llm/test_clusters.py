import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm.clusters import average_groups, describe_groups, reciprocal_merge, similarity_groups
from quillstone.llm.vectors import units


def parts(pairs):
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def run(spark, edges, threshold, linkage):
    df = spark.createDataFrame(edges, "a long, b long, w double")
    return {r.node: r.cluster for r in reciprocal_merge(df, threshold, linkage).collect()}


def test_single_linkage_is_connectivity(spark):
    rng = random.Random(1)
    edges = {}
    for _ in range(120):
        a, b = sorted(rng.sample(range(100), 2))
        edges[a, b] = rng.choice([0.5, 0.9, 0.9, rng.random()])
    edges |= {(200, 200 + i): 0.9 for i in range(1, 12)}  # a star
    edges |= {(300 + i, 301 + i): 0.9 + i / 1000 for i in range(12)}  # a chain of rising weights
    got = run(spark, [(a, b, w) for (a, b), w in edges.items()], 0.6, "single")
    assert got == parts([e for e, w in edges.items() if w >= 0.6])


def average(edges, threshold):
    sim = {}
    for a, b, w in edges:
        sim[a, b] = sim[b, a] = w
    clusters = {n: [n] for e in edges for n in e[:2]}
    while True:
        best = None
        for a in clusters:
            for b in clusters:
                if a < b:
                    s = sum(sim.get((x, y), 0) for x in clusters[a] for y in clusters[b]) / (len(clusters[a]) * len(clusters[b]))
                    if s >= threshold and (best is None or s > best[0]):
                        best = (s, a, b)
        if best is None:
            return {x: min(c) for c in clusters.values() for x in c}
        clusters[best[1]] += clusters.pop(best[2])


def test_average_linkage_equals_one_merge_at_a_time(spark):
    rng = random.Random(2)
    edges = [(a, b, round(rng.random(), 9)) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.6]
    assert run(spark, edges, 0.35, "average") == average(edges, 0.35)
    with pytest.raises(ValueError):
        run(spark, edges, 0.3, "complete")


@pytest.mark.parametrize("together", [50_000, 9])
def test_average_groups_of_vectors(spark, together):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(6, 6))
    x = np.concatenate([c + s * rng.normal(size=(n, 6)) for c, s, n in zip(centers, np.linspace(0.1, 0.6, 6), (1, 2, 3, 6, 9, 11), strict=True)]).astype(np.float32)
    rows = [(i + 3, v.tolist()) for i, v in enumerate(x)] + [(200 + i, x[12].tolist()) for i in range(4)] + [(1, x[30].tolist())]
    bad = [(300, None), (301, [0.0] * 6), (302, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + rows[:5] + bad, "key long, v array<float>").withColumn("id", F.lit("clash"))
    u = units(np.array([r[1] for r in rows], np.float32))
    ids = [r[0] for r in rows]
    s = u @ u.T
    want = average([(min(a, b), max(a, b), s[i, j]) for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j], 0.8)
    got = {r.id: r.cluster_key for r in average_groups(df, "key", "v", 6, threshold=0.8, k=40, together=together).collect()}
    assert got == want and len(set(want.values())) > 6
    assert average_groups(df.limit(0), "key", "v", 6).collect() == []


def test_groups(spark):
    rng = np.random.default_rng(3)
    centers = np.eye(8)[:3] * 3
    sizes, rows, heads = (40, 6, 2), [], ("CONTROL OF VOLHAP PUMP", "INSPECTION OF DREL VALVE", "REVIEW OF TAM GATE")
    key = 10
    for c, n, h in zip(centers, sizes, heads, strict=True):
        for i in range(n):
            rows.append((key, (c + 0.1 * rng.normal(size=8)).tolist(), h if i % 2 else "SCOPE"))
            key += 1
    rows += [(500 + i, rows[0][1], "SCOPE") for i in range(20)]  # copies of one vector
    rows += [(1, None, "Contrl of Volhap pump."), (2, [0.0] * 8, "CTRL  OF VOLHAP PUMP"), (3, [float("nan")] * 8, "Insp. of Drel Valve"), (4, [1.0], "SCOPE"), (5, None, None), (6, None, "Review of Tam Gate"), (7, None, "x" * 5000), (11000, None, "many words " * 20_000), (None, None, heads[0])]
    rows += [(8, None, "Control of Volhap Gate"), (9, None, "")]
    df = spark.createDataFrame(rows + rows[:9], "key long, v array<float>, h string").withColumn("id", F.lit("clash")).withColumn("cluster", F.lit("clash"))
    groups = similarity_groups(df, "key", "v", "h", 8, threshold=0.85)
    got = {(r.cluster_key, r.id) for r in groups.collect()}
    first = {1, 2, *range(10, 50), *range(500, 520)}
    assert got == {(1, i) for i in first} | {(3, i) for i in {3, *range(50, 56)}}
    d = {r.cluster_key: r for r in describe_groups(groups, df, "key", "v", "h", 8).collect()}
    assert (d[1]["size"], d[1].usable_rows, d[3]["size"]) == (62, 60, 7) and set(d[1].headings[:2]) == {"SCOPE", heads[0]}
    x = units(np.array([r[1] for r in rows[40:46]], np.float32))
    mean = x.mean(0)
    assert d[3].typical[0] == 50 + int(np.argmax(x @ mean)) and len(d[3].typical) == 3
    assert similarity_groups(df.limit(0), "key", "v", "h", 8).collect() == []
