import heapq
import random

import pytest

from quillstone.operators import graph
from quillstone.operators.similarity import graph_nodes
from quillstone.session import materialize

INF = float("inf")


def tables(spark, edges, n):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src int, dst int, weight double"), spark.range(n).selectExpr("cast(id as int) as id")


def dijkstra(edges, n, source):
    out = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    dist, heap = {}, [(0.0, source)]
    while heap:
        d, x = heapq.heappop(heap)
        if x in dist:
            continue
        dist[x] = d
        for y, w in out.get(x, []):
            if y not in dist:
                heapq.heappush(heap, (d + w, y))
    return dist


def kruskal(edges, n):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    best = {}
    for a, b, w in edges:
        if a != b:
            k = (min(a, b), max(a, b))
            best[k] = min(w, best.get(k, INF))
    out = set()
    for (a, b), w in sorted(best.items(), key=lambda x: (x[1], x[0])):
        if find(a) != find(b):
            p[find(a)] = find(b)
            out.add((a, b, w))
    return out


def power(edges, n, rounds=200):
    deg = [sum(a == i for a, _, _ in edges) for i in range(n)]
    r = [1 / n] * n
    for _ in range(rounds):
        r = [0.15 / n + 0.85 * sum(r[a] / deg[a] for a, b, _ in edges if b == i) for i in range(n)]
    return r


def peel(edges, n):
    left, level, depth = [sum(b == i for _, b, _ in edges) for i in range(n)], {}, 0
    front = [i for i in range(n) if not left[i]]
    while front:
        new = set()
        for x in front:
            level[x] = depth
        for x in front:
            for a, b, _ in edges:
                if a == x:
                    left[b] -= 1
                    if not left[b]:
                        new.add(b)
        front, depth = sorted(new), depth + 1
    return level


rng = random.Random(1)
GRAPHS = {
    "empty": ([], 0),
    "single": ([], 1),
    "chain": ([(i, i + 1, 0.5) for i in range(39)], 40),
    "cycle with a tail": ([(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1), (3, 4, 1)], 6),
    "clusters": ([(0, 1, 1), (2, 3, 1), (0, 2, 10), (1, 3, 8)], 4),
    "multi": ([(0, 1, 2), (0, 1, 1), (1, 1, 0), (1, 2, 0), (0, 2, 1), (3, 2, 1)], 5),
    "random": ([(rng.randrange(25), rng.randrange(25), rng.randrange(1, 9) / 8) for _ in range(60)], 25),
    "star": ([(0, i, 1 + i / 100) for i in range(1, 20)], 21),
}


@pytest.mark.parametrize("engine", ["local", "distributed"])
@pytest.mark.parametrize("name", list(GRAPHS))
def test_against_plain_models(spark, engine, name):
    edges, n = GRAPHS[name]
    e, v = tables(spark, edges, n)
    hops = dijkstra([(a, b, 1) for a, b, _ in edges], n, 0) if n else {}
    assert {r.id: r.dist for r in graph.bfs(e, v, 0, engine).collect()} == hops
    level = peel(edges, n)
    sorted_ = materialize(graph.topological_sort(e, v, engine))
    order = sorted_.orderBy("pos").collect()
    assert {r.id: r.level for r in order} == level and [r.id for r in order] == sorted(level, key=lambda i: (level[i], i))
    assert [r.pos for r in order] == list(range(len(order)))
    check = graph.cycle_check(sorted_, v).first()
    assert check.has_cycle == (len(level) < n) and check.levels == max(level.values(), default=-1) + 1
    ranks = {r.id: r["rank"] for r in graph.pagerank(e, v, tol=1e-9, engine=engine).collect()}
    want = power(edges, n) if n else []
    assert set(ranks) == set(range(n)) and all(abs(ranks[i] - want[i]) < 1e-6 for i in range(n))
    dist = dijkstra(edges, n, 0) if n else {}
    tree = graph.sssp(e, v, 0, engine)
    got = tree.collect()
    assert {r.id: r.dist for r in got} == pytest.approx(dist)
    weight = {}
    for a, b, w in edges:
        weight[a, b] = min(w, weight.get((a, b), INF))
    paths = {r.id: r.path for r in graph.shortest_paths(materialize(tree), v.limit(5)).collect()} if n else {}
    for r in got:
        path = paths.get(r.id, [0, r.id])
        assert path[0] == 0 and path[-1] == r.id
        if r.id in paths:
            assert sum(weight[p] for p in zip(path, path[1:], strict=False)) == pytest.approx(r.dist)
            assert r.pred == (path[-2] if len(path) > 1 else None) and r.hops == len(path) - 1
    assert {(r.src, r.dst, r.weight) for r in graph.minimum_spanning_forest(e, v, engine).collect()} == kruskal(edges, n)
    every = {(i, j): d for i in range(n) for j, d in dijkstra(edges, n, i).items()}
    assert {(r.src, r.dst): r.dist for r in graph.apsp(e, v, engine).collect()} == pytest.approx(every)


def test_dense_distances(spark):
    edges = [(i, j, 1 + (i * 7 + j * 3) % 5) for i in range(12) for j in range(12) if i != j]
    e, v = tables(spark, edges, 12)
    assert {(r.src, r.dst): r.dist for r in graph.apsp(e, v).collect()} == {(i, j): d for i in range(12) for j, d in dijkstra(edges, 12, i).items()}


def test_ranks_of_the_sample(spark):
    """16 sources, 8 targets, all pairs but one linked: 0.00625, 0.01697 and 0.01621."""
    edges = [(i, 16 + j, 0.1) for i in range(16) for j in range(8) if (i, j) != (1, 0)]
    e, v = tables(spark, edges, 24)
    ranks = [f"{r['rank']:.5f}" for r in graph.pagerank(e, v).orderBy("id").collect()]
    assert ranks == ["0.00625"] * 16 + ["0.01621"] + ["0.01697"] * 7


def test_the_rest(spark):
    edges = [(0, 3, 0.2), (0, 4, 0.1), (1, 4, 0.3)]
    e, _ = tables(spark, edges, 6)
    v = graph_nodes(spark, 3, 3)
    assert {(r.source, r.id): r.dist for r in graph.bfs_from_many(e, v.where("id < 2")).collect()} == {(0, 0): 0, (0, 3): 1, (0, 4): 1, (1, 1): 0, (1, 4): 1}
    gaps = {r.local_idx: r.is_gap for r in graph.bfs_gaps(graph.bfs(e, v, 0), v).collect()}
    assert gaps == {0: False, 1: False, 2: True}
    forest = graph.minimum_spanning_forest(e, v)
    s = graph.forest_stats(forest, v).first()
    assert (s.edges, s.targets) == (3, 2) and s.total_weight == pytest.approx(0.6) and s.targets_pct == pytest.approx(200 / 3)
    assert [r.similarity for r in graph.top_links(forest, 1).collect()] == pytest.approx([0.9])
    assert [r.id for r in graph.strongest_paths(graph.sssp(e, v, 0), v).collect()] == [4, 3]
    assert [tuple(r) for r in graph.top_ranked(graph.pagerank(e, v), 2).select("place", "id").collect()] == [(1, 4), (2, 3)]
    r = graph.bfs_coverage(graph.bfs(e, v, 0), v).first()
    assert (r.covered, r.targets) == (2, 3) and r.coverage_pct == pytest.approx(200 / 3)
    assert sorted((r.src, r.dst) for r in graph.undirected(e).collect()) == sorted([(a, b) for a, b, _ in edges] + [(b, a) for a, b, _ in edges])
    c = graph.apsp_coverage(graph.apsp(e, v), v).first()
    assert (c.pairs, c.reachable, c.gaps) == (9, 3, 6)
    with pytest.raises(ValueError):
        graph.sssp(*tables(spark, [(0, 1, -1)], 2))
    with pytest.raises(ValueError):
        graph.bfs(e, v, 0, "other")
