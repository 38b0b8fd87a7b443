"""Graph algorithms over edge tables ``(src, dst[, weight])`` and node tables ``(id)``.

Each has two engines with the same results. A graph of a checked, small size is one task's work and runs in numpy
there: a distributed loop would spend its time on scheduling. A larger one is iterated with joins that carry only the
frontier or the changes; every round is written to the shared folder, which keeps plans short and survives lost
executors. ``engine`` forces one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import materialize, release

LOCAL_NODES, LOCAL_EDGES = 100_000, 1_000_000  #: largest graph for the one-task engine
LOCAL_PAIRS_NODES = 4_000  #: the same where the result has a row for each pair


def _is_local(edges: DataFrame, nodes: DataFrame, engine: str, most_nodes: int = LOCAL_NODES) -> bool:
    if engine not in ("auto", "local", "distributed"):
        raise ValueError("engine must be auto, local or distributed")
    if engine != "auto":
        return engine == "local"
    return nodes.limit(most_nodes + 1).count() <= most_nodes and edges.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES


Local = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, pa.Array]]


def _one_task(edges: DataFrame, nodes: DataFrame, run: Local, schema: str) -> DataFrame:
    """``run(ids, src, dst, weight)``, with src and dst as positions in the sorted ids, in one task."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    rows = edges.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), weight.alias("w"))
    rows = rows.unionByName(nodes.select(F.col("id").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0.0).alias("w")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        t = pa.concat_tables(tables)
        a, w, is_node = t["a"].to_numpy(), t["w"].to_numpy(), t["b"].is_null().to_numpy()
        b = t["b"].fill_null(0).to_numpy()
        ids = np.unique(a[is_node])
        e = ~is_node & np.isin(a, ids) & np.isin(b, ids)
        order = np.lexsort((w[e], b[e], a[e]))
        src, dst = np.searchsorted(ids, a[e])[order], np.searchsorted(ids, b[e])[order]
        yield from pa.table(run(ids, src, dst, w[e][order])).to_batches()

    return rows.repartition(1).mapInArrow(task, schema)


def _out(first: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Places of the nodes' outgoing edges, which are sorted by source and begin at ``first``."""
    size = first[nodes + 1] - first[nodes]
    return np.repeat(first[nodes], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _levels(n: int, src: np.ndarray, dst: np.ndarray, start: np.ndarray) -> np.ndarray:
    level = np.full(n, -1, np.int64)
    level[start] = 0
    frontier, depth = start, 0
    first = np.searchsorted(src, np.arange(n + 1))
    while len(frontier):
        depth += 1
        reached = np.unique(dst[_out(first, frontier)])
        frontier = reached[level[reached] < 0]
        level[frontier] = depth
    return level


def bfs(edges: DataFrame, nodes: DataFrame, source: int = 0, engine: str = "auto", max_depth: int | None = None) -> DataFrame:
    """Hops from ``source`` along edges: ``(id, dist)`` of the nodes it reaches, itself included."""
    if _is_local(edges, nodes, engine):

        def run(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> dict:
            level = _levels(len(ids), src, dst, np.flatnonzero(ids == source))
            hit = (level >= 0) & (level <= (max_depth if max_depth is not None else len(ids)))
            return {"id": pa.array(ids[hit]), "dist": pa.array(level[hit].astype(np.int32))}

        return _one_task(edges, nodes, run, "id long, dist int")
    links = materialize(edges.select("src", F.col("dst").alias("id")).distinct(), "links")
    seen = materialize(nodes.where(F.col("id") == source).select(F.col("id").cast("long").alias("id"), F.lit(0).alias("dist")), "seen")
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = frontier.select(F.col("id").alias("src")).join(links, "src").select(F.col("id").cast("long").alias("id")).distinct()
        frontier = materialize(reached.join(seen, "id", "left_anti").join(nodes.select(F.col("id").cast("long").alias("id")), "id", "left_semi").withColumn("dist", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    return seen


def bfs_from_many(edges: DataFrame, sources: DataFrame, max_depth: int = 1_000_000) -> DataFrame:
    """``(source, id, dist)`` from each of several sources at once; the frontier carries its source."""
    links = materialize(edges.select("src", F.col("dst").cast("long").alias("id")).distinct(), "links")
    seen = materialize(sources.select(F.col("id").cast("long").alias("source")).distinct().select("source", F.col("source").alias("id"), F.lit(0).alias("dist")), "seen")
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = frontier.select("source", F.col("id").alias("src")).join(links, "src").select("source", "id").distinct()
        frontier = materialize(reached.join(seen, ["source", "id"], "left_anti").withColumn("dist", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def bfs_gaps(dist: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, local_idx, is_gap)`` of the targets: a gap is one that the search doesn't reach."""
    hit = dist.select(F.col("id").alias("id"), F.lit(True).alias("hit"))
    return nodes.where("kind = 'PROC'").join(hit, "id", "left").select("id", "local_idx", F.col("hit").isNull().alias("is_gap"))


def bfs_levels(dist: DataFrame) -> DataFrame:
    return dist.groupBy("dist").agg(F.count("*").alias("nodes"))


def bfs_coverage(dist: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(covered, targets, coverage_pct)``: targets that the search reaches."""
    r = bfs_gaps(dist, nodes).agg(F.count_if(~F.col("is_gap")).alias("covered"), F.count("*").alias("targets"))
    return r.withColumn("coverage_pct", 100.0 * F.col("covered") / F.greatest("targets", F.lit(1)))


def topological_sort(edges: DataFrame, nodes: DataFrame, engine: str = "auto") -> DataFrame:
    """``(id, level, pos)``: nodes in the rounds in which they lose their last incoming edge; within a round by id.
    Nodes on a cycle or behind one have no row."""
    if _is_local(edges, nodes, engine):

        def run(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> dict:
            n = len(ids)
            left = np.bincount(dst, minlength=n)
            level = np.full(n, -1, np.int64)
            first = np.searchsorted(src, np.arange(n + 1))
            frontier, depth = np.flatnonzero(left == 0), 0
            while len(frontier):
                level[frontier] = depth
                met, lost = np.unique(dst[_out(first, frontier)], return_counts=True)
                left[met] -= lost
                frontier, depth = met[left[met] == 0], depth + 1
            order = np.lexsort((ids, level))
            order = order[level[order] >= 0]
            return {"id": pa.array(ids[order]), "level": pa.array(level[order].astype(np.int32)), "pos": pa.array(np.arange(len(order), dtype=np.int32))}

        return _one_task(edges, nodes, run, "id long, level int, pos int")
    ids = nodes.select(F.col("id").cast("long").alias("id"))
    links = materialize(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("id")), "links")
    left = materialize(ids.join(links.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")), "left")
    done, depth = None, 0
    while True:
        frontier = materialize(left.where("n = 0").select("id", F.lit(depth).alias("level")), "frontier")
        if frontier.isEmpty():
            break
        done = frontier if done is None else done.unionByName(frontier)
        lost = frontier.select(F.col("id").alias("src")).join(links, "src").groupBy("id").agg(F.count("*").alias("k"))
        old = left
        left = materialize(left.where("n > 0").join(lost, "id", "left").select("id", (F.col("n") - F.coalesce("k", F.lit(0))).alias("n")), "left")
        release(left.sparkSession, old._quillstone_path)
        depth += 1
    if done is None:
        return ids.limit(0).select("id", F.lit(0).alias("level"), F.lit(0).alias("pos"))
    from quillstone.operators.similarity import sequential_index

    return sequential_index(done, ["level", "id"], "pos").select("id", "level", "pos")


def cycle_check(order: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(nodes, sorted, levels, has_cycle)``."""
    n = nodes.agg(F.count("*").alias("nodes"))
    s = order.agg(F.count("*").alias("sorted"), (F.coalesce(F.max("level"), F.lit(-1)) + 1).alias("levels"))
    return n.crossJoin(s).withColumn("has_cycle", F.col("sorted") < F.col("nodes"))  # one row each


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6, engine: str = "auto") -> DataFrame:
    """``(id, rank)``: r' = (1 - d) / n + d * sum(r_src / outdegree_src), from 1 / n, until no rank changes by
    ``tol``. The mass of nodes without outgoing edges is lost, so ranks need not add up to 1."""
    if _is_local(edges, nodes, engine):

        def run(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> dict:
            n = len(ids)
            rank = np.full(n, 1.0 / max(n, 1))
            share = 1.0 / np.maximum(np.bincount(src, minlength=n), 1)
            for _ in range(max_iter):
                new = (1 - damping) / max(n, 1) + damping * np.bincount(dst, weights=(rank * share)[src], minlength=n)
                change = np.abs(new - rank).max(initial=0)
                rank = new
                if change < tol:
                    break
            return {"id": pa.array(ids), "rank": pa.array(rank)}

        return _one_task(edges, nodes, run, "id long, rank double")
    ids = nodes.select(F.col("id").cast("long").alias("id"))
    n = ids.count()
    degree = edges.groupBy("src").agg(F.count("*").alias("deg"))
    links = materialize(edges.select("src", F.col("dst").cast("long").alias("dst")).join(degree, "src").repartition("src"), "links")
    rank = materialize(ids.withColumn("rank", F.lit(1.0 / max(n, 1))).withColumn("change", F.lit(1.0)), "rank")
    for _ in range(max_iter):
        sent = links.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        new = rank.join(sent, "id", "left").select("id", ((1 - damping) / max(n, 1) + damping * F.coalesce("got", F.lit(0.0))).alias("new"), "rank")
        old, rank = rank, materialize(new.select("id", F.col("new").alias("rank"), F.abs(F.col("new") - F.col("rank")).alias("change")), "rank")
        release(rank.sparkSession, old._quillstone_path)
        if (rank.agg(F.max("change")).first()[0] or 0.0) < tol:
            break
    return rank.select("id", "rank")


def top_ranked(ranks: DataFrame, k: int = 10) -> DataFrame:
    """The k best of all nodes, ``(place, id, rank)``; equal ranks by id."""
    top = ranks.orderBy(F.desc("rank"), "id").limit(k)
    return top.select(F.expr("row_number() over (order by rank desc, id)").alias("place"), "id", "rank")  # k rows


def undirected(edges: DataFrame) -> DataFrame:
    """The edges and their reverses."""
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *cols).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols))


def minimum_spanning_forest(edges: DataFrame, nodes: DataFrame, engine: str = "auto") -> DataFrame:
    """``(src, dst, weight)`` with src < dst: the lightest edges that join all that edges join, direction disregarded.
    Equal weights go by (src, dst), so the forest is unique. Boruvka: every round each component takes its lightest
    edge to another one, and whole trees of such choices merge."""
    lines = edges.where("src != dst").groupBy(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).agg(F.min("weight").alias("weight"))
    if _is_local(lines, nodes, engine):

        def run(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> dict:
            order = np.lexsort((dst, src, w))
            parent, kept = list(range(len(ids))), []
            for e in order.tolist():
                a, b = int(src[e]), int(dst[e])
                while parent[a] != a:
                    parent[a] = a = parent[parent[a]]
                while parent[b] != b:
                    parent[b] = b = parent[parent[b]]
                if a != b:
                    parent[a] = b
                    kept.append(e)
            kept = np.array(kept, np.int64)
            return {"src": pa.array(ids[src[kept]]), "dst": pa.array(ids[dst[kept]]), "weight": pa.array(w[kept])}

        return _one_task(lines, nodes, run, "src long, dst long, weight double")
    lines = materialize(lines.select("src", "dst", "weight", F.col("src").alias("a"), F.col("dst").alias("b")), "lines")
    forest = None
    while True:
        ends = lines.select("a", "b", "src", "dst", "weight").unionByName(lines.select(F.col("b").alias("a"), F.col("a").alias("b"), "src", "dst", "weight"))
        best = materialize(ends.groupBy("a").agg(F.min_by(F.struct("b", "src", "dst", "weight"), F.struct("weight", "src", "dst")).alias("e")).select("a", "e.*"), "best")
        if best.isEmpty():
            return forest if forest is not None else lines.select("src", "dst", "weight").limit(0)
        chosen = best.select("src", "dst", "weight").distinct()
        forest = chosen if forest is None else forest.unionByName(chosen)
        back = best.select(F.col("a").alias("b"), F.col("b").alias("c"))
        mutual = (F.col("c") == F.col("a")) & (F.col("a") < F.col("b"))
        up = materialize(best.select("a", "b").join(back, "b").select("a", F.when(mutual, F.col("a")).otherwise(F.col("b")).alias("r")), "up")
        while True:  # pointer doubling to the roots
            step = materialize(up.join(up.select(F.col("a").alias("r"), F.col("r").alias("t")), "r").select("a", F.col("t").alias("r"), (F.col("t") != F.col("r")).alias("moved")), "up")
            moved = not step.where("moved").isEmpty()
            up = step.drop("moved")
            if not moved:
                break
        to_a, to_b = up.select("a", F.col("r").alias("ra")), up.select(F.col("a").alias("b"), F.col("r").alias("rb"))
        joined = lines.join(to_a, "a").join(to_b, "b").where("ra != rb")
        # of parallel edges between two components only the lightest can be needed
        pair = [F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")]
        new = joined.groupBy(*pair).agg(F.min_by(F.struct("src", "dst", "weight"), F.struct("weight", "src", "dst")).alias("e")).select("e.*", "a", "b")
        old, lines = lines, materialize(new, "lines")
        release(lines.sparkSession, old._quillstone_path)


def forest_stats(forest: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(edges, total_weight, mean_similarity, targets, targets_pct)``; targets are the ones in the forest."""
    ends = forest.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    targets = nodes.where("kind = 'PROC'")
    hit = targets.join(ends, "id", "left_semi").agg(F.count("*").alias("targets"))
    every = targets.agg(F.count("*").alias("n"))
    total = forest.agg(F.count("*").alias("edges"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"), (1 - F.avg("weight")).alias("mean_similarity"))
    return total.crossJoin(hit).crossJoin(every).select("edges", "total_weight", "mean_similarity", "targets", (100.0 * F.col("targets") / F.greatest("n", F.lit(1))).alias("targets_pct"))


def top_links(forest: DataFrame, k: int = 10) -> DataFrame:
    """The forest's k lightest edges, as similarities."""
    return forest.orderBy("weight", "src", "dst").limit(k).select("src", "dst", (1 - F.col("weight")).alias("similarity"))


def _distances(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Only nodes whose distance fell in the last round send it on. Edges are sorted by source."""
    dist = np.full(n, np.inf)
    dist[start] = 0
    first = np.searchsorted(src, np.arange(n + 1))
    changed = start
    while len(changed):
        at = _out(first, changed)
        to, offer = dst[at], dist[src[at]] + w[at]
        better = offer < dist[to]
        to, offer = to[better], offer[better]
        np.minimum.at(dist, to, offer)
        changed = np.unique(to)
    return dist


def sssp(edges: DataFrame, nodes: DataFrame, source: int = 0, engine: str = "auto") -> DataFrame:
    """``(id, dist, pred, hops)`` of the nodes that can be reached from ``source`` over non-negative weights. Of
    several predecessors on shortest ways the one with the fewest hops counts, then the smallest. ``shortest_paths``
    follows the predecessors. ValueError if a weight is below 0."""
    if edges.where("weight < 0").limit(1).count():
        raise ValueError("negative weights")
    if _is_local(edges, nodes, engine):

        def run(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> dict:
            n, start = len(ids), np.flatnonzero(ids == source)
            dist = _distances(n, src, dst, w, start)
            tight = np.isfinite(dist[src]) & (dist[src] + w == dist[dst])
            s, d = src[tight], dst[tight]
            hops = _levels(n, s, d, start)
            use = hops[d] == hops[s] + 1
            pred = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(pred, d[use], s[use])
            hit = np.flatnonzero(hops >= 0)
            before = pa.array(ids[np.where(hops[hit] > 0, pred[hit], 0)], mask=hops[hit] == 0)
            return {"id": pa.array(ids[hit]), "dist": pa.array(dist[hit]), "pred": before, "hops": pa.array(hops[hit].astype(np.int32))}

        return _one_task(edges, nodes, run, "id long, dist double, pred long, hops int")
    ids = nodes.select(F.col("id").cast("long").alias("id"))
    links = materialize(edges.groupBy(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).agg(F.min("weight").alias("weight")), "links")
    best = materialize(ids.where(F.col("id") == source).select("id", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("pred"), F.lit(0).alias("hops")), "best")
    changed = best
    for _ in range(max(ids.count(), 1)):
        # only nodes whose distance fell last round send it on
        sent = changed.select(F.col("id").alias("src"), "dist", "hops").join(links, "src").select(F.col("dst").alias("id"), (F.col("dist") + F.col("weight")).alias("dist"), F.col("src").alias("pred"), (F.col("hops") + 1).alias("hops"))
        sent = sent.join(ids, "id", "left_semi")
        key = F.struct("dist", "hops", "pred")
        offers = sent.groupBy("id").agg(F.min(key).alias("o")).select("id", "o.*")
        known = best.select("id", F.struct("dist", "hops", F.coalesce("pred", F.lit(-(1 << 63))).alias("pred")).alias("k"))
        changed = materialize(offers.join(known, "id", "left").where(F.col("k").isNull() | (key < F.col("k"))).select("id", "dist", "pred", "hops"), "changed")
        if changed.isEmpty():
            return best
        old, best = best, materialize(best.join(changed, "id", "left_anti").unionByName(changed), "best")
        release(best.sparkSession, old._quillstone_path)
    return best


def shortest_paths(found: DataFrame, ends: DataFrame) -> DataFrame:
    """``(id, path)``: the nodes from the source to each of ``ends`` (id) that ``sssp`` found. Predecessors are
    followed for these ends only, all at once, a step in each round; longer ways have been left out of the search."""
    back = found.select(F.col("id").alias("at"), "pred")
    step = ends.select(F.col("id").cast("long").alias("id")).distinct().join(found.select("id"), "id").select("id", F.col("id").alias("at"), F.array("id").alias("path"))
    done = None
    while True:
        step = materialize(step.join(back, "at"), "paths")
        here = step.where("pred is null").select("id", "path")
        done = here if done is None else done.unionByName(here)
        if step.where("pred is not null").isEmpty():
            return done
        step = step.where("pred is not null").select("id", F.col("pred").alias("at"), F.concat(F.array("pred"), "path").alias("path"))


def strongest_paths(dist: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest targets with ``1 - dist`` as their similarity; equal distances by id."""
    return dist.join(nodes.where("kind = 'PROC'"), "id").orderBy("dist", "id").limit(k).select("id", "local_idx", "dist", (1 - F.col("dist")).alias("similarity"))


def distance_summary(dist: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(reachable, reachable_pct, min_dist, max_dist)``."""
    n = nodes.agg(F.count("*").alias("n"))
    d = dist.agg(F.count("*").alias("reachable"), F.min("dist").alias("min_dist"), F.max("dist").alias("max_dist"))
    return d.crossJoin(n).select("reachable", (100.0 * F.col("reachable") / F.greatest("n", F.lit(1))).alias("reachable_pct"), "min_dist", "max_dist")


def apsp(edges: DataFrame, nodes: DataFrame, engine: str = "auto") -> DataFrame:
    """``(src, dst, dist)`` of all pairs with a way from one to the other, each node to itself at 0 included.
    Distributed: min-plus squaring, in as many rounds as the logarithm of the longest way."""
    if _is_local(edges, nodes, engine, LOCAL_PAIRS_NODES):

        def run(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> dict:
            n = len(ids)
            if n == 0:
                return {"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())}
            dist = np.full((n, n), np.inf)
            np.minimum.at(dist, (src, dst), w)
            np.fill_diagonal(dist, 0)
            if len(src) * 8 < n * n:  # sparse: all sources' ways grow by one edge at a time, where they changed
                order = np.argsort(dst, kind="stable")
                s, d, w_ = src[order], dst[order], w[order]
                ways = np.ascontiguousarray(dist.T)  # a row for each end
                moved = np.ones(n, bool)
                while moved.any():
                    use = np.flatnonzero(moved[s])
                    if not len(use):
                        break
                    heads = np.flatnonzero(np.diff(d[use], prepend=-1))
                    moved = np.zeros(n, bool)
                    for a, e in zip(heads, np.append(heads[1:], len(use)), strict=True):
                        at = use[a:e]
                        new = np.minimum((ways[s[at]] + w_[at, None]).min(0), ways[d[at[0]]])
                        if (new < ways[d[at[0]]]).any():
                            ways[d[at[0]]] = new
                            moved[d[at[0]]] = True
                dist = ways.T
            else:
                for m in range(n):
                    np.minimum(dist, dist[:, m : m + 1] + dist[m : m + 1], out=dist)
            i, j = np.nonzero(np.isfinite(dist))
            return {"src": pa.array(ids[i]), "dst": pa.array(ids[j]), "dist": pa.array(dist[i, j])}

        return _one_task(edges, nodes, run, "src long, dst long, dist double")
    ids = nodes.select(F.col("id").cast("long").alias("id"))
    base = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("dist")).unionByName(ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist")))
    dist = materialize(base.groupBy("src", "dst").agg(F.min("dist").alias("dist")), "dist")
    while True:
        left, right = dist.select("src", F.col("dst").alias("m"), F.col("dist").alias("d1")), dist.select(F.col("src").alias("m"), "dst", F.col("dist").alias("d2"))
        joined = left.join(right, "m").groupBy("src", "dst").agg(F.min(F.col("d1") + F.col("d2")).alias("new"))
        both = materialize(joined.join(dist, ["src", "dst"], "left").select("src", "dst", F.col("new").alias("dist"), (F.col("dist").isNull() | (F.col("new") < F.col("dist"))).alias("moved")), "dist")
        moved = not both.where("moved").isEmpty()
        release(both.sparkSession, dist._quillstone_path) if hasattr(dist, "_quillstone_path") else None
        dist = both.drop("moved")
        if not moved:
            return dist


def apsp_coverage(dist: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(pairs, reachable, gaps, reachable_pct)`` over all pairs of a source and a target."""
    regs, procs = (nodes.where(f"kind = '{k}'").select(F.col("id").cast("long").alias(c)) for k, c in (("REG", "src"), ("PROC", "dst")))
    hit = dist.join(regs, "src", "left_semi").join(procs, "dst", "left_semi").agg(F.count("*").alias("reachable"))
    size = nodes.agg((F.count_if(F.col("kind") == "REG") * F.count_if(F.col("kind") == "PROC")).alias("pairs"))
    return hit.crossJoin(size).select("pairs", "reachable", (F.col("pairs") - F.col("reachable")).alias("gaps"), (100.0 * F.col("reachable") / F.greatest("pairs", F.lit(1))).alias("reachable_pct"))
