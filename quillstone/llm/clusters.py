"""Grouping records into similarity clusters by reciprocal nearest neighbours.

Every round each cluster looks for its most similar neighbour on a sparse graph, all reciprocal pairs are merged at
the same time, and the links between what was merged are combined; it ends when no similarity reaches the threshold.

With average linkage only the reciprocal pairs merge, since any other merge could change their order. With single
linkage the similarity of two clusters is their strongest link, so a cluster may join its best neighbour at once even
if that one prefers another: the round then merges whole trees of best links, each of which holds exactly one
reciprocal pair, and the number of rounds is logarithmic even for stars and chains.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.vectors import build_index, links, nearest, usable
from quillstone.session import materialize, release


def _best(edges: DataFrame, score: Column) -> DataFrame:
    """Each cluster's best neighbour; equal similarities go to the smaller pair of ids, from whichever end."""
    both = edges.select("a", "b", score.alias("s")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), score.alias("s")))
    key = F.struct(F.col("s"), (-F.least("a", "b")).alias("x"), (-F.greatest("a", "b")).alias("y"))
    return both.groupBy("a").agg(F.max_by("b", key).alias("b"))


def _pointers(best: DataFrame, trees: bool) -> DataFrame:
    """``(a, r)``: the cluster each one merges into, for those that merge into another one."""
    best = materialize(best, "best")
    back = best.select(F.col("a").alias("b"), F.col("b").alias("c"))
    joined = best.join(back, "b").withColumn("mutual", F.col("c") == F.col("a"))
    if not trees:
        return joined.where("mutual and b < a").select("a", F.col("b").alias("r"))
    # the root of a tree is the smaller one of its reciprocal pair
    ptr = materialize(joined.select("a", F.when(F.col("mutual") & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("r")), "ptr")
    while True:  # pointer doubling: the depth halves each time
        up = ptr.select(F.col("a").alias("r"), F.col("r").alias("n"))
        new = materialize(ptr.join(up, "r").select("a", F.col("n").alias("r"), (F.col("n") != F.col("r")).alias("moved")), "ptr")
        moved = not new.where("moved").isEmpty()
        ptr = new.drop("moved")
        if not moved:
            return ptr.where("a != r")


def reciprocal_merge(edges: DataFrame, threshold: float, linkage: str = "average", max_rounds: int = 200) -> DataFrame:
    """Clusters of the nodes of a sparse graph: ``(node, cluster)``, the cluster named by its smallest node.

    ``edges``: ``(a, b, w)`` with a < b, each pair once. Average linkage divides the sum of the links between two
    clusters by the number of all their pairs, so a missing link counts as no similarity; single linkage takes the
    strongest link. Links below the threshold count for averages but never merge anything by themselves. Only nodes
    with a link come out. No round collects links or clusters; each is written to the shared folder.
    """
    if linkage not in ("average", "single"):
        raise ValueError("linkage must be average or single")
    single = linkage == "single"
    if single:
        edges = edges.where(F.col("w") >= threshold)
    edges = materialize(edges.select("a", "b", F.col("w").alias("w")), "edges")
    nodes = materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("cluster"), F.lit(1).cast("long").alias("size")), "nodes")
    sizes = nodes.select("cluster", "size")
    for _ in range(max_rounds):
        if single:
            candidates, score = edges, F.col("w")
        else:
            sized = edges.join(sizes.select(F.col("cluster").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("cluster").alias("b"), F.col("size").alias("sb")), "b")
            candidates = sized.withColumn("w", F.col("w") / (F.col("sa") * F.col("sb"))).where(F.col("w") >= threshold - 1e-12)
            score = F.col("w")
        moves = materialize(_pointers(_best(candidates, score), trees=single), "moves")
        if moves.isEmpty():
            return _smallest(nodes)
        to = moves.withColumnRenamed("a", "cluster")
        new = nodes.join(to, "cluster", "left").select("node", F.coalesce("r", "cluster").alias("cluster"), "size")
        a, b = moves.withColumnRenamed("r", "ra"), moves.select(F.col("a").alias("b"), F.col("r").alias("rb"))
        moved = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "w").where("a != b")
        moved = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg((F.max("w") if single else F.sum("w")).alias("w"))
        old, edges = edges, materialize(moved, "edges")
        release(edges.sparkSession, old._quillstone_path)
        old, nodes = nodes, materialize(new, "nodes")
        release(edges.sparkSession, old._quillstone_path)
        sizes = nodes.groupBy("cluster").agg(F.sum("size").alias("size"))
        if single and edges.isEmpty():
            return _smallest(nodes)
    raise RuntimeError(f"not done after {max_rounds} rounds")


def _smallest(nodes: DataFrame) -> DataFrame:
    names = nodes.groupBy("cluster").agg(F.min("node").alias("name"))
    return nodes.join(names, "cluster").select("node", F.col("name").alias("cluster"))


#: Words that join a heading's parts and say nothing of the thing it names; fixed values.
_JOINING = ("of", "for", "and", "the", "on", "to", "in", "a")


def heading_words(heading: Column) -> Column:
    """A heading's words: lower case, without accents of writing such as case, spacing and punctuation."""
    return F.filter(F.split(F.lower(heading), "[^a-z0-9]+"), lambda w: F.length(w) > 0)


def names_a_thing(words: Column) -> Column:
    """Whether a heading names a place or thing of its own: it has two words or more besides joining ones and
    numbers. A single common word (Scope, References), or a numbered one (SEC-7), doesn't."""
    own = F.filter(words, lambda w: w.rlike("[a-z]{2}") & ~w.isin(*_JOINING))
    return F.size(own) >= 2


def _masks(words: Column) -> Column:
    """Hashes of the heading as it is and with each of its words left out in turn: what two headings that differ in
    one word have in common. As long as the heading, however many words it has."""
    own = F.transform(words, lambda w, i: F.xxhash64(i, w))
    whole = F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))
    # within a lambda, so that the words and the whole are hashed once and not for each word
    both = F.transform(F.array(F.struct(own.alias("o"), whole.alias("w"))), lambda p: F.concat(F.array(p["w"]), F.transform(p["o"], lambda x, i: p["w"].bitwiseXOR(x).bitwiseXOR(F.xxhash64(i)))))
    return F.array_distinct(both[0])


def _similar_word(a: Column, b: Column) -> Column:
    """Whether two words are the same but for a slip of the pen (an edit or two, or a swap), or one abbreviates the
    other: same first letter, its letters in order within the longer one."""
    slip = F.levenshtein(a, b) <= F.when(F.greatest(F.length(a), F.length(b)) >= 5, 2).otherwise(1)

    def within(short: Column, long: Column) -> Column:
        pattern = F.concat(F.lit("^"), F.regexp_replace(short, "(.)", "$1.*"))
        return (F.length(short) >= 3) & (F.length(short) < F.length(long)) & (F.substring(short, 1, 1) == F.substring(long, 1, 1)) & F.call_function("rlike", long, pattern)

    return slip | within(a, b) | within(b, a)


def place_by_heading(members: DataFrame, headings: DataFrame, lost: DataFrame) -> DataFrame:
    """Puts rows without a vector into the group in whose rows their heading occurs: ``(id, cluster)``.

    ``members``: (id, cluster); ``headings``: (id, heading) of the same rows; ``lost``: (id, heading). The same
    writing but for case, spacing and punctuation comes first; else a heading that differs in one word, by a slip or
    an abbreviation. If it occurs in several groups, the one with most such rows takes it, then the smaller name.
    """
    known = members.join(headings, "id").select("cluster", heading_words(F.col("heading")).alias("w")).where(names_a_thing(F.col("w")))
    known = known.groupBy("w", "cluster").agg(F.count("*").alias("n"))  # few: one row for each writing in a group
    known = known.select("cluster", "n", F.col("w").alias("kw"), F.explode(_masks(F.col("w"))).alias("mask"))
    lost = lost.select("id", heading_words(F.col("heading")).alias("w")).where(names_a_thing(F.col("w")))
    each = lost.groupBy("w").agg(F.count("*").alias("rows"))
    asked = each.select("w", F.explode(_masks(F.col("w"))).alias("mask"))
    pairs = asked.join(known, "mask").where(F.size("w") == F.size("kw"))
    differ = F.filter(F.arrays_zip(F.col("w").alias("x"), F.col("kw").alias("y")), lambda p: p["x"] != p["y"])
    pairs = pairs.withColumn("d", differ).withColumn("same", F.size("d") == 0)
    pairs = pairs.where(F.col("same") | ((F.size("d") == 1) & _similar_word(F.get("d", F.lit(0))["x"], F.get("d", F.lit(0))["y"])))
    votes = pairs.select("w", "kw", "cluster", "n", "same").distinct().groupBy("w", "cluster", "same").agg(F.sum("n").alias("n"))
    best = votes.groupBy("w").agg(F.max_by("cluster", F.struct("same", "n", -F.col("cluster"))).alias("cluster"))
    return lost.join(best, "w").select("id", "cluster")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def average_groups(df: DataFrame, id_col: str, vector_col: str, dim: int, threshold: float = 0.85, k: int = 10, seed: int = 0, together: int = 50_000, max_rounds: int = 500) -> DataFrame:
    """Clusters of average linkage: ``(cluster_key, id)``, one row for each usable row, ``cluster_key`` the smallest id
    of its cluster.

    The similarity of two clusters is the mean cosine of all their pairs, exactly: for unit vectors it is the product
    of the clusters' vector sums divided by their sizes, so no pair within a cluster is ever listed. Candidates are the
    edges of a sparse graph, each row's ``k`` nearest neighbours of at least ``threshold`` (a mean that reaches it needs
    such a pair). Every round all reciprocal nearest clusters merge, edges between what was merged become one, and only
    those are computed again; it ends when no edge reaches the threshold. Rows with the same vector begin as one.
    Parts of the graph that no edge joins don't touch each other: parts of up to ``together`` rows are dealt to tasks
    of about so many, each of which does all its rounds; larger parts are merged by joins, round by round. Both give
    the same clusters.

    Usable rows have ``dim`` finite elements, not all zero; others, and null ids, have no row. Rows that repeat an id
    count once. Equal similarities go to the smaller pair of ids. An empty table gives none. RuntimeError if it isn't
    done after ``max_rounds``.
    """
    spark = df.sparkSession
    index = build_index(df, id_col, vector_col, dim, keep_copies=1, seed=seed)
    found = nearest(index, k)
    edge = found.select("id", F.explode(F.arrays_zip("ids", "cosines")).alias("p")).where(F.col("p.ids") != F.col("id")).where(F.col("p.cosines") >= threshold)
    edges = materialize(edge.groupBy(F.least("id", "p.ids").alias("a"), F.greatest("id", "p.ids").alias("b")).agg(F.max("p.cosines").alias("w")), "edges")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v").cast("array<float>"), dim)).dropDuplicates(["id"])
    if index.copies is not None:
        weight = index.copies.groupBy(F.col("first").alias("id")).agg((F.count("*") + 1).alias("size"))
        rows = rows.join(index.copies.select("id"), "id", "left_anti").join(weight, "id", "left")
    else:
        rows = rows.withColumn("size", F.lit(None).cast("long"))
    top = F.aggregate("v", F.lit(1e-300), lambda s, x: F.greatest(s, F.abs(x)))
    scaled = rows.select("id", F.coalesce("size", F.lit(1).cast("long")).alias("size"), F.transform("v", lambda x: x / top).alias("v"))
    sums = materialize(scaled.select(F.col("id").alias("c"), "size", F.transform("v", lambda x: x * F.col("size") / F.sqrt(_dot("v", "v"))).alias("s")), "sums")
    parts = reciprocal_merge(edges, threshold - 1e-9, "single")  # (node, cluster)
    counts = parts.groupBy("cluster").agg(F.count("*").alias("n"))
    small = materialize(parts.join(counts, "cluster").select(F.col("node").alias("c"), F.col("cluster").alias("part"), (F.col("n") <= together).alias("small")), "parts")
    done = _merged_in_tasks(sums, edges, small.where("small"), threshold, together)
    alone = sums.join(small.select("c"), "c", "left_anti").select(F.col("c").alias("id"), F.col("c").alias("cluster"))
    large = small.where("not small").select("c")
    nodes = done.unionByName(alone)
    if not large.isEmpty():
        nodes = nodes.unionByName(_merged_by_joins(sums.join(large, "c", "left_semi"), edges.join(large.withColumnRenamed("c", "a"), "a", "left_semi"), threshold, max_rounds))
    nodes = materialize(nodes, "nodes")
    if index.copies is not None:
        nodes = nodes.unionByName(index.copies.join(nodes.withColumnRenamed("id", "first"), "first").select("id", "cluster"))
    names = nodes.groupBy("cluster").agg(F.min("id").alias("cluster_key"))
    return nodes.join(names, "cluster").select("cluster_key", "id")


def _merged_in_tasks(sums: DataFrame, edges: DataFrame, part_of: DataFrame, threshold: float, together: int) -> DataFrame:
    """``(id, cluster)`` of whole parts of the graph, several in a task; ``part_of``: (c, part)."""
    n = part_of.count()
    bucket = F.pmod(F.xxhash64("part"), F.lit(max(1, -(-n // together)))).cast("int").alias("bucket")
    placed = part_of.select("c", bucket)
    rows = sums.join(placed, "c").select("bucket", F.col("c").alias("a"), F.lit(None).cast("long").alias("b"), F.col("size").cast("double").alias("w"), "s")
    lines = edges.join(placed.withColumnRenamed("c", "a"), "a").select("bucket", "a", "b", "w", F.lit(None).cast("array<double>").alias("s"))

    def run(table: pa.Table) -> pa.Table:
        node = table["b"].is_null().to_numpy()
        own = table.filter(pa.array(node))
        ids = own["a"].to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        total = own["s"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        link = table.filter(pa.array(~node))
        a, b = np.searchsorted(ids, link["a"].to_numpy()), np.searchsorted(ids, link["b"].to_numpy())
        cluster = average_merge(total, own["w"].to_numpy()[order], a, b, link["w"].to_numpy(), threshold)
        return pa.table({"id": ids, "cluster": ids[cluster]})

    return rows.unionByName(lines).groupBy("bucket").applyInArrow(run, "id long, cluster long")


def average_merge(total: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster of each node, named by its first one: all reciprocal nearest pairs merge in every round. ``total`` and
    ``size``: vector sums and numbers of rows; ``a`` < ``b`` and ``w``: edges and their similarities."""
    total, size = total.astype(np.float64, copy=True), size.astype(np.float64, copy=True)
    cluster = np.arange(len(size))
    while len(w):
        ends, other = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((np.maximum(ends, other), np.minimum(ends, other), -np.round(np.tile(w, 2), 12), ends))
        first = order[np.concatenate([[True], ends[order][1:] != ends[order][:-1]])]
        best = np.full(len(size), -1)
        best[ends[first]] = other[first]
        away = np.flatnonzero((best >= 0) & (best[np.maximum(best, 0)] == np.arange(len(size))) & (best < np.arange(len(size))))
        to = best[away]
        total[to] += total[away]
        size[to] += size[away]
        moved = np.arange(len(size))
        moved[away] = to
        cluster = moved[cluster]
        grown = np.zeros(len(size), bool)
        grown[to] = True
        a, b = moved[a], moved[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        again = grown[a] | grown[b]
        x, y = a[again & (a != b)], b[again & (a != b)]
        key = np.unique(x * np.int64(len(size)) + y)
        x, y = key // len(size), key % len(size)
        v = np.einsum("ij,ij->i", total[x], total[y]) / (size[x] * size[y])
        keep = v >= threshold
        a, b, w = np.concatenate([a[~again], x[keep]]), np.concatenate([b[~again], y[keep]]), np.concatenate([w[~again], v[keep]])
    return cluster


def _merged_by_joins(sums: DataFrame, edges: DataFrame, threshold: float, max_rounds: int) -> DataFrame:
    """``(id, cluster)`` of graphs too large for a task: the same rounds as joins."""
    spark = sums.sparkSession
    sums, edges = materialize(sums, "sums"), materialize(edges.select("a", "b", "w"), "edges")
    nodes = materialize(sums.select(F.col("c").alias("id"), F.col("c").alias("cluster")), "nodes")
    for _ in range(max_rounds):
        best = materialize(_best(edges, F.round("w", 12)), "best")
        moves = best.join(best.select(F.col("a").alias("b"), F.col("b").alias("a_")), "b").where("a = a_ and b < a").select("a", F.col("b").alias("r"))
        moves = materialize(moves, "moves")
        release(spark, best._quillstone_path)
        if moves.isEmpty():
            return nodes
        both = sums.join(moves, sums["c"] == moves["a"], "left").select(F.coalesce("r", "c").alias("c"), "size", "s")
        # two clusters at most come together
        merged = both.groupBy("c").agg(F.sum("size").alias("size"), F.collect_list("s").alias("ss"))
        merged = merged.select("c", "size", F.when(F.size("ss") == 1, F.col("ss")[0]).otherwise(F.zip_with(F.col("ss")[0], F.get("ss", F.lit(1)), lambda x, y: x + y)).alias("s"))
        old, sums = sums, materialize(merged, "sums")
        release(spark, old._quillstone_path)
        a, b = moves.withColumnRenamed("r", "ra"), moves.select(F.col("a").alias("b"), F.col("r").alias("rb"))
        grown = moves.select(F.col("r").alias("a")).union(moves.select("a")).distinct()
        touched = edges.join(grown.withColumn("ta", F.lit(True)), "a", "left").join(grown.select(F.col("a").alias("b"), F.lit(True).alias("tb")), "b", "left")
        same = touched.where("ta is null and tb is null").select("a", "b", "w")
        moved = touched.where("ta or tb").join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).where("x != y")
        moved = moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        one, two = (sums.select(F.col("c").alias(e), F.col("size").alias(f"n{e}"), F.col("s").alias(f"s{e}")) for e in "ab")
        again = moved.join(one, "a").join(two, "b").select("a", "b", (_dot("sa", "sb") / (F.col("na") * F.col("nb"))).alias("w")).where(F.col("w") >= threshold)
        old, edges = edges, materialize(same.unionByName(again), "edges")
        release(spark, old._quillstone_path)
        old, nodes = nodes, materialize(nodes.join(moves.withColumnRenamed("a", "cluster"), "cluster", "left").select("id", F.coalesce("r", "cluster").alias("cluster")), "nodes")
        release(spark, old._quillstone_path)
    raise RuntimeError(f"not done after {max_rounds} rounds")


def similarity_groups(df: DataFrame, id_col: str, vector_col: str, heading_col: str | None, dim: int, threshold: float = 0.85, least: int = 3, seed: int = 0) -> DataFrame:
    """``(cluster_key, id, usable)``: one row for each member of a group of at least ``least`` usable rows.

    * Usable rows have ``dim`` finite elements, not all zero. They go by their vectors; rows that repeat an id count
      once. A group is what links of at least ``threshold`` join, directly or through others: single linkage (see
      ``average_groups`` for the other). Merging of reciprocal neighbours makes them, first within the blocks of the
      index, then between these.
    * Other rows join a group by heading (see ``place_by_heading``), if ``heading_col`` is given.
    * ``cluster_key`` is the smallest id of the group, members placed by heading included. Rows without an id or a
      group have no row. An empty table gives none; other columns are not read, whatever their names.
    """
    index = build_index(df, id_col, vector_col, dim, keep_copies=1, link=threshold, seed=seed, tables=1)
    members, edges = links(index, threshold, merge=lambda e: reciprocal_merge(e, threshold - 1e-5, "single"))
    members = materialize(members, "members")
    joined = reciprocal_merge(edges, threshold - 1e-5, "single")
    members = members.join(joined.withColumnRenamed("node", "label"), "label", "left").select("id", F.coalesce("cluster", "label").alias("cluster"))
    if index.copies is not None:
        members = materialize(members, "members")
        members = members.unionByName(index.copies.join(members.withColumnRenamed("id", "first"), "first").select("id", "cluster"))
    size = members.groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("key")).where(F.col("n") >= least)
    grouped = materialize(members.join(size, "cluster").select("id", F.col("key").alias("cluster")), "grouped")
    parts = [grouped.withColumn("usable", F.lit(True))]
    if heading_col is not None:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(heading_col).alias("heading"), usable(F.col(vector_col).cast("array<float>"), dim).alias("u")).where(F.col("id").isNotNull() & F.col("heading").isNotNull())
        lost = rows.where(~F.col("u")).select("id", "heading").distinct()
        headings = rows.where("u").select("id", "heading")
        parts.append(materialize(place_by_heading(grouped, headings, lost).groupBy("id").agg(F.min("cluster").alias("cluster")).join(grouped.select("id"), "id", "left_anti"), "placed").withColumn("usable", F.lit(False)))
    every = reduce(DataFrame.unionByName, parts)
    keys = every.groupBy("cluster").agg(F.min("id").alias("cluster_key"))
    return every.join(keys, "cluster").select("cluster_key", "id", "usable")


def describe_groups(groups: DataFrame, df: DataFrame, id_col: str, vector_col: str, heading_col: str, dim: int, most: int = 3) -> DataFrame:
    """Each group's size, its ``most`` typical members and headings: ``(cluster_key, size, usable_rows, typical,
    typical_cosine, headings)``. Typical members are nearest to the mean direction of the group's usable rows (equal
    ones: the smaller id), typical headings its most frequent ones (equal ones: in order)."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(heading_col).alias("h")).where("id is not null")
    rows = rows.groupBy("id").agg(F.first("v").alias("v"), F.first("h").alias("h"))
    full = materialize(groups.join(rows, "id"), "full")
    top = F.aggregate("v", F.lit(1e-300), lambda s, x: F.greatest(s, F.abs(x)))
    unit = full.where("usable").withColumn("v", F.transform("v", lambda x: x / top)).withColumn("v", F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))))
    mean = unit.groupBy("cluster_key").agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(dim)])
    mean = mean.select("cluster_key", F.array(*[f"m{i}" for i in range(dim)]).alias("m"))
    dot = F.aggregate(F.zip_with("v", "m", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    near = unit.join(mean, "cluster_key").select("cluster_key", "id", F.round(dot / F.greatest(norm, F.lit(1e-300)), 9).alias("c"))
    # the few best of each hash part first, so that no task ranks a whole large group
    w = "row_number() over (partition by cluster_key{} order by c desc, id)"
    near = near.withColumn("salt", F.pmod("id", F.lit(32))).withColumn("r", F.expr(w.format(", salt"))).where(F.col("r") <= most).withColumn("r", F.expr(w.format(""))).where(F.col("r") <= most)
    typical = near.groupBy("cluster_key").agg(F.sort_array(F.collect_list(F.struct("r", "id", "c"))).alias("t")).select("cluster_key", F.col("t.id").alias("typical"), F.col("t.c").alias("typical_cosine"))
    named = full.where("h is not null").groupBy("cluster_key", F.upper(F.trim(F.regexp_replace("h", "[^A-Za-z0-9]+", " "))).alias("h")).agg(F.count("*").alias("n"))
    named = named.withColumn("r", F.expr("row_number() over (partition by cluster_key order by n desc, h)")).where(F.col("r") <= most)
    named = named.groupBy("cluster_key").agg(F.sort_array(F.collect_list(F.struct("r", "h"))).alias("t")).select("cluster_key", F.col("t.h").alias("headings"))
    sizes = groups.groupBy("cluster_key").agg(F.count("*").alias("size"), F.count_if("usable").alias("usable_rows"))
    return sizes.join(typical, "cluster_key", "left").join(named, "cluster_key", "left")
