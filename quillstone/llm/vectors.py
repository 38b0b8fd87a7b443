"""An index of vectors by cross-polytope hashing, the search for most similar vectors, and the links above a cosine.

Unit vectors go through fast Hadamard pseudo-rotations (three rounds of random signs and a Walsh-Hadamard
transform) and are hashed to the nearest signed axis. A hash is made of several such axes, of a rotation each: their
number grows with the logarithm of the number of rows, so cells keep their size while the collection grows. There are
several tables of cells, with rotations of their own. The rows of a cell are written, in blocks ordered by their angle
to the cell's mean, to the folder all executors share. A search task holds some blocks of queries and probes cells of
all tables in the order of the queries' coordinates (multiprobe). How many cells a query probes is not fixed: it stops
where a vector as similar as its k-th best so far would have been hashed, in every table, with less than a small
chance, and blocks that the triangle inequality of angles excludes are left out. What it meets is reranked exactly, in
double precision. With ``exact``, only that inequality excludes blocks, and nothing is missed.

Links above a high cosine are found without that search: all rows meet in the buckets of as many tables as it takes to
miss none but by a small chance (see ``links``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.dataset as pads
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.session import arrow_filesystem, materialize, release, shared_path

BLOCK_ROWS = 4096  #: rows of a block
GROUP_ROWS = 16384  #: rows of a cell that one task orders and writes; a larger cell is split by a hash
CELL_ROWS = 65536  #: mean rows of a cell above which hashes get another axis
QUERY_ROWS = 8192  #: queries that a search task holds at once
LABEL_ROWS = 512  #: rows of a block that are merged at once; the work is their square
BUCKET_ROWS = 512  #: rows of a bucket of a join, up to twice as many
PART_ROWS = 65536  #: rows of the buckets that a task of a join holds; twice as many at most
SPREAD_ROWS = 65536  #: rows that a task spreads over buckets at once
ROUND_TABLES = 3  #: tables of a join that are in the shared folder at once


def usable(vector: Column, dim: int) -> Column:
    """Exactly ``dim`` finite elements that are not all zero."""
    inf = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Rotation:
    """Three rounds of random signs and a Walsh-Hadamard transform; lengths are filled up to a power of two."""

    def __init__(self, dim: int, seed: int = 0):
        self.dim, self.width = dim, 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (3, self.width))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = np.zeros((len(x), self.width), np.float32)
        y[:, : self.dim] = x
        for signs in self.signs:
            y *= signs
            h = 1
            while h < self.width:
                z = y.reshape(len(y), -1, 2, h)
                a, b = z[:, :, 0], z[:, :, 1]
                y = np.stack([a + b, a - b], 2).reshape(len(y), self.width)
                h *= 2
            y *= np.float32(self.width**-0.5)
        return y

    def cells(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest signed axis of rotated vectors, as 2 * axis + (1 if negative), and the coordinate's size."""
        axis = np.abs(y).argmax(1)
        value = y[np.arange(len(y)), axis]
        return 2 * axis + (value < 0), np.abs(value)


class Hash:
    """The hash of one table: ``levels`` axes, each of a rotation of its own."""

    def __init__(self, dim: int, levels: int, table: int, seed: int = 0):
        self.turns = [Rotation(dim, seed + 7919 * table + 104_729 * k) for k in range(levels)]
        self.sides = 2 * self.turns[0].width

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector, its axes as the digits of one number, and the coordinates towards them."""
        cell, tops = np.zeros(len(x), np.int64), []
        for turn in self.turns:
            c, top = turn.cells(turn(x))
            cell = cell * self.sides + c
            tops.append(top)
        return cell, np.stack(tops, 1)

    def axes(self, cell: int) -> list[int]:
        return [cell // self.sides ** (len(self.turns) - 1 - k) % self.sides for k in range(len(self.turns))]


def levels_for(rows: int, dim: int) -> int:
    """Axes of a hash: one, and one more whenever cells would hold more than CELL_ROWS on average."""
    sides, levels = 2 * Rotation(dim).width, 1
    while rows > CELL_ROWS * sides**levels:
        levels += 1
    return levels


def shares_of_chance(z: float, tables: int, levels: int) -> float:
    """What a row that is missed with the normal distribution's tail beyond ``z`` may be missed with at each axis: it
    is missed if all tables miss it, and a table misses it if one of its axes does."""
    if math.isinf(z):
        return z
    normal = NormalDist()
    return -normal.inv_cdf(normal.cdf(-z) ** (1 / tables) / levels)


def signed(y: np.ndarray) -> np.ndarray:
    """Coordinates towards all cells, numbered as in ``Rotation.cells``."""
    return np.stack([y, -y], 2).reshape(len(y), -1)


def units(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True, initial=1e-300)  # squares of very large or small elements stay finite
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


@lru_cache(maxsize=8)
def _filesystem(uri: str) -> tuple:
    return arrow_filesystem(uri)


def _block(fs: pa.fs.FileSystem, path: str, batch: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with fs.open_input_file(path) as f:
        batch = pa.ipc.open_file(f).get_batch(batch)
    x = np.frombuffer(batch.column(2).buffers()[1], np.float32).reshape(-1, dim)[: len(batch)]
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), x


class File:
    """What a task knows of a cell's file (or a part of a large cell): the mean direction of its rows, their
    coordinates towards the cell's axes, and the range of angles of each block."""

    __slots__ = ("angles", "axes", "center", "name", "spread", "table", "top")

    def __init__(self, name: str, table: int, axes: list[int], center: np.ndarray, top: list[float], spread: list[float]):
        self.name, self.table, self.axes, self.center, self.top, self.spread = name, table, axes, center, top, spread
        self.angles: list[tuple[float, float, int]] = []


class Blocks:
    """The index as a task sees it: what is known of each file and block, and rows on demand. This directory takes
    about 300 bytes for a file and 100 for a block of thousands of rows."""

    def __init__(self, index: VectorIndex):
        fs, path = _filesystem(index.meta_uri)
        table = pads.dataset(path, filesystem=fs, format="parquet").to_table()
        table = table.take(pa.compute.sort_indices(table, [("file", "ascending"), ("batch", "ascending")]))
        self.hashes = [Hash(index.dim, index.levels, t, index.seed) for t in range(index.tables)]
        self.files: dict[str, File] = {}
        for file, t, cell, center, top, spread, n, lo, hi in zip(*(table[c].to_pylist() for c in ("file", "table", "cell", "center", "top", "spread", "n", "angle_lo", "angle_hi")), strict=True):
            f = self.files.get(file)
            if f is None:
                f = self.files[file] = File(file, t, self.hashes[t].axes(cell), np.frombuffer(center, np.float32), top, spread)
            f.angles.append((lo, hi, n))
        self.data_uri, self.dim, self.width = index.data_uri, index.dim, self.hashes[0].turns[0].width

    def load(self, file: str, batch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, labels and raw vectors of a block."""
        fs, path = _filesystem(self.data_uri)
        return _block(fs, f"{path}/{file}", batch, self.dim)

    def coordinates(self, x: np.ndarray) -> list[list[np.ndarray]]:
        """Coordinates of vectors towards all cells, for each axis of each table."""
        return [[signed(turn(x)) for turn in h.turns] for h in self.hashes]

    def ordered(self, u: list[list[np.ndarray]]) -> list[File]:
        """The files, those first towards which the queries' coordinates are large."""
        high = [[np.quantile(level, 0.9, axis=0) if len(level) > 1 else level[0] for level in table] for table in u]
        return sorted(self.files.values(), key=lambda f: -sum(h[a] for h, a in zip(high[f.table], f.axes, strict=True)))

    def near(self, f: File, u: list[list[np.ndarray]], x32: np.ndarray, cosine: np.ndarray, away: np.ndarray, z: float) -> Iterator[tuple[int, np.ndarray]]:
        """The blocks of a file that may hold a row with this cosine with a query, and those queries."""
        rows = None
        if not math.isinf(z):
            for level, axis, top, spread in zip(u[f.table], f.axes, f.top, f.spread, strict=True):
                own = level[:, axis] if rows is None else level[rows, axis]
                ok = own >= _least_coordinate(cosine if rows is None else cosine[rows], top, spread, self.width, z)
                rows = np.flatnonzero(ok) if rows is None else rows[ok]
                if not len(rows):
                    return
        if rows is None:
            rows = np.arange(len(x32))
        angle = np.arccos(np.clip(x32[rows] @ f.center, -1, 1)) if len(rows) else np.zeros(0)
        for b, (lo, hi, _) in enumerate(f.angles):
            ok = (angle - hi <= away[rows]) & (lo - angle <= away[rows])
            if ok.any():
                yield b, rows[ok]


@dataclass
class VectorIndex:
    """``meta``: one row for each block. ``copies``: ids left out because enough smaller ids have the same vector,
    with the smallest one. ``rows``: rows in the index, each of which is in every table."""

    meta: DataFrame
    meta_uri: str
    data_uri: str
    copies: DataFrame | None
    rows: int
    dim: int
    seed: int
    tables: int
    levels: int

    def plain(self) -> VectorIndex:
        """The same without tables, for tasks."""
        return VectorIndex(None, self.meta_uri, self.data_uri, None, self.rows, self.dim, self.seed, self.tables, self.levels)

    def query_tasks(self) -> DataFrame:
        """The blocks of the first table, which hold each row once."""
        parallel = self.meta.sparkSession.sparkContext.defaultParallelism
        n = max(3 * parallel, -(-self.rows // QUERY_ROWS))
        return self.meta.where("table = 0").select("file", "batch", "n").repartition(n, "file", "batch")


def _packed(vectors: pa.Array, dim: int) -> np.ndarray:
    flat = vectors.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def build_index(df: DataFrame, id_col: str, vector_col: str, dim: int, keep_copies: int = 1, link: float | None = None, seed: int = 0, tables: int = 2, levels: int | None = None) -> VectorIndex:
    """Indexes every usable row of ``df`` in each of ``tables`` tables; ids are integers, rows that repeat an id count
    once. Hashes have ``levels`` axes, as many as the number of rows asks for if not given.

    Of rows with the very same vector the ``keep_copies`` smallest ids are indexed, so a vector that a third of all
    rows share costs no more than another; the rest are in ``copies``. With ``link``, each LABEL_ROWS rows of a block are labelled
    by the smallest id of those that merging reciprocal neighbours among them joins by links of at least that cosine.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"), dim))

    key = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    same = rows.select("id", *key)
    shared = same.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    # the k smallest ids of each such vector, in two steps so that no task ranks all of a large group
    again = same.join(shared.select("h1", "h2", "first"), ["h1", "h2"]).distinct().withColumn("salt", F.pmod("id", F.lit(64)))
    spec = "row_number() over (partition by h1, h2{} order by id)"
    kept = again.withColumn("r", F.expr(spec.format(", salt"))).where(F.col("r") <= keep_copies).withColumn("r", F.expr(spec.format(""))).where(F.col("r") <= keep_copies)
    copies = materialize(again.join(kept.select("id"), "id", "left_anti").select("id", "first"), "copies")
    if copies.isEmpty():
        copies = None
    else:
        rows = rows.join(copies.select("id"), "id", "left_anti")

    indexed = rows.count()
    levels = levels or levels_for(indexed, dim)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [Hash(dim, levels, t, seed) for t in range(tables)]
        for batch in batches:
            if len(batch):
                raw = _packed(batch.column("v"), dim)
                x = units(raw)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())
                for t, h in enumerate(hashes):
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.full(len(raw), t, np.int32)), pa.array(h.cells(x)[0]), packed], names=["id", "table", "cell", "x"])

    coded = rows.mapInArrow(hashed, "id long, table int, cell long, x binary")
    large = coded.groupBy("table", "cell").count().where(F.col("count") > GROUP_ROWS).select("table", "cell", F.ceil(F.col("count") / GROUP_ROWS).alias("parts"))
    salted = coded.join(large, ["table", "cell"], "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))).drop("parts")
    data_uri = shared_path(spark, "vectors")
    schema = "file string, batch int, table int, cell long, n int, center binary, angle_lo double, angle_hi double, top array<double>, spread array<double>"

    def write(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        order = np.unique(ids, return_index=True)[1]  # by id, each once: the same file if the task runs again
        ids = ids[order]
        raw = np.frombuffer(b"".join(table["x"].take(pa.array(order)).to_pylist()), np.float32).reshape(-1, dim)
        which, cell, salt = table["table"][0].as_py(), table["cell"][0].as_py(), table["salt"][0].as_py()
        x = units(raw)
        mean = x.mean(0)
        mean = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-9 else x[0]
        angle = np.arccos(np.clip(x @ mean, -1, 1))
        by = np.argsort(angle, kind="stable")
        ids, raw, x, angle = ids[by], raw[by], x[by], angle[by]
        tops = Hash(dim, levels, which, seed).cells(x)[1]
        top, spread = tops.mean(0).tolist(), tops.std(0).tolist()
        # a cell's close rows (members of a cluster) and far ones go to different blocks, with tight ranges of angles
        step = np.floor(np.degrees(angle) / 12)
        cuts = np.flatnonzero(np.diff(step)) + 1
        edges = [0]
        for c in [*cuts.tolist(), len(ids)]:
            small = c - edges[-1] < 256 and c < len(ids)
            while c - edges[-1] > BLOCK_ROWS:
                edges.append(edges[-1] + BLOCK_ROWS)
            if not small and c > edges[-1]:
                edges.append(c)
        fs, path = _filesystem(data_uri)
        fs.create_dir(path, recursive=True)
        name = f"{which}-{cell}-{salt}.arrow"
        kind = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("x", pa.binary(4 * dim))])
        meta = {k: [] for k in ("file", "batch", "table", "cell", "n", "center", "angle_lo", "angle_hi", "top", "spread")}
        tries = f"{path}/.{name}.{np.random.default_rng().integers(1 << 62)}"
        with fs.open_output_stream(tries) as out, pa.ipc.new_file(out, kind) as writer:
            for b, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
                label = ids[s:e] if link is None else np.concatenate([_labels(ids[k : min(k + LABEL_ROWS, e)], x[k : min(k + LABEL_ROWS, e)], link) for k in range(s, e, LABEL_ROWS)])
                vectors = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), e - s, [None, pa.py_buffer(np.ascontiguousarray(raw[s:e]))])
                writer.write_batch(pa.RecordBatch.from_arrays([pa.array(ids[s:e]), pa.array(label), vectors], schema=kind))
                values = (name, b, which, cell, e - s, mean.astype(np.float32).tobytes(), float(angle[s:e].min()), float(angle[s:e].max()), top, spread)
                for k, v in zip(meta, values, strict=True):
                    meta[k].append(v)
        fs.move(tries, f"{path}/{name}")
        return pa.table(meta).cast(pa.schema([("file", pa.string()), ("batch", pa.int32()), ("table", pa.int32()), ("cell", pa.int64()), ("n", pa.int32()), ("center", pa.binary()), ("angle_lo", pa.float64()), ("angle_hi", pa.float64()), ("top", pa.list_(pa.float64())), ("spread", pa.list_(pa.float64()))]))

    meta = materialize(salted.groupBy("table", "cell", "salt").applyInArrow(write, schema), "blocks")
    return VectorIndex(meta, meta._quillstone_path, data_uri, copies, indexed, dim, seed, tables, levels)


def _exact(s: np.ndarray, x: np.ndarray, y: np.ndarray, link: float) -> np.ndarray:
    """Which float32 cosines reach ``link``; those too near to tell are computed again in double precision."""
    over = s >= link
    near = np.flatnonzero(np.abs(s.ravel() - np.float32(link)) < 4e-6)
    if len(near):
        r, c = np.divmod(near, s.shape[1])
        over.ravel()[near] = np.einsum("ij,ij->i", x[r], y[c]) >= link
    return over


def _labels(ids: np.ndarray, x: np.ndarray, link: float) -> np.ndarray:
    """Smallest id of each row's cluster, after merging reciprocal nearest neighbours by single linkage within the
    block: every round each cluster looks for its most similar one, and whole trees of such choices, each of which
    holds one reciprocal pair, merge; links are then those of the strongest members."""
    x32 = x.astype(np.float32)
    s = x32 @ x32.T
    s[~_exact(s, x, x, link)] = -2
    np.fill_diagonal(s, -2)
    cluster = np.arange(len(ids))
    while len(s) > 1:
        best = s.argmax(1)  # equal ones: the first, so choices form no cycle but reciprocal pairs
        some = s[np.arange(len(s)), best] > -2
        if not some.any():
            break
        root = np.where(some, best, np.arange(len(s)))
        pair = root[root] == np.arange(len(s))
        root = np.where(pair & (np.arange(len(s)) < root), np.arange(len(s)), root)
        while (root[root] != root).any():
            root = root[root]
        order = np.argsort(root, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(root[order]) > 0]))
        number = np.empty(len(s), np.int64)
        number[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(s))))
        s = np.maximum.reduceat(np.maximum.reduceat(s[order], heads, 0)[:, order], heads, 1)
        np.fill_diagonal(s, -2)
        cluster = number[cluster]
    first = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(first, cluster, ids)
    return first[cluster]


def _least_coordinate(cosine: np.ndarray, top: float, spread: float, width: int, z: float) -> np.ndarray:
    """How small a query's coordinate towards a cell may be if a vector of the cell has this cosine with it, but for
    a chance of the normal distribution's tail beyond ``z``. The vector's own coordinate is ``top``; what stands at
    right angles to it adds a coordinate of mean 0."""
    across = np.maximum(0, 1 - cosine * cosine) * max(0.0, 1 - top * top) / (width - 1)
    return cosine * top - z * np.sqrt(across + (cosine * spread) ** 2)


def _task_blocks(batch: pa.RecordBatch) -> Iterator[list[tuple[str, int]]]:
    """The task's blocks of queries, in groups of about QUERY_ROWS rows."""
    group, size = [], 0
    for file, number, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if group and size + n > QUERY_ROWS:
            yield group
            group, size = [], 0
        group.append((file, number))
        size += n
    if group:
        yield group


def nearest(index: VectorIndex, k: int, z: float = 2.0) -> DataFrame:
    """``(id, ids, cosines)`` of each indexed row: the k + 1 most similar ones among all rows including itself, by
    falling cosine, equal ones by rising id. ``z`` sets the share that may be missed: 2 leaves about 2 %, and less of
    the nearer ones; infinity none."""
    plain, keep = index.plain(), k + 1
    chance = shares_of_chance(z, index.tables, index.levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = None
        for batch in batches:
            blocks = blocks or Blocks(plain)
            for group in _task_blocks(batch):
                yield _nearest_of(group, blocks, keep, chance)

    return index.query_tasks().mapInArrow(run, "id long, ids array<long>, cosines array<double>")


class Best:
    """The ``keep`` most similar rows of each query so far."""

    def __init__(self, n: int, keep: int):
        self.keep = keep
        self.cosine = np.full((n, keep), -np.inf)
        self.id = np.full((n, keep), np.iinfo(np.int64).max)

    def add(self, r: np.ndarray, q: np.ndarray, ids: np.ndarray, cosine: np.ndarray) -> None:
        """Candidates of queries ``r[q]``; one that is there already, from another table, is left out."""
        keep = self.keep
        by = np.lexsort((ids, -cosine, q))
        q, ids, cosine = q[by], ids[by], cosine[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        fits = rank < keep
        q, ids, cosine, rank = q[fits], ids[fits], cosine[fits], rank[fits]
        new = ~(self.id[r[q]] == ids[:, None]).any(1)
        q, ids, cosine, rank = q[new], ids[new], cosine[new], rank[new]
        if not len(q):
            return
        who, row = np.unique(q, return_inverse=True)
        more = np.full((len(who), keep), -np.inf)
        more_of = np.full((len(who), keep), np.iinfo(np.int64).max)
        more[row, rank], more_of[row, rank] = cosine, ids
        both = np.concatenate([self.cosine[r[who]], more], 1)
        both_of = np.concatenate([self.id[r[who]], more_of], 1)
        order = np.lexsort((both_of, -both), axis=1)[:, :keep]
        self.cosine[r[who]] = np.take_along_axis(both, order, 1)
        self.id[r[who]] = np.take_along_axis(both_of, order, 1)


def _nearest_of(group: list[tuple[str, int]], blocks: Blocks, keep: int, z: float) -> pa.RecordBatch:
    loaded = [blocks.load(*g) for g in group]
    ids = np.concatenate([x[0] for x in loaded])
    x = units(np.concatenate([x[2] for x in loaded]))
    x32 = x.astype(np.float32)
    home = np.repeat(np.arange(len(group)), [len(y[0]) for y in loaded])
    u = blocks.coordinates(x)
    best = Best(len(ids), keep)

    def probe(rows: np.ndarray, y_ids: np.ndarray, raw: np.ndarray) -> None:
        y = units(raw)
        y32 = y.astype(np.float32)
        for a in range(0, len(rows), 1024):
            r = rows[a : a + 1024]
            s = x32[r] @ y32.T
            last = best.cosine[r, -1]
            limit = np.where(np.isfinite(last), last - 1e-6, -2).astype(np.float32)
            over = s > limit[:, None]
            n = over.sum(1)
            full = n > 4 * keep
            if full.any():  # many at once: only those that can be among the first
                part = s[full]
                least = np.partition(part, -min(keep, part.shape[1]), 1)[:, -min(keep, part.shape[1])]
                over[full] &= part >= (least - np.float32(1e-6))[:, None]
            q, c = np.nonzero(over)
            if len(q):
                best.add(r, q, y_ids[c], np.einsum("ij,ij->i", x[r[q]], y[c]))

    for j, (y_ids, _, raw) in enumerate(loaded):
        probe(np.flatnonzero(home == j), y_ids, raw)
    own = {g: j for j, g in enumerate(group)}
    for f in blocks.ordered(u):
        cosine = np.clip(best.cosine[:, -1], -1, 1)
        for b, rows in blocks.near(f, u, x32, cosine, np.arccos(cosine) + 1e-6, z):
            j = own.get((f.name, b))
            if j is not None:
                rows = rows[home[rows] != j]
            if len(rows):
                y_ids, _, raw = blocks.load(f.name, b)
                probe(rows, y_ids, raw)
    found = np.isfinite(best.cosine)
    offsets = pa.array(np.concatenate([[0], np.cumsum(found.sum(1))]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(best.id[found])), pa.ListArray.from_arrays(offsets, pa.array(best.cosine[found]))], names=["id", "ids", "cosines"])


def most_similar(df: DataFrame, id_col: str, vector_col: str, dim: int, k: int = 5, z: float = 2.0, seed: int = 0, tables: int = 2, exact: bool = False, levels: int | None = None) -> DataFrame:
    """The k most similar rows of every row: ``(id, rank, neighbour, cosine)``, rank from 1.

    * A vector takes part if it has ``dim`` finite elements that are not all zero; the id must be an integer and not
      null. Rows that repeat an id count once. Other columns are not read, whatever their names.
    * Cosines are in double precision; equal ones go to the smaller id. Rows with the same vector are neighbours of
      each other. With fewer than k other rows all of them come out; an empty table has no rows.
    * ``z`` and ``tables`` set how much may be missed for less work (see ``nearest``). ``exact`` misses nothing: every
      block is probed that the angles between means don't exclude.
    """
    index = build_index(df, id_col, vector_col, dim, keep_copies=k + 1, seed=seed, tables=1 if exact else tables, levels=levels)
    found = nearest(index, k, math.inf if exact else z)
    if index.copies is not None:  # rows with a vector that k + 1 smaller ids have too: the same list
        found = materialize(found, "nearest")
        others = index.copies.join(found.withColumnRenamed("id", "first"), "first").select("id", "ids", "cosines")
        found = found.unionByName(others)
    pairs = F.filter(F.arrays_zip("ids", "cosines"), lambda p: p["ids"] != F.col("id"))
    out = found.select("id", F.posexplode(F.slice(pairs, 1, k)).alias("pos", "p"))
    return out.select("id", (F.col("pos") + 1).alias("rank"), F.col("p.ids").alias("neighbour"), F.col("p.cosines").alias("cosine"))


class Buckets:
    """One table of a join: vectors meet in the bucket of their nearest signed axes, of a random rotation each; of the
    last one only ``last`` axes count. Whether two vectors meet depends on nothing but their cosine."""

    def __init__(self, dim: int, levels: int, last: int, table: int, seed: int = 0):
        self.turns = []
        for level in range(levels):
            turn = np.linalg.qr(np.random.default_rng([seed, table, level, dim]).normal(size=(dim, dim)))[0]
            self.turns.append(np.ascontiguousarray(turn[:, : last if level == levels - 1 else dim], np.float32))

    def __call__(self, x32: np.ndarray) -> np.ndarray:
        bucket = np.zeros(len(x32), np.int64)
        for turn in self.turns:
            y = x32 @ turn
            size = np.abs(y)
            axis = size.argmax(1)
            bucket = bucket * (2 * turn.shape[1]) + 2 * axis + (y[np.arange(len(y)), axis] < 0)
        return bucket


def join_shape(rows: int, dim: int) -> tuple[int, int]:
    """Axes of a bucket of a join, and how many count in the last rotation: about BUCKET_ROWS rows meet in a bucket,
    however many there are."""
    levels = 1
    while rows > 2 * BUCKET_ROWS * (2 * dim) ** levels:
        levels += 1
    return levels, min(dim, max(1, -(-rows // (2 * BUCKET_ROWS * (2 * dim) ** (levels - 1)))))


@lru_cache(maxsize=64)
def tables_for(link: float, dim: int, levels: int, last: int, miss: float) -> int:
    """Tables in which two vectors with a cosine of ``link`` meet at least once, but for a chance of ``miss``. What
    they meet with in one is drawn, and three standard errors are taken off."""
    rng = np.random.default_rng(0)
    together = 1.0
    for axes, power in ((dim, levels - 1), (last, 1)):
        if not power:
            continue
        hits = tried = 0
        while tried < 40_000:
            n = min(4000, max(1, 400_000 // dim))
            x = units(rng.normal(size=(n, dim)))
            y = rng.normal(size=(n, dim))
            y -= np.einsum("ij,ij->i", x, y)[:, None] * x
            y = link * x + math.sqrt(max(0.0, 1 - link * link)) * y / np.maximum(1e-12, np.sqrt(np.einsum("ij,ij->i", y, y)))[:, None]
            x, y = x[:, :axes], y[:, :axes]
            r, i, j = np.arange(n), np.abs(x).argmax(1), np.abs(y).argmax(1)
            hits += int(((i == j) & ((x[r, i] < 0) == (y[r, j] < 0))).sum())
            tried += n
        p = hits / tried
        together *= max(1e-3, p - 3 * math.sqrt(p * (1 - p) / tried)) ** power
    return math.ceil(math.log(miss) / math.log1p(-min(together, 1 - 1e-9)))


def _joined(names: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """``root``, the smallest member of each one's part, after joining the parts of ``a`` and ``b``."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        x, y = x[apart], y[apart]
        parent = np.arange(names)
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        root = parent[root]


def _across(label: np.ndarray, raw: np.ndarray, link: float) -> tuple[np.ndarray, np.ndarray]:
    """The labels that links between these rows join, directly or through others: each one but the smallest of its
    part, after that one. Rows whose labels are joined already are not compared."""
    names, of = np.unique(label, return_inverse=True)
    root = np.arange(len(names))
    if len(names) > 1:
        if len(of) > 4096:  # large labels first: what they join needs no comparing any more
            order = np.lexsort((of, -np.bincount(of)[of]))
            of, raw = of[order], raw[order]
        x32 = _units32(raw)
        low, high = np.float32(link - 4e-6), np.float32(link + 4e-6)
        step = 1024 if len(of) > 4096 else 256
        for s in range(0, len(of), step):
            rows = np.arange(s, min(s + step, len(of)))
            part = root[of[rows]]
            counts = np.bincount(part)
            main = counts.argmax() if counts.max() >= 64 else -1
            for r, one in ((rows[part != main], False), (rows[part == main], True)):
                if not len(r):
                    continue
                later = np.arange(s, len(of))
                for c in range(0, len(later), 8192):
                    cols = later[c : c + 8192]
                    if one:
                        cols = cols[root[of[cols]] != root[of[r[0]]]]
                    if not len(cols):
                        continue
                    cosine = x32[r] @ x32[cols].T
                    if not one and not c:
                        cosine[np.arange(len(r)), r - s] = -1  # with itself
                    some = np.flatnonzero(cosine.max(1) >= low)
                    if not len(some):
                        continue
                    cosine = cosine[some]
                    flat = np.flatnonzero(cosine >= low)
                    p, q = np.divmod(flat, len(cols))
                    p = some[p]
                    apart = root[of[r[p]]] != root[of[cols[q]]]
                    p, q, near = p[apart], q[apart], cosine.ravel()[flat[apart]] < high
                    if near.any():  # too near to tell in single precision
                        ok = ~near
                        for k in range(0, len(at := np.flatnonzero(near)), 65_536):
                            part_of = at[k : k + 65_536]
                            ok[part_of] = np.einsum("ij,ij->i", units(raw[r[p[part_of]]]), units(raw[cols[q[part_of]]])) >= link
                        p, q = p[ok], q[ok]
                    root = _joined(len(names), of[r[p]], of[cols[q]], root)
    away = np.flatnonzero(root != np.arange(len(names)))
    return names[root[away]], names[away]


def _units32(raw: np.ndarray) -> np.ndarray:
    """``units`` in single precision, to a few units of its last place."""
    square = np.einsum("ij,ij->i", raw, raw)
    if not ((square > 1e-25) & (square < 1e25)).all():  # squares leave the range of single precision
        return units(raw).astype(np.float32)
    return raw * (1 / np.sqrt(square))[:, None]


def links(index: VectorIndex, link: float, miss: float = 1e-6, merge: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """A sparse graph with the same connected parts as all pairs with a cosine of at least ``link``.

    Returns the rows with their labels, ``(id, label)``, and links between labels, ``(a, b, w)`` with a < b: pairs that
    links join, directly or through others within a bucket, ``w`` being ``link``. Labels are those of the index's
    blocks; with ``merge``, which makes ``(node, cluster)`` of links, what the first tables join has one label, and
    only what is left comes out as links.

    All rows meet in the buckets of several tables. A link of just that cosine is missed with a chance of ``miss``, a
    stronger one with less. As buckets keep their size, work grows with the rows and slowly more tables, not with the
    pairs of rows. ROUND_TABLES tables are done at a time, so the shared folder holds the vectors as many
    times. The index must have been built with the same ``link``, and with one table.
    """
    spark, dim, seed, data_uri = index.meta.sparkSession, index.dim, index.seed, index.data_uri
    levels, last = join_shape(index.rows, dim)
    tables = tables_for(link, dim, levels, last, miss)
    parts = max(1, -(-index.rows // PART_ROWS))
    kind = np.dtype([("bucket", np.int64), ("label", np.int64), ("x", np.float32, (dim,))])
    n = max(3 * spark.sparkContext.defaultParallelism, -(-index.rows // SPREAD_ROWS))
    blocks = index.meta.where("table = 0").select("file", "batch", F.array().cast("array<long>").alias("old"), F.array().cast("array<long>").alias("new"))

    def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        fs, path = _filesystem(data_uri)
        for batch in batches:
            for file, number, old, new in zip(*batch.columns, strict=True):
                ids, label, raw = _block(fs, f"{path}/{file.as_py()}", number.as_py(), dim)
                if len(old.values or ()):
                    old, new = old.values.to_numpy(), new.values.to_numpy()
                    order = np.argsort(old)
                    at = np.minimum(np.searchsorted(old[order], label), len(old) - 1)
                    label = np.where(old[order][at] == label, new[order][at], label)
                yield ids, label, raw

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, label, _ in loaded(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label)], names=["id", "label"])

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                for _, label, _ in loaded(iter([batch.slice(k, 1)])):
                    own = np.unique(label)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(own)), pa.array(np.full(len(own), batch.column(1)[k].as_py(), np.int32)), pa.array(own)], names=["file", "batch", "label"])

    def met(first: int, end: int) -> DataFrame:
        """Links that the buckets of these tables show."""
        uri = shared_path(spark, "buckets")

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = [Buckets(dim, levels, last, t, seed) for t in range(first, end)]
            fs, path = _filesystem(uri)
            fs.create_dir(path, recursive=True)
            held, size = [], 0

            def written() -> pa.RecordBatch:
                label, raw = np.concatenate([y[1] for y in held]), np.concatenate([y[2] for y in held])
                x32 = _units32(raw)
                name, at, rows = f"{np.random.default_rng().integers(1 << 62)}.rows", 0, []
                with fs.open_output_stream(f"{path}/{name}") as out:
                    for t, h in zip(range(first, end), hashes, strict=True):
                        bucket = np.concatenate([h(x32[s : s + 8192]) for s in range(0, len(x32), 8192)])
                        part = ((bucket * 2_654_435_761) >> 16) % parts
                        order = np.argsort(part, kind="stable")
                        record = np.empty(len(order), kind)
                        record["bucket"], record["label"], record["x"] = bucket[order], label[order], raw[order]
                        out.write(pa.py_buffer(record))
                        for p, many in enumerate(np.bincount(part, minlength=parts).tolist()):
                            if many:
                                rows.append((t, p, name, at, many))
                            at += many
                return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["table", "part", "name", "at", "n"])

            for block in loaded(batches):
                held.append(block)
                size += len(block[0])
                if size >= SPREAD_ROWS:
                    yield written()
                    held, size = [], 0
            if held:
                yield written()

        def meet(table: pa.Table) -> pa.Table:
            fs, path = _filesystem(uri)
            table = table.take(pa.compute.sort_indices(table, [("name", "ascending"), ("at", "ascending")]))
            counts = table["n"].to_pylist()
            record, at = np.empty(sum(counts), kind), 0
            for name, start, many in zip(table["name"].to_pylist(), table["at"].to_pylist(), counts, strict=True):
                with fs.open_input_file(f"{path}/{name}") as f:
                    record[at : at + many] = np.frombuffer(f.read_at(many * kind.itemsize, start * kind.itemsize), kind)
                at += many
            bucket = record["bucket"].copy()
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) > 0, [True]]))
            found = [(np.zeros(0, np.int64),) * 2]
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if e - s > 1:
                    own = record["label"][order[s:e]]
                    if (own != own[0]).any():
                        found.append(_across(own, record["x"][order[s:e]], link))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.table({"a": a, "b": b})

        places = materialize(blocks.repartition(n, "file", "batch").mapInArrow(spread, "table int, part int, name string, at long, n long"), "places")
        # a part with more rows than a task should hold is cut into sets, and each two sets meet
        total = places.groupBy("table", "part").agg(F.ceil(F.sum("n") / (2 * PART_ROWS)).alias("sets"))
        placed = places.join(total, ["table", "part"]).withColumn("own", F.pmod(F.xxhash64("name"), F.col("sets")))
        other = F.when(F.col("sets") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("sets") - 1), lambda o: o != F.col("own")))
        placed = placed.withColumn("other", F.explode(other)).withColumn("pair", F.struct(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")))
        placed = placed.select("table", "part", F.col("pair.x").alias("x"), F.col("pair.y").alias("y"), "name", "at", "n")
        placed = placed.repartition(max(n, (end - first) * parts), "table", "part", "x", "y")
        edges = materialize(placed.groupBy("table", "part", "x", "y").applyInArrow(meet, "a long, b long").distinct(), "met")
        release(spark, uri)
        release(spark, places._quillstone_path)
        return edges

    begin = 0
    if merge is not None:
        begin = min(ROUND_TABLES, tables)
        joined = merge(met(0, begin).withColumn("w", F.lit(link)))
        of_block = blocks.mapInArrow(labels, "file string, batch int, label long")
        moved = of_block.join(joined.where("node != cluster"), F.col("label") == F.col("node")).groupBy("file", "batch").agg(F.collect_list(F.struct("node", "cluster")).alias("to"))
        empty = F.array().cast("array<long>")
        blocks = materialize(blocks.select("file", "batch").join(moved, ["file", "batch"], "left").select("file", "batch", F.coalesce("to.node", empty).alias("old"), F.coalesce("to.cluster", empty).alias("new")), "relabelled")
    every = [met(t, min(t + ROUND_TABLES, tables)) for t in range(begin, tables, ROUND_TABLES)]
    edges = reduce(DataFrame.unionByName, every) if every else spark.createDataFrame([], "a long, b long")
    return blocks.repartition(n, "file", "batch").mapInArrow(members, "id long, label long"), edges.distinct().withColumn("w", F.lit(link))
