"""The cosine join of two corpora, and the graph of pairs above a threshold.

All pairs are computed block by block with BLAS inside ``mapInArrow``; what a caller needs of them (the pairs above a
threshold, each source's best target) is taken within the block, so the M x N pairs are never materialised unless
they are asked for. A target side of a checked size goes to every task; beyond that, packed blocks of both sides are
written to the shared folder and their places are paired.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COSINE_EPS = 1e-8  #: added to the product of the norms
BROADCAST_BYTES = 64 << 20  #: a target side up to this size is sent to every task
PACK_ROWS = 2048  #: rows of a packed block
PACK_BLOCKS = 64  #: blocks in a file of them
SCREEN_ROWS = 256  #: sources whose products with a block are in a core's cache together
SCREEN_PAIRS = 65536  #: pairs that are computed in double precision at once
MOST_TASKS = 4096  #: tasks that pairs of blocks are dealt to
PACK_RUN = 4  #: blocks of the left that meet a file of the right in one go


def _placed(df: DataFrame, order: list[str]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The rows range-sorted and written down, with their partition ``p_`` and place in it ``i_``; and the partitions
    with their sizes, of which there are few. Rows are only carried along, never joined back: nulls and repeated keys
    keep theirs."""
    from quillstone.session import materialize

    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = materialize(df.sort(*order).select("*", F.spark_partition_id().alias("p_"), at.alias("i_")), "index")
    return rows, sorted((r.p_, r["count"]) for r in rows.groupBy("p_").count().collect())


def _with_base(rows: DataFrame, bases: list[tuple[int, int]]) -> DataFrame:
    table = rows.sparkSession.createDataFrame(bases, "p_ int, base_ long")
    return rows.join(F.broadcast(table), "p_")  # a row for each partition


def sequential_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with 0, 1, 2, ... (int) in the order of the columns, nulls first; every row gets one number, and rows
    that are equal in all of them are numbered in any order. Distributed: a range sort and the sizes of its
    partitions take the place of one large window. OverflowError beyond 2^31 - 1 rows."""
    rows, sizes = _placed(df, order)
    if sum(n for _, n in sizes) >= 1 << 31:
        raise OverflowError("more rows than an int can number")
    bases, at = [], 0
    for p, n in sizes:
        bases.append((p, at))
        at += n
    return _with_base(rows, bases).select(*df.columns, (F.col("base_") + F.col("i_")).cast("int").alias(name))


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each one in the order of a unique column: a range sort,
    running sums within its partitions, and the sums of the partitions before."""
    rows, _ = _placed(df, [order])
    bases, at = [], 0
    for p, n in sorted((r.p_, r.n) for r in rows.groupBy("p_").agg(F.sum(value).alias("n")).collect()):
        bases.append((p, at))
        at += n or 0
    inside = F.sum(value).over(Window.partitionBy("p_").orderBy("i_").rowsBetween(Window.unboundedPreceding, -1))
    return _with_base(rows.withColumn("inside_", F.coalesce(inside, F.lit(0))), bases).select(*df.columns, (F.col("base_") + F.col("inside_")).alias(name))


def vector_problem(v: Column, dim: int | None = None) -> Column:
    """Why a vector can't be compared: ``null``, ``length`` (it isn't ``dim``), ``element`` (one is null, NaN or
    infinite); null for a good one. A zero vector is good, its cosines are 0."""
    inf = F.lit(float("inf"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    wrong = F.size(v) != dim if dim is not None else F.size(v) == 0
    return F.when(v.isNull(), "null").when(wrong, "length").when(~finite, "element")


def set_apart(df: DataFrame, dim: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The rows that can be compared, and the others with their ``problem``: no row is lost."""
    told = df.withColumn("problem", vector_problem(F.col(vector).cast("array<double>"), dim))
    return told.where("problem is null").drop("problem"), told.where("problem is not null")


def check_dimensions(regs: DataFrame, procs: DataFrame, vector: str = "embedding") -> int:
    """The one length of all vectors on both sides. ValueError if there are several, or a vector that can't be
    compared: take those out with ``set_apart``."""
    return _sizes(regs.select(F.col(vector).alias("v")), procs.select(F.col(vector).alias("v")))[0]


def _sizes(left: DataFrame, right: DataFrame) -> tuple[int, int]:
    """Length of the vectors and rows on the right, checked in one pass over both sides."""
    both = left.select("v", F.lit(0).alias("side")).unionByName(right.select("v", F.lit(1).alias("side")))
    v = F.col("v").cast("array<double>")
    r = both.agg(F.min(F.size(v)).alias("lo"), F.max(F.size(v)).alias("hi"), F.count_if(vector_problem(v).isNotNull()).alias("bad"), F.coalesce(F.sum("side"), F.lit(0)).alias("n")).first()
    if r.bad:
        raise ValueError(f"{r.bad} vectors are null, empty or have elements that are no numbers")
    if r.lo != r.hi:
        raise ValueError(f"vectors of different lengths: {r.lo} to {r.hi}")
    return r.lo or 0, r.n


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norms = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
    return (a @ b.T) / (norms + COSINE_EPS)


Emit = Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]
Block = tuple[np.ndarray, np.ndarray]  #: indices and vectors


class _Best:
    """Finds each source's best of all targets in blocks. Unit vectors in single precision tell how high a block goes,
    within a bound of the error; the places that may be highest are then computed in double precision, so the result
    is that of double precision throughout. Where there is no such bound
    (very long or very short vectors), all are computed in double precision."""

    def __init__(self, blocks: list[Block]):
        self.blocks = []
        for ids, y in blocks:
            order = np.argsort(ids, kind="stable")
            self.blocks.append((ids[order], y[order], *self._unit(y[order])))
        some = [n[n > 0].min() for _, _, n, _ in self.blocks if (n > 0).any()]
        self.least, self.finite = min(some, default=1.0), all(np.isfinite(n).all() for _, _, n, _ in self.blocks)

    @staticmethod
    def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norms = np.sqrt((x * x).sum(1))
        return norms, (x / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)

    def _error(self, norms: np.ndarray, dim: int) -> float:
        """By how much a product of unit vectors may miss the cosine: rounding of their elements and sums, and what is
        added to the product of the norms."""
        least = norms[norms > 0].min(initial=np.inf) * self.least
        return 1.01 * (dim + 4) * 2.0**-24 + COSINE_EPS / least if self.finite and np.isfinite(norms).all() and least > 0 else np.inf

    def __call__(self, own: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and cosine of each source's best; equal ones go to the lowest index."""
        norms, unit = self._unit(x)
        error = self._error(norms, x.shape[1])
        top = np.full((len(own), len(self.blocks)), np.inf, np.float32)  # without a bound, every place may be highest
        if error < 1e-3:
            for k, (_, _, _, y) in enumerate(self.blocks):
                for a in range(0, len(own), SCREEN_ROWS):
                    top[a : a + SCREEN_ROWS, k] = (unit[a : a + SCREEN_ROWS] @ y.T).max(1)
        else:
            error = np.inf
        low = top.max(1).astype(np.float64) - 2 * error if error < np.inf else np.full(len(own), -np.inf)
        best, sim = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), -np.inf)
        zero = norms == 0  # equally far from everything
        if zero.any():
            best[zero], sim[zero] = min(int(ids[0]) for ids, *_ in self.blocks), 0.0
        for k, (ids, y, lengths, single) in enumerate(self.blocks):
            rows = np.flatnonzero((top[:, k] >= low) & ~zero)
            for a in range(0, len(rows), SCREEN_ROWS):
                part = rows[a : a + SCREEN_ROWS]
                i, j = np.nonzero(unit[part] @ single.T >= low[part, None]) if error < np.inf else (g.ravel() for g in np.indices((len(part), len(ids))))
                for c in range(0, len(i), SCREEN_PAIRS):
                    r, q = part[i[c : c + SCREEN_PAIRS]], j[c : c + SCREEN_PAIRS]
                    s = np.einsum("ij,ij->i", x[r], y[q]) / (norms[r] * lengths[q] + COSINE_EPS)
                    order = np.lexsort((ids[q], -s, r))
                    first = order[np.concatenate([[True], r[order][1:] != r[order][:-1]])]
                    r, s, q = r[first], s[first], ids[q[first]]
                    better = (s > sim[r]) | (s == sim[r]) & (q < best[r])
                    best[r[better]], sim[r[better]] = q[better], s[better]
        return best, sim


def _over_blocks(regs: DataFrame, procs: DataFrame, emit: Emit | None, schema: str, vector: str, upper: bool = False) -> DataFrame:
    """Applies ``emit(reg_idx, proc_idx, cosines)`` to blocks that cover all pairs; with ``upper``, at least those
    with reg_idx < proc_idx. Without ``emit``, what comes out are sources' best ones of a file of blocks."""
    spark = regs.sparkSession
    left = regs.select("reg_idx", F.col(vector).cast("array<double>").alias("v"))
    right = procs.select("proc_idx", F.col(vector).cast("array<double>").alias("v"))
    dim, n = _sizes(left, right)
    if dim * n * 8 <= BROADCAST_BYTES:
        table = right.toArrow()
        ids = table["proc_idx"].to_numpy()
        order = np.argsort(ids)
        ids, target = ids[order], _matrix(table["v"].combine_chunks())[order]
        shared = spark.sparkContext.broadcast((ids, target))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, target = shared.value
            if emit is None and len(ids):
                find = _Best([(ids[a : a + PACK_ROWS], target[a : a + PACK_ROWS]) for a in range(0, len(ids), PACK_ROWS)])
                for batch in batches:
                    for a in range(0, len(batch), PACK_ROWS):
                        part = batch.slice(a, PACK_ROWS)
                        yield _best_rows(find, part.column("reg_idx").to_numpy(), _matrix(part.column("v")))
                return
            for batch in batches:
                step = max(1, 4_000_000 // max(1, len(ids)))
                for a in range(0, len(batch) if len(ids) else 0, step):
                    part = batch.slice(a, step)
                    own = part.column("reg_idx").to_numpy()
                    at = int(np.searchsorted(ids, own.min(), "right")) if upper else 0
                    yield emit(own, ids[at:], _cosines(_matrix(part.column("v")), target[at:]))

        return left.mapInArrow(run, schema)
    a, b = _packed(left, "reg_idx", dim), _packed(right, "proc_idx", dim)
    # what is paired are places of blocks: a few blocks of the left and the blocks of a file of the right, which is
    # read once for them
    a = a.groupBy(F.col("file").alias("file_a"), F.floor(F.col("batch") / PACK_RUN).alias("run")).agg(F.min("lo").alias("lo_a"), F.array_sort(F.collect_list("batch")).alias("batches"))
    b = b.groupBy(F.col("file").alias("file_b")).agg(F.max("hi").alias("hi_b"))  # a file has at most PACK_BLOCKS
    pairs = a.crossJoin(b)
    if upper:
        pairs = pairs.where("lo_a < hi_b")

    def run_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fa, ks, fb in zip(*(batch.column(c).to_pylist() for c in ("file_a", "batches", "file_b")), strict=True):
                right = _read_blocks(fb)
                find = _Best(right) if emit is None else None
                for k in ks:
                    own, x = _read_blocks(fa, k)[0]
                    if find:
                        yield _best_rows(find, own, x)
                        continue
                    for ids, y in right:
                        if not upper or own.min() < ids.max():
                            yield emit(own, ids, _cosines(x, y))

    # these rows are small and their work is large: a number that is given keeps adaptive execution from putting them
    # all into one task
    tasks = min(max(1, pairs.count()), MOST_TASKS)
    return pairs.repartition(tasks).mapInArrow(run_pairs, schema)


def _best_rows(find: _Best, own: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    best, sim = find(own, x)
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(best.astype(np.int32)), pa.array(sim)], names=["reg_idx", "proc_idx", "sim"])


def _packed(df: DataFrame, key: str, dim: int) -> DataFrame:
    """Writes (key, v) in blocks of PACK_ROWS to the shared folder: ``(file, batch, lo, hi, n)`` of each block. A file
    is named by its attempt, and only the names of attempts that ended come out."""
    from quillstone.session import arrow_filesystem, materialize, shared_path

    uri = shared_path(df.sparkSession, "vectors")
    kind = pa.schema([("id", pa.int64()), ("x", pa.binary(8 * dim))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, xs, have = [], [], 0
        for batch in batches:
            ids.append(batch.column(key).to_numpy().astype(np.int64))
            xs.append(_matrix(batch.column("v")))
            have += len(batch)
            if have >= PACK_ROWS:
                i, x = np.concatenate(ids), np.concatenate(xs)
                for a in range(0, have - have % PACK_ROWS, PACK_ROWS):
                    yield i[a : a + PACK_ROWS], x[a : a + PACK_ROWS]
                ids, xs, have = [i[have - have % PACK_ROWS :]], [x[have - have % PACK_ROWS :]], have % PACK_ROWS
        if have:
            yield np.concatenate(ids), np.concatenate(xs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = arrow_filesystem(uri)
        made = blocks(batches)
        while True:
            some = list(itertools.islice(made, PACK_BLOCKS))
            if not some:
                return
            fs.create_dir(path, recursive=True)
            name = f"{uri}/{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{path}/{name.rsplit('/', 1)[1]}") as out, pa.ipc.new_file(out, kind) as writer:
                for ids, x in some:
                    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * dim), len(ids), [None, pa.py_buffer(np.ascontiguousarray(x))])
                    writer.write_batch(pa.RecordBatch.from_arrays([pa.array(ids), packed], schema=kind))
            columns = [[name] * len(some), list(range(len(some))), [int(i.min()) for i, _ in some], [int(i.max()) for i, _ in some], [len(i) for i, _ in some]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["file", "batch", "lo", "hi", "n"])

    return materialize(df.mapInArrow(run, "file string, batch int, lo long, hi long, n long"), "blocks")


def _read_blocks(file: str, batch: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    from quillstone.session import arrow_filesystem

    fs, path = arrow_filesystem(file)
    with fs.open_input_file(path) as f:
        reader = pa.ipc.open_file(f)
        got = [reader.get_batch(i) for i in (range(reader.num_record_batches) if batch is None else [batch])]
    return [(b.column(0).to_numpy(), np.frombuffer(b.column(1).buffers()[1], np.float64).reshape(len(b), -1)) for b in got]


def pairwise_cosine(regs: DataFrame, procs: DataFrame, min_sim: float | None = None, vector: str = "embedding", upper: bool = False) -> DataFrame:
    """``(reg_idx, proc_idx, sim)`` of all pairs, or of those with at least ``min_sim``:
    dot / (|a| * |b| + 1e-8), so a zero vector has 0. Not clamped. With ``upper``, of a corpus with itself, only pairs
    with reg_idx < proc_idx are computed. All vectors must be good and of one length, else ValueError."""

    def emit(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        keep = s >= min_sim if min_sim is not None else np.ones(s.shape, bool)
        if upper:
            keep &= a[:, None] < b[None, :]
        i, j = np.nonzero(keep)
        return pa.RecordBatch.from_arrays([pa.array(a[i].astype(np.int32)), pa.array(b[j].astype(np.int32)), pa.array(s[i, j])], names=["reg_idx", "proc_idx", "sim"])

    return _over_blocks(regs, procs, emit, "reg_idx int, proc_idx int, sim double", vector, upper)


def best_matches(regs: DataFrame, procs: DataFrame, vector: str = "embedding") -> DataFrame:
    """``(reg_idx, proc_idx, sim)``: each source's most similar target; equal ones go to the lowest index. Each file of
    blocks sends one row for a source."""
    found = _over_blocks(regs, procs, None, "reg_idx int, proc_idx int, sim double", vector)
    key = F.struct(F.col("sim"), -F.col("proc_idx"))
    return found.groupBy("reg_idx").agg(F.max_by("proc_idx", key).alias("proc_idx"), F.max("sim").alias("sim"))


def similarity_range(regs: DataFrame, procs: DataFrame, vector: str = "embedding") -> DataFrame:
    """``(min_sim, max_sim, pairs)`` over all pairs, from one row for each block."""

    def emit(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        few = s.size > 0
        return pa.RecordBatch.from_arrays([pa.array([s.min()] if few else [], pa.float64()), pa.array([s.max()] if few else [], pa.float64()), pa.array([s.size] if few else [], pa.int64())], names=["lo", "hi", "n"])

    blocks = _over_blocks(regs, procs, emit, "lo double, hi double, n long", vector)
    return blocks.agg(F.min("lo").alias("min_sim"), F.max("hi").alias("max_sim"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))


@dataclass
class Compared:
    """What reports need of two corpora, from one pass over all pairs: ``best`` and ``pairs`` (reg_idx, proc_idx, sim),
    the latter with at least the threshold; ``span`` (min_sim, max_sim, pairs)."""

    best: DataFrame
    pairs: DataFrame
    span: DataFrame


def compare(regs: DataFrame, procs: DataFrame, threshold: float, vector: str = "embedding") -> Compared:
    """All pairs are computed once; their blocks send best matches, pairs above the threshold and the range, which are
    written to the shared folder."""
    from quillstone.session import materialize

    def emit(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(s >= threshold)
        if not s.size:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int8(), pa.int32(), pa.int32(), pa.float64())], names=["what", "reg_idx", "proc_idx", "sim"])
        order = np.argsort(b, kind="stable")
        top = order[s[:, order].argmax(1)]
        rows = np.arange(len(a))
        size = np.array([len(a)] * 2, np.int32), np.array([len(b)] * 2, np.int32)  # of the block, beside its least and greatest
        what = np.repeat(np.array([0, 1, 2, 3], np.int8), [len(a), len(i), 1, 1])
        columns = [what, np.concatenate([a, a[i], size[0]]).astype(np.int32), np.concatenate([b[top], b[j], size[1]]).astype(np.int32), np.concatenate([s[rows, top], s[i, j], [s.min(), s.max()]])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["what", "reg_idx", "proc_idx", "sim"])

    made = materialize(_over_blocks(regs, procs, emit, "what byte, reg_idx int, proc_idx int, sim double", vector), "compared")
    best = made.where("what = 0").groupBy("reg_idx").agg(F.max_by("proc_idx", F.struct(F.col("sim"), -F.col("proc_idx"))).alias("proc_idx"), F.max("sim").alias("sim"))
    pairs = made.where("what = 1").select("reg_idx", "proc_idx", "sim")
    size = F.when(F.col("what") == 2, F.col("reg_idx").cast("long") * F.col("proc_idx"))
    span = made.where("what >= 2").agg(F.min("sim").alias("min_sim"), F.max("sim").alias("max_sim"), F.coalesce(F.sum(size), F.lit(0)).alias("pairs"))
    return Compared(best, pairs, span)


def edge_weight(sim: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - sim)


def similarity_edges(pairs: DataFrame, num_regs: int, threshold: float = 0.75) -> DataFrame:
    """Directed edges source -> target ``(src, dst, sim, weight)`` of pairs with ``sim >= threshold``; targets are
    numbered behind the sources."""
    kept = pairs.where(F.col("sim") >= threshold)
    return kept.select(F.col("reg_idx").alias("src"), (F.col("proc_idx") + num_regs).alias("dst"), "sim", edge_weight(F.col("sim")).alias("weight"))


def graph_nodes(spark, num_regs: int, num_procs: int) -> DataFrame:
    """``(id, kind, local_idx)`` of both corpora's sections."""
    ids = spark.range(num_regs + num_procs).select(F.col("id").cast("int").alias("id"))
    source = F.col("id") < num_regs
    return ids.select("id", F.when(source, "REG").otherwise("PROC").alias("kind"), F.when(source, F.col("id")).otherwise(F.col("id") - num_regs).alias("local_idx"))


def out_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, degree)`` of all nodes, zeros included."""
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return nodes.join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))


def csr(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compressed rows: ``(id, row_ptr)`` with one entry more than nodes, and ``(pos, src, dst, sim)`` of the edges in
    row order, targets rising within a row. Zero edges give an empty second table."""
    placed = sequential_index(edges.select("src", "dst", "sim"), ["src", "dst"], "pos")
    degrees = out_degrees(edges, nodes)
    behind = degrees.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).cast("int").alias("id")).withColumn("degree", F.lit(0).cast("long"))
    filled = running_total(degrees.select(F.col("id").cast("int").alias("id"), F.col("degree").cast("long").alias("degree")).unionByName(behind), "id", "degree", "row_ptr")
    return filled.select("id", F.col("row_ptr").cast("int").alias("row_ptr")), placed.select("pos", "src", "dst", "sim")


def edge_density(edges: DataFrame, num_regs: int, num_procs: int) -> DataFrame:
    """``(num_edges, density_pct)``."""
    n = F.count("*")
    return edges.agg(n.alias("num_edges"), (100.0 * n / max(num_regs * num_procs, 1)).alias("density_pct"))
