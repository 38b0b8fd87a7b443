"""Near-duplicate texts: all pairs whose sets of word shingles have a Jaccard similarity of at least a threshold.

Method: a prefix-tree join, in parts.

1. Texts with the same words form a class; only one of them goes on (``members`` has the rest).
2. The shingles of all texts get one global order, the rarest first, from exact counts over all texts. Counts are
   summed within chunks of texts before they move, and come back as one byte for each distinct shingle of a chunk.
3. The top of the tree is spread over tasks by shingle: two ordered sets that are similar enough share a shingle in
   their prefixes, and from its places in both the remaining lengths bound what they can still share; so does a
   sketch of what follows it in the prefixes. Shingles of one text only can't be shared and are skipped. Very
   frequent shingles are dealt to several tasks in blocks.
4. What is left only says which texts have to meet: texts are gathered by the smallest text they met, a large such
   group in blocks, so a text is sent once to a group and not once for each pair. There the ordered sets, the rarest
   shingles first, are stored in a tree with shared beginnings, which is traversed once with all texts of the group:
   an edge's overlap with them is counted once for all sets below it, and a text is given up in a subtree whose
   remaining lengths no longer suffice. All pairs come out of this tree; the result is exact.

No list of all texts, shingles or pairs reaches the driver.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.words import Words, mix, slices
from quillstone.session import arrow_filesystem, materialize, release, shared_path

_BITS = 44  #: of a shingle's hash in steps 2 and 3; step 4 takes all 64
_MASK = np.uint64((1 << _BITS) - 1)
_ROWS = 20  #: bits of a row's number in its chunk; the rest of a text's address is the chunk
_HOT = 4_000  #: a shingle of more texts than this is dealt to several tasks
_BUCKET = 2_000_000  #: shingles for each task of steps 2 and 3
_SEQ = 20  #: bits of a chunk's number in its task; the rest of its name is the task
_TOGETHER, _SHINGLES = 512, 500_000  #: texts, and their shingles, of a block of a group in step 4


def needed(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that sets of n and m must share to be similar enough."""
    return np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9).astype(np.int64)


def _planes(a: np.ndarray, width: int) -> bytes:
    """Integers byte by byte, all lowest bytes first: what is the same in most of them then compresses well."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(b: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _level(count: np.ndarray) -> np.ndarray:
    """A count as one byte: itself up to 200, then in quarters of octaves."""
    rough = 200 + np.floor(4 * np.log2(np.maximum(count, 200) / 200))
    return np.where(count <= 200, count, np.minimum(rough, 255)).astype(np.uint8)


def _least_count(level: np.ndarray) -> np.ndarray:
    l = level.astype(np.float64)
    return np.where(l <= 200, l, 200 * 2 ** ((l - 200) / 4)).astype(np.int64)


def _shingles(words: Words, salt: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and 64-bit hash of each run of k words; texts with another salt have other hashes."""
    n, text = len(words.hash), words.text_of()
    if n < k:
        return text[:0], np.zeros(0, np.uint64)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words.hash[j : n - k + 1 + j]
    same = text[: n - k + 1] == text[k - 1 :]
    text = text[: n - k + 1][same]
    return text, mix(h[same] + mix(salt.view(np.uint64))[text])


class Chunk:
    """The shingle sets of a chunk of texts: ``set_of`` the text's row and ``token`` of each member, ordered by both;
    ``distinct`` tokens and which of them each member is."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, k: int):
        text, h = _shingles(Words(rows.column("text")), rows.column("salt").to_numpy(zero_copy_only=False), k)
        key = np.unique((text.astype(np.uint64) << np.uint64(_BITS)) | (h & _MASK))  # rows of a chunk are far fewer than 2^20
        self.set_of = (key >> np.uint64(_BITS)).astype(np.int64)
        self.token = key & _MASK
        self.size = np.bincount(self.set_of, minlength=len(rows))
        self.distinct, self.which = np.unique(self.token, return_inverse=True)
        self.which = self.which.ravel()

    def edges(self, buckets: int) -> np.ndarray:
        """Where the distinct tokens of each bucket begin; buckets are ranges of tokens."""
        borders = np.array([(b << _BITS) // buckets for b in range(buckets)] + [1 << _BITS], np.uint64)
        return np.searchsorted(self.distinct, borders)


@dataclass
class NearDuplicates:
    """``members``: (within, key, rep, n_words), one row for each text of enough words; ``links``: (within, a, b,
    similarity) between representatives, a < b, of different words."""

    members: DataFrame
    links: DataFrame


def near_duplicates(df: DataFrame, key: str, text: str, within: str | None = None, k: int = 5, similarity: float = 0.8, least_words: int = 5) -> NearDuplicates:
    """Classes of texts with the same words, and all pairs of classes that are similar enough.

    * Sets of ``k`` consecutive words; a pair counts if intersection / union >= ``similarity``. Words are runs of a-z
      and 0-9 after lower-casing. With ``within``, only texts with the same value there are compared.
    * Texts of fewer than ``least_words`` (at least k) words take no part, nor do null texts and null keys. Keys are
      integers. Rows that repeat a key with the same words count once; with other words, each is a text of its own
      whose links name the same key. Other columns are not read, whatever their names. An empty table has no rows.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    spark = df.sparkSession
    least_words = max(least_words, k)
    group = F.lit("") if within is None else F.coalesce(F.col(within).cast("string"), F.lit(""))
    rows = df.select(group.alias("within"), F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & F.col("text").isNotNull())

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                keep = pa.array(np.flatnonzero(words.counts >= least_words))
                c1, c2 = (pa.array(words.sequence_keys(s).view(np.int64)) for s in (1, 2))
                yield pa.RecordBatch.from_arrays([part.column("within"), part.column("key"), c1, c2, pa.array(words.counts)], names=["within", "key", "c1", "c2", "n_words"]).take(keep)

    keyed = materialize(rows.mapInArrow(classes, "within string, key long, c1 long, c2 long, n_words long").distinct(), "classes")
    reps = keyed.groupBy("within", "c1", "c2").agg(F.min("key").alias("rep"))
    members = materialize(keyed.join(reps, ["within", "c1", "c2"]), "members")
    total = members.where("key = rep").agg(F.sum("n_words")).first()[0] or 0
    buckets = max(spark.sparkContext.defaultParallelism * 2, -(-int(total) // _BUCKET))
    chosen = members.where("key = rep").select("within", "key").distinct()
    # texts move once: both sides of the join are parted alike, and stay so. Equal rows are then side by side, so that a
    # repeated one can be dropped on the way; always in the same order, as a task's chunks are named by their places
    reps_rows = rows.repartition(buckets, "within", "key").join(chosen.repartition(buckets, "within", "key"), ["within", "key"])
    ordered = reps_rows.withColumn("salt", F.xxhash64("within")).sortWithinPartitions("within", "key", F.xxhash64("text"))
    folder = shared_path(spark, "chunks")

    counted = _count(ordered, folder, buckets, k, least_words)
    levels = materialize(counted, "levels")
    met = materialize(_candidates(levels, folder, buckets, k, similarity), "met")
    links = materialize(_verified(_sketched(met, folder, similarity), folder, k, similarity), "links")
    for used in (keyed, levels, met):
        release(spark, used._quillstone_path)
    release(spark, folder)
    return NearDuplicates(members.select("within", "key", "rep", "n_words").distinct(), links)


def _write_chunk(folder: str, name: int, rows: pa.Table, kind: str = "") -> None:
    fs, path = arrow_filesystem(folder)
    fs.create_dir(path, recursive=True)
    out = io.BytesIO()
    with pa.ipc.new_file(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    tries = f"{path}/.{name:x}{kind}.{np.random.default_rng().integers(1 << 62)}"
    with fs.open_output_stream(tries) as stream:
        stream.write(out.getvalue())
    fs.move(tries, f"{path}/{name:x}{kind}")


def _read_chunk(folder: str, name: int, kind: str = "") -> pa.Table:
    fs, path = arrow_filesystem(folder)
    with fs.open_input_file(f"{path}/{name:x}{kind}") as f:
        return pa.ipc.open_file(f).read_all()


def _count(ordered: DataFrame, folder: str, buckets: int, k: int, least_words: int) -> DataFrame:
    """Writes the chunks, and gives the level of each of their distinct shingles: (chunk, bucket, level)."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, task, written = None, TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text"):
                table = pa.Table.from_batches([part])
                ids = list(zip(table["within"].to_pylist(), table["key"].to_pylist(), table["text"].to_pylist(), strict=True))
                keep = [i for i, x in enumerate(ids) if x != (ids[i - 1] if i else last)]
                last = ids[-1] if ids else last
                table = table.take(pa.array(keep, pa.int64()))
                if not len(table):
                    continue
                name, written = (task << _SEQ) + written, written + 1
                if task >= 1 << (63 - _ROWS - _SEQ) or written > 1 << _SEQ:
                    raise OverflowError("more chunks than can be named")
                _write_chunk(folder, name, table)
                chunk = Chunk(table, k)
                edges = chunk.edges(buckets)
                counts = np.bincount(chunk.which, minlength=len(chunk.distinct))
                used = [b for b in range(buckets) if edges[b] < edges[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(used), pa.int64()), pa.array(used, pa.int32()), pa.array([_planes(chunk.distinct[edges[b] : edges[b + 1]], 6) for b in used], pa.binary()), pa.array([_planes(counts[edges[b] : edges[b + 1]], 4) for b in used], pa.binary())],
                    names=["chunk", "bucket", "tokens", "counts"],
                )

    def add(table: pa.Table) -> pa.Table:
        tokens = [_from_planes(x, 6) for x in table["tokens"].to_pylist()]
        counts = [_from_planes(x, 4) for x in table["counts"].to_pylist()]
        _, which = np.unique(np.concatenate(tokens), return_inverse=True)
        level = _level(np.bincount(which.ravel(), weights=np.concatenate(counts).astype(np.float64)))[which.ravel()]
        ends = np.cumsum([len(t) for t in tokens])
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "level": pa.array([level[e - len(t) : e].tobytes() for e, t in zip(ends, tokens, strict=True)], pa.binary())})

    sent = ordered.mapInArrow(chunks, "chunk long, bucket int, tokens binary, counts binary")
    return sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(add, "chunk long, bucket int, level binary")


def _bits(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of 128 bits for each token, as two words."""
    bit = mix(token) & np.uint64(127)
    one = np.uint64(1) << (bit & np.uint64(63))
    low = bit < 64
    return np.where(low, one, np.uint64(0)), np.where(low, np.uint64(0), one)


_WORDS = 8  #: words of 64 bits in the sketch of a whole set


def _sketches(chunk: Chunk) -> pa.Table:
    """Size and sketch of each set: one bit for each member, added up without carry."""
    out = np.zeros((len(chunk.size), _WORDS), np.uint64)
    bit = mix(chunk.token ^ np.uint64(0x5DEECE66D)) % np.uint64(64 * _WORDS)
    np.bitwise_xor.at(out, (chunk.set_of, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return pa.table({"n": chunk.size.astype(np.int32)} | {f"s{i}": out[:, i].view(np.int64) for i in range(_WORDS)})


def _sketched(met: DataFrame, folder: str, similarity: float) -> DataFrame:
    """Pairs whose sketches leave room for enough shared members: each member that only one of two sets has changes
    at most one bit, so sketches that differ in d bits have at most (n + m - d) / 2 members in common."""
    names = ["n", *(f"s{i}" for i in range(_WORDS))]
    wanted = met.select(F.explode(F.array("a", "b")).alias("text")).distinct().withColumn("chunk", F.shiftright("text", _ROWS))

    def fetch(table: pa.Table) -> pa.Table:
        own = _read_chunk(folder, table["chunk"][0].as_py(), ".sketch").take(pa.array(table["text"].to_numpy() & ((1 << _ROWS) - 1)))
        return pa.table({"text": table["text"]} | {c: own[c] for c in names})

    known = materialize(wanted.groupBy("chunk").applyInArrow(fetch, "text long, n int, " + ", ".join(f"{c} long" for c in names[1:])), "sketches")
    one = known.select(F.col("text").alias("a"), *[F.col(c).alias(f"{c}_a") for c in names])
    two = known.select(F.col("text").alias("b"), *[F.col(c).alias(f"{c}_b") for c in names])
    both = met.join(one, "a").join(two, "b")
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in names[2:]), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))
    total = F.col("n_a") + F.col("n_b")
    return both.where(F.floor((total - differ) / 2) >= F.ceil(similarity / (1 + similarity) * total - 1e-9)).select("a", "b", "n_a", "n_b")


def _candidates(levels: DataFrame, folder: str, buckets: int, k: int, similarity: float) -> DataFrame:
    """Pairs of representatives, by their addresses, that share a shingle early enough in the global order."""
    widths = {"tokens": 4, "rows": 3, "sizes": 4, "places": 4, "after": 4, "sketch1": 8, "sketch2": 8}

    def prefixes(table: pa.Table) -> pa.Table:
        rows = _read_chunk(folder, table["chunk"][0].as_py())
        chunk = Chunk(rows, k)
        level = np.zeros(len(chunk.distinct), np.uint8)
        edges = chunk.edges(buckets)
        for b, x in zip(table["bucket"].to_pylist(), table["level"].to_pylist(), strict=True):
            level[edges[b] : edges[b + 1]] = np.frombuffer(x, np.uint8)
        member = level[chunk.which]
        ends = np.cumsum(chunk.size)
        levels_ = pa.array([member[e - n : e].tobytes() for e, n in zip(ends.tolist(), chunk.size.tolist(), strict=True)], pa.binary())
        _write_chunk(folder, table["chunk"][0].as_py(), _sketches(chunk).append_column("levels", levels_), ".sketch")
        single = np.bincount(chunk.set_of[member == 1], minlength=len(rows))
        keep = np.flatnonzero(member > 1)
        keep = keep[np.argsort(chunk.set_of[keep] * 256 + member[keep], kind="stable")]
        set_of, token, member = chunk.set_of[keep], chunk.token[keep], member[keep]
        place = np.arange(len(keep)) - np.searchsorted(set_of, set_of) + single[set_of]
        n = chunk.size[set_of]
        early = place <= n - np.ceil(similarity * n - 1e-9)
        set_of, token, place, n, member = set_of[early], token[early], place[early], n[early], member[early]
        # what follows each shingle in its set's prefix: how many, and their bits added up without carry
        end = np.searchsorted(set_of, set_of, "right") - 1
        after = end - np.arange(len(end))
        sketch = []
        for bits in _bits(token):
            sums = np.bitwise_xor.accumulate(bits) if len(bits) else bits
            sketch.append(sums[end] ^ sums)
        # a very frequent shingle's texts are dealt to pairs of blocks; each text goes to all pairs with its own block
        parts = -(-_least_count(member) // _HOT)
        own = (mix(set_of.astype(np.uint64) + np.uint64(table["chunk"][0].as_py())) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64)
        at = np.repeat(np.arange(len(token)), parts)
        other = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        pair = np.minimum(own[at], other) * 65536 + np.maximum(own[at], other)
        spread = mix(token[at] + (pair.astype(np.uint64) << np.uint64(_BITS)))
        where = (spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        order = np.argsort(where, kind="stable")
        at, where = at[order], where[order].astype(np.int64)
        columns = (spread[order] & np.uint64(0xFFFFFFFF), set_of[at], n[at], place[at], after[at], sketch[0][at], sketch[1][at])
        heads = np.searchsorted(where, np.arange(buckets + 1))
        used = [b for b in range(buckets) if heads[b] < heads[b + 1]]
        out = {"chunk": pa.array([table["chunk"][0].as_py()] * len(used), pa.int64()), "bucket": pa.array(used, pa.int32())}
        for (name, width), values in zip(widths.items(), columns, strict=True):
            out[name] = pa.array([_planes(values[heads[b] : heads[b + 1]], width) for b in used], pa.binary())
        return pa.table(out)

    def meet(table: pa.Table) -> pa.Table:
        got = {c: [_from_planes(x, w) for x in table[c].to_pylist()] for c, w in widths.items()}
        chunk = np.repeat(table["chunk"].to_numpy(), [len(x) for x in got["rows"]])
        token, row, n, place, after, s1, s2 = (np.concatenate(x) for x in got.values())
        text = (chunk << _ROWS) + row.astype(np.int64)
        n, place, after = n.astype(np.int64), place.astype(np.int64), after.astype(np.int64)
        order = np.lexsort((text, n, token))
        token, text, n, place, after, s1, s2 = token[order], text[order], n[order], place[order], after[order], s1[order], s2[order]
        rest = np.ceil(similarity * n - 1e-9).astype(np.int64) - 1  # members behind the prefix
        found, pending = [], 0
        i, step = np.arange(len(token)), 0
        while len(i):
            step += 1
            i = i[i + step < len(token)]
            j = i + step
            go = (token[i] == token[j]) & (n[i] >= similarity * n[j] - 1e-9)  # sizes rise within a token: no later one fits either
            i, j = i[go], j[go]
            least = needed(n[i], n[j], similarity)
            can = np.flatnonzero((np.minimum(n[i] - place[i], n[j] - place[j]) >= least) & (text[i] != text[j]))
            p, q = i[can], j[can]
            # the rest of what they share lies in both prefixes, of which the sketches tell how much differs, or
            # behind the prefix that ends first
            differ = np.bitwise_count(s1[p] ^ s1[q]).astype(np.int64) + np.bitwise_count(s2[p] ^ s2[q])
            both = np.minimum(np.minimum(after[p], after[q]), (after[p] + after[q] - differ) // 2)
            can = 1 + both + np.maximum(rest[p], rest[q]) >= least[can]
            p, q = text[p[can]], text[q[can]]
            if len(p):
                found.append(np.stack([np.minimum(p, q), np.maximum(p, q)], 1))
                pending += len(p)
                if pending > 4_000_000:
                    found, pending = [np.unique(np.concatenate(found), axis=0)], 0
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    fields = ", ".join(f"{c} binary" for c in widths)
    sent = levels.groupBy("chunk").applyInArrow(prefixes, f"chunk long, bucket int, {fields}")
    # a bucket has about _BUCKET shingles however many there are; as many partitions keep buckets apart
    return sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


class Sets:
    """Ordered sets of small integers: ``items`` of all, ``first`` offsets, and ``size``, which may count members that
    no other set has and that are left out."""

    def __init__(self, items: np.ndarray, first: np.ndarray, size: np.ndarray):
        self.items, self.first, self.size = items, first, size

    def __len__(self) -> int:
        return len(self.size)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.items[self.first[i] : self.first[i + 1]]


def tree_join(stored: Sets, probes: Sets, similarity: float, cells: int = 1 << 26) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a probe and a stored set that are similar enough: (probes, stored, similarities), for one stored set
    after the other. The stored sets are the leaves of a tree, each edge of which is a run of members. It is traversed
    with ``cells`` divided by the number of integers probes at a time."""
    top = int(max(stored.items.max(initial=-1), probes.items.max(initial=-1))) + 1
    order = sorted(range(len(stored)), key=lambda i: stored[i].astype(">u4").tobytes())
    length = np.diff(stored.first)
    common = [0]  # members that each set begins with as the one before
    for i, j in zip(order, order[1:], strict=False):
        m = min(length[i], length[j])
        differ = np.flatnonzero(stored[i][:m] != stored[j][:m])
        common.append(int(differ[0]) if len(differ) else int(m))
    common, n = np.array([*common, 0]), stored.size[order]
    below = length[order]
    step = max(1, cells // max(1, top))
    for start in range(0, len(probes), step):
        who = np.arange(start, min(start + step, len(probes)))
        has = np.zeros((len(who), top), bool)
        span = probes.items[probes.first[start] : probes.first[who[-1] + 1]]
        row = np.repeat(np.arange(len(who)), np.diff(probes.first[start : who[-1] + 2]))
        has[row, span] = True
        places = row * np.int64(top + 1) + span  # sorted: how many of a probe's members lie before one follows from it
        begin, m = np.searchsorted(row, np.arange(len(who) + 1)), probes.size[who]

        def down(node: tuple, i: int, depth: int, end: int, has=has, places=places, begin=begin, m=m) -> tuple:
            """The node at ``depth`` on the way to set i, from a node above; what is below ends before set ``end``."""
            above, alive, shared = node
            run = stored[order[i]][above:depth]
            if len(run) and len(alive):
                shared = shared + has[alive[:, None], run[None]].sum(1)
                passed = np.searchsorted(places, alive * np.int64(top + 1) + run[-1], "right") - begin[alive]
                most = shared + np.minimum(below[i:end].max() - depth, begin[alive + 1] - begin[alive] - passed)
                live = most >= needed(m[alive], n[i:end].min(), similarity)
                alive, shared = alive[live], shared[live]
            return depth, alive, shared

        stack = [(0, np.arange(len(who)), np.zeros(len(who), np.int64))]
        for i in range(len(order)):
            while stack[-1][0] > common[i]:
                stack.pop()
            branch = min(int(common[i + 1]), int(below[i]))
            for depth in sorted({int(common[i]), max(branch, int(common[i]))}):
                if depth > stack[-1][0]:
                    after = np.flatnonzero(common[i + 1 :] < depth)
                    stack.append(down(stack[-1], i, depth, i + 1 + int(after[0]) if len(after) else len(order)))
            _, alive, shared = down(stack[-1], i, int(below[i]), i + 1)
            if len(alive):
                s = shared / (m[alive] + n[i] - shared)
                good = (s >= similarity - 1e-12) & (shared > 0)
                if good.any():
                    yield who[alive[good]], np.full(int(good.sum()), order[i]), s[good]


def _verified(candidates: DataFrame, folder: str, k: int, similarity: float) -> DataFrame:
    """All pairs of texts that are similar enough, with the similarity, from trees of those that have to meet."""
    candidates = materialize(candidates, "candidates")
    ends = candidates.select(F.col("b").alias("text"), F.col("a").alias("root"), F.col("n_b").alias("n")).unionByName(candidates.select(F.col("a").alias("text"), F.col("a").alias("root"), F.col("n_a").alias("n")))
    roots = ends.groupBy("text").agg(F.min("root").alias("root"), F.first("n").alias("n"))
    parts = roots.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / _TOGETHER), F.ceil(F.sum("n") / _SHINGLES)).alias("parts"))
    place = materialize(roots.join(parts, "root").select("text", "root", F.pmod(F.xxhash64("text"), F.col("parts")).alias("part")), "places")
    pa_, pb = (place.select(F.col("text").alias(c), F.struct("root", "part").alias(f"p{c}")) for c in "ab")
    met = candidates.select("a", "b").join(pa_, "a").join(pb, "b")
    group = F.struct(F.least("pa", "pb").alias("x"), F.greatest("pa", "pb").alias("y"))
    met = met.select(group.alias("group"), F.explode(F.array(F.struct(F.col("a").alias("text"), F.col("pa").alias("p")), F.struct(F.col("b").alias("text"), F.col("pb").alias("p")))).alias("e"))
    # side 0 meets side 1; within one block all meet all
    side = F.when(F.col("group.x") == F.col("group.y"), 2).when(F.col("e.p") == F.col("group.x"), 0).otherwise(1)
    asked = met.select(F.col("group.x.root").alias("g1"), F.col("group.x.part").alias("g2"), F.col("group.y.root").alias("g3"), F.col("group.y.part").alias("g4"), side.alias("side"), F.col("e.text").alias("text")).distinct()
    names = ["g1", "g2", "g3", "g4"]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, rows = None, None
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else []
            for a, b in zip(heads, [*heads[1:], len(chunk)], strict=True):
                if chunk[a] != open_:
                    open_ = chunk[a]
                    rows = _read_chunk(folder, int(open_)).append_column("levels", _read_chunk(folder, int(open_), ".sketch")["levels"]).combine_chunks()
                for c in range(a, b, 4096):  # a text comes once for each group it was asked for
                    part = batch.slice(c, min(4096, b - c))
                    own = rows.take(pa.array(part.column("text").to_numpy() & ((1 << _ROWS) - 1)))
                    columns = [part.column(x) for x in (*names, "side", "text")] + [own[x].combine_chunks() for x in ("within", "key", "salt", "text", "levels")]
                    made = pa.RecordBatch.from_arrays(columns, names=[*names, "side", "text", "within", "key", "salt", "body", "levels"])
                    yield from slices(made, "body")

    wanted = asked.withColumn("chunk", F.shiftright("text", _ROWS)).repartition("chunk").sortWithinPartitions("chunk", "text")
    full = wanted.mapInArrow(fetch, ", ".join(f"{x} long" for x in names) + ", side int, text long, within string, key long, salt long, body string, levels binary")
    tasks = max(candidates.sparkSession.sparkContext.defaultParallelism * 2, -(-candidates.count() // 20_000))
    full = full.repartition(tasks, *names).sortWithinPartitions(*names, "side", "text")

    def ordered(part: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of each text's set, and its members with their levels, by token."""
        text, h = _shingles(Words(part.column("body")), part.column("salt").to_numpy(zero_copy_only=False), k)
        by = np.lexsort((h, h & _MASK, text))
        text, h = text[by], h[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        text, h = text[new], h[new]
        token = h & _MASK
        fresh = np.ones(len(h), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
        levels = np.frombuffer(b"".join(part.column("levels").to_pylist()), np.uint8)
        return np.searchsorted(text, np.arange(len(part) + 1)), h, levels[np.cumsum(fresh) - 1] if len(h) else levels[:0]

    def joined(group: list[tuple]) -> list[tuple]:
        """``group``: (side, within, key, members, levels) of each text."""
        size = np.array([len(x[3]) for x in group])
        h, level = np.concatenate([x[3] for x in group]), np.concatenate([x[4] for x in group])
        which = np.repeat(np.arange(len(group)), size)
        keep = level > 1  # a shingle of one text is in no other
        h, level, which = h[keep], level[keep], which[keep]
        by = np.lexsort((h, level))
        step = np.ones(len(h), bool)
        step[1:] = (h[by][1:] != h[by][:-1]) | (level[by][1:] != level[by][:-1])
        rank = np.empty(len(h), np.int64)
        rank[by] = np.cumsum(step) - 1
        by = np.lexsort((rank, which))
        rank, which = rank[by], which[by]

        def some(at: np.ndarray) -> Sets:
            own = np.isin(which, at)
            return Sets(rank[own], np.searchsorted(which[own], np.append(at, len(group))), size[at])

        sides = np.array([x[0] for x in group])
        probe, store = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
        out = []
        for p, q, s in tree_join(some(store), some(probe), similarity):
            for i, j, x in zip(probe[p].tolist(), store[q].tolist(), s.tolist(), strict=True):
                if group[i][2] != group[j][2] and (sides[i] == 0 or i < j):
                    out.append((group[i][1], min(group[i][2], group[j][2]), max(group[i][2], group[j][2]), x))
        return out

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, group = None, []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64())], names=["within", "a", "b", "similarity"])

        for batch in batches:
            for part in slices(batch, "body"):
                found = []
                first, h, level = ordered(part)
                rows = zip(zip(*(part.column(c).to_pylist() for c in names), strict=True), *(part.column(c).to_pylist() for c in ("side", "within", "key")), strict=True)
                for i, (own, side_, within, key) in enumerate(rows):
                    if own != name:
                        found += joined(group) if len(group) > 1 else []
                        name, group = own, []
                    group.append((side_, within, key, h[first[i] : first[i + 1]], level[first[i] : first[i + 1]]))
                yield batch_of(found)
        yield batch_of(joined(group) if len(group) > 1 else [])

    links = full.mapInArrow(verify, "within string, a long, b long, similarity double")
    return links.groupBy("within", "a", "b").agg(F.max("similarity").alias("similarity"))


def expanded(found: NearDuplicates) -> DataFrame:
    """All pairs of keys, ``(within, key_a, key_b)`` with key_a < key_b: those of one class and those of linked
    classes. Their number is quadratic in the size of a class: for corpora with large groups of copies, take
    ``members`` and ``links``."""
    m = found.members.select("within", "key", "rep").distinct()
    a, b = m.select("within", F.col("key").alias("x"), F.col("rep").alias("a")), m.select("within", F.col("key").alias("y"), F.col("rep").alias("b"))
    links = found.links.select("within", "a", "b")
    linked = links.join(a, ["within", "a"]).join(b, ["within", "b"]).select("within", "x", "y")
    groups = m.groupBy("within", "rep").count().where("count > 1").select("within", F.col("rep").alias("a"))
    same = groups.join(a, ["within", "a"]).join(b.withColumnRenamed("b", "a"), ["within", "a"]).where("x < y").select("within", "x", "y")
    pairs = linked.unionByName(same).where("x != y")
    return pairs.select("within", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def classes_with_links(found: NearDuplicates) -> DataFrame:
    """One row for each text: ``(within, key, class_id, links)``; links are other classes that are similar enough."""
    ends = found.links.select("within", F.explode(F.array("a", "b")).alias("rep")).groupBy("within", "rep").agg(F.count("*").alias("links"))
    return found.members.join(ends, ["within", "rep"], "left").select("within", "key", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
