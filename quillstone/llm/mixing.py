"""Mixing sources to target weights.

Method: every source is cut by a seeded hash into blocks, whose token sums are counted exactly. Whole passes take
every block, the last, partial one takes blocks from the front of the permuted order up to the target. The copies of
blocks are dealt to output shards by a multivariate-hypergeometric splitting tree: at each node the shards are
halved and each source's quota is drawn for the left half, so each shard is an exact random sample without
replacement. Which copies those are is told by a permutation of each source's copies, computed where they are listed.
Within a shard the records are ordered by another hash. Only block sums, of a bounded number, reach the driver; a
document's place follows from its hash, so texts are never shuffled to find it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.words import slices

BITS = 10  #: blocks of a source: 2^10, and as many parts in the block where the partial pass ends


def _kinds() -> np.ndarray:
    kinds = np.full(256, 2, np.uint8)
    for a, b in (("A", "Z"), ("a", "z"), ("0", "9"), ("_", "_")):
        kinds[ord(a) : ord(b) + 1] = 1
    kinds[[9, 10, 11, 12, 13, 32]] = 0
    return kinds


_KINDS = _kinds()


def count_tokens(texts: pa.Array) -> np.ndarray:
    """Tokens of the word-and-punctuation tokenizer: maximal runs of ``A-Za-z0-9_``, and maximal runs of characters
    that are neither these nor ASCII white space. A null has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    if off[-1] == off[0]:
        return np.zeros(n, np.int64)
    kind = _KINDS[np.frombuffer(data, np.uint8)[off[0] : off[-1]]]
    off = off - off[0]
    begins = kind != 0
    begins[1:] &= kind[1:] != kind[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    begins[heads] = kind[heads] != 0  # a text's first character begins a token whatever the text before ends with
    total = np.concatenate([[0], np.cumsum(begins)])
    return total[off[1:]] - total[off[:-1]]


def source_name(c: Column) -> Column:
    """A source's name without differences of writing: trimmed, lower case, blanks and hyphens as underscores."""
    return F.translate(F.lower(F.trim(c)), " -", "__")


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, texts: bool = False) -> DataFrame:
    """``(source, doc_id, h, tokens)`` of each row, and ``text`` with ``texts``; ``h`` is a uniform hash of 62 bits that
    places it."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(text).alias("t"))
    rows = rows.where(F.col("source").isNotNull())
    # the text takes part, so that rows that share an id have places of their own
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "t"), 2))
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("h", T.LongType()), T.StructField("tokens", T.LongType()), *([T.StructField("text", T.StringType())] if texts else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column("source"), part.column("doc_id"), part.column("h"), pa.array(count_tokens(part.column("t"))), *([part.column("t")] if texts else [])], names=schema.names)

    return rows.mapInArrow(run, schema)


def _block(bits: int, level: int = 1) -> Column:
    """Number of a row's block, or of its part of the block."""
    return F.pmod(F.shiftright("h", 62 - bits * level), F.lit(1 << bits)).cast("int")


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Units of each source for each shard, exact in every row and column sum: the splitting tree. Shards' sizes
    differ by one unit at most."""
    out = np.zeros((shards, len(quotas)), np.int64)
    total = int(quotas.sum())
    edges = np.array([total * i // shards for i in range(shards + 1)], np.int64)
    stack = [(0, shards, quotas.astype(np.int64))]
    while stack:
        a, b, left = stack.pop()
        if b - a == 1:
            out[a] = left
            continue
        m = (a + b) // 2
        drawn = rng.multivariate_hypergeometric(left, int(edges[m] - edges[a]), method="marginals") if left.sum() else left
        stack += [(a, m, drawn), (m, b, left - drawn)]
    return out


@dataclass
class MixPlan:
    """``sources``: one row for each listed source; ``units``: the copies of blocks that were drawn, with their
    shards, ``(source, pass_no, block, shard, draw, parts)``, where all 2^bits parts of a block belong to its copy but
    in the block where a partial pass ends."""

    sources: DataFrame
    units: DataFrame
    rows: DataFrame
    bits: int


def plan_mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", shards: int = 16, seed: int = 0, bits: int = BITS, most_sources: int = 4096, texts: bool = False) -> MixPlan:
    """How often each source is passed through, where its partial pass ends, and which shard gets which block.

    * The mix is as large as all documents of the listed sources together. A source gets its share of that, in
      whole passes and a partial one, but never more than ``max_passes``; what it then lacks is not given to others.
    * A source without tokens has no passes and no share. Names are compared by ``source_name``; rows of targets
      that name the same source count once, with the largest share. Null and negative shares count as 0.
    * Rows of unlisted or null sources, and null or empty texts (no tokens), take no part; rows that repeat an id
      are records of their own.
    * There may be ``most_sources`` sources, each of 2^``bits`` blocks: more bits and shards make finer ones for larger
      corpora. ValueError beyond 10^9 copies of blocks.
    """
    if not 1 <= bits <= 20:
        raise ValueError("bits must be 1 to 20")
    spark, blocks = docs.sparkSession, 1 << bits
    wanted = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_passes").alias("max_passes")).where(F.col("source").isNotNull())
    goal = sorted(wanted.limit(most_sources + 1).collect())
    if len(goal) > most_sources:
        raise ValueError(f"more than {most_sources} sources; raise most_sources if the driver can hold {blocks} sums of each")
    rows = counted(docs, doc_id, text, source, seed, texts).where(F.col("source").isin([r.source for r in goal]) if goal else F.lit(False)).where("tokens > 0")
    sums = rows.groupBy("source", _block(bits).alias("block")).agg(F.sum("tokens").alias("tokens")).toArrow()
    number = {r.source: i for i, r in enumerate(goal)}
    tokens = np.zeros((len(goal), blocks), np.int64)
    if sums.num_rows:
        tokens[[number[x] for x in sums["source"].to_pylist()], sums["block"].to_numpy()] = sums["tokens"].to_numpy()
    have = tokens.sum(1)
    size = int(have.sum())
    out, quotas, cuts = [], np.zeros(len(goal), np.int64), {}
    for i, r in enumerate(goal):
        share, most = max(0.0, r.target_share or 0.0), max(0, r.max_passes or 0)
        passes = int(min(most, share * size / int(have[i]) // 1)) if have[i] else 0
        rest = share * size - passes * int(have[i]) if have[i] and passes < most else 0.0
        ends = int(np.searchsorted(np.cumsum(tokens[i]), rest, "right")) if rest > 0 else 0
        quotas[i] = passes * blocks + min(blocks, ends + (rest > 0))
        if rest > 0 and ends < blocks:
            cuts[i] = (ends, rest - int(tokens[i, :ends].sum()))
        out.append([r.source, float(share), int(most), int(have[i]), float(share * size), passes])
    # the partial pass ends within a block: at the part of it, by a finer hash, whose sum comes nearest
    limits = {}
    if cuts:
        where = F.lit(False)
        for i, (block, _) in cuts.items():
            where = where | ((F.col("source") == goal[i].source) & (_block(bits) == block))
        fine = np.zeros((len(goal), blocks), np.int64)
        for r in rows.where(where).groupBy("source", _block(bits, 2).alias("part")).agg(F.sum("tokens").alias("tokens")).collect():
            fine[number[r.source], r.part] = r.tokens
        for i, (block, rest) in cuts.items():
            reached = np.concatenate([[0], np.cumsum(fine[i])])
            limits[i] = (block, int(np.argmin(np.abs(reached[:-1] - rest))))  # never all of it: that would be a whole pass
    rng = np.random.default_rng(seed)
    dealt = np.cumsum(split_quotas(quotas, shards, rng), 0)
    draws = []
    for i, r in enumerate(goal):
        q = int(quotas[i])
        if q:
            step = next(x for x in rng.integers(1, 1 << 20, 1000).tolist() if math.gcd(x, q) == 1)
            draws.append((r.source, q, step, int(rng.integers(q)), out[i][5], *limits.get(i, (-1, 0)), dealt[:, i].tolist()))
    listed = spark.createDataFrame(draws, "source string, q long, step long, start long, passes long, cut int, cut_parts int, until array<long>")
    copies = listed.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)))
    copies = copies.withColumn("block", F.pmod("j", F.lit(blocks)).cast("int")).withColumn("pass_no", (F.floor(F.col("j") / blocks) + 1).cast("int"))
    copies = copies.withColumn("draw", F.pmod(F.col("j") * F.col("step") + F.col("start"), F.col("q")))  # step and q have no common divisor: a permutation
    last = (F.col("pass_no") > F.col("passes")) & (F.col("block") == F.col("cut"))
    units = copies.select("source", "pass_no", "block", F.size(F.filter("until", lambda x: x <= F.col("draw"))).alias("shard"), "draw", F.when(last, F.col("cut_parts")).otherwise(blocks).alias("parts"))
    sources = spark.createDataFrame([tuple(x[:5]) for x in out], "source string, target_share double, max_passes int, tokens long, target_tokens double")
    return MixPlan(sources, units, rows, bits)


def drawn_passes(plan: MixPlan) -> DataFrame:
    """``(source, full_passes)`` of all listed sources that have tokens, counted from the units that the shards were
    dealt: a pass is whole if all of its source's blocks were drawn for it, whole."""
    blocks = 1 << plan.bits
    each = plan.units.where(F.col("parts") == blocks).groupBy("source", "pass_no").agg(F.count_distinct("block").alias("n")).where(F.col("n") == blocks)
    whole = each.groupBy("source").agg(F.count("*").cast("int").alias("full_passes"))
    return plan.sources.where("tokens > 0").join(whole, "source", "left").select("source", F.coalesce("full_passes", F.lit(0)).alias("full_passes"))


def mixed(plan: MixPlan, seed: int = 0) -> DataFrame:
    """The records of the mix: ``(shard, order_key, doc_id, source, pass_no, tokens)``, and ``text`` if the plan keeps
    texts. A shard is read in the order of ``order_key``; ids repeat as often as their block was drawn."""
    placed = plan.rows.withColumn("block", _block(plan.bits)).withColumn("part", _block(plan.bits, 2))
    hit = placed.join(plan.units.select("source", "block", "pass_no", "shard", "parts"), ["source", "block"]).where("part < parts")
    return hit.select("shard", F.xxhash64(F.lit(seed + 1), "h", "pass_no").alias("order_key"), "doc_id", "source", "pass_no", "tokens", *(["text"] if "text" in plan.rows.columns else []))


def write_mix(plan: MixPlan, path: str, files: int, seed: int = 0, mode: str = "errorifexists") -> None:
    """Writes the mix as Parquet, a folder for each shard, its records shuffled: sorted by ``order_key`` within each of
    about ``files`` ranges, so that no task holds a whole shard."""
    placed = mixed(plan, seed).repartitionByRange(files, "shard", "order_key").sortWithinPartitions("shard", "order_key")
    placed.write.mode(mode).partitionBy("shard").parquet(path)


def shares(plan: MixPlan) -> DataFrame:
    """What each source really contributes: tokens, share of the mix, records and passes, beside its target."""
    real = mixed(plan).groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count("*").alias("records"))
    total = real.agg(F.sum("mixed_tokens").alias("all_tokens"))
    out = plan.sources.join(real, "source", "left").join(drawn_passes(plan), "source", "left").crossJoin(F.broadcast(total))  # one row
    n = F.coalesce("mixed_tokens", F.lit(0))
    return out.select("source", "target_share", "max_passes", F.coalesce("full_passes", F.lit(0)).alias("full_passes"), "tokens", "target_tokens", n.alias("mixed_tokens"), F.coalesce("records", F.lit(0)).alias("records"), (n / F.col("all_tokens")).alias("actual_share"))
