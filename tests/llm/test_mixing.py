import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillstone.llm.mixing import count_tokens, drawn_passes, mixed, plan_mix, shares, split_quotas, write_mix

PATTERN = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f\v]+")


def test_tokens():
    texts = ["a b", "a", "b!", None, "", "..", "..a__9 é, x\x0by\x1cz", "  ", "ä", "ä", "a-b_c\n\n(d)", "ab, é! " * 100_000, "x" * 1_000_000]
    assert count_tokens(pa.array(texts)).tolist() == [len(PATTERN.findall(t or "")) for t in texts]
    assert count_tokens(pa.array(texts).slice(2, 6)).tolist() == [len(PATTERN.findall(t or "")) for t in texts[2:8]]


def test_quotas_are_exact():
    rng = np.random.default_rng(1)
    q = np.array([1000, 3, 0, 57])
    got = split_quotas(q, 7, rng)
    assert (got.sum(0) == q).all() and np.ptp(got.sum(1)) <= 1
    assert (split_quotas(np.zeros(3, int), 4, rng) == 0).all()


def make(spark, n=4000):
    rng = random.Random(2)
    names = ["a_b", "A-B ", " a b", "c", "d", "nowhere", None]
    rows = [(i, rng.choices(names, [10, 1, 1, 4, 1, 2, 1])[0], " ".join(["x"] * rng.randrange(0, 40))) for i in range(n)]
    rows += [(n, "c", None), (n, "c", ""), (7, "c", "x x x"), (7, "c", "x x x"), (None, "d", "x x")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tokens", F.lit("clash")).withColumn("h", F.lit(1))


def test_mix(spark):
    docs = make(spark)
    targets = spark.createDataFrame([("a_b", 0.5, 3), ("c", 0.3, 2), ("d", 0.2, 2), ("empty", 0.0, 4)], "source string, target_share double, max_passes int")
    plan = plan_mix(docs, targets, shards=5)
    have = dict.fromkeys(["a_b", "c", "d", "empty"], 0)
    for r in docs.collect():
        k = re.sub("[ -]", "_", (r.source or "?").strip(" ").lower())
        if k in have:
            have[k] += len(PATTERN.findall(r.text or ""))
    size = sum(have.values())
    got = {r.source: r for r in shares(plan).collect()}
    for s, share, most in (("a_b", 0.5, 3), ("c", 0.3, 2), ("d", 0.2, 2)):
        assert got[s].tokens == have[s] and got[s].full_passes == min(most, int(share * size / have[s]))
        assert abs(got[s].mixed_tokens - min(share * size, most * have[s])) <= 40
    assert got["d"].full_passes == 2 and got["empty"].mixed_tokens == 0
    rows = mixed(plan).collect()
    per = {}
    for r in rows:
        per.setdefault((r.source, r.doc_id, r.tokens), []).append(r.pass_no)
    assert max(len(v) for k, v in per.items() if k[1] != 7) == 2
    for (s, d, _), passes in per.items():
        if d != 7:
            assert sorted(passes)[: got[s].full_passes] == list(range(1, got[s].full_passes + 1)) and len(set(passes)) == len(passes)
    by_shard = {}
    for r in rows:
        by_shard[r.shard] = by_shard.get(r.shard, 0) + 1
    assert len(by_shard) == 5
    again = {tuple(r) for r in mixed(plan_mix(docs.repartition(3), targets, shards=5)).collect()}
    assert again == {tuple(r) for r in rows}


def test_units_are_dealt_once(spark, tmp_path):
    docs = make(spark)
    targets = spark.createDataFrame([("a_b", 0.2, 3), ("c", 0.5, 9), ("d", 0.3, 40), ("empty", 0.1, 4)], "source string, target_share double, max_passes int")
    plan = plan_mix(docs, targets, shards=7, bits=6, texts=True)
    units = plan.units.collect()
    assert len({(r.source, r.pass_no, r.block) for r in units}) == len(units) == len({(r.source, r.draw) for r in units})
    sizes = [sum(r.shard == s for r in units) for s in range(7)]
    assert sum(sizes) == len(units) and max(sizes) - min(sizes) <= 1
    counts = {}
    for r in units:
        counts.setdefault((r.source, r.pass_no), []).append(r.parts == 64)
    whole = {s: sum(len(v) == 64 and all(v) for (t, _), v in counts.items() if t == s) for s in ("a_b", "c", "d")}
    assert {r.source: r.full_passes for r in drawn_passes(plan).collect()} == whole and whole["d"] > 2
    write_mix(plan, str(tmp_path / "mix"), 5)
    back = spark.read.parquet(str(tmp_path / "mix"))
    assert back.count() == mixed(plan).count() and {len(PATTERN.findall(r.text)) == r.tokens for r in back.collect()} == {True}


def test_empty(spark):
    targets = spark.createDataFrame([("a_b", 0.5, 3)], "source string, target_share double, max_passes int")
    assert mixed(plan_mix(make(spark, 0).limit(0), targets)).collect() == []
    assert mixed(plan_mix(make(spark, 10), targets.limit(0))).collect() == []
