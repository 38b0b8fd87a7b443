import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import dot, report, similarity
from quillstone.operators.embed import embed, hashing_embedder, input_text, norm_stats, top_pair
from quillstone.functions.vectors import l2_norm, masked_mean_pool


def corpora(spark, m=7, n=5, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(m, dim)), rng.normal(size=(n, dim))
    a[0] = 0
    b[1] = b[2] = a[3]  # equal best matches
    regs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "reg_idx int, embedding array<double>")
    procs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(b)], "proc_idx int, embedding array<double>")
    s = a @ b.T / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1) + 1e-8)
    return regs, procs, s


@pytest.mark.parametrize("sent", [64 << 20, 0])
def test_cosine(spark, monkeypatch, sent):
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", sent)
    monkeypatch.setattr(similarity, "PACK_ROWS", 3)
    regs, procs, s = corpora(spark)
    got = {(r.reg_idx, r.proc_idx): r.sim for r in similarity.pairwise_cosine(regs, procs).collect()}
    assert len(got) == s.size and all(abs(got[i] - s[i]) < 1e-12 for i in np.ndindex(s.shape))
    kept = {(r.reg_idx, r.proc_idx) for r in similarity.pairwise_cosine(regs, procs, 0.1).collect()}
    assert kept == {tuple(map(int, i)) for i in np.argwhere(s >= 0.1)}
    best = {r.reg_idx: r.proc_idx for r in similarity.best_matches(regs, procs).collect()}
    assert best[3] == 1 and best == {i: int(np.round(s[i], 12).argmax()) for i in range(7)}
    r = similarity.similarity_range(regs, procs).first()
    assert (r.min_sim, r.max_sim, r.pairs) == (pytest.approx(s.min()), pytest.approx(s.max()), s.size)
    assert similarity.pairwise_cosine(regs.limit(0), procs).collect() == [] and similarity.best_matches(regs, procs.limit(0)).collect() == []


@pytest.mark.parametrize("sent", [64 << 20, 0])
def test_one_pass_and_upper_half(spark, monkeypatch, sent):
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", sent)
    monkeypatch.setattr(similarity, "PACK_ROWS", 3)
    monkeypatch.setattr(similarity, "PACK_BLOCKS", 2)
    regs, procs, s = corpora(spark, 40, 30)
    seen = similarity.compare(regs, procs, 0.1)
    assert {(r.reg_idx, r.proc_idx) for r in seen.pairs.collect()} == {tuple(map(int, i)) for i in np.argwhere(s >= 0.1)}
    assert {r.reg_idx: r.proc_idx for r in seen.best.collect()} == {i: int(np.round(s[i], 12).argmax()) for i in range(40)}
    r = seen.span.first()
    assert (r.min_sim, r.max_sim, r.pairs) == (pytest.approx(s.min()), pytest.approx(s.max()), s.size)
    none = similarity.compare(regs.limit(0), procs, 0.1)
    assert none.best.collect() == [] and none.span.first().pairs == 0
    same = regs.withColumnRenamed("reg_idx", "proc_idx")
    full = {(r.reg_idx, r.proc_idx) for r in similarity.pairwise_cosine(regs, same).where("reg_idx < proc_idx").collect()}
    half = [(r.reg_idx, r.proc_idx) for r in similarity.pairwise_cosine(regs, same, upper=True).collect()]
    assert len(half) == len(full) == 40 * 39 // 2 and set(half) == full


def test_bad_vectors_are_not_compared(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [3.0, 4.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [None, 1.0]), (7, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "reg_idx int, embedding array<double>")
    procs = df.withColumnRenamed("reg_idx", "proc_idx")
    with pytest.raises(ValueError):
        similarity.pairwise_cosine(df, procs.where("proc_idx = 0"))
    good, bad = similarity.set_apart(df, 2)
    assert {r.reg_idx for r in good.collect()} == {0, 2, 7}
    assert {r.reg_idx: r.problem for r in bad.collect()} == {1: "null", 3: "null", 4: "element", 5: "length", 6: "element"}
    assert similarity.pairwise_cosine(good, good.withColumnRenamed("reg_idx", "proc_idx")).count() == 9


def test_lengths_are_checked(spark):
    regs, procs, _ = corpora(spark)
    assert similarity.check_dimensions(regs, procs) == 6
    with pytest.raises(ValueError):
        similarity.check_dimensions(regs, procs.withColumn("embedding", F.slice("embedding", 1, 2)))


def test_compressed_rows(spark):
    regs, procs, s = corpora(spark)
    edges = similarity.similarity_edges(similarity.pairwise_cosine(regs, procs), 7, 0.1)
    nodes = similarity.graph_nodes(spark, 7, 5)
    ptr, fill = similarity.csr(edges, nodes)
    want = [(i, j + 7) for i, j in np.argwhere(s >= 0.1)]
    assert [(r.src, r.dst) for r in fill.orderBy("pos").collect()] == want
    starts = [r.row_ptr for r in ptr.orderBy("id").collect()]
    assert starts == [sum(a < i for a, _ in want) for i in range(13)]
    none = edges.where("sim > 2")
    ptr, fill = similarity.csr(none, nodes)
    assert fill.collect() == [] and {r.row_ptr for r in ptr.collect()} == {0}
    assert {r.degree for r in similarity.out_degrees(none, nodes).collect()} == {0}
    assert similarity.edge_density(edges, 7, 5).first().density_pct == pytest.approx(100 * len(want) / 35)


def sections(spark, n, index, prefix):
    rows = [(i, f"{prefix}-{i}", f"DOE-{prefix}-{i}" if i % 2 else "", f"{i}.0", "A fairly long heading of a section" if i % 3 else "", "Preview\ntext") for i in range(n)]
    return spark.createDataFrame(rows, f"{index} int, stem string, doc_id string, section_id string, heading string, text_preview string")


def test_reports(spark):
    rng = np.random.default_rng(42)
    s = rng.uniform(0.4, 0.99, (5, 3))
    pairs = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(5) for j in range(3)], "reg_idx int, proc_idx int, sim double")
    regs, procs = sections(spark, 5, "reg_idx", "R"), sections(spark, 3, "proc_idx", "P")
    report.check_shape(pairs, 5, 3)
    with pytest.raises(AssertionError):
        report.check_shape(pairs, 5, 4)
    report.check_ranks(spark.range(8), 5, 3)
    with pytest.raises(AssertionError):
        report.check_ranks(spark.range(7), 5, 3)
    best = pairs.groupBy("reg_idx").agg(F.max_by("proc_idx", "sim").alias("proc_idx"), F.max("sim").alias("sim"))
    report.check_best(best, 5, 3)
    with pytest.raises(AssertionError):
        report.check_best(best, 6, 3)
    covered = report.coverage(best)
    t = report.coverage_summary(covered).first()
    assert t.covered + t.partial + t.gaps == t.total == 5 and t.coverage_pct == 20.0 * (s.max(1) >= 0.75).sum()
    assert report.coverage_summary(covered.limit(0)).first().coverage_pct == 0.0
    few, many = (report.gaps(best, regs, procs, x) for x in (0.5, 0.95))
    assert few.count() <= many.count() == (s.max(1) < 0.95).sum()
    assert {"reg_idx", "best_sim", "reg_label", "proc_label"} <= set(many.columns)
    label = {r.reg_idx: r.label for r in regs.select("reg_idx", report.label().alias("label")).collect()}
    assert label[0] == "R-0 | 0.0" and label[1] == "DOE-R-1 | A fairly long heading of "
    lines = [r.line for r in report.matrix_lines(covered, regs, procs).collect()] + [r.line for r in report.gap_lines(many, regs).collect()]
    assert not any("\x1b" in x for x in lines)
    low = covered.withColumn("sim", F.lit(0.001))
    assert all(x.line[40] == "—" for x in report.matrix_lines(low, regs, procs).collect())
    ranks = spark.createDataFrame([(i, 0.1 if i < 4 else 0.2) for i in range(5)], "id long, rank double")
    ranked = report.rankings(ranks, regs, "reg_idx", 0, 3).orderBy("place").collect()
    assert [(r.place, r.idx, r.medal) for r in ranked] == [(1, 4, "★"), (2, 0, "·"), (3, 1, "·")]


def test_dot(spark, tmp_path):
    pairs = spark.createDataFrame([(0, 0, 0.931), (0, 1, 0.85), (0, 2, 0.85), (0, 3, 0.8), (1, 0, 0.7)], "reg_idx int, proc_idx int, sim double")
    top = dot.styled(dot.top_edges(pairs, 0.75), 0.75)
    got = [(r.proc_idx, r.label, r.colour, r.penwidth) for r in top.orderBy("reg_idx", "k").collect()]
    assert got == [(0, "0.931", "#006400", "1.7"), (2, "0.850", "#228B22", "1.4"), (1, "0.850", "#228B22", "1.4")]
    regs, procs = sections(spark, 2, "reg_idx", "R").withColumn("heading", F.lit('say "x"\\\n')), sections(spark, 4, "proc_idx", "P")
    path = tmp_path / "g.dot"
    assert dot.write_dot(dot.dot_lines(top, regs, procs), str(path)) == 3
    text = path.read_text()
    assert text.startswith("digraph coverage {\n") and text.endswith("}\n") and text.count(" -> ") == 3
    assert r'label="R-0\nsay \"x\"\\\ ' not in text and r"say \"x\"\\" in text and text.count("shape=ellipse") == 4


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9, 4))
    df = spark.createDataFrame([("a" if i < 6 else "b" if i < 8 else "c", i, v.tolist(), i % 2) for i, v in enumerate(x)], "k string, p int, v array<double>, m int")
    u = x / (np.linalg.norm(x, axis=1)[:, None] + 1e-9)
    for block in (1024, 2):
        got = {r.k: (r.i, r.j) for r in top_pair(df, "k", "p", "v", block).collect()}
        s = np.triu(u[:6] @ u[:6].T, 1)
        s[np.tril_indices(6)] = -9
        assert got == {"a": tuple(map(int, divmod(int(s.argmax()), 6))), "b": (6, 7)}
    pooled = {r.k: r.v for r in masked_mean_pool(df, "k", "p", "v", "m").collect()}
    assert pooled["a"] == pytest.approx(x[[1, 3, 5]].mean(0)) and pooled["c"] == pytest.approx([0, 0, 0, 0])
    assert {r.k: r.n for r in norm_stats(df, "k", "v").collect()} == {"a": 6, "b": 2, "c": 1}
    texts = spark.createDataFrame([(1, "the shipping cask"), (2, "the shipping cask"), (3, None)], "i int, t string")
    made = {r.i: r.e for r in embed(texts, "t", hashing_embedder(8), "e", 2).collect()}
    assert made[1] == made[2] and len(made[1]) == 8 and set(made[3]) == {0.0}
    row = texts.select(input_text(F.lit("s"), F.lit(None).cast("string"), F.col("t")).alias("x"), l2_norm(F.array(F.lit(3.0), F.lit(4.0))).alias("n")).first()
    assert (row.x, row.n) == ("s |  | the shipping cask", 5.0)


def test_running_numbers(spark):
    df = spark.range(0, 500).select((F.col("id") * 37 % 500).alias("k")).repartition(7)
    got = similarity.sequential_index(df, ["k"], "i").collect()
    assert all(r.k == r.i for r in got) and len(got) == 500
    assert similarity.sequential_index(df.limit(0), ["k"], "i").collect() == []
    odd = spark.createDataFrame([(None, 1), (None, 2), (3, 3), (3, 4), (1, 5)], "k int, v int")
    got = similarity.sequential_index(odd, ["k"], "i").orderBy("i").collect()
    assert [r.i for r in got] == [0, 1, 2, 3, 4] and [r.k for r in got] == [None, None, 1, 3, 3] and {r.v for r in got} == {1, 2, 3, 4, 5}
    sums = similarity.running_total(df.withColumn("w", F.lit(2).cast("long")), "k", "w", "s").collect()
    assert all(r.s == 2 * r.k for r in sums) and len(sums) == 500


def test_pairs_of_blocks_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(similarity, "PACK_ROWS", 3)
    monkeypatch.setattr(similarity, "PACK_BLOCKS", 2)
    monkeypatch.setattr(similarity, "PACK_RUN", 1, raising=False)
    regs, procs, s = corpora(spark, 40, 30)
    got = similarity.pairwise_cosine(regs, procs).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in got) == s.size and len(got) > 20 and max(r["count"] for r in got) < s.size / 5


@pytest.mark.parametrize("scale", [1.0, 1e-5, 1e-160])
def test_best_of_nearly_equal_ones(scale):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 16))
    y = np.concatenate([x[:20] + 1e-6 * rng.normal(size=(20, 16)) for _ in range(8)] + [-x, np.zeros((3, 16))]) * scale  # closer than single precision tells
    x[7] = 0
    ids = rng.permutation(len(y)).astype(np.int64)
    y[11], y[31] = y[51], y[51]  # equal ones
    norms = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))
    s = np.stack([np.einsum("ij,ij->i", np.repeat(a[None], len(y), 0), y) for a in x]) / (norms + similarity.COSINE_EPS)
    best, sim = similarity._Best([(ids[a : a + 30], y[a : a + 30]) for a in range(0, len(y), 30)])(np.arange(50), x)
    top = s.max(1)
    assert np.allclose(sim, top, rtol=0, atol=1e-15) and (s[np.arange(50), np.argsort(ids)[best]] >= top - 1e-15).all()
    assert best[7] == ids.min() and best[11] == min(ids[[11, 31, 51]][s[11, [11, 31, 51]] == top[11]], default=best[11])
