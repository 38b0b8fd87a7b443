"""The queries over the test tables. Each takes the session and the tables' folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import entities
from quillstone.functions import text as tx
from quillstone.functions.vectors import masked_mean_pool
from quillstone.operators import dot, embed, graph, report, similarity
from quillstone.plans.corpora import GRAPH_THRESHOLD, STATUS_FLOOR, STATUS_THRESHOLD, corpora, self_graph
from quillstone.plans.oracles import ORACLES
from quillstone.session import materialize, shared_path
from quillstone.sources import documents as docs
from quillstone.sources.sections import corpus_stats, load_sections, require_sections, without_ansi, write_sections
from quillstone.sources.sections import relabelled as labels_of
from quillstone.streaming.ingest import ingest_state as state_of
from quillstone.streaming.ingest import start_ingest

__all__ = ["ORACLES", "QUERIES"]
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# ---- similarity ----


@query
def pairwise_cosine(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    return similarity.pairwise_cosine(c.regs, c.procs).select("reg_idx", "proc_idx", _r("sim"))


@query
def cosine_stats(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    return similarity.similarity_range(c.regs, c.procs).select(_r("min_sim"), _r("max_sim"), "pairs")


@query
def edges(spark: SparkSession, d: str) -> DataFrame:
    return corpora(spark, d).edges().select("src", "dst", _r("sim"), _r("weight"))


@query
def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    return similarity.out_degrees(c.edges(), c.nodes)


@query
def csr_row_ptr(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    return similarity.csr(c.edges(), c.nodes)[0]


@query
def csr_fill(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    return similarity.csr(c.edges(), c.nodes)[1].select("pos", "src", "dst", _r("sim"))


@query
def edge_density(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    return similarity.edge_density(c.edges(), c.num_regs, c.num_procs).select("num_edges", _r("density_pct"))


# ---- coverage ----


@query
def best_match(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    return similarity.best_matches(c.regs, c.procs).select("reg_idx", "proc_idx", _r("sim"))


@query
def coverage_status(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    best = similarity.best_matches(c.regs, c.procs)
    covered = report.coverage(best, STATUS_THRESHOLD, STATUS_FLOOR)
    named = covered.join(c.regs.select("reg_idx", report.label().alias("reg_label")), "reg_idx").join(c.procs.select("proc_idx", report.label().alias("proc_label")), "proc_idx")
    return named.select("reg_idx", "proc_idx", _r("sim"), "status", "reg_label", "proc_label")


@query
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    covered = report.coverage(similarity.best_matches(c.regs, c.procs), STATUS_THRESHOLD, STATUS_FLOOR)
    return report.coverage_summary(covered).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query
def coverage_default_threshold(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    covered = report.coverage(similarity.best_matches(c.regs, c.procs))
    summary = report.coverage_summary(covered).withColumn("coverage_pct", F.round("coverage_pct", 6))
    return summary.crossJoin(c.edges(report.THRESHOLD).agg(F.count("*").alias("edges")))  # one row each


@query
def gap_list(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    found = report.gaps(similarity.best_matches(c.regs, c.procs), c.regs, c.procs, STATUS_THRESHOLD, STATUS_FLOOR)
    return found.select("reg_idx", "best_proc", _r("best_sim"), "reg_label", "proc_label", "severity")


@query
def gap_totals(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    return report.gap_totals(report.gaps(similarity.best_matches(c.regs, c.procs), c.regs, c.procs, STATUS_THRESHOLD, STATUS_FLOOR))


@query
def gap_lines(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    found = report.gaps(similarity.best_matches(c.regs, c.procs), c.regs, c.procs, STATUS_THRESHOLD, STATUS_FLOOR)
    return report.gap_lines(found, c.regs.withColumn("text_preview", F.concat("heading", F.lit("\nof "), "stem")))


@query
def one_pass(spark: SparkSession, d: str) -> DataFrame:
    """Best matches, edges and range from one pass over all pairs, as the reports take them."""
    c = corpora(spark, d)
    seen = similarity.compare(c.regs, c.procs, GRAPH_THRESHOLD)
    report.check_best(seen.best, c.num_regs, c.num_procs)
    b = seen.best.agg(F.count("*").alias("sources"), F.round(F.sum("sim"), 6).alias("best_sum"))
    e = seen.pairs.agg(F.count("*").alias("edges"), F.round(F.sum("sim"), 6).alias("edge_sum"))
    return seen.span.select(_r("min_sim"), _r("max_sim"), "pairs").crossJoin(b).crossJoin(e)  # one row each


@query
def labels(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "sections").select("global_idx", report.label().alias("label"), report.label(28).alias("ranking_label")).distinct()


@query
def matrix_lines(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    covered = report.coverage(similarity.best_matches(c.regs, c.procs), STATUS_THRESHOLD, STATUS_FLOOR)
    return report.matrix_lines(covered, c.regs, c.procs)


@query
def dot_edges(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    top = dot.styled(dot.top_edges(similarity.pairwise_cosine(c.regs, c.procs, GRAPH_THRESHOLD), GRAPH_THRESHOLD), GRAPH_THRESHOLD)
    return top.select("reg_idx", "k", "proc_idx", "colour", "penwidth", "label")


@query
def dot_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "sections").select("global_idx", "doc_id", "stem", "heading", "section_id").distinct()
    return dot.node_lines(rows, "global_idx", "SRC", "box", "lightblue")


@query
def dot_file(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the graph's file as it was written."""
    c = corpora(spark, d)
    top = dot.styled(dot.top_edges(similarity.pairwise_cosine(c.regs, c.procs, GRAPH_THRESHOLD), GRAPH_THRESHOLD), GRAPH_THRESHOLD)
    path = shared_path(spark, "drawing") + "/graph.dot"
    dot.write_dot(dot.dot_lines(top, c.regs, c.procs), path)
    return _lines(spark, path).select("n", "line")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The numbered lines of one file."""
    text = spark.read.text(path, wholetext=True).select(F.split(F.rtrim("value", F.lit("\n")), "\n").alias("x"))
    return text.select(F.posexplode("x").alias("i", "line")).select((F.col("i") + 1).cast("long").alias("n"), "line")


@query
def report_file(spark: SparkSession, d: str) -> DataFrame:
    """The command line's reports of coverage and gaps over stored sections, as they were written to files."""
    from quillstone import cli

    c = corpora(spark, d)
    regs, procs = shared_path(spark, "regs"), shared_path(spark, "procs")
    write_sections(c.regs.withColumn("row_pos", F.col("reg_idx")).withColumn("stem", F.lit("REGS")), regs)
    write_sections(c.procs.withColumn("row_pos", F.col("proc_idx")).withColumn("stem", F.lit("PROCS")), procs)
    folder, out = shared_path(spark, "reports"), []
    for kind in ("coverage", "gaps"):
        cli.main(["report", "--regs", regs, "--procs", procs, "--threshold", str(STATUS_THRESHOLD), "--type", kind, "--output", f"{folder}/{kind}"], spark)
        out.append(_lines(spark, f"{folder}/{kind}").select(F.lit(kind).alias("kind"), "n", "line"))
    return out[0].unionByName(out[1])


# ---- vectors and loading ----


@query
def l2_norm_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = embed.norm_stats(_read(spark, d, "embeddings"), "label")
    return stats.select("label", _r("min_norm"), _r("max_norm"), _r("mean_norm"), "n")


@query
def top_pair_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return embed.top_pair(_read(spark, d, "embeddings"), "label", "vec_id").select("label", "i", "j", _r("sim"))


@query
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    tokens = _read(spark, d, "embeddings").withColumn("mask", (F.col("embedding")[0] > 0).cast("int"))
    pooled = masked_mean_pool(tokens, "label", "vec_id", "embedding", "mask")
    return pooled.select("label", F.posexplode("embedding").alias("dim", "value")).select("label", "dim", _r("value"))


@query
def embed_input_text(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "sections").select("global_idx", embed.input_text(F.col("subject"), F.col("heading"), F.col("text_preview")).alias("input"))
    return rows.distinct()


@query
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Every parsed section embedded by the offline model; elements that are not 0."""
    rows = _read(spark, d, "parsed_sections").select("section_key", embed.input_text(None, F.col("heading"), F.col("text")).alias("input")).distinct()
    made = embed.embed(rows, "input", embed.hashing_embedder())
    return made.select("section_key", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "value")).where("value != 0").select("section_key", "dim", _r("value", 4))


@query
def load_union(spark: SparkSession, d: str) -> DataFrame:
    """The sections twice behind each other, as they are, with repeated rows, bad vectors and all: the numbers of each
    stem's rows in each of the two."""
    table = f"{d}/sections.parquet"
    both = load_sections(spark, [table, table])
    n = both.count() // 2
    each = both.withColumn("source", F.when(F.col("global_idx") < n, 0).otherwise(1))
    return each.groupBy("source", "stem").agg(F.min("global_idx").alias("first"), F.max("global_idx").alias("last"), F.count("*").alias("rows"), F.count_distinct("global_idx").alias("numbers"))


@query
def load_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row that was loaded, with defaults, and how often."""
    rows = load_sections(spark, [f"{d}/sections.parquet"])
    columns = ["stem", "doc_id", "doc_type", "subject", "section_id", "heading", "text_preview", "obligations", "citations"]
    return rows.groupBy(*columns, F.coalesce(F.size("embedding"), F.lit(-1)).alias("dims")).agg(F.count("*").alias("rows"))


@query
def stored_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections written and read again, and what the store says of itself."""
    path = shared_path(spark, "store")
    write_sections(load_sections(spark, [f"{d}/sections.parquet"]).coalesce(1), path)
    again = load_sections(spark, [path])
    require_sections(again, "the store")
    return corpus_stats(spark, path, again).select("files", "sections", (F.col("megabytes") > 0).alias("has_bytes"))


@query
def vector_problems(spark: SparkSession, d: str) -> DataFrame:
    """Rows of sections by what keeps their vectors from being compared."""
    good, bad = similarity.set_apart(_read(spark, d, "sections"), 64)
    told = good.select(F.lit("none").alias("problem")).unionByName(bad.select("problem"))
    return told.groupBy("problem").agg(F.count("*").alias("rows"))


@query
def dirty_best(spark: SparkSession, d: str) -> DataFrame:
    """The cosine join over a dirty table: every fourth section's highest cosine among the others, bad vectors set
    apart."""
    good, _ = similarity.set_apart(_read(spark, d, "sections").select("global_idx", "embedding").distinct(), 64)
    good = materialize(good, "good")  # read several times below
    source = F.col("global_idx") % 4 == 0
    best = similarity.best_matches(good.where(source).withColumnRenamed("global_idx", "reg_idx"), good.where(~source).withColumnRenamed("global_idx", "proc_idx"))
    return best.select("reg_idx", _r("sim"))


@query
def relabelled(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "parsed_documents").select("stem", F.concat(F.lit("\x1b[1m"), "subject", F.lit("\x1b[0m")).alias("shown")).distinct()
    named = labels_of(rows, {"740": "First", "O-": "Order"}, "Other")
    return named.select("stem", "label", without_ansi(F.col("shown")).alias("subject"))


@query
def stem_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Documents under several paths; a copy of the folder is another path."""
    files = _read(spark, d, "parsed_documents").select("stem", "source_file")
    found = docs.stem_collisions(files.unionByName(files.select("stem", F.concat(F.lit("mirror/"), "source_file").alias("source_file"))), "stem", "source_file")
    return found.select("stem", "n", F.array_join("paths", "|").alias("paths"))


@query
def skip_done(spark: SparkSession, d: str) -> DataFrame:
    """Of two folders' documents those of which no section has been parsed yet."""
    files = _read(spark, d, "parsed_documents").select("stem").unionByName(_read(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("stem"))).distinct()
    return docs.not_done(files, _read(spark, d, "parsed_sections")).select("stem")


@query
def empty_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a text have no sections."""
    rows = _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("stem"), "text")
    return embed.empty_documents(rows.select("stem"), docs.parse_sections(rows)).select("stem")


def _files(spark: SparkSession, d: str) -> str:
    """The documents as files, one each; one without a text becomes a PDF file that can't be decoded."""
    folder = shared_path(spark, "files")
    rows = _read(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.coalesce(F.col("text").cast("binary"), F.lit(b"%PDF-broken")).alias("content"))
    docs.write_files(rows, "name", "content", folder)
    return folder


@query
def document_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as files, found and decoded again."""
    read = docs.decode(docs.discover(spark, _files(spark, d)))
    return read.select("stem", "page_count", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"), F.col("error").isNotNull().alias("failed"))


@query
def first_files(spark: SparkSession, d: str) -> DataFrame:
    """The first five files by path, as in test mode."""
    return docs.discover(spark, _files(spark, d), limit=5).select("stem", "length")


@query
def ingest(spark: SparkSession, d: str) -> DataFrame:
    """The sections that the ingest stream wrote of the documents' files."""
    out = shared_path(spark, "ingested")
    start_ingest(spark, _files(spark, d), out, f"{out}/checkpoint", files_per_batch=2000, timeout=60).awaitTermination()
    return spark.read.parquet(f"{out}/sections").select("stem", "section_pos", "section_id", "heading", "text_preview", "obligations", "citations", F.size("embedding").alias("dims"))


@query
def ingest_state(spark: SparkSession, d: str) -> DataFrame:
    """What the ingest says of itself."""
    source, out = _files(spark, d), shared_path(spark, "ingested")
    start_ingest(spark, source, out, f"{out}/checkpoint", files_per_batch=2000).awaitTermination()
    s = state_of(spark, source, out)
    return spark.createDataFrame([(s.files, s.done, s.failed, s.backlog, s.percent)], "files long, done long, failed long, backlog long, percent double")


# ---- graph ----


@query
def bfs(spark: SparkSession, d: str) -> DataFrame:
    e, n = self_graph(spark, d)
    return graph.bfs(e, n, 0)


@query
def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    e, n = self_graph(spark, d)
    return graph.bfs_levels(graph.bfs(e, n, 0))


@query
def bfs_gaps(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    return graph.bfs_gaps(graph.bfs(c.edges(), c.nodes, 0), c.nodes)


@query
def bfs_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    return graph.bfs_coverage(graph.bfs(c.edges(), c.nodes, 0), c.nodes).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query
def bfs_from_many(spark: SparkSession, d: str) -> DataFrame:
    """The search from every source section at once."""
    c = corpora(spark, d)
    return graph.bfs_from_many(c.edges(), c.nodes.where("kind = 'REG'"))


@query
def undirected_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.undirected(corpora(spark, d).edges()).select("src", "dst", _r("weight"))


@query
def topo_order(spark: SparkSession, d: str) -> DataFrame:
    return graph.topological_sort(*self_graph(spark, d))


@query
def topo_levels(spark: SparkSession, d: str) -> DataFrame:
    order = graph.topological_sort(*self_graph(spark, d))
    return order.groupBy("level").agg(F.count("*").alias("nodes"))


@query
def cycle_check(spark: SparkSession, d: str) -> DataFrame:
    """The graph with one more edge, from the largest id back to the smallest: it then may have a cycle."""
    e, n = self_graph(spark, d)
    back = n.agg(F.max("id").alias("src"), F.min("id").alias("dst"))
    return graph.cycle_check(graph.topological_sort(e.select("src", "dst").unionByName(back), n), n)


@query
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    e, n = self_graph(spark, d)
    return graph.pagerank(e, n, tol=1e-13).select("id", F.round(F.col("rank") + 1e-12, 8).alias("rank"))  # ranks are fractions, some half of a last digit


def _rounded_ranks(c) -> DataFrame:
    # ties between equal sums in different orders are broken by the index
    return graph.pagerank(c.edges(), c.nodes).select("id", F.round(F.col("rank") + 1e-12, 9).alias("rank"))


@query
def rank_sources(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    return report.rankings(_rounded_ranks(c), c.regs, "reg_idx", 0, 15)


@query
def rank_targets(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    return report.rankings(_rounded_ranks(c), c.procs, "proc_idx", c.num_regs, 10)


@query
def rank_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of all sections, of either corpus."""
    return graph.top_ranked(_rounded_ranks(corpora(spark, d)))


@query
def ranking_lines(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    ranks = _rounded_ranks(c)
    report.check_ranks(ranks, c.num_regs, c.num_procs)
    return report.ranking_lines(report.rankings(ranks, c.regs, "reg_idx", 0, 15))


@query
def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    return report.hierarchy(graph.topological_sort(c.edges(), c.nodes), c.regs, c.procs, c.num_regs)


@query
def sssp(spark: SparkSession, d: str) -> DataFrame:
    e, n = self_graph(spark, d)
    return graph.sssp(e, n, 0).select("id", _r("dist"), "pred")


@query
def sssp_path(spark: SparkSession, d: str) -> DataFrame:
    """The shortest ways from the first vector to all that it reaches."""
    e, n = self_graph(spark, d)
    found = materialize(graph.sssp(e, n, 0), "tree")
    return graph.shortest_paths(found, n).select("id", F.array_join("path", ">").alias("path"))


@query
def strongest_paths(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    return graph.strongest_paths(graph.sssp(c.edges(), c.nodes, 0), c.nodes).select("id", "local_idx", _r("dist"), _r("similarity"))


@query
def distance_summary(spark: SparkSession, d: str) -> DataFrame:
    e, n = self_graph(spark, d)
    return graph.distance_summary(graph.sssp(e, n, 0), n).select("reachable", _r("reachable_pct"), _r("min_dist"), _r("max_dist"))


@query
def apsp(spark: SparkSession, d: str) -> DataFrame:
    return graph.apsp(*self_graph(spark, d)).select("src", "dst", _r("dist"))


@query
def apsp_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    return graph.apsp_coverage(graph.apsp(c.edges(), c.nodes), c.nodes).withColumn("reachable_pct", F.round("reachable_pct", 6))


@query
def mst_edges(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    return graph.minimum_spanning_forest(c.edges(), c.nodes).select("src", "dst", _r("weight"))


@query
def mst_stats(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    stats = graph.forest_stats(graph.minimum_spanning_forest(c.edges(), c.nodes), c.nodes)
    return stats.select("edges", _r("total_weight"), _r("mean_similarity"), "targets", _r("targets_pct"))


@query
def mst_top_links(spark: SparkSession, d: str) -> DataFrame:
    c = corpora(spark, d)
    return graph.top_links(graph.minimum_spanning_forest(c.edges(), c.nodes)).select("src", "dst", _r("similarity"))


# ---- text ----


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "parsed_sections").select("section_key", F.coalesce("text", F.lit("")).alias("text")).distinct()


def _cited(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _parts(spark, d).select("section_key", F.explode(tx.references(F.col("text"), kind)).alias("reference")).distinct()

    run.__name__ = f"cite_{kind}"
    return query(run)


for _kind in tx.CITATIONS:
    _cited(_kind)


@query
def citations(spark: SparkSession, d: str) -> DataFrame:
    """References of all kinds with their surroundings."""
    return _parts(spark, d).select("section_key", F.inline(tx.citations(F.col("text"))))


@query
def obligations(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.inline(tx.obligations(F.col("text")))).distinct()


@query
def definitions(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select("section_key", F.inline(tx.definitions(F.col("text"))))


@query
def dates(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select("section_key", F.explode(tx.dates(F.col("text"))).alias("date")).distinct()


@query
def document_dates(spark: SparkSession, d: str) -> DataFrame:
    """The approval dates as typed, normalised."""
    rows = _read(spark, d, "parsed_documents").where("approved_date is not null").select("approved_date").distinct()
    return rows.select("approved_date", tx.normalized_date(F.col("approved_date")).alias("date"))


@query
def agencies(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.explode(tx.agencies(F.col("text"))).alias("agency")).distinct()


@query
def doc_metadata(spark: SparkSession, d: str) -> DataFrame:
    meta = [c.alias("found_id" if n == "doc_id" else n) for n, c in tx.metadata(F.col("text")).items()]
    return _texts(spark, d).select("doc_id", *meta).distinct()


@query
def header_strip(spark: SparkSession, d: str) -> DataFrame:
    clean = tx.clean_text(F.col("text"))
    return _texts(spark, d).select("doc_id", F.length(clean).alias("n_chars"), F.md5(clean.cast("binary")).alias("digest"), tx.near_empty(F.col("text")).alias("near_empty")).distinct()


@query
def organisations(spark: SparkSession, d: str) -> DataFrame:
    """Bodies that the offline rule finds in whole texts."""
    return _parts(spark, d).select("section_key", F.explode(entities.organisations(F.col("text"))).alias("name"))


@query
def truncation(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut as for a model of 2,048 characters."""
    cut = tx.truncated(F.col("text"))
    return _parts(spark, d).select("section_key", F.length(cut).alias("n_chars"), F.md5(cut.cast("binary")).alias("digest"))


@query
def sections_split(spark: SparkSession, d: str) -> DataFrame:
    rows = tx.split_sections(_texts(spark, d).withColumn("text", tx.clean_text(F.col("text"))), "text")
    each = rows.select("doc_id", F.posexplode("sections").alias("pos", "s"))
    return each.select("doc_id", "pos", F.col("s.section_id").alias("section_id"), F.col("s.heading").alias("heading"), F.length("s.text").alias("n_chars"), F.md5(F.col("s.text").cast("binary")).alias("digest"))


@query
def section_facts(spark: SparkSession, d: str) -> DataFrame:
    """Every section of the documents with its facts; agencies are its document's."""
    rows = docs.parse_sections(_texts(spark, d).select(F.col("doc_id").cast("string").alias("stem"), "text"))
    cols = [("citations", "reference"), ("obligations", "sentence"), ("definitions", "term")]
    return rows.select("stem", "section_pos", *[F.array_join(F.col(c)[f], "|").alias(c) for c, f in cols], F.array_join("dates", "|").alias("dates"), F.array_join("agencies", "|").alias("agencies"))


@query
def fact_counts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of facts and previews of all parsed sections, repeated rows once."""
    rows = _read(spark, d, "parsed_sections").select("section_key", "text", F.size("obligations").alias("obligations"), F.size("citations").alias("citations")).distinct()
    return rows.select("section_key", "obligations", "citations", tx.preview(F.col("text")).alias("text_preview"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return docs.parse_documents(_texts(spark, d).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").cast("string").alias("stem"), F.lit(1).alias("page_count"), "text"))


def _summary(parsed: DataFrame) -> DataFrame:
    first = [("first_citations", "reference"), ("first_obligations", "sentence"), ("first_definitions", "term")]
    head = docs.document_summary(parsed)
    return head.select("source_file", F.col("doc_id").alias("found_id"), "doc_type", "subject", "approved_date", "initiating_office", "sections", "citations", "obligations", "definitions", "agencies", *[F.array_join(F.col(c)[f], "|").alias(c) for c, f in first])


@query
def document_summary(spark: SparkSession, d: str) -> DataFrame:
    return _summary(_parsed(spark, d))


@query
def parsed_json(spark: SparkSession, d: str) -> DataFrame:
    """The same of documents written as JSON and read again."""
    path = shared_path(spark, "parsed")
    docs.write_parsed(_parsed(spark, d), path)
    return _summary(docs.read_parsed(spark, path))
