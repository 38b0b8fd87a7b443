"""Command line: analyze, report, benchmark, ingest."""

from __future__ import annotations

import argparse
import statistics
import sys
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import dot, graph, report, similarity
from quillstone.session import build_session, materialize, text_output
from quillstone.sources.sections import load_sections, require_sections

REPORTS = ("gaps", "coverage", "rankings", "hierarchy")
KERNELS = ("cosine", "graph", "full")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillstone", description="How two corpora of documents relate.")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "report"):
        c = commands.add_parser(name)
        c.add_argument("--regs", nargs="+", required=True, help="section tables of the source corpus")
        c.add_argument("--procs", nargs="+", required=True, help="section tables of the target corpus")
        c.add_argument("--threshold", type=float, default=report.THRESHOLD)
        if name == "analyze":
            c.add_argument("--graph", help="file for the graph in DOT")
            c.add_argument("--verbose", action="store_true", help="distances from the first source")
        else:
            c.add_argument("--type", choices=REPORTS, required=True)
            c.add_argument("--output", help="file for the report")
    c = commands.add_parser("benchmark")
    c.add_argument("--kernel", choices=KERNELS, default="full")
    c = commands.add_parser("ingest")
    c.add_argument("--input-dir", required=True)
    c.add_argument("--output-dir", required=True)
    c.add_argument("--checkpoint")
    c.add_argument("--files-per-batch", type=int, default=200, help="files in a batch of the stream")
    c.add_argument("--batch-size", type=int, help="texts that the model gets at once")
    c.add_argument("--workers", type=int, help="tasks that decode and parse at the same time")
    c.add_argument("--section-limit", type=int, help="cut sections to so many characters before facts are looked for")
    c.add_argument("--timeout", type=float, default=30.0, help="seconds after which a file's decoding is given up")
    c.add_argument("--follow", action="store_true", help="wait for more files")
    return p


def _load(spark: SparkSession, sources: list[str], index: str, name: str) -> tuple[DataFrame, int]:
    df = materialize(load_sections(spark, sources).withColumnRenamed("global_idx", index), name)
    require_sections(df, name)
    return df, df.count()


def _text(lines: DataFrame, order: str) -> list[str]:
    return [r.line for r in lines.orderBy(order).toLocalIterator()]


class Session:
    """Both corpora, and what is computed of them at most once."""

    def __init__(self, spark: SparkSession, regs: list[str], procs: list[str], threshold: float):
        self.threshold = threshold
        self.regs, self.m = _load(spark, regs, "reg_idx", "source corpus")
        self.procs, self.n = _load(spark, procs, "proc_idx", "target corpus")
        self.nodes = similarity.graph_nodes(spark, self.m, self.n)
        seen = similarity.compare(self.regs, self.procs, threshold)  # checks the vectors; one pass over all pairs
        self.best, self.pairs, self.span = seen.best, seen.pairs, seen.span
        report.check_best(self.best, self.m, self.n)
        self.edges = similarity.similarity_edges(self.pairs, self.m, threshold)

    def coverage(self) -> list[str]:
        covered = report.coverage(self.best, self.threshold)
        s = report.coverage_summary(covered).first()
        head = [f"Best matches at threshold {self.threshold:.2f}", f"{self.m} source sections, {self.n} target sections"]
        return [*head, *_text(report.matrix_lines(covered, self.regs, self.procs), "reg_idx"), f"Covered {s.covered}, partial {s.partial}, gap {s.gaps}; coverage {s.coverage_pct:.1f} %"]

    def gaps(self) -> list[str]:
        found = materialize(report.gaps(self.best, self.regs, self.procs, self.threshold), "gaps")
        totals = {r.severity: r.n for r in report.gap_totals(found).collect()}
        total = sum(totals.values())
        head = [f"Gaps at threshold {self.threshold:.2f}", f"{total} of {self.m} source sections lack a match"]
        if not total:
            return [*head, "Every source section has a match."]
        return [*head, *_text(report.gap_lines(found, self.regs), "reg_idx"), f"{totals.get('NO MATCH', 0)} below {report.PARTIAL_FLOOR:g}, {totals.get('PARTIAL', 0)} between"]

    def rankings(self, top: int) -> list[str]:
        if self.pairs.isEmpty():
            return ["No edges: nothing to rank."]
        ranks = materialize(graph.pagerank(self.edges, self.nodes), "ranks")
        report.check_ranks(ranks, self.m, self.n)
        out = [f"Source sections by PageRank, the first {top}", *_text(report.ranking_lines(report.rankings(ranks, self.regs, "reg_idx", 0, top)), "place")]
        if self.m > top:
            out.append(f"  ... {self.m - top} more source sections")
        few = min(top, 10)
        return [*out, f"Target sections by PageRank, the first {few}", *_text(report.ranking_lines(report.rankings(ranks, self.procs, "proc_idx", self.m, few)), "place")]

    def hierarchy(self) -> list[str]:
        if self.pairs.isEmpty():
            return ["No edges: no hierarchy."]
        order = graph.topological_sort(self.edges, self.nodes)
        rows = report.hierarchy(order, self.regs, self.procs, self.m)
        return _text(rows.select("pos", F.format_string("%5d  [%-4s]  %s", "pos", "kind", "label").alias("line")), "pos")

    def distances(self) -> list[str]:
        s = graph.distance_summary(graph.sssp(self.edges, self.nodes, 0), self.nodes).first()
        return [f"Shortest ways from source 0: {s.reachable} nodes, distances {s.min_dist:.4f} to {s.max_dist:.4f}"]

    def write_dot(self, path: str) -> int:
        top = dot.styled(dot.top_edges(self.pairs, self.threshold), self.threshold)
        return dot.write_dot(dot.dot_lines(top, self.regs, self.procs), path)


def median_of(run: Callable[[], object], times: int = 5) -> float:
    """Median seconds of some runs after one that isn't counted."""
    run()
    took = []
    for _ in range(times):
        start = time.perf_counter()
        run()
        took.append(time.perf_counter() - start)
    return statistics.median(took)


def _random(spark: SparkSession, n: int, dim: int, index: str, seed: int) -> DataFrame:
    cells = spark.range(n).select(F.col("id").cast("int").alias(index), F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (F.xxhash64(F.lit(seed), "id", i) % 2000 / 1000.0).cast("float")).alias("embedding"))
    return materialize(cells, "random")


def benchmark(spark: SparkSession, kernel: str) -> list[str]:
    def full(df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    out = []
    if kernel in ("cosine", "full"):
        for m, n in ((100, 100), (1000, 500), (10000, 500)):
            a, b = _random(spark, m, 768, "reg_idx", 1), _random(spark, n, 768, "proc_idx", 2)
            t = median_of(lambda a=a, b=b: full(similarity.best_matches(a, b)))
            out.append(f"cosine {m} x {n} x 768: {t * 1000:.1f} ms, {m * n / t / 1e6:.1f} M pairs/s")
    if kernel in ("graph", "full"):
        for m, n in ((500, 500), (1000, 500)):
            rng = np.random.default_rng(42)
            s = rng.random((m, n))
            i, j = np.nonzero(s >= 0.75)
            edges = materialize(spark.createDataFrame(list(zip(i.tolist(), (j + m).tolist(), (1 - s[i, j]).tolist(), strict=True)), "src int, dst int, weight double"), "edges")
            nodes = similarity.graph_nodes(spark, m, n)
            for name, run in (("bfs", graph.bfs), ("topological sort", graph.topological_sort), ("pagerank", graph.pagerank), ("spanning forest", graph.minimum_spanning_forest), ("shortest paths", graph.sssp), ("all pairs", graph.apsp)):
                out.append(f"{name}, {m + n} nodes, {len(i)} edges: {median_of(lambda run=run: full(run(edges, nodes))) * 1000:.0f} ms")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or build_session()
    spark.sparkContext.setLogLevel("ERROR")
    if args.command == "benchmark":
        print(*benchmark(spark, args.kernel), sep="\n")
        return 0
    if args.command == "ingest":
        from quillstone.streaming.ingest import Progress, ingest_state, start_ingest

        progress = Progress()
        spark.streams.addListener(progress)
        q = start_ingest(spark, args.input_dir, args.output_dir, args.checkpoint or f"{args.output_dir}/checkpoint", files_per_batch=args.files_per_batch, once=not args.follow, limit=args.section_limit, workers=args.workers, batch=args.batch_size, timeout=args.timeout)
        q.awaitTermination()
        state = ingest_state(spark, args.input_dir, args.output_dir)
        print(f"{state.done} of {state.files} files done ({state.percent:.0f} %), {state.failed} failed, {state.backlog} waiting, {state.sections} sections; {progress.batches} batches, {progress.files_per_minute:.0f} files a minute")
        return 0
    try:
        s = Session(spark, args.regs, args.procs, args.threshold)
    except (FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if args.command == "report":
        lines = s.rankings(20) if args.type == "rankings" else getattr(s, args.type)()
        if args.output:
            with text_output(args.output) as write:
                write("\n".join(lines) + "\n")
        else:
            print(*lines, sep="\n")
        return 0
    stats = s.span.first()
    n = s.pairs.count()
    print(f"Similarity: {s.m} x {s.n}, range [{stats.min_sim:.4f}, {stats.max_sim:.4f}]; {n} edges, density {100 * n / max(s.m * s.n, 1):.2f}%")
    parts = [s.coverage(), s.gaps(), s.rankings(15), *([s.distances()] if args.verbose and n else [])]
    for lines in parts:
        print("", *lines, sep="\n")
    if args.graph:
        print(f"\nGraph: {args.graph}, {s.write_dot(args.graph)} edges")
    return 0


if __name__ == "__main__":
    sys.exit(main())
