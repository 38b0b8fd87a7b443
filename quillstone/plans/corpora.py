"""The two corpora and the graphs that the queries are about, from the table ``embeddings``.

By the test convention every fourth vector belongs to the source corpus and the others to the target corpus: the
whole table is used, parted in two.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.similarity import edge_weight, graph_nodes, pairwise_cosine, sequential_index, similarity_edges
from quillstone.session import materialize

GRAPH_THRESHOLD, STATUS_THRESHOLD, STATUS_FLOOR = 0.30, 0.35, 0.30


@dataclass
class Corpora:
    regs: DataFrame
    procs: DataFrame
    num_regs: int
    num_procs: int

    @property
    def nodes(self) -> DataFrame:
        return graph_nodes(self.regs.sparkSession, self.num_regs, self.num_procs)

    def edges(self, threshold: float = GRAPH_THRESHOLD) -> DataFrame:
        """Written down once: graph algorithms read their edges several times."""
        return materialize(similarity_edges(pairwise_cosine(self.regs, self.procs, threshold), self.num_regs, threshold), "edges")


def corpora(spark: SparkSession, d: str) -> Corpora:
    """Both corpora, numbered: sources first, so one running number serves both."""
    table = spark.read.parquet(f"{d}/embeddings.parquet")
    doc = F.concat(F.lit("DOC-"), F.col("label").cast("string"))
    named = table.select("vec_id", "embedding", doc.alias("stem"), F.col("vec_id").cast("string").alias("section_id"), F.concat(F.lit("SEC-"), F.col("vec_id").cast("string")).alias("heading"), F.lit("Order").alias("doc_type"), F.lit("").alias("subject"), F.lit("").alias("text_preview"), doc.alias("doc_id"), (F.col("vec_id") % 4 != 0).alias("target"))
    both = sequential_index(named, ["target", "vec_id"], "node")
    n = {r.target: r["count"] for r in both.groupBy("target").count().collect()}
    m = n.get(False, 0)
    regs = both.where("not target").withColumnRenamed("node", "reg_idx").drop("target")
    procs = both.where("target").withColumn("proc_idx", F.col("node") - m).drop("target", "node")
    return Corpora(regs, procs, m, n.get(True, 0))


def self_graph(spark: SparkSession, d: str, threshold: float = GRAPH_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of the similarity graph of all vectors, from the smaller to the larger id: a general graph
    without cycles."""
    table = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("i"), "embedding")
    pairs = pairwise_cosine(table.withColumnRenamed("i", "reg_idx"), table.withColumnRenamed("i", "proc_idx"), threshold, upper=True)
    edges = pairs.select(F.col("reg_idx").alias("src"), F.col("proc_idx").alias("dst"), "sim", edge_weight(F.col("sim")).alias("weight"))
    return materialize(edges, "edges"), table.select(F.col("i").alias("id"))
