"""Section tables with embeddings: reading, defaults, numbering, writing."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.similarity import sequential_index

COLUMNS = {"stem": "string", "doc_id": "string", "doc_type": "string", "subject": "string", "section_id": "string", "heading": "string", "text_preview": "string", "obligations": "int", "citations": "int"}


def with_defaults(df: DataFrame, position: str = "row_pos", keep: list[str] | None = None) -> DataFrame:
    """A section table without holes: a blank doc_id becomes the stem, a missing number the row's position, missing
    counts 0. Rows without any metadata (``has_meta`` false) are named by their position."""
    missing = ~F.col("has_meta") if "has_meta" in df.columns else F.lit(False)
    have = {c: F.col(c) if c in df.columns else F.lit(None).cast(t) for c, t in COLUMNS.items()}
    place = F.col(position).cast("string")
    return df.select(
        "stem",
        F.coalesce(F.nullif(have["doc_id"], F.lit("")), F.col("stem")).alias("doc_id"),
        F.coalesce(F.when(missing, "Order"), have["doc_type"], F.lit("Order")).alias("doc_type"),
        F.coalesce(F.when(missing, F.col("stem")), have["subject"], F.lit("")).alias("subject"),
        F.coalesce(have["section_id"], place).alias("section_id"),
        F.coalesce(F.when(missing, F.concat(F.lit("SEC-"), place)), have["heading"], F.lit("")).alias("heading"),
        F.coalesce(have["text_preview"], F.lit("")).alias("text_preview"),
        F.coalesce(have["obligations"], F.lit(0)).alias("obligations"),
        F.coalesce(have["citations"], F.lit(0)).alias("citations"),
        position,
        "embedding",
        *(keep or []),
    )


def numpy_files(spark: SparkSession, path: str) -> DataFrame:
    """``(stem, row_pos, embedding, has_meta, ...)`` of matrices ``{stem}_sections.npy`` with ``{stem}_meta.json``
    lists beside them, where there are any."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                matrix = np.load(io.BytesIO(data)).astype(np.float32)
                name = p.rsplit("/", 1)[-1].removesuffix(".npy").removesuffix("_sections")
                flat = pa.array(matrix.ravel())
                offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(matrix)), pa.array(np.arange(len(matrix), dtype=np.int32)), pa.ListArray.from_arrays(offsets, flat)], names=["stem", "row_pos", "embedding"])

    vectors = files.mapInArrow(rows, "stem string, row_pos int, embedding array<float>")
    folder = path if not path.endswith(".npy") else path.rsplit("/", 1)[0]
    item = "struct<doc_id:string,doc_type:string,subject:string,section_id:string,heading:string,text_preview:string,obligations:int,citations:int>"
    texts = spark.read.format("binaryFile").option("pathGlobFilter", "*_meta.json").load(folder)
    lists = texts.select(F.regexp_extract("path", r"([^/]+)_meta\.json$", 1).alias("stem"), F.from_json(F.col("content").cast("string"), f"array<{item}>").alias("m"))
    meta = lists.select("stem", F.posexplode("m").alias("row_pos", "m")).select("stem", "row_pos", "m.*", F.lit(True).alias("has_meta"))
    return vectors.join(meta, ["stem", "row_pos"], "left").withColumn("has_meta", F.coalesce("has_meta", F.lit(False)))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_sections(spark: SparkSession, sources: list[str]) -> DataFrame:
    """Section tables of files and folders, one after the other, numbered by ``global_idx`` from 0 in the order of
    sources, stems, files and rows. Parquet tables, or matrices with lists of metadata. FileNotFoundError for a path
    that isn't there, ValueError if nothing was found.

    Every row keeps its place: null stems come first, and rows with the same stem and position have a number each.
    Columns of a table besides those of a section are left out.
    """
    parts = []
    for i, s in enumerate(sources):
        if not _exists(spark, s):
            raise FileNotFoundError(s)
        npy = s.endswith(".npy") or not spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(s).select("path").isEmpty()
        if npy:
            part = with_defaults(numpy_files(spark, s)).withColumn("file_", F.lit(""))
        else:
            found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(s).select("path").isEmpty()
            if found:
                continue
            part = spark.read.parquet(s)
            at = F.col("row_pos").cast("long") if "row_pos" in part.columns else F.col("_metadata.row_index")
            part = part.select(*[c for c in part.columns if c not in ("row_pos", "file_")], at.alias("row_pos"), F.col("_metadata.file_path").alias("file_"))
            part = with_defaults(part, keep=["file_"])
        parts.append(part.withColumn("source_pos", F.lit(i)).withColumn("row_pos", F.col("row_pos").cast("long")))
    if not parts:
        raise ValueError("no section table in " + ", ".join(sources))
    both = reduce(DataFrame.unionByName, parts)
    return sequential_index(both, ["source_pos", "stem", "file_", "row_pos"], "global_idx").drop("source_pos", "file_", "row_pos")


def write_sections(df: DataFrame, path: str, mode: str = "append") -> None:
    """Vectors and metadata in one row each, so nothing has to stay aligned by position."""
    df.write.mode(mode).parquet(path)


def require_sections(df: DataFrame, name: str) -> None:
    if df.isEmpty():
        raise ValueError(f"{name} has no sections")


def corpus_stats(spark: SparkSession, folder: str, sections: DataFrame) -> DataFrame:
    """``(files, megabytes, sections)`` of a stored corpus: its files with vectors (matrices or Parquet, not the
    metadata beside them) and their size in units of 1,048,576 bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{npy,parquet}").load(folder)
    return files.agg(F.count("*").alias("files"), (F.coalesce(F.sum("length"), F.lit(0)) / 1_048_576).alias("megabytes")).crossJoin(sections.agg(F.count("*").alias("sections")))


def relabelled(df: DataFrame, labels: dict[str, str], other: str, column: str = "stem", name: str = "label") -> DataFrame:
    """A label for each row: that of the first key its stem contains, else ``other``."""
    out = F.lit(other)
    for key, value in reversed(labels.items()):
        out = F.when(F.lower(column).contains(key.lower()), value).otherwise(out)
    return df.withColumn(name, out)


def without_ansi(c):
    """Text without terminal escapes."""
    return F.regexp_replace(c, "\x1b\\[[0-9;]*m", "")
