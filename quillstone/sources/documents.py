"""Finding, decoding and parsing documents; reading and writing what was parsed."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.session import arrow_filesystem

#: Decoder of one file's bytes: text and number of pages.
Decoder = Callable[[bytes], tuple[str, int]]
#: Expression over a document's cleaned text that gives the agencies it names.
Agencies = Callable[[Column], Column]

# The fields of the stored form.

CITATION = "struct<cit_type:string,reference:string,context:string>"
OBLIGATION = "struct<modal:string,sentence:string>"
DEFINITION = "struct<term:string,definition:string>"
SECTION = f"struct<section_id:string,heading:string,text:string,citations:array<{CITATION}>,obligations:array<{OBLIGATION}>,definitions:array<{DEFINITION}>,dates:array<string>,agencies:array<string>>"
PARSED = f"source_file string, doc_id string, doc_type string, subject string, approved_date string, initiating_office string, page_count int, sections array<{SECTION}>, all_citations array<{CITATION}>, all_obligations array<{OBLIGATION}>, all_definitions array<{DEFINITION}>"
DEFAULT_GLOB = "*.{pdf,PDF,txt,TXT}"


def plain_text(data: bytes) -> tuple[str, int]:
    """Decodes text files: pages are parted by form feeds and joined by blank lines."""
    pages = data.decode("utf-8", "replace").split("\f")
    return "\n\n".join(pages), len(pages)


def pdf_text(data: bytes) -> tuple[str, int]:
    """Decodes PDF files where PyMuPDF is installed."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("decoding PDF files needs PyMuPDF") from e
    with fitz.open(stream=data, filetype="pdf") as doc:
        pages = [page.get_text() for page in doc]
    return "\n\n".join(pages), len(pages)


def by_content(data: bytes) -> tuple[str, int]:
    return pdf_text(data) if data[:5] == b"%PDF-" else plain_text(data)


def discover(spark: SparkSession, folder: str, glob: str = DEFAULT_GLOB, limit: int | None = None) -> DataFrame:
    """Files below a folder, ``(path, length, stem, content)``; the content isn't read unless it is used. With
    ``limit``, the first ones by path (test mode). FileNotFoundError if there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no document below {folder}")
    files = files.select("path", "length", stem_of(F.col("path")).alias("stem"), "content")
    return files if limit is None else files.orderBy("path").limit(limit)


def stem_of(path):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def stem_collisions(files: DataFrame, stem: str = "stem", path: str = "path") -> DataFrame:
    """``(stem, n, paths)`` of stems under several paths."""
    each = files.select(stem, path).distinct()
    return each.groupBy(stem).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(path)).alias("paths")).where("n > 1")


def not_done(files: DataFrame, done: DataFrame, stem: str = "stem") -> DataFrame:
    """Files whose stem has no output yet."""
    return files.join(done.select(stem).distinct(), stem, "left_anti")


class _Guarded:
    """A decoder in a child process of its own, which is stopped and replaced if a file takes too long. Results come
    through a pipe that is read while the child still runs, so a large one can't block it."""

    def __init__(self, decoder: Decoder, seconds: float):
        self.decoder, self.seconds, self.child = decoder, seconds, None

    def _serve(self, pipe) -> None:
        while True:
            try:
                data = pipe.recv_bytes()
            except EOFError:
                return
            try:
                pipe.send((*self.decoder(data), None))
            except Exception as e:
                pipe.send((None, None, f"{type(e).__name__}: {e}"))

    def __call__(self, data: bytes) -> tuple[str, int]:
        if self.child is None:
            self.pipe, other = multiprocessing.get_context("fork").Pipe()
            self.child = multiprocessing.get_context("fork").Process(target=self._serve, args=(other,), daemon=True)
            self.child.start()
            other.close()
        self.pipe.send_bytes(data)
        if not self.pipe.poll(self.seconds):
            self.close()
            raise TimeoutError(f"not decoded within {self.seconds:g} s")
        try:
            text, pages, error = self.pipe.recv()
        except EOFError:
            self.close()
            raise RuntimeError("the decoder's process ended") from None
        if error is not None:
            raise RuntimeError(error)
        return text, pages

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None


def decode(files: DataFrame, decoder: Decoder = by_content, timeout: float | None = None) -> DataFrame:
    """``(path, stem, text, page_count, error)``: a file that can't be decoded, or not within ``timeout`` seconds, has
    an error and no text; the others go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guarded = _Guarded(decoder, timeout) if timeout is not None else None
        use = guarded or decoder
        for batch in batches:
            texts, pages, errors = [], [], []
            for data in batch.column("content").to_pylist():
                try:
                    t, n = use(data or b"")
                    texts.append(t)
                    pages.append(n)
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    pages.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("stem"), pa.array(texts, pa.string()), pa.array(pages, pa.int32()), pa.array(errors, pa.string())], names=["path", "stem", "text", "page_count", "error"])
        if guarded:
            guarded.close()

    return files.select("path", "stem", "content").mapInArrow(run, "path string, stem string, text string, page_count int, error string")


def write_files(df: DataFrame, name: str, content: str, folder: str) -> int:
    """Writes each row's binary ``content`` as a file of its own, named by ``name``; returns their number. A file
    that is there already is replaced, so a repeated task does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = arrow_filesystem(folder)
        fs.create_dir(path, recursive=True)
        for batch in batches:
            for n, data in zip(batch.column("n").to_pylist(), batch.column("c").to_pylist(), strict=True):
                with fs.open_output_stream(f"{path}/{n}") as out:
                    out.write(data or b"")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["k"])

    made = df.select(F.col(name).alias("n"), F.col(content).alias("c")).mapInArrow(run, "k long").agg(F.coalesce(F.sum("k"), F.lit(0))).first()
    return made[0]


def parse_sections(docs: DataFrame, limit: int | None = None, text: str = "text", agencies: Agencies | None = None) -> DataFrame:
    """One row for each section with its facts: ``(stem, section_pos, section_id, heading, text, citations,
    obligations, definitions, dates, agencies)``. Agencies are those of the whole document; ``agencies`` replaces the
    dictionary (see ``functions.entities``). With ``limit``, a section is cut before its facts are looked for, as for
    a model of that length. Null texts have no sections."""
    clean = docs.where(F.col(text).isNotNull()).select("stem", tx.clean_text(F.col(text)).alias("text"))
    found = (agencies or tx.agencies)(F.col("text"))
    cut = tx.split_sections(clean.withColumn("agencies_", found), "text")
    rows = cut.select("stem", "agencies_", F.posexplode("sections").alias("section_pos", "s"))
    body = F.col("s.text") if limit is None else tx.truncated(F.col("s.text"), limit)
    rows = rows.select("stem", "section_pos", F.col("s.section_id").alias("section_id"), F.col("s.heading").alias("heading"), body.alias("text"), "agencies_")
    return tx.facts(rows, "text", F.col("agencies_")).drop("agencies_")


def parse_documents(docs: DataFrame, text: str = "text", agencies: Agencies | None = None) -> DataFrame:
    """One row for each document in the nested form (``PARSED``); obligations of the whole document end at 50."""
    clean = docs.where(F.col(text).isNotNull()).select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "stem", "page_count", tx.clean_text(F.col(text)).alias("text"))
    clean = clean.withColumn("agencies_", (agencies or tx.agencies)(F.col("text")))
    cut = tx.split_sections(clean, "text", "cut_", cite=True).withColumn("cited_", tx.citations(F.col("text")))

    def section(s):
        t = s["text"]
        return F.struct(s["section_id"].alias("section_id"), s["heading"].alias("heading"), t.alias("text"), s["citations"].alias("citations"), tx.obligations(t).alias("obligations"), tx.definitions(t).alias("definitions"), tx.dates(t).alias("dates"), F.col("agencies_").alias("agencies"))

    t = F.col("text")
    meta = [c.alias(n) for n, c in tx.metadata(t).items()]
    return cut.select("source_file", *meta, "page_count", F.transform("cut_", section).alias("sections"), F.col("cited_").alias("all_citations"), F.slice(tx.obligations(t), 1, tx.MOST_OBLIGATIONS).alias("all_obligations"), tx.definitions(t).alias("all_definitions"))


def document_summary(parsed: DataFrame) -> DataFrame:
    """Counts of a document's facts and the first ones of them."""
    sizes = [F.size(c).alias(n) for c, n in (("sections", "sections"), ("all_citations", "citations"), ("all_obligations", "obligations"), ("all_definitions", "definitions"))]
    agencies = F.coalesce(F.size(F.get("sections", F.lit(0))["agencies"]), F.lit(0)).alias("agencies")
    return parsed.select("source_file", "doc_id", "doc_type", "subject", "approved_date", "initiating_office", "page_count", *sizes, agencies, F.slice("all_citations", 1, 5).alias("first_citations"), F.slice("all_obligations", 1, 3).alias("first_obligations"), F.slice("all_definitions", 1, 3).alias("first_definitions"))


def write_parsed(parsed: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Writes JSON lines, one document each, characters as they are."""
    parsed.write.mode(mode).json(folder)


def read_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Reads parsed documents: files of lines as ``write_parsed`` makes them, told by Spark's names for the parts of a
    table, and any other ``*.json`` as one object, indented or not. Lists of metadata (``*_meta.json``) beside them are
    left out."""
    source = spark.read.schema(PARSED).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    name = F.col("_metadata.file_name")
    part = name.rlike(r"^part-\d{5}-[0-9a-f]{8}-[0-9a-f-]{27}[^/]*\.json$")
    lines = source.json(folder).where(part)
    whole = source.option("multiLine", "true").json(folder).where(~part & ~name.endswith("_meta.json"))
    return lines.unionByName(whole)
