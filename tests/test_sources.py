import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone import cli
from quillstone.sources import documents as docs
from quillstone.sources import sections as sec
from quillstone.streaming.ingest import Progress, ingest_state, start_ingest, tuned

TEXT = "DOE O 1.1\n1. PURPOSE. The site shall comply with 10 CFR 830. \f\n2.\n\nSCOPE. All of DOE.\n" + "x" * 3000 + " HSPD-5"


def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text(TEXT)
    (tmp_path / "in/sub/b.TXT").write_text("Nothing numbered here.")
    (tmp_path / "in/sub/a.pdf").write_bytes(b"%PDF-broken")
    (tmp_path / "in/skip.log").write_text("x")
    return str(tmp_path / "in")


def test_documents(spark, tmp_path):
    files = docs.discover(spark, folder(tmp_path))
    assert files.count() == 3 and docs.discover(spark, str(tmp_path / "in"), limit=2).count() == 2
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        docs.discover(spark, str(tmp_path / "none"))
    assert [(r.stem, r.n) for r in docs.stem_collisions(files).collect()] == [("a", 2)]
    decoded = docs.decode(files)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in decoded.collect()}
    assert rows["a.pdf"].error and rows["a.pdf"].text is None and rows["a.txt"].page_count == 2 and rows["a.txt"].error is None
    parsed = docs.parse_documents(decoded)
    by = {r.source_file: r for r in parsed.collect()}
    assert set(by) == {"a.txt", "b.TXT"} and by["a.txt"].doc_id == "DOE O 1.1" and len(by["a.txt"].sections) == 2
    assert by["a.txt"].sections[0].citations[0].reference == "10 CFR 830." and by["a.txt"].sections[0].agencies == ["DOE"]
    assert {c.reference for c in by["a.txt"].all_citations} == {"DOE O 1.1", "10 CFR 830.", "HSPD 5"}
    out = str(tmp_path / "out")
    docs.write_parsed(parsed, out)
    assert {r.source_file: r for r in docs.read_parsed(spark, out).collect()} == by
    docs.write_parsed(parsed.coalesce(1), out, "overwrite")  # both in one file
    (tmp_path / "out/own.json").write_text(json.dumps({"source_file": "own", "sections": []}, indent=2))
    assert {r.source_file for r in docs.read_parsed(spark, out).collect()} == {*by, "own"}
    s = {r.source_file: r for r in docs.document_summary(parsed).collect()}["a.txt"]
    assert (s.sections, s.citations, s.agencies, len(s.first_citations)) == (2, 3, 1, 3)
    rows = {(r.stem, r.section_pos): r for r in docs.parse_sections(decoded).collect()}
    assert rows["a", 1].heading == "SCOPE" and len(rows["a", 1].citations) == 1
    cut = {(r.stem, r.section_pos): r for r in docs.parse_sections(decoded, 2048).collect()}
    assert cut["a", 1].citations == [] and len(cut["a", 1].text) == 2048
    assert [r.stem for r in docs.not_done(decoded.select("stem").distinct(), parsed.select(F.lit("a").alias("stem"))).collect()] == ["b"]


def matrices(tmp_path):
    rng = np.random.default_rng(0)
    d = tmp_path / "emb"
    d.mkdir()
    np.save(d / "one_sections.npy", rng.normal(size=(3, 8)).astype(np.float32))
    (d / "one_meta.json").write_text(json.dumps([{"doc_id": "", "heading": "FIRST", "section_id": "1", "obligations": 2}, {"doc_id": "DOE O 1", "doc_type": "Guide"}, {}]))
    np.save(d / "two_sections.npy", rng.normal(size=(2, 8)).astype(np.float32))
    return d


def test_section_tables(spark, tmp_path):
    d = matrices(tmp_path)
    rows = sec.load_sections(spark, [str(d)]).orderBy("global_idx").collect()
    assert [r.global_idx for r in rows] == [0, 1, 2, 3, 4] and [r.stem for r in rows] == ["one"] * 3 + ["two"] * 2
    assert (rows[0].doc_id, rows[0].heading, rows[0].obligations, rows[0].citations) == ("one", "FIRST", 2, 0)
    assert (rows[1].doc_id, rows[1].doc_type, rows[1].section_id, rows[1].heading) == ("DOE O 1", "Guide", "1", "")
    assert (rows[3].doc_id, rows[3].subject, rows[3].doc_type, rows[3].section_id, rows[3].heading) == ("two", "two", "Order", "0", "SEC-0")
    assert len(rows[4].embedding) == 8
    out = str(tmp_path / "table")
    sec.write_sections(sec.load_sections(spark, [str(d / "one_sections.npy")]).withColumnRenamed("global_idx", "row_pos"), out)
    both = sec.load_sections(spark, [out, str(d)]).orderBy("global_idx").collect()
    assert len(both) == 8 and [r.stem for r in both[:3]] == ["one"] * 3
    with pytest.raises(FileNotFoundError):
        sec.load_sections(spark, [str(tmp_path / "missing")])
    (tmp_path / "void").mkdir()
    with pytest.raises(ValueError):
        sec.load_sections(spark, [str(tmp_path / "void")])
    with pytest.raises(ValueError):
        sec.require_sections(spark.range(0), "x")
    stats = sec.corpus_stats(spark, str(d), sec.load_sections(spark, [str(d)])).first()
    assert stats.files == 2 and stats.sections == 5 and stats.megabytes > 0
    named = sec.relabelled(spark.createDataFrame([("o-151-x",), ("zzz",)], "stem string"), {"151": "A"}, "other")
    assert [r.label for r in named.collect()] == ["A", "other"]
    assert spark.createDataFrame([("\x1b[1mx\x1b[0m",)], "t string").select(sec.without_ansi(F.col("t"))).first()[0] == "x"


def test_slow_files_are_given_up(spark, tmp_path):
    def slow(data):
        import time

        if data == b"slow":
            time.sleep(60)
        if data == b"dead":
            import os

            os._exit(1)
        return data.decode() * 100_000, 1

    for name, data in (("a", b"x"), ("b", b"slow"), ("c", b"\xff"), ("d", b"dead"), ("e", b"y")):
        (tmp_path / f"{name}.txt").write_bytes(data)
    rows = {r.stem: r for r in docs.decode(docs.discover(spark, str(tmp_path)).coalesce(1), slow, timeout=2).collect()}
    assert rows["a"].text == "x" * 100_000 and rows["e"].text == "y" * 100_000 and rows["e"].error is None
    assert "within 2 s" in rows["b"].error and "UnicodeDecodeError" in rows["c"].error and "ended" in rows["d"].error
    assert all(rows[k].text is None for k in "bcd")


def test_nothing_is_lost_in_dirty_tables(spark, tmp_path):
    rows = [("a", 0, [1.0]), ("a", 0, [2.0]), (None, 0, [3.0]), (None, 0, None), ("b", None, [4.0])]
    spark.createDataFrame(rows, "stem string, row_pos int, embedding array<float>").coalesce(2).write.parquet(str(tmp_path / "t"))
    got = sec.load_sections(spark, [str(tmp_path / "t")] * 2).orderBy("global_idx").collect()
    assert [r.global_idx for r in got] == list(range(10)) and [r.stem for r in got] == [None, None, "a", "a", "b"] * 2
    assert sorted(str(r.embedding) for r in got[:5]) == sorted(str(x[2]) for x in rows)
    for name in ("catalog", "logistics-2", "order", "order_meta"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"source_file": name}))
    assert {r.source_file for r in docs.read_parsed(spark, str(tmp_path)).collect()} == {"catalog", "logistics-2", "order"}


def test_files_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", b"x"), ("b.txt", None), ("c.txt", b"")], "n string, c binary")
    assert docs.write_files(df, "n", "c", str(tmp_path / "f")) == 3 == docs.write_files(df, "n", "c", f"file://{tmp_path}/f")
    assert (tmp_path / "f/a.txt").read_bytes() == b"x" and (tmp_path / "f/b.txt").read_bytes() == b""
    assert docs.write_files(df.limit(0), "n", "c", str(tmp_path / "g")) == 0


def test_ingest(spark, tmp_path):
    source = folder(tmp_path)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    progress = Progress()
    spark.streams.addListener(progress)
    start_ingest(spark, source, out, mark, files_per_batch=2).awaitTermination()
    rows = spark.read.parquet(out + "/sections").collect()
    assert sorted((r.stem, r.section_pos) for r in rows) == [("a", 0), ("a", 1), ("b", 0)] and len(rows[0].embedding) == 64
    assert [r.stem for r in spark.read.parquet(out + "/failed").collect()] == ["a"]
    (tmp_path / "in/c.txt").write_text("1. NEW. text")
    state = ingest_state(spark, source, out)
    assert (state.files, state.done, state.failed, state.backlog, state.percent, state.sections) == (4, 3, 1, 1, 75.0, 3)
    start_ingest(spark, source, out, mark, workers=2, batch=4, limit=10).awaitTermination()
    assert {r.stem for r in spark.read.parquet(out + "/sections").collect()} == {"a", "b", "c"}
    spark.streams.removeListener(progress)
    assert tuned(spark, batch=5)["batch"] == 5 and tuned(spark)["partitions"] >= 1
    # what was ingested can be loaded and compared
    loaded = sec.load_sections(spark, [out + "/sections"])
    assert loaded.count() == 4 and loaded.agg(F.max("global_idx")).first()[0] == 3


def test_command_line(spark, tmp_path, capsys):
    d = str(matrices(tmp_path))
    args = ["--regs", d + "/one_sections.npy", "--procs", d + "/two_sections.npy"]
    a = cli.parser().parse_args(["analyze", *args])
    assert a.threshold == 0.75 and a.graph is None and not a.verbose
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["report", *args, "--type", "other"])
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["analyze", "--regs", "x"])
    assert cli.parser().parse_args(["benchmark"]).kernel == "full"
    assert cli.main(["analyze", *args, "--threshold", "-1", "--graph", str(tmp_path / "g.dot"), "--verbose"], spark) == 0
    shown = capsys.readouterr().out
    assert "Covered 3" in shown and "Target sections by PageRank" in shown and "Shortest ways" in shown and (tmp_path / "g.dot").read_text().count("->") == 6
    for kind in cli.REPORTS:
        assert cli.main(["report", *args, "--type", kind, "--output", str(tmp_path / kind)], spark) == 0
        assert (tmp_path / kind).read_text()
    assert cli.main(["report", "--regs", "/missing", "--procs", d, "--type", "gaps"], spark) == 1


def test_timing_takes_the_median_of_later_runs():
    calls = []
    assert cli.median_of(lambda: calls.append(1), 3) < 1 and len(calls) == 4
    assert set(cli.KERNELS) == {"cosine", "graph", "full"}


def test_text_output(tmp_path):
    from quillstone.session import text_output

    for path in (str(tmp_path / "a"), f"file://{tmp_path}/new/b"):
        with text_output(path) as write:
            write("x\n")
            write("é\n")
    assert (tmp_path / "a").read_bytes() == (tmp_path / "new/b").read_bytes() == "x\né\n".encode()


def test_paths_of_the_shared_folder(tmp_path):
    from quillstone.session import arrow_filesystem

    for uri in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        fs, path = arrow_filesystem(uri)
        assert path == str(tmp_path) and fs.type_name == "local"


def test_ingest_keeps_empty_files_and_takes_few_tasks(spark, tmp_path):
    from quillstone.streaming.ingest import document_stream

    (tmp_path / "in").mkdir()
    for i in range(40):
        (tmp_path / f"in/d {i}.txt").write_text("" if i % 10 == 3 else f"1. SCOPE. All {i} shall go. See 10 CFR {i}.")
    source, out, parts = str(tmp_path / "in"), str(tmp_path / "out"), []
    start_ingest(spark, source, out, str(tmp_path / "mark"), files_per_batch=25).awaitTermination()
    rows = {r.stem: r for r in spark.read.parquet(out + "/sections").collect()}
    assert set(rows) == {f"d {i}" for i in range(40)} and rows["d 4"].obligations == rows["d 4"].citations == 1
    assert (rows["d 3"].heading, rows["d 3"].text_preview, rows["d 3"].citations) == ("FULL_TEXT", "", 0)
    state = ingest_state(spark, source, out)
    assert (state.files, state.done, state.failed, state.sections) == (40, 40, 0, 40)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        query = document_stream(spark, source, files_per_batch=40).writeStream.foreachBatch(lambda df, n: parts.append(df.rdd.getNumPartitions())).option("checkpointLocation", str(tmp_path / "m"))
        query.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(parts) == 1 and parts[0] <= spark.sparkContext.defaultParallelism
