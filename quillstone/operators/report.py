"""Coverage, gaps and rankings of two corpora, as tables and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTIAL_FLOOR, SHOWN_FLOOR, THRESHOLD = 0.5, 0.01, 0.75


def label(heading: int = 25, prefix: str = "") -> Column:
    """``document | section``: the id, else the stem, cut at 18; the heading, else the section's number."""
    doc = F.coalesce(F.nullif(F.col(prefix + "doc_id"), F.lit("")), F.col(prefix + "stem"))
    head = F.coalesce(F.nullif(F.substring(F.col(prefix + "heading"), 1, heading), F.lit("")), F.col(prefix + "section_id"))
    return F.concat(F.substring(doc, 1, 18), F.lit(" | "), head)


def status(sim: Column, threshold: float = THRESHOLD, floor: float = PARTIAL_FLOOR) -> Column:
    return F.when(sim >= threshold, "COVERED").when(sim >= floor, "PARTIAL").otherwise("GAP")


def coverage(best: DataFrame, threshold: float = THRESHOLD, floor: float = PARTIAL_FLOOR) -> DataFrame:
    """``best`` (reg_idx, proc_idx, sim) with each source's status."""
    return best.withColumn("status", status(F.col("sim"), threshold, floor))


def coverage_summary(covered: DataFrame) -> DataFrame:
    """``(covered, partial, gaps, total, coverage_pct)``; 0 % of no sources."""
    counts = [F.count_if(F.col("status") == s).alias(n) for s, n in (("COVERED", "covered"), ("PARTIAL", "partial"), ("GAP", "gaps"))]
    out = covered.agg(*counts, F.count("*").alias("total"))
    return out.withColumn("coverage_pct", F.coalesce(100.0 * F.col("covered") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)))


def check_shape(pairs: DataFrame, num_regs: int, num_procs: int) -> None:
    """AssertionError unless the pairs are those of corpora of these sizes."""
    r = pairs.agg(F.count("*").alias("n"), F.max("reg_idx").alias("a"), F.max("proc_idx").alias("b")).first()
    assert (r.n, r.a, r.b) == (num_regs * num_procs, num_regs - 1 if r.n else None, num_procs - 1 if r.n else None), "pairs do not match the corpora"


def check_best(best: DataFrame, num_regs: int, num_procs: int) -> None:
    """AssertionError unless there is one best match for each source, within the targets."""
    r = best.agg(F.count("*").alias("n"), F.max("reg_idx").alias("a"), F.max("proc_idx").alias("b")).first()
    assert r.n == (num_regs if num_procs else 0) and (not r.n or (r.a == num_regs - 1 and r.b < num_procs)), "best matches do not fit the corpora"


def check_ranks(ranks: DataFrame, num_regs: int, num_procs: int) -> None:
    """AssertionError unless there is one rank for each section of both corpora."""
    n = ranks.count()
    assert n == num_regs + num_procs, f"{n} ranks for {num_regs + num_procs} sections"


def _labels(sections: DataFrame, index: str, name: str, heading: int = 25) -> DataFrame:
    return sections.select(F.col(index), label(heading).alias(name))


def gaps(best: DataFrame, regs: DataFrame, procs: DataFrame, threshold: float = THRESHOLD, floor: float = PARTIAL_FLOOR) -> DataFrame:
    """Sources whose best match is below the threshold, partial ones included: ``(reg_idx, best_proc, best_sim,
    reg_label, proc_label, severity)``."""
    below = best.where(F.col("sim") < threshold)
    named = below.join(_labels(regs, "reg_idx", "reg_label"), "reg_idx").join(_labels(procs, "proc_idx", "proc_label"), "proc_idx")
    severity = F.when(F.col("sim") < floor, "NO MATCH").otherwise("PARTIAL")
    return named.select("reg_idx", F.col("proc_idx").alias("best_proc"), F.col("sim").alias("best_sim"), "reg_label", "proc_label", severity.alias("severity"))


def gap_totals(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("n"))


def rankings(ranks: DataFrame, sections: DataFrame, index: str, offset: int = 0, top_n: int = 15) -> DataFrame:
    """The ``top_n`` sections by rank, equal ones by index: ``(place, medal, idx, rank, label)``."""
    named = sections.select(F.col(index).alias("idx"), label(28).alias("label"))
    top = ranks.select((F.col("id") - offset).alias("idx"), "rank").join(named, "idx").orderBy(F.desc("rank"), "idx").limit(top_n)
    placed = top.withColumn("place", F.expr("row_number() over (order by rank desc, idx)"))  # top_n rows
    medal = F.when(F.col("place") == 1, "★").when(F.col("place") <= 3, "·").otherwise("")
    return placed.select("place", medal.alias("medal"), "idx", "rank", "label")


def hierarchy(order: DataFrame, regs: DataFrame, procs: DataFrame, num_regs: int) -> DataFrame:
    """``(pos, kind, label)`` of all sections in dependency order."""
    names = regs.select(F.col("reg_idx").cast("long").alias("id"), F.lit("REG").alias("kind"), label().alias("label")).unionByName(procs.select((F.col("proc_idx") + num_regs).cast("long").alias("id"), F.lit("PROC").alias("kind"), label().alias("label")))
    return order.join(names, "id").select("pos", "kind", "label")


def _padded(c: Column, width: int) -> Column:
    return F.rpad(F.substring(c, 1, width), width, " ")


def matrix_lines(covered: DataFrame, regs: DataFrame, procs: DataFrame) -> DataFrame:
    """One line of text for each source, ``(reg_idx, line)``; a match below 0.01 shows a dash."""
    named = covered.join(_labels(regs, "reg_idx", "reg_label"), "reg_idx").join(_labels(procs, "proc_idx", "proc_label"), "proc_idx")
    shown = F.col("sim") >= SHOWN_FLOOR
    target = F.when(shown, F.col("proc_label")).otherwise("—")
    sim = F.when(shown, F.format_string("%7.4f", "sim")).otherwise("   —   ")
    return named.select("reg_idx", F.concat(_padded(F.col("reg_label"), 38), F.lit("  "), _padded(target, 38), F.lit("  "), sim, F.lit("  "), "status").alias("line"))


def gap_lines(found: DataFrame, regs: DataFrame) -> DataFrame:
    """A few lines of text for each gap, ``(reg_idx, line)``, with a preview of 100 characters."""
    named = found.join(regs.select("reg_idx", "text_preview"), "reg_idx")
    match = F.when(F.col("best_sim") >= SHOWN_FLOOR, F.format_string("nearest: %s (%.4f)", "proc_label", "best_sim")).otherwise("nothing like it")
    text = F.when(F.coalesce(F.length("text_preview"), F.lit(0)) > 0, F.concat(F.lit("\n           text: "), F.translate(F.substring("text_preview", 1, 100), "\n", " "), F.lit("…"))).otherwise("")
    return named.select("reg_idx", F.concat(F.lit("["), F.rpad("severity", 8, " "), F.lit("]  "), "reg_label", F.lit("\n           "), match, text).alias("line"))


def ranking_lines(ranked: DataFrame) -> DataFrame:
    mark = F.rpad(F.col("medal"), 1, " ")
    doc, section = F.substring_index("label", " | ", 1), F.expr("substring(label, locate(' | ', label) + 3)")
    return ranked.select("place", F.concat(F.lit("  "), mark, F.lit(" "), F.format_string("%3d  %8.5f", "place", "rank"), F.lit("  "), _padded(doc, 22), F.lit("  "), section).alias("line"))
