"""The similarity graph in Graphviz's DOT language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.session import text_output

#: Colours of edges by least similarity; fixed values.
COLOURS = ((0.9, "#006400"), (0.8, "#228B22"))
OTHER_COLOUR = "#FF8C00"


def escaped(s: Column) -> Column:
    """With a backslash before each quote, backslash and line end."""
    return F.regexp_replace(s, r'(["\\\n])', r"\\$1")


# Shapes, colours, names and line forms that drawings have had so far.
NODE_FORM = ('    "{prefix}-', '" [label="', '" shape={shape} style=filled fillcolor={fill}];')
EDGE_FORM = '  "SRC-%d" -> "TGT-%d" [label="%s" color="%s" penwidth="%s"];'
CLUSTERS = (("cluster_source", "Source Corpus", "lightblue"), ("cluster_target", "Target Corpus", "lightgreen"))


def node_lines(sections: DataFrame, index: str, prefix: str, shape: str, fill: str) -> DataFrame:
    """``(idx, line)``: the document cut at 20, the heading at 22 or the section's number."""
    doc = F.coalesce(F.nullif(F.col("doc_id"), F.lit("")), F.col("stem"))
    head = F.coalesce(F.nullif(F.substring("heading", 1, 22), F.lit("")), F.col("section_id"))
    text = F.concat(escaped(F.substring(doc, 1, 20)), F.lit("\\n"), escaped(head))
    a, b, c = (x.format(prefix=prefix, shape=shape, fill=fill) for x in NODE_FORM)
    line = F.concat(F.lit(a), F.col(index).cast("string"), F.lit(b), text, F.lit(c))
    return sections.select(F.col(index).alias("idx"), line.alias("line"))


def top_edges(pairs: DataFrame, threshold: float = 0.75, most: int = 3) -> DataFrame:
    """Each source's ``most`` strongest edges ``(reg_idx, k, proc_idx, sim)``; equal ones: the higher index first."""
    ranked = pairs.where(F.col("sim") >= threshold).withColumn("k", F.expr("row_number() over (partition by reg_idx order by sim desc, proc_idx desc)"))
    return ranked.where(F.col("k") <= most).select("reg_idx", "k", "proc_idx", "sim")


def styled(edges: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Edges with colour, pen width and label."""
    colour = F.lit(OTHER_COLOUR)
    for least, value in reversed(COLOURS):
        colour = F.when(F.col("sim") >= least, value).otherwise(colour)
    return edges.withColumns({"colour": colour, "penwidth": F.format_string("%.1f", 1 + (F.col("sim") - threshold) * 4), "label": F.format_string("%.3f", "sim")})


def edge_lines(edges: DataFrame) -> DataFrame:
    line = F.format_string(EDGE_FORM, "reg_idx", "proc_idx", "label", "colour", "penwidth")
    return edges.select("reg_idx", "k", line.alias("line"))


def dot_lines(edges: DataFrame, regs: DataFrame, procs: DataFrame, graph_name: str = "coverage", title: str = "Similar sections") -> DataFrame:
    """The whole file as ``(part, idx, k, line)``, to be written in that order. ``edges`` are styled top edges."""
    spark = edges.sparkSession
    font = 'fontname="Helvetica"'
    head = [f"digraph {graph_name} {{", f'  graph [rankdir=LR {font} label="{title}" labelloc=t fontsize=14];', f"  node [{font} fontsize=10];", f"  edge [{font} fontsize=8];", ""]
    openings = [[f"  subgraph {name} {{", f'    label="{label}"; style=filled; color={colour};'] for name, label, colour in CLUSTERS]
    groups = [openings[0], ["  }", "", *openings[1]], ["  }", ""], ["}"]]
    fixed = [(0, i, 0, x) for i, x in enumerate(head)] + [(part, i, 0, x) for part, lines in zip((1, 3, 5, 7), groups, strict=True) for i, x in enumerate(lines)]
    out = spark.createDataFrame(fixed, "part int, idx int, k int, line string")
    for part, lines in ((2, node_lines(regs, "reg_idx", "SRC", "box", "lightblue")), (4, node_lines(procs, "proc_idx", "TGT", "ellipse", "lightgreen"))):
        out = out.unionByName(lines.select(F.lit(part).alias("part"), F.col("idx").cast("int").alias("idx"), F.lit(0).alias("k"), "line"))
    return out.unionByName(edge_lines(edges).select(F.lit(6).alias("part"), F.col("reg_idx").cast("int").alias("idx"), F.col("k").cast("int").alias("k"), "line"))


def write_dot(lines: DataFrame, path: str) -> int:
    """Writes the lines as one file; returns the number of edges. A file for a drawing program is one machine's: its
    lines come to the driver a partition at a time."""
    edges = 0
    with text_output(path) as write:
        for r in lines.orderBy("part", "idx", "k").toLocalIterator():
            write(r.line + "\n")
            edges += r.part == 6
    return edges
