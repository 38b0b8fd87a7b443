"""Regulatory text: cleaning, header metadata, sections and facts, as column expressions.

Everything but the section splitter and the surroundings of citations is made of built-in expressions and stays in
the JVM. Character classes are
Unicode ones, as documents come with no-break spaces and accented letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns that say what counts as a reference, an obligation, a definition, a date, a page header,
# a section. Kinds of references come in the order in which they are listed.
CITATIONS = {
    "doe": (r"(?iuU)\bDOE\s+[OPMGN]\s+[\d]+\.[\d]+[A-Za-z\d.\-]*(?:\s+Chg\s*\d+)?(?:\s+\([A-Za-z]+\))?", None),
    "cfr": (r"(?U)\b(\d+)\s+C\.?F\.?R\.?\s+(?:[Pp]arts?\s+|§\s*)?(\d+[\d.\-]*)", " CFR "),
    "usc": (r"(?U)\b(\d+)\s+U\.?S\.?C\.?\s+(?:[Ss]ec(?:tions?|\.?)\s*|§\s*)?(\d+[\d.\-]*)", " USC "),
    "eo": (r"(?iuU)\bExecutive\s+Order\s+(\d+)", "EO "),
    "pl": (r"(?iuU)\b(?:P\.?L\.?|Public\s+Law)\s+(\d+[-–]\d+)", "PL "),
    "hspd": (r"(?iuU)\bHSPD[-\s](\d+)", "HSPD "),
}
SENTENCE = r"[^.!?]*[.!?]"
MODAL = r"(?iuU)\b(?:shall|must)\b"
SHALL = r"(?iuU)\bshall\b"
DEFINITIONS = (
    r'(?iuU)"([^"]{2,80})"\s+means\s+([^.]{10,300}\.)',
    r"(?U)\b([A-Z][A-Z\s]{2,50})\s+means\s+([^.]{10,300}\.)",
    r'(?iuU)\bthe\s+term\s+"([^"]{2,80})"\s+(?:means|is\s+defined\s+as)\s+([^.]{10,300}\.)',
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DATE = r"(?iuU)\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|(?:" + "|".join(MONTHS) + r")\s+\d{1,2},?\s+\d{4})"
AGENCIES = ("CIA", "DHS", "DOD", "DOE", "DOT", "EPA", "FBI", "FEMA", "GAO", "NASA", "NIST", "NNSA", "NRC", "NSA", "OMB", "OSHA")
PAGE_HEADERS = (
    r"(?iuU)\n\s*\d*\s*\n?\s*DOE\s+[OPMGN]\s+[\d]+\.[\d]+[A-Za-z\d.\- ]*\n\s*[\d\-]+\s*\n",
    r"(?iuU)\n\s*DOE\s+[OPMGN]\s+[\d]+\.[\d]+[A-Za-z\d.\- ]*\s*\n\s*\d+\s*\n\s*[\d\-]+\s*\n",
)
DOC_ID = r"(?U)\bDOE\s+([OPMGN])\s+([\d]+\.[\d]+[A-Za-z\d.\-]*(?:\s+Chg\s*\d+)?)"
DOC_TYPES = {"O": "Order", "P": "Policy", "M": "Manual", "G": "Guide", "N": "Notice"}
SUBJECT = r"(?iuU)SUBJECT[:\s]+([^\n]{5,200})"
APPROVED = r"(?iuU)Approved\s*[:\s]+([^\n]{5,30})"
OFFICE = r"(?iuU)INITIATED\s+BY[:\s]+([^\n]{5,100})"
HEADED = r"^(\d{1,2})\.\s+([A-Z][A-Z ,/()\-]{2,80})\.\s*(.*)"
NUMBERED = r"^\s*(\d{1,2})\.\s*$"
HEADING = r"^([A-Z][A-Z\s,/()\-]{2,80})\.\s*(.*)"

DATE_WINDOW, ID_WINDOW, OFFICE_WINDOW, SUBJECT_WINDOW = 800, 500, 1000, 1500  #: characters searched for metadata
NEAR_EMPTY, MODEL_LIMIT, PREVIEW, CONTEXT, MOST_OBLIGATIONS = 100, 2048, 200, 40, 50


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Without repeated page headers; three line ends or more become two."""
    for pattern in PAGE_HEADERS:
        text = F.regexp_replace(text, pattern, "\n")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def near_empty(text: Column) -> Column:
    return F.length(strip(text)) < NEAR_EMPTY


def truncated(text: Column, limit: int = MODEL_LIMIT) -> Column:
    return F.substring(text, 1, limit)


def preview(text: Column) -> Column:
    return F.translate(F.substring(text, 1, PREVIEW), "\n", " ")


def _number(c: Column) -> Column:
    return c.try_cast("int")


def normalized_date(raw: Column) -> Column:
    """``yyyy-MM-dd`` of a date with month first (or day first where only that can be), in digits or with the month's
    name; years of two digits are 1969 to 2068. What is no such date stays as it is."""
    digits = [_number(F.regexp_extract(raw, r"(?U)^\s*(\d{1,2})[-/](\d{1,2})[-/](\d{4}|\d{2})\s*$", i)) for i in (1, 2, 3)]
    named = [F.regexp_extract(raw, r"(?U)^\s*(\p{L}+)\s+(\d{1,2}),?\s+(\d{4})\s*$", i) for i in (1, 2, 3)]
    month_of_name = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(named[0])).cast("int")
    a, b, year = digits
    swapped = (a > 12) & (b <= 12)
    month = F.coalesce(F.when(swapped, b).otherwise(a), month_of_name)
    day = F.coalesce(F.when(swapped, a).otherwise(b), _number(named[1]))
    year = F.when(year < 69, year + 2000).when(year < 100, year + 1900).otherwise(F.coalesce(year, _number(named[2])))
    sane = month.between(1, 12) & (day >= 1) & (year >= 1)
    first = F.make_date(F.when(sane, year), F.when(sane, month), F.lit(1))
    good = day <= F.dayofmonth(F.last_day(first))
    return F.when(good, F.format_string("%04d-%02d-%02d", year, month, day)).otherwise(raw)


def metadata(text: Column) -> dict[str, Column]:
    """doc_id, doc_type, subject, approved_date and initiating_office from a document's first characters; what isn't
    found is empty, the type then is Order."""
    head = F.substring(text, 1, ID_WINDOW)
    letter = F.regexp_extract(head, DOC_ID, 1)
    number = strip(F.regexp_extract(head, DOC_ID, 2))
    types = F.create_map(*[F.lit(x) for pair in DOC_TYPES.items() for x in pair])
    approved = strip(F.regexp_extract(F.substring(text, 1, DATE_WINDOW), APPROVED, 1))
    return {
        "doc_id": F.when(letter == "", F.lit("")).otherwise(F.concat(F.lit("DOE "), letter, F.lit(" "), number)),
        "doc_type": F.when(letter == "", F.lit("Order")).otherwise(types[letter]),
        "subject": strip(F.regexp_extract(F.substring(text, 1, SUBJECT_WINDOW), SUBJECT, 1)),
        "approved_date": normalized_date(approved),
        "initiating_office": strip(F.regexp_extract(F.substring(text, 1, OFFICE_WINDOW), OFFICE, 1)),
    }


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _first_by(items: Column, field: str) -> Column:
    """Without items whose field an earlier one has: sorted by field and place, the first of each kept, put in order
    again. Not quadratic, however many there are."""
    placed = F.transform(items, lambda x, i: F.struct(x[field].alias("k"), i.alias("i"), x.alias("x")))
    heads = _let(F.array_sort(placed), lambda s: F.filter(s, lambda y, i: (i == 0) | (F.get(s, i - 1)["k"] != y["k"])))
    return F.transform(F.array_sort(F.transform(heads, lambda y: F.struct(y["i"].alias("i"), y["x"].alias("x")))), lambda z: z["x"])


def _may_cite(text: Column, kind: str) -> Column:
    """A quick test that every text with a reference of the kind passes: most have none, and are spared the search."""
    small = F.translate(F.lower(text), "ſıİ", "sii")
    if kind in ("cfr", "usc"):
        return text.rlike({"cfr": r"C\.?F\.?R", "usc": r"U\.?S\.?C"}[kind])
    if kind == "pl":
        return small.rlike(r"(?U)[lw]\.?\s+\d")
    return small.contains({"doe": "doe", "eo": "executive", "hspd": "hspd"}[kind])


def _matches(text: Column, kind: str) -> Column:
    return F.when(_may_cite(text, kind), _all(text, CITATIONS[kind][0])).otherwise(F.array().cast("array<string>"))


def _name(match: Column, kind: str) -> Column:
    """The reference that a match stands for."""
    pattern, form = CITATIONS[kind]
    if kind == "doe":
        return strip(match)
    groups = [F.regexp_extract(match, pattern, i) for i in (1, 2)]
    return F.concat(groups[0], F.lit(form), groups[1]) if kind in ("cfr", "usc") else F.concat(F.lit(form), groups[0])


def _python(pattern: str) -> re.Pattern:
    """A pattern as Python's engine reads it, whose classes are Unicode ones already."""
    flags = re.match(r"\(\?(\w+)\)", pattern)
    return re.compile(pattern[flags.end() :], re.IGNORECASE if "i" in flags[1] else 0)


_CITATIONS = {kind: (_python(pattern), form) for kind, (pattern, form) in CITATIONS.items()}
CITATION_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("cit_type", "reference", "context")]))


def citations_of(text: str) -> list[dict[str, str]]:
    """The citations of one text, see ``citations``; one pass for each kind."""
    out: dict[str, dict[str, str]] = {}
    for kind, (pattern, form) in _CITATIONS.items():
        for m in pattern.finditer(text):
            name = m[0].strip() if kind == "doe" else f"{m[1]}{form}{m[2]}" if kind in ("cfr", "usc") else form + m[1]
            if name not in out:
                around = text[max(0, m.start() - CONTEXT) : m.end() + CONTEXT].replace("\n", " ").strip()
                out[name] = {"cit_type": kind, "reference": name, "context": around}
    return list(out.values())


@F.pandas_udf(CITATION_TYPE)
def _cite(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else citations_of(t))


def citations(text: Column) -> Column:
    """``array<struct<cit_type, reference, context>>``: kinds in turn, each reference once, with 40 characters on both
    sides of its first place. No built-in function gives the places of matches, so texts that may have some (a test
    in the JVM tells) go through Arrow batches; the others don't."""
    some = F.lit(False)
    for kind in CITATIONS:
        some = some | _may_cite(text, kind)
    none = F.array().cast(CITATION_TYPE)
    return F.when(text.isNull(), F.lit(None)).otherwise(F.coalesce(_cite(F.when(some, text)), none))


def references(text: Column, kind: str) -> Column:
    """The distinct references of one kind, in order."""
    return F.array_distinct(F.transform(_matches(text, kind), lambda m: _name(m, kind)))


def obligations(text: Column) -> Column:
    """``array<struct<modal, sentence>>`` of sentences of 15 to 600 characters with shall or must; shall goes first."""
    # sentences first, then the modal: one pattern for both would try every start of every sentence
    sentences = F.filter(_all(text, SENTENCE), lambda s: s.rlike(MODAL))
    kept = F.filter(F.transform(sentences, strip), lambda s: F.length(s).between(15, 600))
    each = F.array_distinct(F.transform(kept, lambda s: F.translate(s, "\n", " ")))
    return F.transform(each, lambda s: F.struct(F.when(s.rlike(SHALL), "shall").otherwise("must").alias("modal"), s.alias("sentence")))


def definitions(text: Column) -> Column:
    """``array<struct<term, definition>>``: quoted terms, terms in capitals, then "the term ..."; each term once."""
    parts = [F.zip_with(_all(text, p, 1), _all(text, p, 2), lambda a, b: F.struct(strip(a).alias("term"), strip(b).alias("definition"))) for p in DEFINITIONS]
    return _first_by(F.concat(*parts), "term")


def dates(text: Column) -> Column:
    """Dates in order, each writing once, normalised where they can be."""
    return F.transform(F.array_distinct(F.transform(_all(text, DATE), strip)), normalized_date)


def agencies(text: Column) -> Column:
    """Acronyms of the fixed list that occur as words, in alphabetical order."""
    return F.filter(F.array(*[F.lit(a) for a in AGENCIES]), lambda a: F.call_function("rlike", text, F.concat(F.lit(r"(?U)\b"), a, F.lit(r"\b"))))


def facts(df: DataFrame, text: str, agency: Column | None = None) -> DataFrame:
    """``df`` with citations, obligations, definitions, dates and agencies of ``text``. ``agency`` replaces the
    dictionary of acronyms, as for a whole document's agencies or a model's."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"citations": citations(t), "obligations": obligations(t), "definitions": definitions(t), "dates": dates(t), "agencies": agencies(t) if agency is None else agency})


_HEADED, _NUMBERED, _HEADING = re.compile(HEADED), re.compile(NUMBERED), re.compile(HEADING)


def sections_of(text: str) -> list[tuple[str, str, str]]:
    """``(section_id, heading, text)`` of numbered sections. A header is a number and a heading in capitals on one
    line, or a number alone whose next line with anything on it is the heading. A number without one closes the
    section before but makes none; what is before the first header belongs to none. Without sections the whole text
    is one."""
    lines = text.splitlines()
    bare = [x.strip() for x in lines]
    marks: list[tuple[int, str, str | None, list[str], int]] = []  # line, number, heading, first words, where it goes on
    skip = -1
    for at, line in enumerate(bare):
        if at < skip or not line[:1].isdigit():
            continue
        same = _HEADED.match(line)
        if same:
            marks.append((at, same[1], same[2].strip(), [same[3]] if same[3].strip() else [], at + 1))
            continue
        alone = _NUMBERED.match(line)
        if alone:
            skip = next((j for j in range(at + 1, len(bare)) if bare[j]), len(bare))
            head = _HEADING.match(bare[skip]) if skip < len(bare) else None
            if head:
                skip += 1
            first = head[2].strip() if head else ""
            marks.append((at, alone[1], head[1].strip() if head else None, [first] if first else [], skip))
    ends = [*(m[0] for m in marks), len(lines)][1:]
    out = [(number, heading, "\n".join([*first, *lines[start:end]]).strip()) for (_, number, heading, first, start), end in zip(marks, ends, strict=True) if heading]
    return out or [("0", "FULL_TEXT", text.strip())]


def split_sections(df: DataFrame, text: str, name: str = "sections", cite: bool = False) -> DataFrame:
    """``df`` with an array of its text's sections. Lines are looked at in turn, with what was before: this is done
    in Arrow batches, without a shuffle; a null text has a null array. With ``cite``, each section has its citations."""
    if name in df.columns:
        raise ValueError(f"{name} is a column already")
    fields = [T.StructField(n, T.StringType()) for n in ("section_id", "heading", "text")]
    kinds = [(n, pa.string()) for n in ("section_id", "heading", "text")]
    if cite:
        fields.append(T.StructField("citations", CITATION_TYPE))
        kinds.append(("citations", pa.list_(pa.struct([(n, pa.string()) for n in ("cit_type", "reference", "context")]))))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.StructType(fields)))])
    kind = pa.list_(pa.struct(kinds))

    def section(number: str, heading: str, body: str) -> dict:
        out = {"section_id": number, "heading": heading, "text": body}
        return out | {"citations": citations_of(body)} if cite else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [None if t is None else [section(*s) for s in sections_of(t)] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cut, kind)], names=schema.names)

    return df.mapInArrow(run, schema)
