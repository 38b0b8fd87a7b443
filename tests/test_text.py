import re
import time

import pytest
from pyspark.sql import functions as F

from quillstone.functions import entities
from quillstone.functions import text as tx
from quillstone.sources import documents as docs

SAMPLE = """DOE O 212.4B Chg 2
SUBJECT: CARE OF HISTORIC ORCHARDS
Approved: 3-9-2014
INITIATED BY: Office of Orchards and Gardens
Preamble with 19 CFR 77. and 19 CFR 77 and 33 C.F.R. § 118.40-6, 21 U.S.C. Section 3141; 35 USC § 908.
1.

PURPOSE. This paper follows Executive Order 11111 and P.L. 99-123, Public Law 98–76, HSPD-3 and HSPD 41.
2. CANCELS/SUPERSEDES. None shall be kept. You must not go! Both shall and must hold.
doe p 333.7A (Draft) and DOE M 555.2-9 stay. 19 CFR 77 again.
3.

not a heading
4. SCOPE.

"Grove" means a stand of trees under care. PRUNING SEASON LEVEL means a span of weeks for it. The term "blight" is defined as a source of harm to trees.
January 1, 2020 and 13-5-99 and 2/30/2020 and January 1, 2020. NISTABLE NIST, EPA.
"""


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def python_pattern(p):
    flags = re.match(r"\(\?(\w+)\)", p)
    names = flags[1] if flags else ""
    return re.compile(p[flags.end() :] if flags else p, re.IGNORECASE if "i" in names else 0)


def plain_citations(text):
    out = {}
    for kind, (p, form) in tx.CITATIONS.items():
        for m in python_pattern(p).finditer(text):
            name = m[0].strip() if kind == "doe" else f"{m[1]}{form}{m[2]}" if kind in ("cfr", "usc") else form + m[1]
            around = text[max(0, m.start() - 40) : m.end() + 40].replace("\n", " ").strip()
            out.setdefault(name, (kind, name, around))
    return list(out.values())


@pytest.mark.parametrize("text", [SAMPLE, "", "none", SAMPLE * 3, "10 CFR 8\xa0" + "é" * 50 + " 10\xa0CFR\xa09 x", "10 CFR 1" * 30])
def test_citations(spark, text):
    assert [tuple(r) for r in one(spark, text, tx.citations)] == plain_citations(text)


def test_references(spark):
    assert one(spark, SAMPLE, lambda t: tx.references(t, "cfr")) == ["19 CFR 77.", "19 CFR 77", "33 CFR 118.40-6"]
    assert one(spark, SAMPLE, lambda t: tx.references(t, "pl")) == ["PL 99-123", "PL 98–76"]


def test_obligations(spark):
    want = [("shall", "None shall be kept."), ("must", "You must not go!"), ("shall", "Both shall and must hold.")]
    got = [tuple(r) for r in one(spark, SAMPLE, tx.obligations)]
    # the first sentence begins where the last one ended
    assert got[-2:] == want[-2:] and got[0][1].endswith("None shall be kept.")
    for n, kept in ((14, 0), (15, 1), (600, 1), (601, 0)):
        assert len(one(spark, "must " + "x" * (n - 6) + ".", tx.obligations)) == kept
    assert one(spark, "mustard. marshall", tx.obligations) == []


def test_definitions(spark):
    got = [tuple(r) for r in one(spark, SAMPLE, tx.definitions)]
    assert got == [("Grove", "a stand of trees under care."), ("PRUNING SEASON LEVEL", "a span of weeks for it."), ("blight", "a source of harm to trees.")]


def test_dates_and_agencies(spark):
    assert one(spark, SAMPLE, tx.dates) == ["2014-03-09", "2020-01-01", "1999-05-13", "2/30/2020"]
    for raw, want in {"8/1/16": "2016-08-01", "12-31-68": "2068-12-31", "March 3 2001": "2001-03-03", "13-13-2000": "13-13-2000", "soon": "soon", "": "", "1-1-123": "1-1-123"}.items():
        assert one(spark, raw, tx.normalized_date) == want
    assert one(spark, SAMPLE, tx.agencies) == ["DOE", "EPA", "NIST"]


def test_metadata(spark):
    df = spark.createDataFrame([(SAMPLE,), ("",), ("x" * 500 + " DOE P 1.2",)], "t string").select(*[c.alias(n) for n, c in tx.metadata(F.col("t")).items()])
    got = [tuple(r) for r in df.collect()]
    assert got[0] == ("DOE O 212.4B Chg 2", "Order", "CARE OF HISTORIC ORCHARDS", "2014-03-09", "Office of Orchards and Gardens")
    assert got[1] == got[2] == ("", "Order", "", "", "")


def test_cleaning(spark):
    page = "end of page\n\n12\nDOE O 151.1D\n8-11-2016\nnext page\n DOE O 151.1D \n 3 \n 8-11-2016\nmore\n\n\n\n\nlast"
    want = page
    for p in tx.PAGE_HEADERS:
        want = python_pattern(p).sub("\n", want)
    want = re.sub(r"\n{3,}", "\n\n", want)
    assert one(spark, page, tx.clean_text) == want and "151" not in want
    assert one(spark, "  short\xa0", tx.near_empty) and not one(spark, "x" * 100, tx.near_empty)
    assert len(one(spark, "x" * 3000, tx.truncated)) == 2048 and one(spark, "a\nb" * 100, tx.preview) == ("a b" * 100)[:200]


def test_sections():
    got = tx.sections_of(SAMPLE)
    assert [(a, b) for a, b, _ in got] == [("1", "PURPOSE"), ("2", "CANCELS/SUPERSEDES"), ("4", "SCOPE")]
    assert got[0][2].startswith("This paper follows") and got[1][2].endswith("19 CFR 77 again.") and got[2][2].startswith('"Grove" means')
    assert tx.sections_of(" no sections \n") == [("0", "FULL_TEXT", "no sections")] and tx.sections_of("") == [("0", "FULL_TEXT", "")]
    # a number without a heading closes the section before it; what follows belongs to none
    assert tx.sections_of("1. FIRST. a\nb\n2.\n\nlost\n3.\n4. NEXT. c") == [("1", "FIRST", "a\nb"), ("4", "NEXT", "c")]
    assert tx.sections_of("1.\n2. TWO. x") == [("2", "TWO", "x")]
    assert tx.sections_of("1. ONE. a\n\n1. ONE. b") == [("1", "ONE", "a"), ("1", "ONE", "b")]
    assert tx.sections_of("1.\n\nHEAD. \n  body\n") == [("1", "HEAD", "body")]


def test_split_table(spark):
    df = spark.createDataFrame([(1, SAMPLE), (2, None), (3, "")], "i int, t string")
    got = {r.i: r.sections for r in tx.split_sections(df, "t").collect()}
    assert len(got[1]) == 3 and got[2] is None and got[3][0].heading == "FULL_TEXT"
    with pytest.raises(ValueError):
        tx.split_sections(df.withColumn("sections", F.lit(1)), "t")


def test_long_texts_take_linear_time(spark):
    n = 100_000
    text = " ".join(f'The grove {i} shall stand by 19 CFR {i}. "Tree {i}" means the plant {i} of all.' for i in range(n))
    start = time.perf_counter()
    for f in (tx.obligations, tx.definitions, tx.citations):
        assert one(spark, text * 2, lambda t, f=f: F.size(f(t))) == n
    assert time.perf_counter() - start < 60


def test_citations_of_sections(spark):
    df = spark.createDataFrame([(1, SAMPLE), (2, None)], "i int, t string")
    got = {r.i: r.sections for r in tx.split_sections(df, "t", cite=True).collect()}
    assert got[2] is None and [[tuple(c) for c in s.citations] for s in got[1]] == [plain_citations(s.text) for s in got[1]]
    assert df.where("t is null").select(tx.citations(F.col("t")).alias("c")).first().c is None


def test_entities(spark):
    text = "The Office of Public Gardens met the Harbor Safety Board and DOE. Office staff left; committees did not."
    assert one(spark, text, entities.organisations) == ["Harbor Safety Board", "Office of Public Gardens"]
    assert one(spark, text, entities.agencies_and(entities.organisations)) == ["DOE", "Harbor Safety Board", "Office of Public Gardens"]
    assert one(spark, "x" * 200_000 + " Harbor Board", entities.organisations) == ["Harbor Board"] and one(spark, "", entities.organisations) == []
    model = entities.with_model(lambda: lambda texts: [[w for w in t.split() if w.istitle()] + ["ab", "y" * 81] for t in texts])
    assert one(spark, "Some People met People", model) == ["People", "Some"]
    docs_ = spark.createDataFrame([("f", "f", 1, text)], "path string, stem string, page_count int, text string")
    assert docs.parse_documents(docs_, agencies=entities.agencies_and(entities.organisations)).first().sections[0].agencies[0] == "DOE"
