import random

import pytest
from pyspark.sql import functions as F

from quillstone.llm.canonical import Letters, body_entries, body_readings, candidates, citation_entries, citation_readings, listed, map_values, resolve, typed_values, within


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_distance_table():
    rng = random.Random(1)
    words = {"".join(rng.choices("abc", k=rng.randrange(0, 7))) for _ in range(150)}
    trie = Letters()
    for w in words:
        trie.add(w)
    for _ in range(150):
        q = "".join(rng.choices("abcd", k=rng.randrange(0, 7)))
        for most in (0, 1, 2):
            assert trie.within(q, most) == {w: osa(q, w) for w in words if osa(q, w) <= most}


def test_abbreviations():
    trie = Letters()
    for w in ("service", "services", "science", "board", "commission"):
        trie.add(w)
    assert trie.shortened("svc") == {"service": 0.2, "services": 0.2}
    assert trie.shortened("servi") == {"service": 0.1, "services": 0.1}
    assert trie.shortened("commn") == {"commission": 0.2} and trie.shortened("xyz") == {} and trie.shortened("") == {}


BODIES = [
    {"entry": "A1", "name": "Quarry Restoration Service", "acronym": "QRS", "former_names": []},
    {"entry": "A2", "name": "Office of Hydrogen Safety", "acronym": "OHS", "former_names": ["Council on Fire"]},
    {"entry": "A3", "name": "Center for Archive Services", "acronym": "CAS", "former_names": None},
    {"entry": "A4", "name": "Hydrogen Safety Agency", "acronym": None, "former_names": ["Bureau of Fire & Gas"]},
]
TYPED = {
    "Quarry  Resto. Svc.": "A1", "SERVICE, QUARRY RESTORATION,": "A1", "the Qaurry Restoraton Service HQ": "A1", "Q.R.S.": "A1", "qrs": "A1", "QRS - Quarry Restoration Service": "A1",
    "Quarry Restoration Service (QRS)": "A1", "U.S. Quarry-Restoration-Service's": "A1", "Hydrogen Safety, Ofc. of": "A2", "Council on Fire": "A2", "Bur. of Fire and Gas": "A4", "Hydro. Safety Agcy.": "A4", "Center for Archive Servi.": "A3",
    "Quarry Restoration Board": None, "QXRS": None, "HQ": None, "various": None, "": None, "the": None, "Bureau of Hydrogen Safety": None, "...": None,
}


def test_bodies():
    trie = body_entries(BODIES)
    for typed, entry in TYPED.items():
        got = resolve(typed, trie, body_readings)
        assert (got and got[1]) == entry, (typed, got)


def test_citations():
    same = {
        "79 CFR 1401.2-3": ["79 CFR 1401.2-3", "Part 1401.2-3 of 79 CFR", "CFR Title 79, Part 1401.2-3", "79CFRl4O1.2-3", "79  C F R  1401.2-3.", "79 Code of Federal Regulations 1401.2-3", "79 crf § 1401.2-3"],
        "88 USC 8546": ["88 USC 8546", "sec. 8546, 88 U.S.C.", "Title 88 U.S. Code, section 8546", "88UCS8546", "88 usc §8546", " 88 U.S.C. Sec. 8546."],
        "PL 177-632": ["PL 177-632", "Pub. L. No. 177–632", "P.L. l77-632", "public law 177 - 632", "PL177-632", "Pubic Law 177-632"],
        "EO 38782": ["EO 38782", "E. O. 38,782", "Executive Oder 38782", "EO-38782", "Exec. Order No. 38782"],
        "HSPD 112": ["HSPD 112", "hspd 1l2", "HPSD-112", "H.S.P.D. 112", "Homeland Security Presidential Directive 112", "Presidential Directive HSPD 112"],
        "DOE O 671.3A": ["DOE O 671.3A", "D.O.E. O 671.3A", "DEO O 67l.3A", "DOE-O-671.3A", "DOE O671.3 A. Chg 2", "Order 671.3A", "DOE ORDER 671.3A (Admin)"],
        "DOE P 686.9": ["Policy 686.9", "DOE P 686.9,"],
        None: ["ibid.", "", "79 CFR", "same as para. 4", "12", "79 CFR 1401.2", "79 CFR 1401.2-4", "88 CFR 8546", "88 USC 79", "8546 USC 88", "PL 632-177", "EO 38783", "HSPD 38782", "P 671.3A", "O 671.3A"],
    }
    trie = citation_entries([{"entry": k, "name": k} for k in same if k])
    for key, forms in same.items():
        for f in forms:
            got = resolve(f, trie, citation_readings)
            assert (got and got[1]) == key, f
    trie = citation_entries([{"entry": "R1", "name": "79 CFR 1401"}, {"entry": "R2", "name": "DOE O 671.3A"}, {"entry": "R3", "name": "as agreed"}])
    for typed, entry in {"Part 140l of 79 CFR": "R1", "79 CFR 1402": None, "79 USC 1401": None, "DOE O 671.3B": None, "DOE M 671.3A": None, "AS AGREED": "R3"}.items():
        got = resolve(typed, trie, citation_readings)
        assert (got and got[1]) == entry, typed


def test_all_entries_within_the_distance():
    names = ["Harbor Board", "Harber Board", "Harbor Boards", "Harbour Bord"]
    trie = body_entries([{"entry": n, "name": n} for n in names])
    for typed in (*names, "Harbor Bord", "Hrbor Boord"):
        got = within(typed, trie, body_readings)
        assert [d for d, _ in got] == sorted(d for d, _ in got)
        got = {e: d for d, e in got}
        for n in names:  # an abbreviation may be nearer than its edits
            d = [osa(a, b) for a, b in zip(typed.lower().split(), n.lower().split(), strict=True)]
            assert (got[n] <= sum(d)) if all(x <= 1 for x in d) else True


def test_tables(spark):
    rows = [(1, ["Quarry Restoration Service", None, "qrs", ""]), (1, ["Quarry Restoration Service", None, "qrs", ""]), (2, None), (3, []), (4, ["HQ", "x" * 50_000]), (None, ["OHS"])]
    df = spark.createDataFrame(rows, "key long, names array<string>").withColumn("value", F.lit("clash"))
    sections = spark.createDataFrame([(b["entry"], b["name"], b["acronym"], b["former_names"]) for b in BODIES], "agency_id string, name string, acronym string, former_names array<string>")
    names = listed(sections, "agency_id", "name", acronym="acronym", former_names="former_names")
    typed = typed_values(df, "key", F.col("names"), "agency", names)
    want = {(1, 2, "A1"), (1, 3, "none"), (4, 0, "none"), (4, 1, "none"), (None, 0, "A2")}
    got = map_values(typed, "value", names, body_entries, body_readings).select("key", "pos", "entry_id").distinct()
    assert {tuple(r) for r in got.collect()} == want
    every = candidates(typed, "value", names, body_entries, body_readings).select("key", "pos", "entry_id").distinct()
    assert {tuple(r) for r in every.collect()} == {x for x in want if x[2] != "none"}
    assert map_values(typed.limit(0), "value", names, body_entries, body_readings).collect() == []
    assert {r.entry_id for r in map_values(typed, "value", [], body_entries, body_readings).collect()} == {"none"}


def test_a_long_list_gives_the_same_as_a_short_one(spark):
    """Beside 25,000 other entries a value means what it means in the short list; a tie stays one."""
    others = [{"entry": f"Z{i}", "name": f"Bureau {i} of " + "".join(chr(97 + int(c)) for c in f"{i:06d}") * 3} for i in range(25_000)]
    tied = [{"entry": "T1", "name": "Cabin Watch Board"}, {"entry": "T2", "name": "Cabon Watch Board"}]
    typed = spark.createDataFrame([("Cabxn Watch Board",), ("Quarry Resto. Svc.",), (None,)], "value string")
    for more in ([], others):
        got = map_values(typed, "value", BODIES + tied + more, body_entries, body_readings).collect()
        assert [r.entry_id for r in got] == ["none", "A1", "none"]
    with pytest.raises(ValueError):
        listed(spark.range(5).selectExpr("cast(id as string) as e", "'x' as n"), "e", "n", most=4)
