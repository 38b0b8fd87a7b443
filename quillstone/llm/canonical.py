"""Mapping free-typed values to a canonical list.

Method: a trie of the list's entries, with further paths for their aliases, is searched with a Levenshtein automaton.
The trie has two layers. Each edge of the upper one is a word; the words themselves are in a trie of letters, in
which a typed word is followed with the automaton's states (swapped neighbours count as one edit), or, if it is
abbreviated, with a subsequence automaton. A value follows all paths whose words it may mean; those that end at
entries, with their distances, are the result. How far a word may be off depends on its length.

Values are resolved where they are read, each distinct one once in a task: nothing is shuffled to look it up, and a
value that makes up a third of all rows costs no more than another.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NONE = "none"
_REMEMBERED = 200_000  #: words and values whose meanings a task keeps


def allowed(n: int) -> int:
    """Edits allowed in a word of n letters."""
    return 0 if n <= 3 else 1 if n <= 7 else 2


class Letters:
    """A trie of words, searched by distance or as abbreviations."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = word

    def within(self, typed: str, most: int) -> dict[str, int]:
        """Words at most ``most`` edits away. The automaton's states are rows of the distance table, one for each
        letter followed; a path whose row has no small entry left is given up."""
        found: dict[str, int] = {}
        first = list(range(len(typed) + 1))
        stack = [(self.root, first, None, "")]
        while stack:
            node, row, before, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[-1] <= most:
                        found[child] = row[-1]
                    continue
                new = [row[0] + 1]
                for j, t in enumerate(typed, 1):
                    d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (t != c))
                    if before is not None and j > 1 and t == last and typed[j - 2] == c:
                        d = min(d, before[j - 2] + 1)
                    new.append(d)
                if min(new) <= most or (before is not None and min(row) <= most):
                    stack.append((child, new, row, c))
        return found

    def shortened(self, typed: str) -> dict[str, float]:
        """Words that ``typed`` abbreviates: it begins them, or its letters are in them in order, the first being
        the first."""
        found: dict[str, float] = {}
        if not typed or typed[0] not in self.root:
            return found
        stack = [(self.root[typed[0]], 1, True)]
        while stack:
            node, have, beginning = stack.pop()
            for c, child in node.items():
                if c == "":
                    if have == len(typed) and len(child) > len(typed):
                        found[child] = 0.1 if beginning else 0.2
                    continue
                if have < len(typed) and typed[have] == c:
                    stack.append((child, have + 1, beginning))
                else:
                    stack.append((child, have, beginning and have == len(typed)))
        return found


@dataclass(frozen=True)
class Token:
    """A word of a value. ``exact``: it must be met as it is (numbers, acronyms); ``short``: it looks abbreviated."""

    text: str
    exact: bool = False
    short: bool = False


class Entries:
    """The two-layered trie. ``prefer`` breaks ties between paths: names before aliases."""

    def __init__(self, edits: Callable[[int], int] = allowed, abbreviations: bool = True) -> None:
        self.letters = Letters()
        self.root: dict = {}
        self.edits, self.abbreviations = edits, abbreviations
        self._memo: dict[Token, list[tuple[str, float]]] = {}

    def add(self, tokens: Iterable[Token], entry: str, prefer: int = 0) -> None:
        node = self.root
        for t in tokens:
            if not t.exact:
                self.letters.add(t.text)
            node = node.setdefault(("=" if t.exact else "") + t.text, {})
        ends = node.setdefault("", {})
        ends[entry] = min(prefer, ends.get(entry, prefer))

    def _meanings(self, token: Token) -> list[tuple[str, float]]:
        got = self._memo.get(token)
        if got is None:
            if token.exact:
                got = [("=" + token.text, 0.0)]
            else:
                near: dict[str, float] = dict(self.letters.within(token.text, self.edits(len(token.text))))
                if self.abbreviations and 0 not in near.values() and (token.short or len(token.text) >= 4):
                    for word, cost in self.letters.shortened(token.text).items():
                        near[word] = min(near.get(word, 9), cost if token.short else cost + 0.5)
                got = list(near.items())
            if len(self._memo) >= _REMEMBERED:
                self._memo.clear()
            self._memo[token] = got
        return got

    def search(self, tokens: list[Token]) -> dict[str, tuple[float, int]]:
        """All entries that a path of the value's words leads to, with the least distance and preference."""
        states: list[tuple[dict, float]] = [(self.root, 0.0)]
        for token in tokens:
            means = self._meanings(token)
            states = [(node[w], cost + d) for node, cost in states for w, d in means if w in node]
            if not states:
                return {}
        found: dict[str, tuple[float, int]] = {}
        limit = 1 + sum(len(t.text) for t in tokens if not t.exact) / 8
        for node, cost in states:
            for entry, prefer in node.get("", {}).items():
                if cost <= limit:
                    found[entry] = min((round(cost, 3), prefer), found.get(entry, (9e9, 9)))
        return found


def closest(found: dict[str, tuple[float, int]]) -> tuple[float, str] | None:
    """The entry at the least distance; none if two different ones are equally near though not met exactly."""
    if not found:
        return None
    ranked = sorted((d, p, e) for e, (d, p) in found.items())
    if len(ranked) > 1 and ranked[0][:2] == ranked[1][:2] and ranked[0][0] > 0:
        return None
    return ranked[0][0], ranked[0][2]


Readings = Callable[[str], list[list[Token]]]


def resolve(value: str, trie: Entries, readings: Readings) -> tuple[float, str] | None:
    """The entry that a value means, by its likeliest reading that leads to one."""
    for tokens in readings(value):
        got = closest(trie.search(tokens))
        if got:
            return got
    return None


def within(value: str, trie: Entries, readings: Readings) -> list[tuple[float, str]]:
    """All entries that any reading of a value leads to, with their least distances, the nearest first."""
    found: dict[str, float] = {}
    for tokens in readings(value):
        for entry, (d, _) in trie.search(tokens).items():
            found[entry] = min(d, found.get(entry, d))
    return sorted((d, e) for e, d in found.items())


def _plain(s: str) -> str:
    s = unicodedata.normalize("NFKC", s).lower()
    return re.sub(r"[‐-―−]", "-", s).replace("’", "'")


# ---- names of bodies ----

#: Words that join the parts of a name; fixed values.
_JOINING = {"of", "on", "for", "and", "&", "the"}


def _name_tokens(s: str) -> list[Token]:
    out = []
    for word in re.split(r"[\s,;:/_-]+", s):
        letters = re.sub(r"[^a-z0-9]", "", word)
        if letters and word not in _JOINING and letters not in _JOINING:
            out.append(Token(letters, short=word.endswith(".") or "'" in word))
    return out


def body_readings(value: str) -> list[list[Token]]:
    """The ways to read a typed name, the likeliest first: the whole, then what is before, behind or between
    brackets or a dash, as these often hold the acronym."""
    s = re.sub(r"\s+", " ", _plain(value)).strip()
    s = re.sub(r"'s?(?=$|[\s,.])", "", s).strip(" ,;:")
    s = re.sub(r"^(the|u\. ?s\.|us)\s+", "", re.sub(r"^the\s+", "", s))
    s = re.sub(r"[\s,-]+(hq|h\.q\.|headquarters)\.?$", "", s).strip(" ,;:")
    inner = re.findall(r"\(([^)]*)\)", s)
    outer = re.sub(r"\([^)]*\)", " ", s).strip(" ,;:")
    parts = re.split(r"\s-\s", outer)
    texts = [outer, *sorted(parts, key=len, reverse=True), *inner]
    out: list[list[Token]] = []
    for t in dict.fromkeys(x.strip() for x in texts):
        packed = re.sub(r"[.\s]", "", t)
        if re.fullmatch(r"[a-z0-9]{2,8}", packed) and (re.fullmatch(r"[a-z0-9]+\.?", t) or re.fullmatch(r"([a-z]\.\s?)+[a-z]?\.?", t)):
            out.append([Token(packed, exact=True)])
        tokens = _name_tokens(t)
        if len(tokens) > 1 or (tokens and len(tokens[0].text) > 4):
            out.append(tokens)
    return out


def body_entries(rows: list[dict]) -> Entries:
    """A trie of bodies: paths for name, former names, both also turned round at each word ("Service, Field
    Inspection"), and the acronym. ``rows``: dicts with entry, name, acronym, former_names."""
    trie = Entries()
    for r in rows:
        for prefer, name in [(0, r["name"]), *[(1, f) for f in r.get("former_names") or []]]:
            tokens = [Token(t.text) for t in _name_tokens(_plain(name or ""))]
            if tokens:
                trie.add(tokens, r["entry"], prefer)
                if len(tokens) > 1:
                    # the kind of body is the first word ("Office of ...") or the last ("... Office")
                    trie.add([*tokens[1:], tokens[0]], r["entry"], prefer + 2)
                    trie.add([tokens[-1], *tokens[:-1]], r["entry"], prefer + 2)
        acronym = re.sub(r"[^a-z0-9]", "", _plain(r.get("acronym") or ""))
        if acronym:
            trie.add([Token(acronym, exact=True)], r["entry"])
    return trie


# ---- citations ----

#: How the kinds of citations are written, without blanks and full stops; fixed values.
_KINDS = {
    "cfr": ("cfr", "codeoffederalregulations", "codefederalregulations"),
    "usc": ("usc", "uscode", "unitedstatescode"),
    "eo": ("eo", "executiveorder", "execord", "execorder", "exorder"),
    "pl": ("pl", "publiclaw", "publaw", "publlaw", "publ", "publicl", "publno", "publiclawno", "plno"),
    "hspd": ("hspd", "homelandsecuritypresidentialdirective", "presidentialdirectivehspd", "presidentialdirective"),
}
#: Directives' letters and names; fixed values.
_DIRECTIVES = {"o": "order", "p": "policy", "m": "manual", "g": "guide", "n": "notice"}
#: Letters that stand for digits in bad scans; fixed values.
_SCANNED = str.maketrans({"l": "1", "i": "1", "|": "1", "o": "0", "s": "5"})
_D = "[0-9lios|]"
_SUB = re.compile(rf"(?<![a-z0-9])(?={_D}*[0-9]){_D}+(?:\.{_D}+)*(?:-{_D}+)?(?![a-z0-9])")
_PLACE = re.compile(r"\b(title|part|pt|parts|section|sections|sec|secs|sect)\b\.?|§+|\bno\b\.?")


_KIND_OF = {f: kind for kind, forms in _KINDS.items() for f in forms}


def citation_edits(n: int) -> int:
    """Edits allowed in a citation's n letters: kinds are few and far apart, and numbers are met as they are."""
    return 0 if n < 3 else 1 if n < 9 else 2 if n < 16 else 3


def _digits(s: str) -> str:
    return s.translate(_SCANNED)


def _letters(s: str) -> str:
    return re.sub(r"[^a-z]", "", s)


def citation_readings(value: str) -> list[list[Token]]:
    """The ways to read a typed citation: the letters that say its kind, put together, then its numbers in order (with
    digits for the letters that bad scans put there), which must be met as they are. A directive has its body, its
    type and its number. What none of them fits is met only as written."""
    s = re.sub(r"\s+", " ", _plain(value)).strip(" .,;:")
    s = re.sub(r"\([^)]*\)", " ", s)
    s = re.sub(r"[\s,]+(chg|change|chng|ch)\b\.?\s*[0-9lio]+\s*$", "", s.strip(" .,;:")).strip(" .,;:")
    out: list[list[Token]] = []
    m = re.fullmatch(rf"(?:((?:[a-z]\.\s?){{3}}|[a-z]{{2,4}})[\s.-]+)?([a-z]{{4,7}}|[opmgn])[\s.-]*({_D}{{2,4}}\.{_D}{{1,2}})\s*-?\s*([a-z])?", s)
    if m and re.search("[0-9]", m[3]):
        body = [Token(_letters(m[1]))] if m[1] else []
        out.append([*body, Token(m[2], exact=len(m[2]) == 1), Token(_digits(m[3]) + (m[4] or ""), exact=True)])
    tight = re.fullmatch(rf"({_D}+)\s*([a-z.]{{3,8}}?)\s*({_D}[0-9lios|.-]*)", s)  # "10CFR20"
    if tight and re.search("[0-9]", tight[1]) and re.search("[0-9]", tight[3]):
        out.append([Token(_letters(tight[2])), Token(_digits(tight[1]), exact=True), Token(_digits(tight[3].strip(".-")), exact=True)])
    for cut in range(2, 6):  # "EO12"
        head, tail = s[:cut], s[cut:]
        if re.fullmatch("[a-z.]+", head) and re.match(rf"{_D}*[0-9]", tail) and head.replace(".", "") in _KIND_OF:
            s = f"{head} {tail}"
            break
    s = re.sub(r"(?<=[0-9lios]),(?=[0-9lios]{3}(?![0-9a-z]))", "", s)
    spread = re.sub(r"\s*-\s*", "-", s)
    places = list(_SUB.finditer(spread))
    numbers = [_digits(n[0]) for n in places]
    if len(places) == 2 and re.search(r"(\bparts?|\bpt|\bsec\w*|§)[\s.]*$", spread[: places[0].start()]):
        numbers.reverse()  # the part comes first: "Part 12 of 10 CFR"
    words = _PLACE.sub(" ", _SUB.sub(" ", spread))
    flat = [p for n in numbers for p in n.split("-")]
    for letters in dict.fromkeys((_letters(re.sub(r"\bof\b(?=[\s.,-]*(?:[a-z]\.?\s?){3}\s*$)", " ", words)), _letters(re.sub(r"\bof\b", " ", words)))):
        if letters and numbers:
            for parts in (numbers, flat) if flat != numbers else (numbers,):
                out.append([Token(letters), *(Token(n, exact=True) for n in parts)])
    return [*out, [Token("=", exact=True), Token(_plain(value), exact=True)]]


def citation_entries(rows: list[dict]) -> Entries:
    """A trie of citations: a path for each way to write an entry's kind, with its numbers. ``rows``: dicts with entry
    and name. A citation that can't be read has only the path of its name."""
    trie = Entries(citation_edits, abbreviations=False)
    types = {**_DIRECTIVES, **{w: w for w in _DIRECTIVES.values()}}
    for r in rows:
        name = r["name"] or ""
        trie.add([Token("=", exact=True), Token(_plain(name), exact=True)], r["entry"])
        for tokens in citation_readings(name)[:-1]:
            kind, rest = tokens[0].text, tokens[1:]
            if kind == "doe" and len(rest) == 2 and rest[0].text in types:
                word = types[rest[0].text]
                for path in ([tokens[0], Token(word[0], exact=True)], [tokens[0], Token(word)], [Token(word)]):
                    trie.add([*path, rest[1]], r["entry"])
                break
            if kind in _KIND_OF:
                # a law's two numbers are told apart, those of a part stay together
                numbers = [Token(p, exact=True) for t in rest for p in (t.text.split("-") if _KIND_OF[kind] == "pl" else [t.text])]
                if len(numbers) == (2 if _KIND_OF[kind] in ("cfr", "usc", "pl") else 1):
                    for form in _KINDS[_KIND_OF[kind]]:
                        trie.add([Token(form), *numbers], r["entry"])
                    break
    return trie


# ---- tables ----


def _searched(values: DataFrame, value: str, entries: list[dict], build: Callable[[list[dict]], Entries], find: Callable[[str, Entries], list[tuple[float, str]]], drop: tuple[str, ...]) -> DataFrame:
    """``values`` with ``found_``, an array of entries and distances; each distinct value is searched once in a task."""
    kept = [f for f in values.schema if f.name not in drop]
    item = T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("entry_id", T.StringType())])
    schema = T.StructType([*kept, T.StructField("found_", T.ArrayType(item))])
    names = [f.name for f in kept]
    kind = pa.list_(pa.struct([("distance", pa.float64()), ("entry_id", pa.string())]))
    shared = values.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memo = build(shared.value), {}
        for batch in batches:
            column = batch.column(value).dictionary_encode()
            found = []
            for v in column.dictionary.to_pylist():
                if v not in memo:
                    if len(memo) >= _REMEMBERED:
                        memo.clear()
                    memo[v] = [{"distance": d, "entry_id": e} for d, e in find(v, trie)]
                found.append(memo[v])
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found, kind).take(column.indices)], names=[*names, "found_"])

    return values.select(*names).mapInArrow(run, schema)


def map_values(values: DataFrame, value: str, entries: list[dict], build: Callable[[list[dict]], Entries], readings: Readings) -> DataFrame:
    """``values`` with a column ``entry_id``: the entry that ``value`` means, else ``none``; a column of that name is
    replaced. Null and blank values are ``none``, and so is one that is equally near to two entries. ``entries`` is on
    the driver and in every task: it is the clean list, of a size that ``listed`` bounds, not data; there is one trie
    whatever its length."""
    found = _searched(values, value, entries, build, lambda v, trie: [x for x in [resolve(v, trie, readings)] if x], ("entry_id", "found_"))
    return found.withColumn("entry_id", F.coalesce(F.get("found_", F.lit(0))["entry_id"], F.lit(NONE))).drop("found_")


def candidates(values: DataFrame, value: str, entries: list[dict], build: Callable[[list[dict]], Entries], readings: Readings) -> DataFrame:
    """``values`` with ``entry_id`` and ``distance``, a row for each of all entries within the distance of ``value``
    that its length allows; values without one have no row. Columns of these names are replaced."""
    found = _searched(values, value, entries, build, lambda v, trie: within(v, trie, readings), ("entry_id", "distance", "found_"))
    return found.select(*[c for c in found.columns if c != "found_"], F.explode("found_").alias("f")).select("*", "f.entry_id", "f.distance").drop("f")


def listed(df: DataFrame, entry: str, name: str, most: int = 200_000, **more: str) -> list[dict]:
    """The clean list's rows as dicts with entry, name and other columns. It must fit the driver and each task: ValueError
    beyond ``most`` rows."""
    rows = df.select(F.col(entry).alias("entry"), F.col(name).alias("name"), *[F.col(c).alias(k) for k, c in more.items()]).where("entry is not null and name is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the list has more than {most} entries")
    return [r.asDict(recursive=True) for r in sorted(rows, key=lambda r: r.entry)]


def typed_values(df: DataFrame, key: str, values: Column, field: str, names: list[dict]) -> DataFrame:
    """``(key, field, pos, value)`` of the values of an array column that are not a listed name letter for letter.
    Nulls in the array keep their place and are left out; rows that repeat a key count once."""
    rows = df.select(F.col(key).alias(key), F.posexplode(values).alias("pos", "value")).where(F.col("value").isNotNull())
    written = df.sparkSession.createDataFrame([(r["name"],) for r in names] or [], "value string")
    return rows.join(written.distinct(), "value", "left_anti").select(key, F.lit(field).alias("field"), "pos", "value")
