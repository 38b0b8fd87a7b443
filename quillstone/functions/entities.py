"""Names of organisations in text: a plug-in point, with a default that works offline.

``parse_sections`` and ``parse_documents`` take the agencies of a document from an expression over its text. A model is
plugged in with ``with_model``; ``organisations`` is a rule of built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import text as tx

#: Makes a function from texts to the entities in each of them; called once in a worker.
Entities = Callable[[], Callable[[list[str]], list[list[str]]]]

LEAST, MOST = 3, 80  #: characters of a name

# Words that make a run of capitalised words the name of an organisation.
HEADS = ("Administration", "Agency", "Authority", "Board", "Bureau", "Center", "Commission", "Committee", "Council", "Department", "Directorate", "Institute", "Laboratory", "Ministry", "Office", "Service")

_WORD = r"[A-Z][A-Za-z&-]*"
_HEAD = "(?:" + "|".join(HEADS) + ")"
ORGANISATION = rf"\b(?:{_WORD} )*{_HEAD}\b(?: (?:of|for|on)(?: the)? {_WORD}(?: {_WORD})*(?: and {_WORD}(?: {_WORD})*)?)*"


def _bounded(names: Column) -> Column:
    return F.filter(names, lambda x: F.length(x).between(LEAST, MOST))


def organisations(text: Column) -> Column:
    """Names of 3 to 80 characters that a rule finds: capitalised words around one that names a kind of body, with
    what "of" and the like join to it ("Office of Public Affairs"); such a word by itself is no name. Sorted, each
    once. The whole text is searched."""
    names = F.transform(F.regexp_extract_all(text, F.lit(ORGANISATION), F.lit(0)), lambda x: F.regexp_replace(x, "^The ", ""))
    return F.array_sort(F.array_distinct(F.filter(_bounded(names), lambda x: ~x.isin(*HEADS))))


def with_model(entities: Entities) -> Callable[[Column], Column]:
    """An expression that finds entities with a model, made once in a worker, on Arrow batches of texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = entities()
        for texts in batches:
            found = model([t or "" for t in texts])
            yield pd.Series([sorted({x for x in names if LEAST <= len(x) <= MOST}) for names in found])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<string>")


def agencies_and(found: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The dictionary's acronyms and the entities of ``found``, sorted, each once."""
    return lambda text: F.array_sort(F.array_union(tx.agencies(text), F.coalesce(found(text), F.array().cast("array<string>"))))
