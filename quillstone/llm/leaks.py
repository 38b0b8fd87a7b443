"""Evaluation items that leak into training documents.

Method: one FM-index per shard of the corpus. A shard is a run of whole documents in one task; its words become
integers, its Burrows-Wheeler transform is stored as a wavelet matrix, all phrases are searched backward at the same
time, block after block of items, and sampled suffix positions give the places. Documents never move: the only
shuffle is of the hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.words import Words, slices
from quillstone.session import arrow_filesystem, materialize, shared_path


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in lexical order. The last symbol is 0 and occurs nowhere else.

    Prefix doubling: the first sort takes as many symbols as fit into a key; each later round sorts only suffixes
    that are still tied with another one, by the ranks of what follows.
    """
    n = len(text)
    width = max(1, int(text.max(initial=0)).bit_length())
    have = max(1, min(62 // width, 16))
    key = np.zeros(n, np.int64)
    for j in range(have):
        key <<= width
        key[: n - j] |= text[j:]
    order = np.argsort(key)
    at = np.arange(n, dtype=np.int64)
    sorted_ = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, at, 0))
    places = at
    while True:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        places = places[tied]
        if not len(places):
            return order
        p = order[places]
        key = rank[p] * np.int64(n) + rank[np.minimum(p + have, n - 1)]
        by = np.argsort(key)
        p, key = p[by], key[by]
        order[places] = p
        fresh = np.ones(len(p), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[p] = np.maximum.accumulate(np.where(fresh, places, 0))
        have *= 2


class FMIndex:
    """An FM-index of a sequence of symbols whose last one is 0 and occurs nowhere else."""

    STEP = 8  #: every so many text positions are kept; the others are found by walking back

    def __init__(self, text: np.ndarray):
        text = text.astype(np.int64)
        self.n = len(text)
        sigma = int(text.max(initial=0)) + 1
        order = suffix_order(text)
        self.bwt = text[order - 1]  # before position 0 comes the last symbol
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.sampled = order % self.STEP == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []  # a wavelet matrix: zeros before each place, and in all
        level = self.bwt
        for b in range(self.bits - 1, -1, -1):
            one = ((level >> b) & 1).astype(bool)
            zeros = np.zeros(self.n + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((zeros, int(zeros[-1])))
            level = np.concatenate([level[~one], level[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i symbols of the transform."""
        low = np.zeros(len(symbol), np.int64)
        for b, (zeros, border) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = ((symbol >> b) & 1).astype(bool)
            i0, l0 = zeros[i], zeros[low]
            i = np.where(one, border + i - i0, i0)
            low = np.where(one, border + low - l0, l0)
        return i - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase, for all phrases at once. ``phrases``: one row each, of
        which ``lengths`` symbols count; a phrase with a symbol below 0 occurs nowhere."""
        p = len(lengths)
        lo, hi = np.zeros(p, np.int64), np.full(p, self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            on = np.flatnonzero((j < lengths) & (lo < hi))
            if not len(on):
                continue
            s = phrases[on, j]
            known = s >= 0
            lo[on[~known]] = hi[on[~known]] = 0
            on, s = on[known], s[known]
            base = self.starts[s]
            lo[on], hi[on] = base + self.rank(s, lo[on]), base + self.rank(s, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out = np.full(len(rows), -1, np.int64)
        at, back = rows.copy(), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            r = at[left]
            got = self.sampled[r]
            done = left[got]
            out[done] = self.samples[self.sample_rank[at[done]]] + back[done]
            left = left[~got]
            r = at[left]
            s = self.bwt[r]
            at[left] = self.starts[s] + self.rank(s, r)
            back[left] += 1
        return out


def phrases_of(items: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct phrases to look for: their words' hashes, one row each, and their lengths; then the pairs of
    phrase and item. An item has a phrase at each run of ``window`` words, or is one phrase if it is shorter."""
    words = Words(items.column("text"))
    rows, lengths, of = [], [], []
    for i in range(items.num_rows):
        h = words.hash[words.first[i] : words.first[i + 1]]
        if not len(h):
            continue
        if len(h) >= window:
            rows.append(np.lib.stride_tricks.sliding_window_view(h, window))
        else:
            rows.append(np.concatenate([h, np.zeros(window - len(h), np.uint64)])[None])
        lengths.append(np.full(len(rows[-1]), min(len(h), window)))
        of.append(np.full(len(rows[-1]), i))
    if not rows:
        return np.zeros((0, window), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.column_stack([np.concatenate(rows), np.concatenate(lengths).astype(np.uint64)])
    distinct, which = np.unique(both, axis=0, return_inverse=True)
    return distinct[:, :-1], distinct[:, -1].astype(np.int64), which.ravel(), np.concatenate(of)


class Shard:
    """The FM-index of the texts of one shard, built once; any number of blocks of phrases is searched in it."""

    def __init__(self, words: Words):
        self.vocabulary, symbol = np.unique(words.hash, return_inverse=True)
        self.filled = np.flatnonzero(words.counts > 0)
        first = words.first[:-1][self.filled]
        self.begins = first + np.arange(len(self.filled))  # of the marks before each text
        # 0 ends the shard, 1 stands before each text, words are 2 and up
        text = np.insert(symbol.ravel().astype(np.int64) + 2, first, 1)
        self.index = FMIndex(np.append(text, 0)) if len(words.hash) else None

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences: row of the text, number of the word at which it begins, and the phrase."""
        none = (np.zeros(0, np.int64),) * 3
        if self.index is None or not len(lengths):
            return none
        at = np.searchsorted(self.vocabulary, phrases)
        known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == phrases
        lo, hi = self.index.search(np.where(known, at + 2, -1), lengths)
        n = hi - lo
        if not n.sum():
            return none
        phrase = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = self.index.locate(rows)
        mark = np.searchsorted(self.begins, place, "right") - 1
        return self.filled[mark], place - self.begins[mark] - 1, phrase


def merged_spans(doc: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Joins spans of the same document and item that touch or overlap."""
    by = np.lexsort((end, begin, item, doc))
    doc, item, begin, end = doc[by], item[by], begin[by], end[by]
    group = np.ones(len(doc), bool)
    group[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    number = np.cumsum(group)
    span = int(end.max(initial=0)) + 2
    reach = np.maximum.accumulate(end + number * span) - number * span  # farthest end so far within the group
    new = group.copy()
    new[1:] |= begin[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(doc)) - 1
    return doc[heads], item[heads], begin[heads], reach[tails]


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 12, items_at_once: int = 20_000, shard_bytes: int = 8 << 20) -> DataFrame:
    """Where documents contain ``window`` consecutive words of an item, or all words of a shorter item:
    ``(doc_id, item_id, first_word, end_word)``, one row for each span of words to remove, ends exclusive, merged.

    * Words are runs of a-z and 0-9 after lower-casing, so case, line breaks and punctuation make no difference.
    * Null, empty and wordless texts and items have no row. Repeated rows and copies are each reported under their
      own id; rows that repeat an id too are merged. Other columns are not read, whatever their names.
    * Items are written to the shared folder in blocks of about ``items_at_once``. A task indexes each of its shards
      once and searches all blocks in it, one in memory at a time; no item passes through the driver.
    """
    names = [doc_id, item_id] if doc_id != item_id else [doc_id, f"{item_id}_item"]
    schema = T.StructType([T.StructField(names[0], docs.schema[doc_id].dataType), T.StructField(names[1], items.schema[item_id].dataType), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())])
    files = _blocks(items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where(F.length("text") > 0).distinct(), window, items_at_once)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(files)
        for batch in batches:
            for part in slices(batch, "t", shard_bytes):
                shard = Shard(Words(part.column("t")))
                for block in blocks:
                    row, word, phrase = shard.search(block.phrases, block.lengths)
                    if not len(row):
                        continue
                    n = np.diff(block.borders)[phrase]  # one hit for each item that has the phrase
                    item = block.item_no[np.repeat(block.borders[phrase], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    row, word, size = np.repeat(row, n), np.repeat(word, n), np.repeat(block.lengths[phrase], n)
                    row, item, begin, end = merged_spans(row, item, word, word + size)
                    yield pa.RecordBatch.from_arrays([part.column("d").take(pa.array(row)), block.items.take(pa.array(item)), pa.array(begin), pa.array(end)], names=schema.names)

    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where(F.length("t") > 0).mapInArrow(run, schema).distinct()


class Block:
    """Distinct phrases of a block of items, and the items of each."""

    def __init__(self, table: pa.Table, window: int):
        self.items = table["item"].combine_chunks()
        self.phrases, self.lengths, phrase_no, item_no = phrases_of(table, window)
        by = np.argsort(phrase_no, kind="stable")
        self.item_no, self.borders = item_no[by], np.searchsorted(phrase_no[by], np.arange(len(self.lengths) + 1))


class Blocks:
    """All blocks of items as a task sees them: read one after the other, a single one only once."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files, self.only = files, None

    def __iter__(self) -> Iterator[Block]:
        for uri, window in self.files:
            if self.only is None or len(self.files) > 1:
                fs, path = arrow_filesystem(uri)
                with fs.open_input_file(path) as f:
                    self.only = Block(pa.ipc.open_file(f).read_all(), window)
            yield self.only


def _blocks(items: DataFrame, window: int, size: int) -> list[tuple[str, int]]:
    """Writes the items in blocks; the names of their files, one for about ``size`` items, come back."""
    spark = items.sparkSession
    folder = shared_path(spark, "items")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if len(b)]
        if not table:
            return
        fs, path = arrow_filesystem(folder)
        fs.create_dir(path, recursive=True)
        name = uuid.uuid4().hex  # an attempt that fails leaves a file that no one reads
        with fs.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_file(out, table[0].schema) as writer:
            for b in table:
                writer.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    parts = max(1, -(-items.count() // size))
    made = materialize(items.repartition(parts, "item", "text").mapInArrow(write, "name string"), "item_blocks")
    return [(f"{folder}/{r.name}", window) for r in made.orderBy("name").collect()]


def leaked_pairs(hits: DataFrame) -> DataFrame:
    """Documents with the items that leaked into them, each pair once."""
    return hits.select(*hits.columns[:2]).distinct()
