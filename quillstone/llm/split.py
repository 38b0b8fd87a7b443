"""Cutting oversized texts into overlapping pieces at natural boundaries.

Method: pointer doubling. Every possible start of a piece is joined to the start of the piece after it, all at
once with array operations; squaring that successor table gives, in a logarithmic number of steps, all starts that
can be reached from the first one. The operator is a narrow transformation: no shuffle besides that of the pieces'
positions, which counts repeated rows once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE, _TAB, _LF, _CR = 32, 9, 10, 13
_STOPS = (ord("."), ord("!"), ord("?"))


@dataclass(frozen=True)
class SplitRule:
    """``limit``: most characters of a piece; ``least``: a cut lies further than this behind the piece's start;
    ``overlap``: how far back the next piece may begin; ``window``: characters of a very long text worked on at once."""

    limit: int = 2048
    least: int = 1024
    overlap: int = 200
    window: int = 1 << 20

    def __post_init__(self) -> None:
        if not 0 < self.overlap < self.least < self.limit:
            raise ValueError("0 < overlap < least < limit must hold, else pieces need not move on")
        if self.window < 4 * self.limit:
            raise ValueError("window must be at least four times the limit")


def _last_at(flags: np.ndarray) -> np.ndarray:
    """For each position, the last flagged position up to it, or -1."""
    at = np.where(flags, np.arange(len(flags), dtype=np.int64), -1)
    return np.maximum.accumulate(at)


def _tables(chars: np.ndarray, rule: SplitRule) -> tuple[np.ndarray, np.ndarray]:
    """For each start: the end of the piece that begins there, and the start of the next one. Only starts that
    leave more than ``limit`` characters have an entry."""
    n = len(chars)
    white = (chars == _SPACE) | (chars == _TAB) | (chars == _LF) | (chars == _CR)
    after = np.zeros(n + 1, bool)  # position directly after a white space
    after[1:] = white
    kinds = [np.zeros(n + 1, bool) for _ in range(3)]
    lf = chars == _LF
    kinds[0][2:] = lf[1:] & lf[:-1]
    kinds[1][1:] = lf
    kinds[2][2:] = white[1:] & np.isin(chars[:-1], _STOPS)
    starts = np.arange(max(0, n - rule.limit), dtype=np.int64)
    end = starts + rule.limit
    open_ = np.ones(len(starts), bool)
    for flags in (*kinds, after):
        best = _last_at(flags)[starts + rule.limit]
        use = open_ & (best > starts + rule.least)
        end[use] = best[use]
        open_ &= ~use
    following = np.where(after, np.arange(n + 1, dtype=np.int64), n + 1)
    following = np.minimum.accumulate(following[::-1])[::-1]  # first position after a white space, from here on
    first = following[end - rule.overlap]
    return end, np.where(first < end, first, end - rule.overlap)


def _reach(next_: np.ndarray, start: int) -> np.ndarray:
    """All starts on the way from ``start``, by squaring the successor table. A start without a successor of its
    own is the last one."""
    n = len(next_)
    top = max(n, int(next_.max()) if n else 0, start) + 1
    jump = np.arange(top, dtype=np.int64)
    jump[:n] = next_
    found = np.array([start], np.int64)
    while True:
        reached = np.unique(np.concatenate([found, jump[found]]))
        if len(reached) == len(found):
            return found
        found = reached
        jump = jump[jump]


def cut(text: str, rule: SplitRule = SplitRule()) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each piece of ``text``, in code points. A text within the limit is one piece; an empty one
    has none."""
    n = len(text)
    if n <= rule.limit:
        return (np.zeros(1, np.int64), np.array([n], np.int64)) if n else (np.zeros(0, np.int64),) * 2
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts, ends, base = [], [], 0
    while True:
        part = chars[base : base + rule.window]
        last = base + len(part) == n
        end, next_ = _tables(part, rule)
        # what is near the part's end may be cut differently with more text in sight: the next part does it again
        got = _reach(next_, 0)
        whole = got[got < len(end)]
        starts.append(base + whole)
        ends.append(base + end[whole])
        if last:
            tail = got[got >= len(end)]
            starts.append(base + tail)
            ends.append(np.full(len(tail), n, np.int64))
            return np.concatenate(starts), np.concatenate(ends)
        base += int(next_[whole[-1]])


def split_texts(df: DataFrame, key: str, text: str, rule: SplitRule = SplitRule(), only_long: bool = False, with_text: bool = False) -> DataFrame:
    """Pieces of every text: ``(key, text_hash, piece_no, start_pos, end_pos)``, positions in code points, the end
    exclusive; with ``with_text``, also ``piece``, the text itself.

    * Rows that repeat a key with the same text count once. A key's different texts are told by ``text_hash`` and
      have their pieces each, null keys too.
    * A null or empty text has no piece; a text within the limit is one piece, or none with ``only_long``.
    * Other columns of ``df``, whatever their names, are not read.
    * A piece's end is the last boundary of the best kind in sight: blank line, line end, sentence end, white space,
      else a cut at the limit. The next piece starts after a white space within the overlap, else ``overlap`` before.

    Texts are cut where they are read; what is shuffled to drop repeated rows are pieces, not texts (unless they are
    asked for).
    """
    out_key = df.schema[key]
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h")).where(F.col("t").isNotNull() & (F.length("t") > (rule.limit if only_long else 0)))
    fields = [T.StructField(key, out_key.dataType), T.StructField("text_hash", T.LongType()), T.StructField("piece_no", T.IntegerType()), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())]
    schema = T.StructType([*fields, *([T.StructField("piece", T.StringType())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, starts, ends, pieces = [], [], [], []
            for t in batch.column("t"):
                body = t.as_py()
                s, e = cut(body, rule)
                n.append(len(s))
                starts.append(s)
                ends.append(e)
                if with_text:
                    pieces += [body[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
            counts = np.array(n, np.int64)
            if not counts.sum():
                continue
            rows_ = pa.array(np.repeat(np.arange(len(counts)), counts))
            piece = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            columns = [batch.column("k").take(rows_), batch.column("h").take(rows_), pa.array(piece.astype(np.int32)), pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends))]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(pieces, pa.string())] if with_text else [])], names=schema.names)

    return rows.mapInArrow(run, schema).dropDuplicates([key, "text_hash", "piece_no"])
