"""Words, shingles and their hashes, computed for whole Arrow batches at once.

A *word* is a maximal run of ``a-z`` and ``0-9`` after lower-casing. All functions work on the UTF-8 buffer of
an Arrow string column with numpy, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_BASE = np.uint64(0x9E3779B97F4A7C55 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SLICE = 1 << 20  #: bytes of text hashed at once
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        code = np.zeros(256, np.uint8)  # 0 outside words, else 1..36
        code[ord("a") : ord("z") + 1] = np.arange(1, 27)
        code[ord("A") : ord("Z") + 1] = np.arange(1, 27)
        code[ord("0") : ord("9") + 1] = np.arange(27, 37)
        _TABLES["code"] = code
        _grow(1 << 12)
    return _TABLES


def _grow(n: int) -> None:
    for name, base in (("up", _BASE), ("down", _INV)):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        _TABLES[name] = np.multiply.accumulate(powers)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets into them; nulls are empty. Lower-casing that turns another
    character into ASCII (Kelvin sign, dotted capital I) is done here; plain capitals are left to the tables."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    raw = buf.tobytes() if (buf == 0xE2).any() or (buf == 0xC4).any() else b""
    if b"\xe2\x84\xaa" in raw or b"\xc4\xb0" in raw:
        lowered = pa.array([t.lower() for t in texts.to_pylist()], pa.large_string())
        _, offsets, data = lowered.buffers()
        off = np.frombuffer(offsets, np.int64)[: n + 1]
        buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return buf, off - off[0]


class Words:
    """The words of a batch of texts: ``hash`` of each, ``start`` and ``end`` as byte positions in ``buf``, and
    ``first``, the n + 1 offsets of each text's words."""

    def __init__(self, texts: pa.Array):
        self.buf, self.offsets = utf8(texts)
        tables = _tables()
        code = tables["code"][self.buf]
        # a word never spans two texts: a border counts as a gap
        inside = np.zeros(len(code) + 1, bool)
        inside[:-1] = code > 0
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            change = np.concatenate([[0], change])
        start, end = change[0::2], change[1::2]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(code))]
        cut = np.unique(cut[inside[cut - 1] & inside[cut]]) if len(cut) else cut
        if len(cut):  # a word that runs over the border of two texts is two words
            start = np.sort(np.concatenate([start, cut]))
            end = np.sort(np.concatenate([end, cut]))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, self.offsets)
        self.hash = self._hash(code)

    def _hash(self, code: np.ndarray) -> np.ndarray:
        """Polynomial hashes of the words modulo 2^64, from prefix sums over slices of the buffer."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):
            lo = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, lo + _SLICE, "right")))
            hi = int(self.end[to - 1])
            n = hi - lo + 1
            if n > len(_TABLES["up"]):
                _grow(int(n * 1.25))
            sums = np.zeros(n, np.uint64)
            np.cumsum(code[lo:hi].astype(np.uint64) * _TABLES["up"][: n - 1], out=sums[1:])
            s, e = self.start[at:to] - lo, self.end[at:to] - lo
            out[at:to] = (sums[e] - sums[s]) * _TABLES["down"][s] + (e - s).astype(np.uint64)
            at = to
        return mix(out)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word, the row of the text it is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> str:
        return self.buf[self.start[i] : self.end[i]].tobytes().decode().lower()

    def sequence_keys(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each text's whole sequence of words."""
        n = len(self.first) - 1
        if not len(self.hash):
            return np.full(n, np.uint64(seed))
        place = np.arange(len(self.hash)) - np.repeat(self.first[:-1], self.counts)
        top = int(place.max()) + 1
        odd = np.uint64(2 * seed + 0x5851F42D4C957F2D | 1)
        powers = np.full(top, odd, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(mix(self.hash + np.uint64(seed)) * powers[place], out=sums[1:])
        return mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.counts.astype(np.uint64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The sets of k consecutive words of all texts: sorted distinct hashes text after text, and the n + 1
        offsets of each text's set. A text of fewer than k words has an empty set."""
        n = len(self.first) - 1
        total = len(self.hash)
        if total < k:
            return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
        h = np.zeros(total - k + 1, np.uint64)
        for j in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.hash[j : total - k + 1 + j]
        h = mix(h)
        text = self.text_of()
        same = text[: total - k + 1] == text[k - 1 :]
        h, text = h[same], text[: total - k + 1][same]
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        h, text = h[new], text[new]
        return h, np.searchsorted(text, np.arange(n + 1))


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that no piece has much more than ``most`` bytes of text (a single longer text stays whole)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to
