"""The subject areas of each document.

Method: bisecting k-means over document vectors. The terms (words and pairs of words) that tell subjects apart are found
from hand-labelled documents; wrong labels and documents of several subjects are evened out by re-estimating each
sentence's subject from its terms. Each labelled document becomes a normalised vector over these terms, and bisecting
k-means divides the vectors into leaves; a leaf has the mixture of subjects of its documents and is labelled by its
discriminative terms. Every document of the corpus is put into the leaf whose centre its own vector is nearest to, and
its subjects come from the leaf's mixture: it weighs what the terms of each of its sentences say. The document gets
every subject of a large enough part of its subject-bearing sentences, as mixtures of whole leaves can't tell how large
a part a subject has in one document.

The model is fitted on at most ``most_labelled`` labelled documents and ``most_bytes`` of their texts, in one task that
writes it to the shared folder. All documents are assigned where they are read, whole, without a shuffle.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.words import _grow, _tables, mix, slices, utf8
from quillstone.session import arrow_filesystem, shared_path

#: Plain letters for U+00C0 to U+00FF, in order; a blank keeps the letter out of words. Fixed values.
_LATIN = "aaaaaa ceeeeiiiidnooooo ouuuuy  aaaaaa ceeeeiiiidnooooo ouuuuy y"
_SALT = np.uint64(0xA0761D6478BD642F)


def _fold(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes in which accented Latin letters are plain ones and combining marks are left out."""
    out = buf.copy()
    upper = (out >= 65) & (out <= 90)
    out[upper] += 32
    if not (buf >= 0xC3).any():
        return out, offsets
    keep = np.ones(len(buf), bool)
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    table = np.frombuffer(_LATIN.encode(), np.uint8)
    out[lead + 1] = table[buf[lead + 1] & 63]
    keep[lead] = False
    marks = np.flatnonzero((buf[:-1] == 0xCC) | ((buf[:-1] == 0xCD) & (buf[1:] < 0xB0)))
    keep[marks] = keep[marks + 1] = False
    place = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], place[offsets]


class Sentences:
    """The sentences of a batch of texts: ``text`` of each, and for each word its ``hash`` and ``sentence``. A sentence
    ends with a full stop, ``!`` or ``?`` before white space or a border; pieces of lines and table cells without
    that are headings and the like and have no words here."""

    def __init__(self, texts: pa.Array):
        buf, offsets = utf8(texts)
        if (buf >= 0xC4).any():  # capitals of other scripts
            buf, offsets = utf8(pa.compute.utf8_lower((texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string())))
        buf, offsets = _fold(buf, offsets)
        n = len(buf)
        code = np.where((buf >= 97) & (buf <= 122), buf - 96, 0).astype(np.uint8)
        high = np.flatnonzero(buf >= 0x80)
        if len(high):  # letters of other scripts are in words as they are; signs between words aren't
            code[high] = buf[high]
            lead = buf[high]
            for first, second, size in ((0xC2, None, 2), (0xE2, None, 3), (0xE3, 0x80, 3), (0xEF, 0xBC, 3)):
                at = high[lead == first]
                at = at[at + size <= n]
                at = at if second is None else at[buf[at + 1] == second]
                for j in range(size):
                    code[at + j] = 0
        after = np.full(n, 10, np.uint8)
        after[:-1] = buf[1:]
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        after[last] = 10
        stop = ((buf == 46) | (buf == 33) | (buf == 63)) & ((after == 32) | (after == 10) | (after == 13) | (after == 9) | (after == 124))
        cut = (buf == 10) | (buf == 13) | (buf == 124)
        cut[last] |= True
        ends = np.flatnonzero(stop | cut)  # each piece's last byte
        finished = stop[ends]
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = code > 0
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[0::2], edge[1::2]
        borders = offsets[1:-1]
        borders = borders[(borders > 0) & (borders < n)]
        borders = np.unique(borders[(code[borders - 1] > 0) & (code[borders] > 0)]) if len(borders) else borders
        if len(borders):
            start, end = np.sort(np.concatenate([start, borders])), np.sort(np.concatenate([end, borders]))
        piece = np.searchsorted(ends, end - 1)
        whole = finished[piece] if len(ends) else np.zeros(0, bool)
        start, end, piece = start[whole], end[whole], piece[whole]
        self.used, self.sentence = np.unique(piece, return_inverse=True)
        self.sentence = self.sentence.ravel()
        self.text = np.searchsorted(offsets, ends[self.used], "right") - 1 if len(self.used) else np.zeros(0, np.int64)
        self.start, self.end, self.buf = start, end, buf
        self.hash = self._hash(code)

    def _hash(self, code: np.ndarray) -> np.ndarray:
        tables = _tables()
        out, at = np.empty(len(self.start), np.uint64), 0
        while at < len(self.start):
            lo = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, lo + (1 << 20), "right")))
            n = int(self.end[to - 1] - lo) + 1
            if n > len(tables["up"]):
                _grow(int(n * 1.25))
            sums = np.zeros(n, np.uint64)
            np.cumsum(code[lo : lo + n - 1].astype(np.uint64) * tables["up"][: n - 1], out=sums[1:])
            s, e = self.start[at:to] - lo, self.end[at:to] - lo
            out[at:to] = (sums[e] - sums[s]) * tables["down"][s]
            at = to
        return mix(out)

    def pairs(self) -> np.ndarray:
        """Numbers of the words that have a following one in their sentence."""
        return np.flatnonzero(self.sentence[1:] == self.sentence[:-1])

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and sentence of each word, then of each pair of neighbouring words of a sentence."""
        at = self.pairs()
        both = mix(self.hash[at] * _SALT + self.hash[at + 1])
        return np.concatenate([self.hash, both]), np.concatenate([self.sentence, self.sentence[at]])


@dataclass(frozen=True)
class SubjectModel:
    """``terms``: sorted hashes; ``weights``: what each says of each subject; ``idf``: its weight in document vectors;
    ``centers``: the leaves' centres, one column each; ``mixtures``: their subjects; ``sizes`` and ``labels``: how many
    documents they were made of, and their discriminative terms."""

    subjects: tuple[str, ...]
    terms: np.ndarray
    weights: np.ndarray
    idf: np.ndarray
    centers: np.ndarray
    mixtures: np.ndarray
    sizes: np.ndarray
    labels: tuple[str, ...]

    def hits(self, sentences: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """The model's terms in sentences: number of the term, and sentence."""
        if not len(self.terms) or not len(sentences.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sieve = np.zeros(1 << 16, bool)
        sieve[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True
        term, sentence = sentences.terms()
        near = np.flatnonzero(sieve[(term & np.uint64(0xFFFF)).astype(np.int64)])
        term, sentence = term[near], sentence[near]
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        return at[hit], sentence[hit]

    def leaves(self, texts: int, term: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Leaf of each text by its vector over the terms, -1 without a term."""
        leaf = np.full(texts, -1, np.int64)
        key, count = np.unique(text * np.int64(len(self.terms) + 1) + term, return_counts=True)
        if len(key):
            text, term = key // (len(self.terms) + 1), key % (len(self.terms) + 1)
            value = (count * self.idf[term]).astype(np.float32)  # its length doesn't change which centre is nearest
            heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            score = np.concatenate([np.add.reduceat(self.centers[term[a:b]].astype(np.float32) * value[a:b, None], np.flatnonzero(np.concatenate([[True], text[a + 1 : b] != text[a : b - 1]])), 0) for a, b in _runs(heads, len(text))])
            leaf[text[heads]] = score.argmax(1)
        return leaf

    def of_sentences(self, sentences: Sentences, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sentences that bear a subject, which one, and the leaf of each text."""
        at, sentence = self.hits(sentences)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(texts, -1, np.int64)
        leaf = self.leaves(texts, at, sentences.text[sentence])
        n = len(sentences.used)
        score = np.stack([np.bincount(sentence, weights=w, minlength=n) for w in self.weights[at].T], 1)
        bears = np.flatnonzero(score.max(1) > 1e-9)
        mixture = self.mixtures[leaf[sentences.text[bears]]]
        return bears, (score[bears] * (0.25 + 0.75 * mixture / mixture.max(1, keepdims=True))).argmax(1), leaf

    def write(self, uri: str) -> None:
        fs, path = arrow_filesystem(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        table = {f: getattr(self, f) for f in ("terms", "weights", "idf", "centers", "mixtures", "sizes")}
        packed = io.BytesIO()
        np.savez(packed, labels=np.array(self.labels, dtype=str), subjects=np.array(self.subjects, dtype=str), **table)
        with fs.open_output_stream(f"{path}.part") as out:
            out.write(packed.getvalue())
        fs.move(f"{path}.part", path)


def _runs(heads: np.ndarray, n: int, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Whole texts of about ``most`` terms together."""
    a = 0
    while a < n:
        at = int(np.searchsorted(heads, a + most))
        b = int(heads[at]) if at < len(heads) else n
        yield a, b
        a = b


def empty_model(subjects: tuple[str, ...]) -> SubjectModel:
    k = len(subjects)
    return SubjectModel(subjects, np.zeros(0, np.uint64), np.zeros((0, k)), np.zeros(0), np.zeros((0, 1), np.float16), np.zeros((1, k)), np.zeros(1, np.int64), ("",))


@lru_cache(maxsize=2)
def read_model(uri: str) -> SubjectModel:
    fs, path = arrow_filesystem(uri)
    with fs.open_input_file(path) as f:
        got = np.load(io.BytesIO(f.read()))
    return SubjectModel(tuple(got["subjects"].tolist()), *(got[k] for k in ("terms", "weights", "idf", "centers", "mixtures", "sizes")), tuple(got["labels"].tolist()))


def _purity(counts: np.ndarray, prior: np.ndarray, strength: float) -> np.ndarray:
    return (counts + strength * prior) / (counts.sum(1, keepdims=True) + strength)


def bisecting_kmeans(term: np.ndarray, row: np.ndarray, value: np.ndarray, rows: int, terms: int, mixture: np.ndarray, leaves: int, pure: float, seed: int = 0) -> np.ndarray:
    """Leaf of each row of a sparse matrix of unit rows. The node that is least pure for its size is divided first,
    until all are pure enough or there are ``leaves`` of them."""
    rng = np.random.default_rng(seed)
    leaf = np.zeros(rows, np.int64)
    order = np.argsort(row, kind="stable")
    term, row, value = term[order], row[order], value[order]
    first = np.searchsorted(row, np.arange(rows + 1))

    def impurity(members: np.ndarray) -> float:
        total = mixture[members].sum(0)
        return float(total.sum() - total.max()) if total.max() < pure * total.sum() else 0.0

    todo = {0: impurity(np.arange(rows))} if rows else {}
    count = 1
    while count < leaves and todo:
        node = max(todo, key=todo.get)
        if todo.pop(node) <= 0:
            continue
        members = np.flatnonzero(leaf == node)
        if len(members) < 4:
            continue
        sizes = first[members + 1] - first[members]
        at = np.repeat(first[members], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        t, v, r = term[at], value[at], np.repeat(np.arange(len(members)), sizes)
        # two rows of different leading subjects begin, so that divisions follow subjects where they can
        lead = mixture[members].argmax(1)
        common = np.bincount(lead, minlength=mixture.shape[1]).argsort()[::-1]
        picks = [rng.choice(np.flatnonzero(lead == s)) for s in common[:2] if (lead == s).any()]
        if len(picks) < 2:
            picks = list(rng.choice(len(members), 2, replace=False))
        centers = np.zeros((2, terms))
        for c, p in zip(centers, picks, strict=True):
            own = r == p
            np.add.at(c, t[own], v[own])
        side = None
        for _ in range(12):
            score = np.stack([np.bincount(r, weights=c[t] * v, minlength=len(members)) for c in centers], 1)
            new = score[:, 1] > score[:, 0]
            if side is not None and (new == side).all():
                break
            side = new
            for k in (0, 1):
                own = side[r] == bool(k)
                centers[k] = np.bincount(t[own], weights=v[own], minlength=terms)
                centers[k] /= max(np.linalg.norm(centers[k]), 1e-12)
        if side.all() or not side.any():
            continue
        leaf[members[side]] = count
        todo[node], todo[count] = impurity(members[~side]), impurity(members[side])
        count += 1
    return leaf


def fit(texts: pa.Array, labels: np.ndarray, subjects: tuple[str, ...], leaves: int = 64, rounds: int = 8) -> SubjectModel:
    """A model from labelled texts. ``labels``: one row each with a 1 for each of its subjects."""
    empty = empty_model(subjects)
    sentences = Sentences(texts)
    hashes, sentence = sentences.terms()
    if not len(hashes):
        return empty
    n, s, docs = len(sentences.used), len(subjects), len(labels)
    vocabulary, term = np.unique(hashes, return_inverse=True)
    term = term.ravel()
    given = labels / np.maximum(labels.sum(1, keepdims=True), 1)
    prior = np.maximum(given.sum(0), 0.5)
    prior = prior / prior.sum()
    base = (labels.sum(0) + 0.5) / (docs + 1)

    # what the labels alone say of a term: in how many more of its documents than elsewhere its best subject is one
    seen = np.unique(term * np.int64(docs) + sentences.text[sentence])
    t, d = seen // docs, seen % docs
    having = np.bincount(t, minlength=len(vocabulary))
    with_label = np.stack([np.bincount(t, weights=labels[d, k], minlength=len(vocabulary)) for k in range(s)], 1)
    gain = ((with_label + 2 * base) / (having[:, None] + 2) - base) / (1 - base)
    # pairs in which a word goes with all subjects alike ("the", "must") say no more than the other word
    words = len(sentences.hash)
    plain = gain.max(1) < 0.1
    first = sentences.pairs()
    word, pair, every = term[:words], term[words:], len(vocabulary)
    framed = np.zeros(len(term), bool)
    framed[words:] = plain[term[first]] | plain[term[first + 1]]

    once = np.unique(term[~framed] * np.int64(n) + sentence[~framed])  # a term counts once in a sentence
    term, sentence = once // n, once % n
    often = (np.bincount(term, minlength=len(vocabulary)) >= 3) & (gain.max(1) >= 0.3)
    number = np.cumsum(often) - 1
    original = np.flatnonzero(often)
    keep = often[term]
    term, sentence, vocabulary, gain = number[term[keep]], sentence[keep], vocabulary[often], gain[often]
    doc = 0.85 * given + 0.15 * prior  # a label may be wrong, and a minor subject has none
    belief = doc[sentences.text]
    weight = np.ones(n)
    for round_ in range(rounds):
        share = belief * weight[:, None]
        counts = np.stack([np.bincount(term, weights=share[sentence, k], minlength=len(vocabulary)) for k in range(s)], 1)
        pure = _purity(counts, prior, 2.0)
        lift = np.log(pure / prior)
        telling = (pure.max(1) > (0.45 if round_ < 2 else 0.6)) & (lift.max(1) > 0.7)
        use = telling[term]
        score = np.stack([np.bincount(sentence[use], weights=lift[term[use], k], minlength=n) for k in range(s)], 1)
        logit = np.log(doc[sentences.text]) + score
        belief = np.exp(logit - logit.max(1, keepdims=True))
        belief /= belief.sum(1, keepdims=True)
        weight = np.where(np.bincount(sentence[use], minlength=n) > 0, 1.0, 0.05)
    counts = np.stack([np.bincount(term, weights=(belief * (weight > 0.5)[:, None])[sentence, k], minlength=len(vocabulary)) for k in range(s)], 1)
    pure = _purity(counts, prior, 1.5)
    total = np.bincount(term, minlength=len(vocabulary))
    best = pure.argmax(1)
    chosen = (pure.max(1) >= 0.8) & (gain[np.arange(len(best)), best] >= 0.3) & (counts.sum(1) >= 0.6 * total)
    # a word that is met nearly always in one chosen pair says less by itself, where it may mean something else
    telling = np.zeros(every, bool)
    telling[original[chosen]] = True
    use = telling[pair] & ~framed[words:]
    both = np.concatenate([word[first[use]], word[first[use] + 1]]) * np.int64(every) + np.concatenate([pair[use]] * 2)
    key, times = np.unique(both, return_counts=True)
    part = np.zeros(every)
    np.maximum.at(part, key // every, times)
    part /= np.maximum(np.bincount(word, minlength=every), 1)
    chosen &= part[original] < 0.8
    if not chosen.any():
        return empty
    number = np.cumsum(chosen) - 1
    keep = chosen[term]
    term, sentence = number[term[keep]], sentence[keep]
    idf = np.log(1 + n / total[chosen])
    terms, purity = int(chosen.sum()), pure[chosen]
    weights = purity * idf[:, None]
    weights *= weights >= 0.2 * weights.max(1, keepdims=True)
    # vectors of whole documents, of unit length, and the subjects of their sentences
    key, count = np.unique(sentences.text[sentence] * np.int64(terms) + term, return_counts=True)
    doc_, term_ = key // terms, key % terms
    used, row = np.unique(doc_, return_inverse=True)
    row = row.ravel()
    value = count * idf[term_]
    value = value / np.sqrt(np.bincount(row, weights=value**2))[row]
    bearing = np.unique(sentence)
    mixture = np.stack([np.bincount(np.searchsorted(used, sentences.text[bearing]), weights=belief[bearing, k], minlength=len(used)) for k in range(s)], 1)
    mixture /= mixture.sum(1, keepdims=True)
    leaf = bisecting_kmeans(term_, row, value, len(used), terms, mixture, leaves, 0.97)
    parts = int(leaf.max()) + 1
    centers = np.zeros((terms, parts))
    cell = np.bincount(term_ * np.int64(parts) + leaf[row], weights=value, minlength=terms * parts).reshape(terms, parts)
    centers = cell / np.maximum(np.sqrt((cell**2).sum(0)), 1e-12)
    sizes = np.bincount(leaf, minlength=parts)
    mixtures = np.stack([np.bincount(leaf, weights=mixture[:, k], minlength=parts) for k in range(s)], 1) / np.maximum(sizes, 1)[:, None]
    # a leaf's labels: terms of a large share in it that are mostly met there
    apart = centers * cell / np.maximum(cell.sum(1, keepdims=True), 1e-12)
    texts_of = _term_texts(sentences, vocabulary[chosen])
    labels = tuple("|".join(texts_of.get(int(t), "") for t in np.argsort(-apart[:, j], kind="stable")[:8] if apart[t, j] > 0) for j in range(parts))
    return SubjectModel(subjects, vocabulary[chosen], weights, idf, centers.astype(np.float16), mixtures, sizes, labels)


def _term_texts(sentences: Sentences, terms: np.ndarray) -> dict[int, str]:
    """The words of each of the sorted terms, from where it is met first."""
    hashes, _ = sentences.terms()
    first, pair = len(sentences.hash), sentences.pairs()
    found, at = np.unique(hashes, return_index=True)
    place = at[np.searchsorted(found, terms)]
    out = {}
    for i, p in enumerate(place.tolist()):
        a, b = (p, p) if p < first else (int(pair[p - first]), int(pair[p - first]) + 1)
        out[i] = sentences.buf[sentences.start[a] : sentences.end[b]].tobytes().decode("utf-8", "replace")
    return out


@dataclass(frozen=True)
class StoredModel:
    """A model in the shared folder; none if nothing could be learnt."""

    subjects: tuple[str, ...]
    uri: str | None

    def read(self) -> SubjectModel:
        return read_model(self.uri) if self.uri else empty_model(self.subjects)


def fit_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text: str = "text", subject: str = "subject_id", most_labelled: int = 20_000, most_bytes: int = 256 << 20, most_subjects: int = 1000, leaves: int = 64) -> StoredModel:
    """Fits on labelled documents, in the order of a hash of their ids: at most ``most_labelled`` of them, and as many
    as have ``most_bytes`` of text together.

    Labels of unlisted subjects, of null ids, repeated ones and ones of documents without text don't count. Of rows
    that repeat an id one text counts. ValueError beyond ``most_subjects``.
    """
    names = tuple(sorted(r[0] for r in subjects.select(subject).where(F.col(subject).isNotNull()).distinct().limit(most_subjects + 1).collect()))
    if len(names) > most_subjects:
        raise ValueError(f"more than {most_subjects} subjects")
    listed = labels.select(F.col(doc_id).alias("d"), F.col(subject).alias("s")).where(F.col("s").isin(list(names)) & F.col("d").isNotNull()).distinct()
    chosen = listed.select("d").distinct().orderBy(F.xxhash64("d"), "d").limit(most_labelled)
    own = listed.join(chosen, "d", "left_semi").groupBy("d").agg(F.sort_array(F.collect_set("s")).alias("s"))
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("length(t) > 0").join(F.broadcast(own), "d")  # most_labelled rows
    rows = rows.groupBy("d").agg(F.min_by("t", F.xxhash64("t")).alias("t"), F.first("s").alias("s"))
    number = {x: i for i, x in enumerate(names)}
    uri = f"{shared_path(docs.sparkSession, 'subjects')}/model.npz"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            ends = size + np.cumsum(pa.compute.binary_length(batch.column("t")).to_numpy(zero_copy_only=False).astype(np.int64))
            fits = int(np.searchsorted(ends, most_bytes, "right"))
            kept.append(batch.slice(0, fits))
            if fits < len(batch):
                break
            size = int(ends[-1]) if len(ends) else size
        table = pa.Table.from_batches(kept) if kept else None
        if table is None or not len(table):
            return
        given = np.zeros((len(table), len(names)))
        for i, own_ in enumerate(table["s"].to_pylist()):
            given[i, [number[x] for x in own_]] = 1
        fit(table["t"], given, names, leaves).write(uri)
        yield pa.RecordBatch.from_arrays([pa.array([len(table)], pa.int64())], names=["n"])

    # a sample of bounded size in one task; a repeated task writes the same model
    made = rows.repartition(1).sortWithinPartitions(F.xxhash64("d"), "d").mapInArrow(run, "n long").collect()
    return StoredModel(names, uri if made else None)


def subject_shares(docs: DataFrame, model: StoredModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, subject_id, sentences, share, leaf)`` of every subject of each row: sentences that deal with it, their
    share of the row's subject-bearing sentences, and the row's leaf. Null and empty texts, and texts without such
    sentences, have no row; rows that repeat an id are counted each by itself. Other columns are not read, whatever
    their names."""
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("length(t) > 0")
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("subject_id", T.StringType()), T.StructField("sentences", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("leaf", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = None
        for batch in batches:
            use = use or model.read()
            names = pa.array(use.subjects or ("",), pa.string())
            for part in slices(batch, "t"):
                sentences = Sentences(part.column("t"))
                bears, subject, leaf = use.of_sentences(sentences, len(part))
                if not len(bears):
                    continue
                counts = np.zeros((len(part), len(use.subjects)), np.int64)
                np.add.at(counts, (sentences.text[bears], subject), 1)
                row, s = np.nonzero(counts)
                share = counts[row, s] / counts.sum(1)[row]
                yield pa.RecordBatch.from_arrays([part.column("d").take(pa.array(row)), names.take(pa.array(s)), pa.array(counts[row, s]), pa.array(share), pa.array(leaf[row].astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)


def assign_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text: str = "text", subject: str = "subject_id", least_share: float = 0.25, **fitting: int) -> DataFrame:
    """``(doc_id, subject_id, sentences, share, leaf)`` of the subjects that at least ``least_share`` of each row's
    subject-bearing sentences deal with."""
    model = fit_subjects(docs, labels, subjects, doc_id, text, subject, **fitting)
    return subject_shares(docs, model, doc_id, text).where(F.col("share") >= least_share)


def describe_leaves(model: StoredModel, spark: SparkSession) -> DataFrame:
    """``(leaf, documents, subject_id, share, terms)``: the leaves' mixtures, each with its discriminative terms."""
    m = model.read()
    rows = [(j, int(m.sizes[j]), s, float(m.mixtures[j, k]), m.labels[j]) for j in range(len(m.sizes)) for k, s in enumerate(m.subjects) if m.mixtures[j, k] > 0]
    return spark.createDataFrame(rows, "leaf int, documents long, subject_id string, share double, terms string")  # leaves x subjects
