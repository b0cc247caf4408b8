"""Toxic documents by a subsequence string kernel over sentences, Nystroem landmarks and a support vector machine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._memory import lean_batches
from ._words import CHUNK, mix, text_buffer

#: Subsequences have ORDER letters within SPAN places; each place costs a factor DECAY.
ORDER, SPAN, DECAY = 4, 6, 0.8
PATTERNS = [(0, *p) for p in combinations(range(1, SPAN), ORDER - 1)]
START = 63
#: A sentence without an end is cut after so many words.
SENTENCE = 24
#: The length of a usual insult's feature map, and the power of the words' kernel.
UNIT, POWER = 1.7, 2
# Usual digit and sign substitutions for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _alphabet() -> np.ndarray:
    """Codes 1..62 of the code points below 0x10000; 0 for what is skipped, 255 for white space."""
    cp = np.arange(0x10000)
    cp = np.where((cp >= 0x41) & (cp <= 0x5A) | (cp >= 0xC0) & (cp <= 0xDE) & (cp != 0xD7), cp + 32, cp)
    codes = (29 + (cp * 2654435761 >> 7) % 34).astype(np.uint8)
    letters = (cp >= 0x61) & (cp <= 0x7A)
    codes[letters] = (cp[letters] - 0x60).astype(np.uint8)
    codes[:0x80][~letters[:0x80]] = 0
    codes[0x30:0x3A] = 27
    codes[0x80:0xC0] = 0
    codes[0x2000:0x2070] = 0
    for sign, letter in SUBSTITUTES.items():
        codes[ord(sign)] = ord(letter) - 0x60
    codes[[0x20, *range(0x09, 0x0E), 0x85, 0xA0, 0x2028, 0x2029, 0x3000]] = 255
    return codes


_CODES = _alphabet()
_TABLE = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Words:
    """Words of some rows: flat codes (START first in each), where they begin, their rows, their
    sentences (numbered through) and the bytes at which they begin."""

    codes: np.ndarray
    begin: np.ndarray
    row: np.ndarray
    sentence: np.ndarray
    byte: np.ndarray


def _nothing() -> Words:
    none = np.empty(0, np.int64)
    return Words(np.empty(0, np.uint8), np.zeros(1, np.int64), none, none, none)


def _split(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Cut the rows of a byte buffer into words; signs inside a word are skipped and runs of
    single letters with white space between them count as one word.  A sentence ends after
    '.', '!' or '?' before white space, at a new line, and after SENTENCE words."""
    at = offsets - offsets[0]
    raw = data[offsets[0] : offsets[-1]]
    leads = (raw & 0xC0) != 0x80
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    places = np.concatenate([[0], np.cumsum(leads, dtype=np.int32)])[at]
    codes = _CODES[np.minimum(cp, 0xFFFF)]
    space = codes == 255
    brk = np.zeros(len(cp) + 1, np.int32)
    brk[:-1] = space
    np.add.at(brk, places[places < len(cp)], 1)
    keep = np.flatnonzero(~space & (codes > 0)).astype(np.int32)
    if not len(keep):
        return _nothing()
    over = np.append(space, True)
    over[places[1:-1]] = True
    stop = (cp == 10) | ((cp == 46) | (cp == 33) | (cp == 63)) & over[1:]
    ends = np.cumsum(stop, dtype=np.int32)
    level = np.cumsum(brk, dtype=np.int32)[keep]
    heads = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]]))
    row = np.searchsorted(places, keep[heads], "right") - 1
    size = np.diff(np.append(heads, len(keep)))
    glue = np.zeros(len(heads), bool)
    glue[1:] = (size[1:] == 1) & (size[:-1] == 1) & (row[1:] == row[:-1])
    heads, row = heads[~glue], row[~glue]
    first = keep[heads]
    own = ends[first]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1])])
    begin = np.flatnonzero(new)
    rank = np.arange(len(heads)) - np.repeat(begin, np.diff(np.append(begin, len(heads))))
    sentence = np.cumsum(rank % SENTENCE == 0) - 1
    return Words(np.insert(codes[keep], heads, START), np.append(heads + np.arange(len(heads)), len(keep) + len(heads)), row, sentence, np.flatnonzero(leads)[first])


def _pieces(texts: pa.Array, most: int) -> Iterator[tuple[int, Words]]:
    """(first row, words) of runs of rows of about ``most`` bytes.  A longer text comes in pieces, each
    of which begins at the sentence that the last one left unfinished, so that no word and no sentence
    depends on where a piece ends."""
    data, offsets = text_buffer(texts)
    row, last = 0, len(offsets) - 1
    while row < last:
        if offsets[row + 1] - offsets[row] <= most:
            stop = min(last, max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1))
            yield row, _split(data, offsets[row : stop + 1])
            row = stop
            continue
        begin, end, take = int(offsets[row]), int(offsets[row + 1]), most
        while begin < end:
            cut = min(begin + take, end)
            while cut < end and data[cut] & 0xC0 == 0x80:
                cut += 1
            words = _split(data, np.array([begin, cut]))
            if cut == end:
                yield row, words
                break
            # What may go on behind the cut is read again: the whole last sentence.
            later = words.byte[words.sentence == words.sentence[-1]][:1] if len(words.row) else np.zeros(0, np.int64)
            if len(later) and later[0] > 0:
                done = words.byte < later[0]
                yield row, Words(words.codes[: words.begin[done.sum()]], words.begin[: done.sum() + 1], words.row[done], words.sentence[done], words.byte[done])
                begin, take = begin + int(later[0]), most
            elif len(words.row):
                take *= 2
            else:
                begin, take = cut, most
        row += 1


def _pick(words: Words, which: np.ndarray) -> Words:
    """The listed words alone."""
    lengths = np.diff(words.begin)[which]
    begin = np.concatenate([[0], np.cumsum(lengths)])
    take = np.arange(begin[-1]) - np.repeat(begin[:-1], lengths) + np.repeat(words.begin[which], lengths)
    return Words(words.codes[take], begin, words.row[which], words.sentence[which], words.byte[which])


def _hashes(words: Words) -> np.ndarray:
    size = np.diff(words.begin)
    inside = np.arange(len(words.codes), dtype=np.int32) - np.repeat(words.begin[:-1].astype(np.int32), size)
    powers = np.multiply.accumulate(np.full(int(size.max()), _STEP, np.uint64))
    return mix(np.add.reduceat(_TABLE[words.codes] * powers[inside], words.begin[:-1]))


def _distinct(words: Words) -> tuple[Words, np.ndarray]:
    """The distinct words, and for each word which of them it is."""
    _, first, which = np.unique(_hashes(words), return_index=True, return_inverse=True)
    return _pick(words, first), which


def _bags(words: Words) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, the different words of each sentence in turn, where each sentence's begin, and its row."""
    distinct, which = _distinct(words)
    pairs = np.unique(words.sentence << 32 | which)
    number, which = pairs >> 32, pairs & 0xFFFFFFFF
    heads = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    return distinct, which, heads, words.row[np.searchsorted(words.sentence, number[heads])]


def _subsequences(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pattern of gaps: words, packed letters, weight."""
    owner = np.repeat(np.arange(len(words.begin) - 1, dtype=np.int32), np.diff(words.begin))
    left = words.begin[owner + 1] - np.arange(len(owner))
    wide = words.codes.astype(np.int32)
    for p in PATTERNS:
        i = np.flatnonzero(left > p[-1])
        packed = wide[i]
        for k in p[1:]:
            packed = packed << 6 | wide[i + k]
        yield owner[i], packed, DECAY ** (p[-1] + 1)


def _maps(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Known subsequences and, for each of them and each word, its weight in the word's unit feature map."""
    packs, owners, weights = zip(*[(packed, owner, np.full(len(owner), weight)) for owner, packed, weight in _subsequences(words)], strict=True)
    known, ident = np.unique(np.concatenate(packs), return_inverse=True)
    maps = np.zeros((len(known), len(words.row)))
    np.add.at(maps, (ident, np.concatenate(owners)), np.concatenate(weights))
    return known, maps / np.sqrt((maps**2).sum(axis=0))


class Kernel:
    """K(s, t) = sum over the different words of two sentences of (subsequence kernel of the words / UNIT)^POWER.

    A sum of powers of inner products, so positive semidefinite.  Landmarks are one-word sentences; their
    feature maps are scaled to UNIT, and words of a text aren't scaled, so that a word inside a longer run
    counts in full."""

    def __init__(self, landmarks: Words):
        known, maps = _maps(landmarks)
        self.n = len(landmarks.row)
        self.gram = np.clip(maps.T @ maps, 0, 1) ** POWER
        used, which = np.unique(known >> 12, return_inverse=True)
        self.page = np.zeros(4096, np.int32)
        self.page[used] = np.arange(1, len(used) + 1) << 12
        self.ident = np.zeros((len(used) + 1) << 12, np.uint16)
        self.ident[(which + 1 << 12) + (known & 4095)] = np.arange(1, len(known) + 1)
        self.weights = np.vstack([np.zeros((1, self.n)), maps / UNIT]).astype(np.float32)

    def words(self, words: Words, block: int = 8192) -> np.ndarray:
        """The kernel of every word with every landmark."""
        out = np.zeros((len(words.row), self.n), np.float32)
        owners, ids, weights = [], [], []
        for owner, packed, weight in _subsequences(words):
            hit = self.ident[self.page[packed >> 12] + (packed & 4095)]
            some = np.flatnonzero(hit)
            owners.append(owner[some])
            ids.append(hit[some])
            weights.append(np.full(len(some), weight, np.float32))
        owner, ident, weight = (np.concatenate(x) for x in (owners, ids, weights))
        order = np.argsort(owner, kind="stable")
        owner = owner[order]
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
        for at in range(0, len(heads), block):
            part = heads[at : at + block]
            own = order[part[0] : heads[at + block] if at + block < len(heads) else len(owner)]
            out[owner[part]] = np.add.reduceat(self.weights[ident[own]] * weight[own, None], part - part[0], axis=0) ** POWER
        return out


def _sums(values: np.ndarray, which: np.ndarray, heads: np.ndarray, block: int = 8192) -> np.ndarray:
    """Sums of ``values[which]`` from each head to the next."""
    bounds = np.append(heads, len(which))
    parts = [np.add.reduceat(values[which[bounds[k] : bounds[min(k + block, len(heads))]]], heads[k : k + block] - bounds[k], axis=0) for k in range(0, len(heads), block)]
    return np.concatenate(parts)


@dataclass
class Model:
    """Decision on sentences, its offset and the calibration of a document's largest margin;
    ``kernel`` is None where the labels hold one class only."""

    kernel: Kernel | None
    direction: np.ndarray
    offset: float
    slope: float
    shift: float

    def margins(self, texts: pa.Array, most: int = CHUNK) -> np.ndarray:
        """The largest decision on any sentence of each text; the offset for texts without words."""
        out = np.full(len(texts), -np.inf)
        for first, words in _pieces(texts, most):
            if len(words.row):
                distinct, which, heads, row = _bags(words)
                value = self.kernel.words(distinct) @ self.direction
                np.maximum.at(out, first + row, _sums(value, which, heads))
        return np.where(np.isfinite(out), out, 0.0) + self.offset

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(texts), 1 / (1 + np.exp(-self.shift)))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -30, 30)))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, start: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the offset) of the squared-hinge support vector machine, by Newton steps."""
    w = np.zeros(x.shape[1] + 1) if start is None else start
    ridge = np.eye(len(w)) * penalty
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        a, b = ridge.copy(), np.zeros(len(w))
        for at in range(0, len(x), 8192):
            own = np.hstack([x[at : at + 8192].astype(float), np.ones((len(x[at : at + 8192]), 1))])
            side, wt = y[at : at + 8192], weight[at : at + 8192]
            inside = (side * (own @ w) < 1) & (wt > 0)
            own, side, wt = own[inside], side[inside], wt[inside]
            a += own.T @ (own * wt[:, None])
            b += own.T @ (side * wt)
        new = np.linalg.solve(a, b)
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w


def _choose(every: Words, word: np.ndarray, doc: np.ndarray, toxic: np.ndarray, n: int) -> np.ndarray:
    """``n`` words of labelled sentences as landmarks, three quarters of them from class 1.

    One by one, the word that the sentences of its class hold most beyond those of the other class, by the
    documents that earlier landmarks leave unexplained (each halves a document's share)."""
    pairs = np.unique(word.astype(np.int64) << 32 | doc)
    word, doc = pairs >> 32, pairs & 0xFFFFFFFF
    bounds = np.searchsorted(word, np.arange(len(every.row) + 1))
    share = 1 / np.bincount(toxic, minlength=2)[toxic]
    held = [np.bincount(word, weights=share[doc] * (toxic[doc] == c), minlength=len(every.row)) for c in (0, 1)]
    usable = (np.diff(every.begin) >= ORDER) & (np.diff(bounds) >= 3)
    out: list[int] = []
    for c, most in ((1, n - n // 4), (0, n // 4)):
        left = share * (toxic == c)
        for _ in range(most):
            gain = np.bincount(word, weights=left[doc], minlength=len(usable)) - held[1 - c]
            gain = np.where(usable, gain / np.sqrt(held[0] + held[1] + 1e-3), -1.0)
            best = int(gain.argmax())
            if gain[best] <= 0:
                break
            out.append(best)
            usable[best] = False
            left[doc[bounds[best] : bounds[best + 1]]] *= 0.5
    return np.array(out, np.int64)


def fit(texts: pa.Array, toxic: np.ndarray, prior: float, landmarks: int = 64, rounds: int = 5, penalty: float = 0.05) -> Model:
    """Fit on texts and their 0/1 labels; ``prior`` is the share of label 1 among all labelled rows.

    Sentences carry their document's label.  Those of class 0 are all examples; of a document of class 1
    the sentence that the machine of the round before rates highest is one (at first each of its
    sentences, with the document's weight shared out)."""
    toxic = np.asarray(toxic).astype(np.int64)
    base = float(np.log(np.clip(prior, 1e-4, 1 - 1e-4) / (1 - np.clip(prior, 1e-4, 1 - 1e-4))))
    none = Model(None, np.empty(0), 0.0, 1.0, base)
    spelt, word_of, doc, heads, seen, words_seen = [], [], [], [], 0, 0
    for first, w in _pieces(texts, CHUNK) if 0 < toxic.sum() < len(toxic) else ():  # only distinct words of a piece stay spelt out
        if not len(w.row):
            continue
        distinct, which, head, row = _bags(w)
        heads.append(head + words_seen)
        doc.append(first + row)
        word_of.append(which + seen)
        spelt.append(distinct)
        seen, words_seen = seen + len(distinct.row), words_seen + len(which)
    if not spelt:
        return none
    every = Words(np.concatenate([x.codes for x in spelt]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x.begin) for x in spelt]))]), *[np.zeros(seen, np.int64)] * 3)
    every, which = _distinct(every)
    word_of, doc, heads = which[np.concatenate(word_of)].astype(np.int32), np.concatenate(doc), np.concatenate(heads)
    chosen = _choose(every, word_of, np.repeat(doc, np.diff(np.append(heads, len(word_of)))), toxic, landmarks)
    if not len(chosen):
        return none
    kernel = Kernel(_pick(every, chosen))
    value, vector = np.linalg.eigh(kernel.gram)
    whiten = vector / np.sqrt(np.clip(value, 0.05, None))
    x = (_sums(kernel.words(every), word_of, heads) @ whiten).astype(np.float32)
    y = np.where(toxic[doc] == 1, 1.0, -1.0)
    per_doc = np.bincount(doc, minlength=len(toxic))
    n1, n0 = len(np.unique(doc[y > 0])), max(1, len(np.unique(doc[y < 0])))
    shared = np.where(y > 0, prior / max(1, n1), (1 - prior) / n0) * len(toxic)
    weight = shared / per_doc[doc]
    for turn in range(rounds):
        w = _machine(x, y, weight, penalty)
        score = x @ w[:-1] + w[-1]
        order = np.lexsort((-score, doc))
        best = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
        weight = np.where(y > 0, 0.0, shared / per_doc[doc])
        weight[best] = shared[best]
    margin = np.full(len(toxic), w[-1])
    margin[doc[best]] = score[best]
    slope, shift = _calibrate(margin, toxic, prior)
    return Model(kernel, whiten @ w[:-1], float(w[-1]), slope, shift)


def _calibrate(margin: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of the logistic curve over documents' margins, kept finite by a weak prior."""
    weight = np.where(toxic == 1, prior / max(1, (toxic == 1).sum()), (1 - prior) / max(1, (toxic == 0).sum())) * len(toxic)
    at = np.array([4.0, 0.0])

    def loss(v: np.ndarray) -> float:
        z = v[0] * margin + v[1]
        return float((weight * (np.logaddexp(0, z) - toxic * z)).sum() + (v[0] - 4) ** 2 / 2 + 0.05 * v[1] ** 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at[0] * margin + at[1], -30, 30)))
        h = weight * np.clip(p * (1 - p), 1e-9, None)
        g = np.array([(weight * (toxic - p) * margin).sum() - (at[0] - 4), (weight * (toxic - p)).sum() - 0.1 * at[1]])
        a = np.array([[(h * margin**2).sum() + 1, (h * margin).sum()], [(h * margin).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(a, g)
        while loss(at + step) > loss(at) and np.abs(step).max() > 1e-9:
            step = step / 2
        at = at + step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(at[0], 0.1)), float(at[1])


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id's text leaves remainder 2 by 4; such rows are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 1500, longest: int = 100_000, landmarks: int = 64) -> Model:
    """Fit on the sentences of at most ``per_class`` documents of each label (those of least id hash among the
    rows that may be learnt from) of at most ``longest`` characters; this bound is what the
    driver holds.  Rows with null id or label are skipped, repeated labels count once (the larger)."""
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    count = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    total = count.get(0, 0) + count.get(1, 0)
    if not total:
        return Model(None, np.empty(0), 0.0, 1.0, -4.0)
    ids = [r for c in (0, 1) for r in usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    picked = docs.sparkSession.createDataFrame(ids, usable.schema)
    sample = (
        texts.where(F.length("text") <= longest).join(F.broadcast(picked), "doc_id").orderBy("doc_id", F.xxhash64("text")).limit(2 * per_class)
    )
    table = sample.select("text", "toxic").toArrow()
    return fit(table.column("text").combine_chunks(), table.column("toxic").to_numpy(), count.get(1, 0) / total, landmarks)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "score", drop_from: float | None = None) -> DataFrame:
    """``docs`` with a double ``out_col``: the calibrated chance of label 1 of every whole text
    (null counts as empty).  With ``drop_from`` the rows of that score or more are left out and no
    column is added.  Columns of ``docs`` pass through; a column named ``out_col`` is replaced."""
    docs = docs if drop_from is not None else docs.drop(out_col)
    at = docs.columns.index(text_col)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(docs.schema.fields + ([] if drop_from is not None else [T.StructField(out_col, T.DoubleType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                values = own.score(batch.column(at).cast(pa.string()))
                if drop_from is not None:
                    yield batch.filter(pa.array(values < drop_from))
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(lean_batches(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **more) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    A document's score is that of its worst sentence: a support vector machine on the sentences' kernel
    values with landmark words of both classes, whitened by the landmarks' Gram matrix.  Nothing depends on
    how a text is cut for processing, whatever its length.  Empty and null texts get the score of a text without any landmark; a null id is not held out.
    Without labels of both classes every score is the prior."""
    model = train(docs, labels, **more)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = own.select(F.col("text"), F.col("doc_id"), held_out().alias("held_out"))
    scored = _slim(ids, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _slim(ids: DataFrame, model: Model) -> DataFrame:
    shipped = ids.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = shipped.value.score(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(values)], names=["doc_id", "held_out", "score"])

    return ids.mapInArrow(lean_batches(run), "doc_id long, held_out boolean, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **more) -> DataFrame:
    """``docs`` without the rows that the model scores at ``threshold`` or more; columns unchanged."""
    return score(docs, train(docs, labels, **more), drop_from=threshold)
