"""Document quality from weak labels: expectation maximisation over labellers, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._memory import lean_batches
from ._words import text_buffer, word_hashes

SIGNALS = ("letters", "capitals", "signs", "distinct", "echo", "lines", "endings", "length")
#: For each labeller: (at most this: bad, at least this: good) or, with falling=True, the reverse.
RULES = {
    "letters": (0.74, 0.77, False),
    "capitals": (0.06, 0.25, True),
    "signs": (0.006, 0.02, True),
    "distinct": (0.35, 0.55, False),
    "echo": (0.02, 0.10, True),
    "lines": (0.55, 0.80, False),
    "endings": (0.60, 0.95, False),
    "length": (5.0, 8.0, True),
}
BUCKETS = 1 << 14
#: Distinct words are counted in runs of WINDOW words, so that length alone changes nothing; PRIOR words of
#: a middling share keep the labeller undecided about very short texts.
WINDOW, PRIOR, MIDDLING = 512, 15, 0.45
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"]] = True


def distinct_share(words: np.ndarray) -> float:
    """Share of distinct words, by runs of WINDOW words, shrunk to MIDDLING by PRIOR words."""
    runs = [words[k : k + WINDOW] for k in range(0, len(words), WINDOW)]
    return (sum(len(np.unique(r)) for r in runs) + PRIOR * MIDDLING) / (len(words) + PRIOR)


def signals(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(rows x SIGNALS), (word counts) and word hashes of each whole text; nulls are empty."""
    data, offsets = text_buffer(texts)
    out = np.zeros((len(texts), len(SIGNALS)))
    n_words = np.zeros(len(texts), np.int64)
    words_of: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    for row, words in word_hashes(texts):
        own = data[offsets[row] : offsets[row + 1]]
        words_of[row], n_words[row] = words, len(words)
        if not len(words):
            continue
        leads = max(1, int(((own & 0xC0) != 0x80).sum()))
        letters = _LETTER[own] & ((own & 0xC0) != 0x80)
        lines = [x.strip() for x in own.tobytes().split(b"\n")]
        lines = [x for x in lines if x]
        signs, distinct = _SIGN[own].sum() / leads, distinct_share(words)
        echo = float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0
        ends = sum(x[-1:] in b".!?" for x in lines) / max(1, len(lines))
        out[row] = (
            letters.sum() / leads, _CAPITAL[own].sum() / max(1, letters.sum()), signs, distinct, echo, len(set(lines)) / max(1, len(lines)), ends, leads / len(words),
        )
    return out, n_words, words_of


def votes(values: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Votes of the labellers: 0 bad, 1 good, 2 abstains.  A text without words gets 0 from each."""
    out = np.full(values.shape, 2, np.int8)
    for k, name in enumerate(SIGNALS):
        low, high, falling = RULES[name]
        x = values[:, k]
        out[x <= low, k] = 1 if falling else 0
        out[x >= high, k] = 0 if falling else 1
    out[n_words == 0] = 0
    return out


@dataclass
class LabelModel:
    """Share of good documents and each labeller's vote probabilities (class x labeller x vote)."""

    good: float
    table: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        logs = np.log(self.table)
        own = [logs[c, np.arange(v.shape[1])[None, :], v].sum(axis=1) for c in (0, 1)]
        odds = own[1] - own[0] + np.log(self.good / (1 - self.good))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation maximisation over distinct vote patterns and how many documents show each.

    It starts from the majority of the votes; sums are over all documents, and at most 3^8
    patterns exist whatever the corpus."""
    k = patterns.shape[1] if patterns.size else len(SIGNALS)
    if not len(counts):
        return LabelModel(0.5, np.full((2, k, 3), 1 / 3))
    q = np.clip(((patterns == 1).sum(axis=1) - 3.0 * (patterns == 0).sum(axis=1) + 3) / 6, 0.05, 0.95)
    model = LabelModel(0.5, np.full((2, k, 3), 1 / 3))
    for _ in range(rounds):
        table = np.zeros((2, k, 3))
        for c, share in ((0, 1 - q), (1, q)):
            for vote in range(3):
                table[c, :, vote] = ((patterns == vote) * (counts * share)[:, None]).sum(axis=0) + 1.0
            table[c] /= table[c].sum(axis=1, keepdims=True)
        model = LabelModel(float(np.clip((counts * q).sum() / counts.sum(), 0.01, 0.99)), table)
        new = model.posterior(patterns)
        if np.abs(new - q).max() < 1e-7:
            break
        q = new
    return model


@dataclass
class Scorer:
    """Linear scorer: mean weight of a text's hashed words plus weights of its votes and an offset."""

    words: np.ndarray
    marks: np.ndarray
    offset: float

    def score(self, words_of: list[np.ndarray], v: np.ndarray) -> np.ndarray:
        means = np.array([self.words[(w >> np.uint64(40)).astype(np.int64) % BUCKETS].mean() if len(w) else 0.0 for w in words_of])
        margin = means + self.marks[np.arange(v.shape[1])[None, :], v].sum(axis=1) + self.offset
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def train_scorer(words_of: list[np.ndarray], v: np.ndarray, target: np.ndarray, rounds: int = 150) -> Scorer:
    """Logistic regression on soft targets, by damped gradient steps scaled for each weight."""
    size = np.array([len(w) for w in words_of])
    bucket = np.concatenate([(w >> np.uint64(40)).astype(np.int64) % BUCKETS for w in words_of] or [np.empty(0, np.int64)])
    row = np.repeat(np.arange(len(words_of)), size)
    value = 1.0 / np.maximum(size, 1)[row]
    k = v.shape[1]
    mark = np.arange(k)[None, :] * 3 + v
    w, m, b = np.zeros(BUCKETS), np.zeros(k * 3), 0.0
    gw, gm, gb = np.full(BUCKETS, 1e-6), np.full(k * 3, 1e-6), 1e-6
    n = max(1, len(words_of))
    for _ in range(rounds):
        margin = np.bincount(row, weights=w[bucket] * value, minlength=len(words_of)) + m[mark].sum(axis=1) + b
        err = target - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        dw = np.bincount(bucket, weights=err[row] * value, minlength=BUCKETS) / n - 1e-4 * w
        dm = np.bincount(mark.ravel(), weights=np.repeat(err, k), minlength=k * 3) / n - 1e-4 * m
        db = err.mean() if len(err) else 0.0
        gw, gm, gb = gw + dw**2, gm + dm**2, gb + db**2
        w, m, b = w + 0.1 * dw / np.sqrt(gw), m + 0.3 * dm / np.sqrt(gm), b + 0.3 * db / np.sqrt(gb)
    return Scorer(w, m.reshape(k, 3), float(b))


def _pattern(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def _unpack(p: np.ndarray) -> np.ndarray:
    return (p[:, None] // 3 ** np.arange(len(SIGNALS)) % 3).astype(np.int8)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, n_words, _ = signals(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(_pattern(votes(values, n_words)))], names=["pattern"])


def fit(docs: DataFrame, *, sample: int = 4000, longest: int = 100_000) -> tuple[LabelModel, Scorer]:
    """The label model over the votes of all documents, and the scorer trained on the posteriors of
    at most ``sample`` different texts (least hash, at most ``longest`` characters each), which is
    all the text that the driver holds."""
    text = docs.select(F.col("text").cast("string").alias("text"))
    found = text.mapInArrow(lean_batches(_vote), "pattern long").groupBy("pattern").count().orderBy("pattern").collect()
    model = label_model(_unpack(np.array([r[0] for r in found], np.int64)), np.array([r[1] for r in found], float))
    hashed = text.where(F.length("text") <= longest).select("text", F.xxhash64("text").alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    # Only texts up to the last hash of the sample move, one copy of each.
    picked = hashed.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("text").alias("text")).orderBy("h").limit(sample).toArrow()
    if not picked.num_rows:
        return model, Scorer(np.zeros(BUCKETS), np.zeros((len(SIGNALS), 3)), 0.0)
    values, n_words, words_of = signals(picked.column("text").combine_chunks())
    v = votes(values, n_words)
    return model, train_scorer(words_of, v, model.posterior(v))


def quality(docs: DataFrame, *, threshold: float = 0.5, sample: int = 4000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_good and n_bad votes, posterior (label model), score
    (hashed linear scorer), keep (score >= threshold).

    Eight heuristic labellers vote on every whole text or abstain; expectation maximisation over the
    counts of vote patterns gives their accuracies and posteriors.  Empty and null texts are bad
    by every vote.  Rows are judged one by one, so repeated rows get equal results."""
    model, scorer = fit(docs, sample=sample)
    shipped = docs.sparkSession.sparkContext.broadcast((model, scorer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model, own_scorer = shipped.value
        names = ["doc_id", "n_good", "n_bad", "posterior", "score", "keep"]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                values, n_words, words_of = signals(batch.column(1))
                v = votes(values, n_words)
                score = own_scorer.score(words_of, v)
                columns = [(v == 1).sum(axis=1), (v == 0).sum(axis=1), own_model.posterior(v), score, score >= threshold]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=names)

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(lean_batches(run), "doc_id long, n_good long, n_bad long, posterior double, score double, keep boolean")
