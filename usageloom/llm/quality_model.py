"""Quality classifier: a factorisation machine over words and structure.

Inputs are hashed words with their shares of the text, structure statistics
(how words, lines, letters and signs are made up) and size. Every pair of inputs
interacts through low-rank factors; the sum over all pairs takes linear time, as
half the difference between the square of the sum and the sum of the squares.
The model is fitted on the driver from a bounded labelled sample; all texts are
scored whole, in one pass and without a shuffle.

Defined cases: null and empty texts are scored from their statistics (no words,
size zero); null labels are not learned from; without labelled rows every score
is 0.5; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageloom.llm.arrays import bytes_of, column, slices
from usageloom.llm.samples import labelled_sample
from usageloom.llm.textstats import Words, byte_class, duplicate_lines, per_text, repeated_words

BUCKETS = 2048
FACTORS = 8
#: Labelled documents learned from, for each label.
SAMPLE = 3000
GOOD = 0.7

_UPPER, _LOWER = byte_class(bytes(range(65, 91))), byte_class(bytes(range(97, 123)))
_DIGIT = byte_class(b"0123456789")
_SIGN = byte_class(b"#*$%&<>@^~=+_{}[]\\/")
_STOP = byte_class(b".,;:?'\"()-")
_CALL, _BAR = byte_class(b"!"), byte_class(b"|")
_WIDE = np.arange(256) >= 128
STATISTICS = 16


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and share of each distinct word bucket, and the statistics of each text."""
    words = Words(data, bounds)
    hashes = words.hashes()
    n = len(words.count)
    bucket = (hashes >> np.uint64(53)).astype(np.int64) % BUCKETS
    pair, times = np.unique(words.text * BUCKETS + bucket, return_counts=True)
    text = pair // BUCKETS
    share = times / np.maximum(words.count, 1)[text]
    size, count = np.diff(bounds), words.count
    per_char, per_word = np.maximum(size, 1), np.maximum(count, 1)
    letters = np.maximum(per_text(_UPPER[data] | _LOWER[data], bounds), 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])
    signed = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SIGN[data] | _CALL[data] | _BAR[data], out=signed[1:])
    marked = signed[words.ends] > signed[words.starts]
    caps = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LOWER[data], out=caps[1:])
    shouted = (caps[words.ends] == caps[words.starts]) & (words.ends - words.starts > 1)
    order = np.lexsort((hashes, words.text))
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (words.text[order][1:] != words.text[order][:-1])
    kinds = np.bincount(words.text[order][first], minlength=n)
    dup, full = duplicate_lines(words)
    shares = [
        np.log1p(count),
        np.log1p(size),
        size / per_word / 10,
        per_text(_UPPER[data], bounds) / letters,
        per_text(_DIGIT[data], bounds) / per_char * 10,
        per_text(_SIGN[data], bounds) / per_char * 10,
        per_text(_STOP[data], bounds) / per_word,
        per_text(_CALL[data], bounds) / per_word,
        per_text(_BAR[data], bounds) / per_word,
        per_text(_WIDE[data], bounds) / per_char,
        per_text(same, words.cuts) / per_word,
        per_text(marked, words.cuts) / per_word,
        per_text(shouted, words.cuts) / per_word,
        repeated_words(words, hashes) / per_word,
        dup / np.maximum(full, 1),
        kinds / per_word,
    ]
    return text, pair % BUCKETS, share, np.stack(shares, axis=1)


@dataclass
class Model:
    """Bias, linear weights, factors, and how statistics are scaled; words come first."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -4, 4)

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, one per text."""
        n = len(bounds) - 1
        text, bucket, share, stats = features(data, bounds)
        x = self.scaled(stats)
        share = share * WORD_SCALE
        total = np.bincount(text, self.linear[bucket] * share, n) + x @ self.linear[BUCKETS:]
        for f in range(self.factors.shape[1]):
            own, fixed = self.factors[bucket, f] * share, self.factors[BUCKETS:, f]
            whole = np.bincount(text, own, n) + x @ fixed
            squares = np.bincount(text, own * own, n) + (x * x) @ (fixed * fixed)
            total += (whole * whole - squares) / 2
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


#: Word shares are small; they are scaled to the size of the statistics.
WORD_SCALE = 10.0


def fit(texts: list[str], labels: list[int], epochs: int = 30, rate: float = 0.02) -> Model:
    """Learn by Adam on the logistic loss, classes weighted alike in pairs of small batches."""
    n_inputs = BUCKETS + STATISTICS
    rng = np.random.default_rng(11)
    model = Model(0.0, np.zeros(n_inputs), rng.normal(0, 0.02, (n_inputs, FACTORS)), np.zeros(STATISTICS), np.ones(STATISTICS))
    if not texts:
        model.factors[:] = 0
        return model
    parts, stats = [], []
    batch = pa.RecordBatch.from_pydict({"text": texts})
    for part in slices(batch):
        text, bucket, share, own = features(*bytes_of(column(part, "text")))
        x = np.zeros((part.num_rows, n_inputs), np.float32)
        x[text, bucket] = share * WORD_SCALE
        parts.append(x)
        stats.append(own)
    x, raw = np.concatenate(parts), np.concatenate(stats)
    model.mean, model.spread = raw.mean(axis=0), np.maximum(raw.std(axis=0), 0.02)
    x[:, BUCKETS:] = model.scaled(raw)
    y = np.array(labels, float)
    state = [np.zeros(n_inputs + 1), np.zeros((n_inputs, FACTORS))]
    moment = [np.zeros_like(s) for s in state]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
            step += 1
            own, v = x[rows], model.factors
            whole = own @ v
            squared = own * own
            raw_score = model.bias + own @ model.linear + (whole * whole - squared @ (v * v)).sum(axis=1) / 2
            error = (1 / (1 + np.exp(-np.clip(raw_score, -30, 30))) - y[rows]) / len(rows)
            grad = [
                np.concatenate([[error.sum()], own.T @ error + 1e-4 * model.linear]),
                own.T @ (error[:, None] * whole) - (squared.T @ error)[:, None] * v + 1e-4 * v,
            ]
            moves = []
            for g, m, s in zip(grad, moment, state):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                moves.append(rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8))
            model.bias -= moves[0][0]
            model.linear -= moves[0][1:]
            model.factors -= moves[1]
    return model


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from a bounded sample of labelled documents (doc_id, text; doc_id, quality)."""
    rows = labelled_sample(docs, labels, "quality", sample).select("doc_id", "text", "label")
    taken = rows.orderBy("doc_id", "label").toArrow()
    return fit(taken.column("text").to_pylist(), [int(v == 1) for v in taken.column("label").to_pylist()])


def with_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = model.score(*bytes_of(column(part, "text")))
                predicted = pa.array((score >= GOOD).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(score), predicted], ["doc_id", "score", "predicted"]
                )

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double, predicted int")
