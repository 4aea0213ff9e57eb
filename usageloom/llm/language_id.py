"""Language identification in two steps: family first, then languages inside it.

A text is a histogram of hashed byte trigrams of its lower-cased letters. One
linear support vector machine per family tells families apart; inside a family
one machine per pair of languages votes. Models are fitted on the driver from a
bounded sample; every text is scored whole, in one pass and without a shuffle.

Defined cases: a null text or one without a letter is `und` with score 0;
languages without a family are a family of their own; with one learned language
every text with a letter gets it; repeated rows get equal results; an empty
table gives an empty result, and no training rows give `und` for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageloom.llm.arrays import bytes_of, column, slices, tidy
from usageloom.llm.samples import labelled_sample
from usageloom.llm.staging import packed, unpacked

UNKNOWN = "und"
BUCKETS = 4096
#: Documents learned from, over all languages.
SAMPLE = 4000
#: Texts whose histograms are held at once.
ROWS = 256

#: Families of languages by code; a code that is missing is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "sinitic": ("zh", "yue"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def histograms(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Square roots of trigram shares, one row per text; rows have length 1."""
    n = len(bounds) - 1
    letters = np.where(_GAP[data], 32, data).astype(np.uint32)
    if len(letters) < 3:
        return np.zeros((n, BUCKETS), np.float32)
    code = (letters[:-2] << np.uint32(16)) | (letters[1:-1] << np.uint32(8)) | letters[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    text = np.repeat(np.arange(n), np.diff(bounds))
    inside = text[:-2] == text[2:]
    dull = (letters[:-2] == 32) & (letters[1:-1] == 32)
    keep = inside & ~dull
    counts = np.bincount(text[:-2][keep] * BUCKETS + bucket[keep], minlength=n * BUCKETS).reshape(n, BUCKETS)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.sqrt(counts / total).astype(np.float32)


#: Bytes of ASCII that are no letters count as gaps between words.
_GAP = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def linear_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Weights of a squared-hinge machine by dual coordinate descent on some rows; y is 1 or -1.

    The last column of ``x`` is 1, its weight the bias. Rows are never copied.
    """
    norms = np.einsum("ij,ij->i", x, x)[rows] + 1 / (2 * cost)
    weight = np.zeros(x.shape[1], np.float32)
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            own = x[rows[i]]
            step = (1 - y[i] * float(own @ weight) - alpha[i] / (2 * cost)) / norms[i]
            change = max(-alpha[i], step)
            if change:
                alpha[i] += change
                weight += (change * y[i]) * own
    return weight


@dataclass
class Model:
    """Family machines and pair machines; columns of one weight matrix."""

    languages: list[str] = field(default_factory=list)
    families: list[list[int]] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + 1, 0), np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language of each row and its score in 0..1."""
        margins = x @ self.weights[:-1] + self.weights[-1]
        sure = 1 / (1 + np.exp(-4 * margins.astype(np.float64)))
        n = len(x)
        family_count = len(self.families)
        head = sure[:, :family_count] if family_count > 1 else np.ones((n, 1))
        head = head / head.sum(axis=1, keepdims=True)
        votes = np.zeros((n, len(self.languages)))
        for (a, b), p in zip(self.pairs, sure[:, family_count:].T):
            votes[:, a] += p
            votes[:, b] += 1 - p
        chosen = head.argmax(axis=1)
        language = np.zeros(n, np.int64)
        score = np.zeros(n)
        for f, own in enumerate(self.families):
            rows = np.flatnonzero(chosen == f)
            inner = votes[np.ix_(rows, own)] / max(1, len(own) - 1) if len(own) > 1 else np.ones((len(rows), 1))
            best = inner.argmax(axis=1)
            language[rows] = np.array(own)[best]
            score[rows] = head[rows, f] * inner[np.arange(len(rows)), best]
        return language, np.clip(score, 0, 1)


def fit(texts: list[str], languages: list[str]) -> Model:
    """Learn the machines from sampled texts."""
    model = Model(sorted(set(languages)))
    if not model.languages:
        return model
    x = np.ones((len(texts), BUCKETS + 1), np.float32)
    at = 0
    for part in slices(pa.RecordBatch.from_pydict({"text": [f" {t.lower()} " for t in texts]}), rows=ROWS):
        x[at : at + part.num_rows, :BUCKETS] = histograms(*bytes_of(column(part, "text")))
        at += part.num_rows
    y = np.array([model.languages.index(code) for code in languages])
    names = [_FAMILY.get(code, code) for code in model.languages]
    model.families = [[i for i, name in enumerate(names) if name == family] for family in sorted(set(names))]
    every = np.arange(len(y))
    columns = [linear_svm(x, every, np.where(np.isin(y, own), 1.0, -1.0)) for own in model.families]
    for own in model.families:
        for a, b in combinations(own, 2):
            rows = np.flatnonzero((y == a) | (y == b))
            model.pairs.append((a, b))
            columns.append(linear_svm(x, rows, np.where(y[rows] == a, 1.0, -1.0)))
    model.weights = np.stack(columns, axis=1)
    return model


def fit_on(training: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from a bounded sample of rows with doc_id, text and lang."""
    known = training.where("lang is not null").select("doc_id", "text", "lang")
    languages = max(1, known.select("lang").distinct().count())
    rows = labelled_sample(known, known, "lang", max(1, sample // languages))
    taken = rows.select("doc_id", "text", "label").orderBy("doc_id", "label").toArrow()
    return fit(taken.column("text").to_pylist(), taken.column("label").to_pylist())


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred and score; all other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "letters", rows=ROWS):
                known = np.array(column(part, "known").to_numpy(zero_copy_only=False), bool)
                language, score = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                if known.any() and model.languages:
                    x = histograms(*bytes_of(column(part, "letters")))
                    language[known], score[known] = model.predict(x[known])
                codes = [model.languages[i] if k and model.languages else UNKNOWN for i, k in zip(language, known)]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "row"), pa.array(codes, pa.string()), pa.array(score)], ["row", "lang_pred", "score"]
                )

    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("known")
    letters = F.concat(F.lit(" "), F.lower(F.coalesce("text", F.lit(""))), F.lit(" ")).alias("letters")
    rows = packed(docs, known, letters)
    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double"
    return unpacked(rows.mapInArrow(tidy(run), schema), "lang_pred", "score")
