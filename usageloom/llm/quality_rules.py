"""Quality rules with risk-controlled cutoffs.

Every rule rejects a text whose measure is above a cutoff, and the cutoffs of all
rules are tightened together along one fixed order: ``DOUBT`` puts the measures
on one scale, and step k of the order is one cutoff on it. So a step's false
rejections are those of the union of the rules, and one sequence of tests per
stratum spends the risk once. Going from the loosest to the strictest, a step is
kept as long as the exact binomial test shows, at the stratum's level, that the
rules reject less than ``risk`` of all good documents of the stratum, beyond what
the base rules reject. The tests run in a fixed order and stop at the first that
fails, which needs no correction inside a stratum.

Over strata ``delta`` is divided by the number of those whose labels could
certify anything at all, and a stratum that certifies the whole order hands its
level on (Holm). With probability 1 - ``delta`` no stratum loses more. Labels,
strata and texts are used whole.

Defined cases: a null or empty text has no words and fails the base rules; a
null stratum is a stratum of its own; a stratum with fewer good labels than
``labels_needed`` gets no cutoff, so its texts meet the base rules only; null or repeated labels count
as none or as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageloom.llm.arrays import bytes_of, column, slices
from usageloom.llm.staging import Stage
from usageloom.llm.textstats import Words, base_counts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Allowed share of good documents that all rules together reject, and the chance of missing it.
RISK = 0.02
DELTA = 0.05

#: Measures of the rules as SQL, each growing with doubt about a text.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
}
#: Doubt about a text, the greatest of its measures on one scale. Good texts repeat words and lines now and
#: then but hold few signs, so signs get strict first.
DOUBT = f"greatest({RULES['symbols']}, pow({RULES['duplicate_lines']}, 2), pow({RULES['repeats']}, 4))"
#: Cutoffs on doubt, loosest first, fixed before any label is seen.
CUTOFFS = tuple(round(0.95 ** k, 6) for k in range(120))


def with_counts(docs: DataFrame) -> DataFrame:
    """Add the base counts to doc_id and stratum of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(*bytes_of(column(part, "text")))
                counts = base_counts(words, words.hashes())
                arrays = [column(part, "doc_id"), column(part, "stratum")]
                yield pa.RecordBatch.from_arrays(
                    arrays + [pa.array(counts[c].astype(np.int64)) for c in COUNTS], ["doc_id", "stratum", *COUNTS]
                )

    texts = docs.select(
        F.col("doc_id").cast("long"), F.col("stratum").cast("string"), F.coalesce("text", F.lit("")).alias("text")
    )
    return texts.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def binomial_tail(rejected: int, n: int, share: float) -> float:
    """P(X <= rejected) for X binomial(n, share), in logarithms."""
    if rejected >= n:
        return 1.0
    total, a, b = 0.0, math.log(share), math.log1p(-share)
    top = math.lgamma(n + 1)
    for k in range(rejected, -1, -1):
        term = math.exp(top - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * a + (n - k) * b)
        total += term
        if term < total * 1e-17 and k < n * share:
            break
    return min(1.0, total)


def cutoff(counts: np.ndarray, share: float, level: float) -> float | None:
    """The strictest certified cutoff; ``counts[k]`` good texts have measures in step k.

    Step k lies above cutoff k and at most cutoff k - 1, step 0 above the first.
    """
    n = int(counts.sum())
    rejected, kept = 0, None
    for k, value in enumerate(CUTOFFS):
        rejected += int(counts[k])
        if n == 0 or binomial_tail(rejected, n, share) > level:
            break
        kept = value
    return kept


def labels_needed(strata: int, risk: float = RISK, delta: float = DELTA) -> int:
    """Good labels with no false rejection that certify a cutoff when ``strata`` strata share ``delta``."""
    return math.ceil(math.log(delta / strata) / math.log1p(-risk))


def sharing(sizes: list[int], risk: float, delta: float) -> int:
    """The least number K such that at most K strata could certify anything at level delta / K."""
    able = [sum(n >= labels_needed(k, risk, delta) for n in sizes) for k in range(1, len(sizes) + 1)]
    return next((k for k, count in enumerate(able, 1) if count <= k), 1)


def levels(histograms: list[np.ndarray], risk: float, delta: float) -> list[float]:
    """The level of each stratum's tests; a stratum that certifies all its steps hands its level on."""
    sizes = [int(counts.sum()) for counts in histograms]
    open_ = sharing(sizes, risk, delta)
    able = {i for i, n in enumerate(sizes) if n >= labels_needed(open_, risk, delta)}
    out = [0.0] * len(sizes)
    while able:
        level = delta / open_
        for i in able:
            out[i] = level
        whole = {i for i in able if cutoff(histograms[i], risk, level) == CUTOFFS[-1]}
        if not whole:
            break
        able -= whole
        open_ = max(1, open_ - len(whole))
    return out


def base_failed() -> Column:
    """Whether a text fails the base rules."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def fit_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, cutoff) on doubt from good holdout documents; a cutoff may be null.

    Only histograms of fixed width leave the map side and reach the driver: at
    most one row per labelled stratum and step.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    grid = f"array({', '.join(f'{c}D' for c in CUTOFFS)})"
    step = F.when(base_failed(), len(CUTOFFS)).otherwise(F.expr(f"size(filter({grid}, c -> c >= {DOUBT}))"))
    rows = measured.join(good, "doc_id").groupBy("stratum", step.alias("step")).count().collect()
    strata = sorted({row.stratum for row in rows}, key=lambda s: (s is not None, s or ""))
    counts = [np.zeros(len(CUTOFFS) + 1, np.int64) for _ in strata]
    for row in rows:
        counts[strata.index(row.stratum)][row.step] += row["count"]
    found = [
        (stratum, cutoff(own, risk, level) if level else None)
        for stratum, own, level in zip(strata, counts, levels(counts, risk, delta))
    ]
    return measured.sparkSession.createDataFrame(found, "stratum string, cutoff double")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Base counts, base_failed and kept of each document (columns doc_id, stratum, text)."""
    stage = Stage(docs.sparkSession, "quality-rules")
    measured = stage.keep(with_counts(docs))
    cutoffs = fit_cutoffs(measured, labels, risk, delta)
    fine = ~F.coalesce(F.expr(DOUBT) > F.col("cutoff"), F.lit(False))
    limits = cutoffs.withColumnRenamed("stratum", "_stratum")
    return (
        measured.join(F.broadcast(limits), F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & fine)
        .select("doc_id", "stratum", *COUNTS, "base_failed", "kept")
    )
