"""What each of five filters removes, alone, in every order, and as a fair share.

A document is described by the set of filters it fails. One pass over the texts
writes that mask beside narrow columns; counts per part and mask then give the
removals v(S) of all 32 coalitions, and nothing else is ever counted:

* applied after the filters P, filter i removes v(P + i) - v(P);
* its Shapley value solves the least squares problem over all coalitions with
  the Shapley kernel as weights, under the constraint that the values sum to
  v(all). The normal equations are the same for every part, so they are solved
  once, in rationals, for the linear map from v to the values; times 120 the map
  has whole coefficients, and Spark applies it to each part's counts.

Defined cases: a null text is empty, a null part an empty string; a null doc_id
is smaller than every other; rows that share the smallest doc_id of a text are
all first. A document is good (toxic) if any of its label rows says so. Of an
empty table there are no rows.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageloom.llm.staging import Stage

#: The filters and their limits, as the contract of the audit gives them.
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
SIGNS = "[#$%&*|]"
_SPACES = r"[\x20\x09-\x0D]+"

N = len(FILTERS)
ALL = (1 << N) - 1
MEASURES = ("n", "good", "toxic")



def _solve(matrix: list[list[Fraction]], sides: list[list[Fraction]]) -> list[list[Fraction]]:
    """X with matrix X = sides, by elimination in rationals."""
    rows = [list(a) + list(b) for a, b in zip(matrix, sides)]
    for at in range(len(rows)):
        pivot = next(r for r in range(at, len(rows)) if rows[r][at])
        rows[at], rows[pivot] = rows[pivot], rows[at]
        rows[at] = [x / rows[at][at] for x in rows[at]]
        for r, row in enumerate(rows):
            if r != at and row[at]:
                rows[r] = [x - row[at] * y for x, y in zip(row, rows[at])]
    return [row[len(matrix) :] for row in rows]


def shapley_map() -> list[list[int]]:
    """For each filter the factor of v(S), S from 0 to 31, in its Shapley value times 120.

    Minimises sum k(S) (v(S) - sum of the values in S)^2 over the proper
    coalitions, k(S) = (n - 1) / (C(n, s) s (n - s)), with the values summing to
    v(all). With a multiplier the stationary point solves a system of n + 1 rows.
    """
    proper = range(1, ALL)
    weight = {s: Fraction(N - 1, comb(N, s.bit_count()) * s.bit_count() * (N - s.bit_count())) for s in proper}
    matrix = [[sum((weight[s] for s in proper if s >> i & s >> j & 1), Fraction(0)) for j in range(N)] + [Fraction(1)] for i in range(N)]
    matrix.append([Fraction(1)] * N + [Fraction(0)])
    sides = [[weight.get(s, Fraction(0)) * (s >> i & 1) for s in range(ALL + 1)] for i in range(N)]
    sides.append([Fraction(s == ALL) for s in range(ALL + 1)])
    values = [[x * factorial(N) for x in row] for row in _solve(matrix, sides)[:N]]
    assert all(x.denominator == 1 for row in values for x in row)
    return [[int(x) for x in row] for row in values]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def text_mask(text: Column) -> Column:
    """The failed ones of A to D, filter i as bit i."""
    words = _words(text)
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]", ""))
    failed = (
        n < MIN_WORDS,
        100 * distinct < MIN_DISTINCT_PERCENT * n,
        100 * capitals > MAX_CAPITAL_PERCENT * F.char_length(text),
        text.rlike(SIGNS),
    )
    mask = F.lit(0)
    for i, wrong in enumerate(failed):
        mask = mask + F.when(wrong, 1 << i).otherwise(0)
    return mask.cast("int")


def failures(docs: DataFrame, labels: DataFrame, part: Column, stage: Stage) -> DataFrame:
    """part, mask, good and toxic of each document, with the copies marked.

    A text's first document is joined on text hash and doc_id together, so
    thousands of copies of one text are that many different keys.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stage.keep(
        docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("d"),
            F.col("doc_id").alias("label_id"),
            F.unhex(F.sha2(text, 256)).alias("h"),
            F.coalesce(part.cast("string"), F.lit("")).alias("part"),
            text_mask(text).alias("mask"),
        )
    )
    first = rows.groupBy("h").agg(F.min("d").alias("d")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    copy = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return (
        rows.join(first, ["h", "d"], "left")
        .join(marks, "label_id", "left")
        .select(
            "part",
            (F.col("mask") + copy).alias("mask"),
            F.coalesce("good", F.lit(0)).alias("good"),
            F.coalesce("toxic", F.lit(0)).alias("toxic"),
        )
    )


def coalitions(failed: DataFrame) -> DataFrame:
    """One row per part: arrays n, good and toxic with the removals of all coalitions, and its documents as ``all``."""
    cells = failed.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    )
    zero = F.lit(0).cast("long")

    def removed(measure: str) -> Column:
        hit = [F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(measure))), zero) for s in range(ALL + 1)]
        return F.array(*hit).alias(f"{measure}_removed")

    return cells.groupBy("part").agg(F.sum("n").alias("all"), *[removed(m) for m in MEASURES])


def audit(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """One row per part, order of the filters and step."""
    stage = Stage(docs.sparkSession, "filter-audit")
    tables = stage.keep(coalitions(failures(docs, labels, part, stage)))
    steps = F.expr("inline(array(" + ", ".join(_step_literals()) + "))")
    v = {m: lambda mask, m=m: F.get(f"{m}_removed", mask) for m in MEASURES}
    before, bit = F.col("_before"), F.col("_bit")
    after, rest = before.bitwiseOR(bit), F.lit(ALL).bitwiseXOR(bit)
    removed = v["n"](after) - v["n"](before)
    shares = [sum((F.lit(k) * v["n"](F.lit(s)) for s, k in enumerate(row) if k), F.lit(0).cast("long")) for row in shapley_map()]
    return (
        tables.withColumn("_shares", F.array(*shares))
        .select("*", steps)
        .select(
            "part",
            "filter_order",
            "step",
            F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"),
            (F.col("all") - v["n"](after)).alias("kept"),
            removed.alias("removed"),
            (v["n"](bit) - removed).alias("redundant"),
            (v["n"](F.lit(ALL)) - v["n"](rest)).alias("unique_fails"),
            (v["good"](after) - v["good"](before)).alias("good_lost"),
            (v["toxic"](after) - v["toxic"](before)).alias("toxic_lost"),
            F.get("_shares", F.col("_filter")).alias("shapley"),
        )
    )


def _step_literals() -> list[str]:
    """Every order and step: the filter, its bit and the coalition applied before it."""
    out = []
    for order in permutations(range(N)):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            out.append(f"named_struct('filter_order', '{name}', 'step', {step}, '_filter', {i}, '_bit', {1 << i}, '_before', {before})")
            before |= 1 << i
    return out
