"""Ordered-series state: values carried along a file, exact for files of any length."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one series that one task handles together.
SEGMENT_ROWS = 500_000


def carry_along(
    rows: DataFrame,
    series: str,
    position: str,
    last: tuple[str, ...] = (),
    previous: tuple[str, ...] = (),
    first: Mapping[str, Column] | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add ``last_<c>``, ``previous_<c>`` and ``first_<name>``.

    ``last`` is the newest non-null value up to and including the row,
    ``previous`` the newest one strictly before it, and ``first`` the first
    non-null value of an expression in the whole series.

    A series is cut into segments by position, so that no task holds more than
    ``segment_rows`` positions of a long file. Each segment hands its end state
    on through a table with one row per segment, and that state fills what the
    segment could not see itself.
    """
    carried = tuple(dict.fromkeys((*last, *previous)))
    first = first or {}
    columns = rows.columns
    # The join below needs non-null keys; saying so here gives both of its sides
    # the same filter, and so the same shuffle.
    cut = (
        rows.withColumn("_segment", F.floor(F.col(position) / segment_rows))
        .filter(F.col(series).isNotNull() & F.col("_segment").isNotNull())
        .repartition(series, "_segment")
    )
    inside = Window.partitionBy(series, "_segment").orderBy(position)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select(
        "*",
        *[F.last(c, True).over(upto).alias(f"_l_{c}") for c in carried],
        *[F.last(c, True).over(before).alias(f"_p_{c}") for c in previous],
    )
    # Taking the whole last row keeps both uses of the shuffle identical, so it
    # is written once and read twice. Pass only columns that are used later.
    tails = local.groupBy(series, "_segment").agg(
        F.max_by(F.struct(*local.columns), position).alias("_tail"),
        *[
            F.min_by(value, F.when(value.isNotNull(), F.col(position))).alias(f"_h_{name}")
            for name, value in first.items()
        ],
    )
    segments = Window.partitionBy(series).orderBy("_segment")
    earlier = segments.rowsBetween(Window.unboundedPreceding, -1)
    whole = segments.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    handed = tails.select(
        series,
        "_segment",
        *[F.last(f"_tail._l_{c}", True).over(earlier).alias(f"_e_{c}") for c in carried],
        *[F.first(f"_h_{c}", True).over(whole).alias(f"first_{c}") for c in first],
    )
    return local.join(handed, [series, "_segment"]).select(
        *columns,
        *[F.coalesce(f"_l_{c}", f"_e_{c}").alias(f"last_{c}") for c in last],
        *[F.coalesce(f"_p_{c}", f"_e_{c}").alias(f"previous_{c}") for c in previous],
        *[F.col(f"first_{c}") for c in first],
    )
