"""Instant and local-date expressions. The session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: date, time with seconds, and an offset are all required.
INSTANT_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{0,9})?(Z|[+-]\d{2}:\d{2}(:\d{2})?)$"
)


def parse_instant(text: Column) -> Column:
    """Timestamp, or null for anything that is not a complete ISO instant."""
    upper = F.upper(text)
    return F.when(upper.rlike(INSTANT_PATTERN), F.try_to_timestamp(upper))


def local_date(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def _micros(ts: Column) -> Column:
    return F.pmod(F.unix_micros(ts), F.lit(1_000_000))


def canonical_instant(ts: Column) -> Column:
    """UTC text with no, three or six fraction digits, the form keys are built on."""
    micros = _micros(ts)
    digits = F.lpad(micros.cast("string"), 6, "0")
    fraction = (
        F.when(micros == 0, "")
        .when(micros % 1000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 3)))
        .otherwise(F.concat(F.lit("."), digits))
    )
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def offset_text(ts: Column, zone: str) -> Column:
    """Local text with its zone offset, for documents."""
    local = F.from_utc_timestamp(ts, zone)
    shift = F.unix_seconds(local) - F.unix_seconds(ts)
    minutes = F.abs(shift) / 60
    offset = F.when(shift == 0, F.lit("Z")).otherwise(
        F.concat(
            F.when(shift < 0, "-").otherwise("+"),
            F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"),
            F.lit(":"),
            F.lpad((minutes % 60).cast("int").cast("string"), 2, "0"),
        )
    )
    micros = _micros(ts)
    fraction = F.when(micros == 0, "").otherwise(
        F.concat(
            F.lit("."),
            F.regexp_replace(F.lpad(micros.cast("string"), 6, "0"), "0+$", ""),
        )
    )
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), fraction, offset)
