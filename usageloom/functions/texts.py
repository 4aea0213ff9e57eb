"""Text expressions: blanks, hashes, masks, file names and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usageloom.model import FORBIDDEN_FIELDS, KNOWN_TOOLS, TOKENS, UNKNOWN


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.btrim(text, F.lit(" \t\n\r\f\x0b")) == "")


def or_unknown(text: Column) -> Column:
    return F.when(is_blank(text), F.lit(UNKNOWN)).otherwise(text)


def is_known_model(model: Column) -> Column:
    return ~is_blank(model) & (model != UNKNOWN)


def known_model(model: Column) -> Column:
    return F.when(is_known_model(model), model)


def is_known_tool(tool: Column) -> Column:
    return F.coalesce(tool.isin(*KNOWN_TOOLS), F.lit(False))


def has_positive_usage(columns=TOKENS) -> Column:
    return F.greatest(*[F.col(c) if isinstance(c, str) else c for c in columns]) > 0


def mentions_forbidden(text: Column) -> Column:
    found = F.lit(False)
    for field in FORBIDDEN_FIELDS:
        found = found | text.contains(f'"{field}"')
    return found


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def masked(token: Column) -> Column:
    """Preview fixed when a token is registered; the token itself is not kept."""
    stars = F.lit("****")
    return (
        F.when(is_blank(token), F.lit("unrecoverable"))
        .when(F.length(token) <= 12, F.concat(F.left(token, F.lit(1)), stars, F.right(token, F.lit(1))))
        .otherwise(F.concat(F.left(token, F.lit(6)), stars, F.right(token, F.lit(4))))
    )


def decoded_path(uri: Column) -> Column:
    """Plain path of a file URI; a literal plus sign survives decoding."""
    path = F.regexp_replace(uri, "^file:(//)?", "")
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.jsonl$", "")


def leading_digits(text: Column) -> Column:
    """The digits a JSON value starts with; '' for other values."""
    return F.regexp_extract(text, "^([-0-9]*)", 1)


def unreadable(digits: Column) -> Column:
    """Digits are there but make no 64-bit number."""
    return (digits != "") & digits.try_cast("bigint").isNull()


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    wide = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.length(text) + wide
