"""Event keys. They must be stable to the byte so that replays are recognised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usageloom.functions.texts import short_hash
from usageloom.model import MESSAGE_TOOL, SNAPSHOT_TOOL, TOKENS


def piped(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def snapshot_event_key(session: Column, path: Column, line: Column, cumulative: Column) -> Column:
    return piped(
        F.lit(SNAPSHOT_TOOL),
        session,
        short_hash(path),
        line,
        cumulative["total_tokens"],
        cumulative["input_tokens"],
        cumulative["output_tokens"],
    )


def message_event_key(kind: Column, session: Column, identity: Column, model: Column) -> Column:
    fingerprint = piped(*[F.col(t) for t in TOKENS])
    return piped(
        F.lit(MESSAGE_TOOL), kind, session, short_hash(identity), model, short_hash(fingerprint)
    )
