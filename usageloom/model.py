"""Column names, fixed values and scopes shared by all jobs."""

from __future__ import annotations

from dataclasses import dataclass

# The five token counters of a usage event.
TOKENS = (
    "input_tokens",
    "cached_input_tokens",
    "output_tokens",
    "reasoning_output_tokens",
    "total_tokens",
)

# Tools whose events are accepted.
SNAPSHOT_TOOL = "codex"
MESSAGE_TOOL = "claude-code"
KNOWN_TOOLS = (SNAPSHOT_TOOL, MESSAGE_TOOL)

# Fields an uploaded event must not carry.
FORBIDDEN_FIELDS = ("prompt", "response", "raw_api_body", "transcript")

# Limits of one upload and of one report.
MAX_ENVELOPE_CHARS = 1_048_576
MAX_ENVELOPE_EVENTS = 500
ACTIVE_GAP_SECONDS = 1800
UPLOAD_LIST_ROWS = 50
RECENT_UPLOADS_PER_DEVICE = 3
COMPARE_ROWS = 8
OVERVIEW_ROWS = 6
RANKED_MODEL_ROWS = 50
MAX_SESSION_PAGE = 10
LOOKBACK_DAYS = 35
WARNING_GAP_SECONDS = 1800
STALE_GAP_SECONDS = 7200
COLLECTOR_VERSION = "0.1.0"

UNKNOWN = "unknown"

DEVICE = ("team_id", "user_id", "device_id")

EVENT_COLUMNS = (
    "event_key",
    "tool",
    "session_id",
    "model",
    "event_ts",
    "local_date",
    *TOKENS,
    "source_kind",
    "source_quality",
)
LOCAL_EVENT_COLUMNS = (*EVENT_COLUMNS, "source_path", "line_number")
TEAM_EVENT_COLUMNS = (*DEVICE, *EVENT_COLUMNS, "received_at")


@dataclass(frozen=True)
class Scope:
    """What identifies a session, and which distinct people and devices to count."""

    name: str
    session: tuple[str, ...]
    counted: tuple[tuple[str, str], ...] = ()

    @property
    def call(self) -> tuple[str, ...]:
        """Two events are one call when all of these agree."""
        return (*self.session, "tool", "model", "event_ts", *TOKENS)


LOCAL = Scope("local", ("session_id",))
TEAM = Scope("team", (*DEVICE, "session_id"), (("user_id", "users"), ("device_id", "devices")))
