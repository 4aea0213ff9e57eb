"""DuckDB SQL that says what each registered query must return.

Written from the definitions (lists of timestamps, distinct tuples, per-row
windows), not from the way the Spark plans compute them.
"""

from __future__ import annotations

TOKENS = (
    "input_tokens",
    "cached_input_tokens",
    "output_tokens",
    "reasoning_output_tokens",
    "total_tokens",
)

BASE = """base AS (
  SELECT 'ev-'||event_id AS event_key, 'team-'||(uid%3) AS team_id, 'user-'||uid AS user_id,
    'device-'||(uid*2 + extract(day FROM lts)%2) AS device_id,
    CASE WHEN event_type IN ('view','click') THEN 'codex'
         WHEN event_type IN ('signup','purchase') THEN 'claude-code' ELSE 'other' END AS tool,
    's-'||uid||'-'||strftime(lts,'%Y%m%d') AS session_id,
    CASE WHEN k%10=9 THEN 'unknown' ELSE 'model-'||(k%5) END AS model,
    ts AS event_ts, CAST(lts AS DATE) AS local_date,
    i AS input_tokens, CASE WHEN k>=95 THEN i+k ELSE (i*k)//100 END AS cached_input_tokens,
    o AS output_tokens, (o*(k%7))//10 AS reasoning_output_tokens,
    i+o+(o*(k%7))//10 AS total_tokens,
    CASE k%3 WHEN 0 THEN 'local_jsonl' WHEN 1 THEN 'otel_metric' ELSE '' END AS source_kind,
    CASE k%3 WHEN 0 THEN 'derived' WHEN 1 THEN 'reported' ELSE '' END AS source_quality,
    event_id, k, uid
  FROM (
    SELECT event_id, ts, ts + INTERVAL 8 HOUR AS lts, user_id AS uid, event_type,
      CAST(json_extract_string(props,'$.k') AS BIGINT) AS k,
      CAST(floor(value*10) AS BIGINT) AS i, CAST(floor(value*3) AS BIGINT) AS o
    FROM events))"""

MONTH = "local_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'"
USAGE = f"u AS (SELECT * FROM base WHERE tool <> 'other' AND {MONTH})"
REPLAYED = "replayed AS (SELECT *, 0 AS copy FROM base UNION ALL SELECT *, 1 FROM base WHERE event_id%20=0)"
CALLS = """calls AS (SELECT * FROM base UNION ALL
  SELECT * REPLACE (event_key||'-b' AS event_key) FROM base WHERE event_id%25=0)"""
DEC = """moved AS (SELECT * REPLACE (
    CASE WHEN event_id%2=1 THEN event_ts - INTERVAL 31 DAY ELSE event_ts END AS event_ts,
    CASE WHEN event_id%2=1 THEN local_date - 31 ELSE local_date END AS local_date) FROM base)"""
REGISTRY = """devices AS (SELECT DISTINCT team_id, user_id, device_id, uid FROM base WHERE uid%11<>0),
tokens AS (SELECT *, device_id||'-token' AS token FROM devices
  UNION ALL SELECT *, device_id||'-second' FROM devices WHERE uid%5=0),
registry AS (SELECT sha256(token) AS token_hash, team_id, user_id, device_id,
    CASE WHEN uid%4=0 THEN '' ELSE 'Dev '||device_id END AS display_name,
    CASE WHEN uid%13=0 THEN 'disabled' WHEN uid%17=0 THEN 'revoked' ELSE 'active' END AS status,
    TIMESTAMP '2024-01-01 00:00:00' AS created_at, CAST(NULL AS TIMESTAMP) AS last_seen_at,
    left(token,6)||'****'||right(token,4) AS token_preview, token FROM tokens),
names AS (SELECT team_id, user_id, device_id, first(display_name ORDER BY token_hash) AS device_name
  FROM registry GROUP BY ALL)"""
UPLOADS = """uploads AS (SELECT team_id, user_id, device_id, local_date AS upload_date,
    max(event_ts) AS upload_time, count(*) AS event_count,
    count(*) FILTER (tool<>'other' AND event_id%20<>0) AS accepted,
    count(*) FILTER (tool<>'other' AND event_id%20=0) AS duplicate,
    count(*) FILTER (tool='other') AS rejected,
    CASE WHEN max(k)=99 THEN 'error' ELSE 'ok' END AS status, '' AS message
  FROM base GROUP BY ALL)"""
SNAPSHOTS = f"""halves AS (SELECT *, CASE WHEN extract(hour FROM event_ts + INTERVAL 8 HOUR)>=12 THEN 1 ELSE 0 END AS half
  FROM base),
running AS (SELECT event_id, session_id, event_ts, half, model, tool,
  {", ".join(f"CAST(sum({t}) OVER w AS BIGINT) AS {t}" for t in TOKENS)}
  FROM halves WINDOW w AS (PARTITION BY session_id, half ORDER BY event_ts, event_id)),
snapshots AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_ts, event_id, copy) AS line_no,
    '/logs/'||session_id||'.jsonl' AS path,
    CASE WHEN event_id%4=0 THEN model END AS context_model
  FROM (SELECT *, 0 AS copy FROM running UNION ALL SELECT *, 1 FROM running WHERE event_id%7=0))"""


def delta_sql(source: str, order: str = "line_no") -> str:
    """CTE ``deltas``: per-counter growth since the previous line of ``source``."""
    lag = ", ".join(
        f"greatest(0, {t} - coalesce(lag({t}) OVER w, 0)) AS d_{t}" for t in TOKENS
    )
    return f"""deltas AS (SELECT *, {lag} FROM {source}
  WINDOW w AS (PARTITION BY path ORDER BY {order}))"""


POSITIVE_DELTA = "(" + " OR ".join(f"d_{t}>0" for t in TOKENS) + ")"
POSITIVE = "(" + " OR ".join(f"{t}>0" for t in TOKENS) + ")"

TEAM_SESSION = ("team_id", "user_id", "device_id", "session_id")
LOCAL_SESSION = ("session_id",)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def names(*groups) -> str:
    return ", ".join(dict.fromkeys(c for g in groups for c in g))


def share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole}=0 THEN 0.0::DOUBLE ELSE {part}::DOUBLE/{whole}::DOUBLE END"


def rate(delta: str, previous: str) -> str:
    return (
        f"CASE WHEN {previous}=0 THEN CASE WHEN {delta}=0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END "
        f"ELSE {delta}::DOUBLE/{previous}::DOUBLE END"
    )


def rollup(keys, session, source="u", more="", name="r") -> str:
    """CTEs ending in ``name``: every metric per ``keys``."""
    call = names(session, ("tool", "model", "event_ts"), TOKENS)
    group = f"GROUP BY {names(keys)}" if keys else ""
    lead = f"{names(keys)}, " if keys else ""
    sums = ", ".join(f"coalesce(sum({t}),0)::BIGINT AS {t}" for t in TOKENS)
    team = ", count(DISTINCT user_id) AS users, count(DISTINCT device_id) AS devices"
    return f"""{name}_gaps AS (SELECT *, sec - lag(sec) OVER (PARTITION BY {names(keys, session)} ORDER BY event_ts) AS gap
  FROM (SELECT *, floor(epoch(event_ts))::BIGINT AS sec FROM {source})),
{name}_sums AS (SELECT {lead}{sums},
    coalesce(sum(greatest(0, input_tokens-cached_input_tokens)),0)::BIGINT AS net_input_tokens,
    count(*) AS usage_event_count, count(DISTINCT ({call})) AS call_count,
    count(DISTINCT ({names(session)}{", ''" if len(session) == 1 else ""})) AS sessions,
    coalesce(sum(gap) FILTER (gap<=1800),0)::BIGINT AS active_seconds,
    min(event_ts) AS started_at, max(event_ts) AS ended_at{team if len(session) > 1 else ""}{more}
  FROM {name}_gaps {group}),
{name} AS (SELECT *, net_input_tokens+output_tokens+reasoning_output_tokens AS net_total_tokens,
    least(1.0::DOUBLE, {share("cached_input_tokens", "input_tokens")}) AS cache_hit_rate,
    {share("reasoning_output_tokens", "output_tokens")} AS reasoning_ratio,
    {share("total_tokens", "sessions")} AS avg_tokens_per_session,
    {share("total_tokens", "call_count")} AS avg_tokens_per_call
  FROM {name}_sums)"""


LONGS = (
    *TOKENS,
    "net_input_tokens",
    "net_total_tokens",
    "usage_event_count",
    "call_count",
    "sessions",
    "active_seconds",
)
DOUBLES = ("cache_hit_rate", "reasoning_ratio", "avg_tokens_per_session", "avg_tokens_per_call")


def filled(alias: str, more=()) -> str:
    longs = [f"coalesce({alias}.{c},0)::BIGINT AS {c}" for c in (*LONGS, *more)]
    doubles = [f"coalesce({alias}.{c},0.0)::DOUBLE AS {c}" for c in DOUBLES]
    return ", ".join(longs + doubles)


def histogram_text(dimension: str, keys=(), source="u") -> str:
    """Select of keys and 'value:count' text of one dimension."""
    lead = f"{names(keys)}, " if keys else ""
    group = f"GROUP BY {names(keys)}" if keys else ""
    return f"""SELECT {lead}string_agg(value||':'||n, ',' ORDER BY value) AS {dimension} FROM (
    SELECT {lead}CASE WHEN trim({dimension})='' THEN 'unknown' ELSE {dimension} END AS value, count(*) AS n
    FROM {source} GROUP BY ALL) {group}"""


def values_text(column: str, name: str, keys) -> str:
    return (
        f"SELECT {names(keys)}, string_agg(DISTINCT {column}, ',' ORDER BY {column}) AS {name} "
        f"FROM u GROUP BY {names(keys)}"
    )


def first_device(keys, source="u") -> str:
    """CTE ``fd``: the device of the session that started first, per keys."""
    return f"""fd AS (SELECT {names(keys)}, first(device_id ORDER BY started, device_id) AS first_device FROM (
    SELECT {names(keys, TEAM_SESSION)}, min(event_ts) AS started FROM {source} GROUP BY ALL)
  GROUP BY {names(keys)})"""


WEEK = {
    "current": ("2024-01-15", "2024-01-17"),
    "previous": ("2024-01-08", "2024-01-10"),
}
MONTH_PAIR = {
    "current": ("2024-01-01", "2024-01-17"),
    "previous": ("2023-12-01", "2023-12-17"),
}


def periods(pair, source="base") -> str:
    """CTE ``p``: usage of both periods, each row tagged."""
    tests = " ".join(
        f"WHEN local_date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, (a, b) in pair.items()
    )
    return f"""p AS (SELECT * FROM (SELECT *, CASE {tests} END AS period FROM {source} WHERE tool<>'other')
  WHERE period IS NOT NULL)"""


def compare_summary(session, source_cte=None, pair=WEEK, labels=("This Week", "Previous Week")) -> str:
    source = "moved" if source_cte else "base"
    team = len(session) > 1
    metrics = ["total_tokens", "usage_event_count", "call_count", "sessions"] + (
        ["users", "devices"] if team else []
    )
    (c0, c1), (p0, p1) = pair["current"], pair["previous"]
    return (
        with_(BASE, *([source_cte] if source_cte else []), periods(pair, source), rollup(("period",), session, "p"))
        + f"""SELECT l.*, {", ".join(f"coalesce(r.{m},0)::BIGINT AS {m}" for m in metrics)}
FROM (VALUES ('current','{labels[0]}',DATE '{c0}',DATE '{c1}'),
             ('previous','{labels[1]}',DATE '{p0}',DATE '{p1}')) l(period,label,start_date,end_date)
LEFT JOIN r USING (period)"""
    )


def compare_delta(session) -> str:
    team = len(session) > 1
    metrics = ["usage_event_count", "call_count", "sessions"] + (["users", "devices"] if team else [])
    diff = lambda m: f"(c.{m}-b.{m})"
    return (
        with_(BASE, periods(WEEK), rollup(("period",), session, "p"))
        + f"""SELECT {diff("total_tokens")} AS total_tokens,
  {rate(diff("total_tokens"), "b.total_tokens")} AS total_tokens_rate,
  {", ".join(f"{diff(m)} AS {m}" for m in metrics)}
FROM (SELECT * FROM r WHERE period='current') c, (SELECT * FROM r WHERE period='previous') b"""
    )


def compare_daily(source_cte=None, pair=WEEK, days=3) -> str:
    source = "moved" if source_cte else "base"
    c0, p0 = pair["current"][0], pair["previous"][0]
    return (
        with_(BASE, *([source_cte] if source_cte else []), periods(pair, source))
        + f"""SELECT day_index, strftime("current_date",'%a') AS label, "current_date", previous_date,
  c AS current_total_tokens, b AS previous_total_tokens, c-b AS delta_total_tokens,
  {rate("(c-b)", "b")} AS delta_total_tokens_rate
FROM (SELECT i AS day_index, DATE '{c0}'+i::INT AS "current_date", DATE '{p0}'+i::INT AS previous_date,
    coalesce((SELECT sum(total_tokens) FROM p WHERE period='current' AND local_date=DATE '{c0}'+i::INT),0)::BIGINT AS c,
    coalesce((SELECT sum(total_tokens) FROM p WHERE period='previous' AND local_date=DATE '{p0}'+i::INT),0)::BIGINT AS b
  FROM range({days}) t(i))"""
    )


def compare_by(keys, more_select="", more_ctes=(), joins="") -> str:
    return (
        with_(
            BASE,
            periods(WEEK),
            f"""d AS (SELECT {names(keys)}, c AS current_total_tokens, b AS previous_total_tokens,
    c-b AS delta_total_tokens, {rate("(c-b)", "b")} AS delta_total_tokens_rate FROM (
    SELECT {names(keys)}, coalesce(sum(total_tokens) FILTER (period='current'),0)::BIGINT AS c,
      coalesce(sum(total_tokens) FILTER (period='previous'),0)::BIGINT AS b FROM p GROUP BY {names(keys)})
  ORDER BY abs(c-b) DESC, {names(keys)} LIMIT 8)""",
            *more_ctes,
        )
        + f"SELECT d.*{more_select} FROM d {joins}"
    )
