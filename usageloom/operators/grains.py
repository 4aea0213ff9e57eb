"""Many bucketings of one range from one scan and one shuffle.

A report has a summary, days, models, tools, sessions and comparisons: the same
events in different buckets. ``Grains`` scans the events once, into one row per
distinct call (``base``). Each row is then dealt to all sections it takes part
in, as one row per section with that section's keys, and all sections go through
the stages of the metric layer together: the section is a column of the keys.
Values to list or count per bucket (``facets``) come from the base the same way.

Rows are dealt where they shuffle no more. Calls become half hours of sessions at
the finest keys of all sections, and those are shuffled once by session. A bucket
of a session then lies in one task whatever its keys, so half hours are dealt to
the different *cuts* of a session (sections that differ in session columns alone
share one) and summed to sessions without another shuffle. Sessions are dealt to
sections last, and summed per section and key on the map side.

A report run passes a ``keep`` that stages the base, the rollups and the facets;
the two results are written in one folder per section, so a section reads its
own rows only. Without ``keep`` everything is one plan, in which both results
start from the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usageloom.functions.texts import or_unknown
from usageloom.model import Scope
from usageloom.operators.rollup import ADDED, SLOT, half_hours, session_grain, with_ratios

Keep = Callable[..., DataFrame]
#: How the session is chosen that names a bucket: the least or greatest of an instant.
ENDS = {"first": ("min", "started_at"), "last": ("max", "ended_at")}
#: Values in one map of a report; values beyond are given as rows.
MAP_VALUES = 1000


@dataclass(frozen=True)
class Section:
    """One bucketing: its keys, the condition on base rows, and what is counted per bucket."""

    name: str
    keys: tuple[str, ...] = ()
    where: str = "true"
    facets: tuple[str, ...] = ()


def _unstaged(df: DataFrame, purpose: str, by: str | None = None) -> DataFrame:
    return df


def _names(*groups: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(name for group in groups for name in group))


@dataclass(frozen=True)
class Grains:
    """Rollups and facets of several sections of the same events.

    ``flags`` are columns that conditions of sections read; ``also`` names
    session columns whose value every bucket gets from one of its sessions, the
    one that started first or ended last; ties go by the value.
    """

    events: DataFrame
    scope: Scope
    sections: tuple[Section, ...]
    flags: tuple[str, ...] = ()
    also: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    keep: Keep = _unstaged
    _made: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    @staticmethod
    def of_calls(calls: DataFrame, scope: Scope, sections: tuple[Section, ...]) -> Grains:
        """From a table that is at call grain already, with ``usage_event_count``."""
        return Grains(calls, scope, sections, _made={"base": calls})

    def _once(self, name: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.keep(make(), name, by)
        return self._made[name]

    @property
    def base(self) -> DataFrame:
        """Calls by everything that any section asks for, with the number of their events."""
        dimensions = _names(*[s.facets for s in self.sections])
        columns = _names(self.scope.call, *[s.keys for s in self.sections], self.flags, dimensions)
        return self._once("base", lambda: self.events.groupBy(*columns).agg(F.expr("count(*) AS usage_event_count")))

    @property
    def _single(self) -> bool:
        """One section that all rows take part in is grouped by its own columns; nothing is dealt."""
        return len(self.sections) == 1 and self.sections[0].where == "true"

    def _key(self, name: str) -> str:
        return name if self._single else f"_key_{name}"

    def _group(self, keys: Sequence[str]) -> list[str]:
        return list(keys) if self._single else ["section", *map(self._key, keys)]

    def _of(self, rows: DataFrame, name: str) -> DataFrame:
        return rows if self._single else rows.where(F.col("section") == name)

    def _dealt(self, rows: DataFrame, sections: Sequence[Section], values: bool) -> DataFrame:
        """One row per row and section it takes part in, with the keys of that section."""
        if self._single:
            return self._with_values(rows) if values else rows
        keys = _names(*[s.keys for s in sections])
        types = {f.name: f.dataType for f in rows.schema.fields}
        shares = []
        for s in sections:
            own = [(F.col(k) if k in s.keys else F.lit(None).cast(types[k])).alias(self._key(k)) for k in keys]
            for dimension in s.facets if values else (None,):
                facet = [] if dimension is None else [
                    F.lit(dimension).alias("dimension"), or_unknown(F.col(dimension)).alias("value"), F.col(dimension).alias("raw"),
                ]
                shares.append(F.when(F.expr(s.where), F.struct(F.lit(s.name).alias("section"), *own, *facet)))
        return rows.select("*", F.inline(F.filter(F.array(*shares), lambda x: x.isNotNull())))

    def _with_values(self, rows: DataFrame) -> DataFrame:
        """One row per row and dimension of the only section."""
        shares = [
            F.struct(F.lit(c).alias("dimension"), or_unknown(F.col(c)).alias("value"), F.col(c).alias("raw"))
            for c in self.sections[0].facets
        ]
        return rows.select("*", F.inline(F.array(*shares)))

    @property
    def rollups(self) -> DataFrame:
        """Sums of every bucket of every section."""
        return self._once("rollups", self._rollups, None if self._single else "section")

    def _rollups(self) -> DataFrame:
        keys = _names(*[s.keys for s in self.sections])
        calls = self.base
        columns = _names(self.scope.call, keys, self.flags)
        if set(calls.columns) > {*columns, "usage_event_count"}:
            # Facets split calls further; here a call is one row again.
            if not self._single:
                # One shuffle by session and half hour serves calls and half hours.
                calls = calls.withColumn("_slot", F.expr(SLOT))
                calls = calls.repartition(*_names(self.scope.session, keys, self.flags, ["_slot"]))
                columns.append("_slot")
            calls = calls.groupBy(*columns).agg(F.expr("sum(usage_event_count) AS usage_event_count"))
        if not self._single:
            return self._summed(self._shared_sessions(calls, keys), keys)
        sessions = session_grain(half_hours(calls, keys, self.scope), keys, self.scope)
        return sessions.groupBy(*keys).agg(
            *[F.expr(f"coalesce(sum(_{c}), 0L) AS {c}") for c in ADDED],
            F.expr("count(*) AS sessions"),
            F.expr("coalesce(sum(_active), 0L) AS active_seconds"),
            F.expr("min(started_at) AS started_at"),
            F.expr("max(ended_at) AS ended_at"),
            *[F.count_distinct(c).alias(name) for c, name in self.scope.counted],
            *[F.expr(f"{ENDS[end][0]}_by({c}, struct({ENDS[end][1]}, {c})) AS {name}") for name, (end, c) in self.also.items()],
        )

    def _cut(self, section: Section) -> tuple[str, tuple[str, ...]]:
        """What a section cuts sessions by: its condition, and its keys that are no session columns."""
        return section.where, tuple(k for k in section.keys if k not in self.scope.session)

    @property
    def _cuts(self) -> list[tuple[str, tuple[str, ...]]]:
        return list(dict.fromkeys(map(self._cut, self.sections)))

    def _shared_sessions(self, calls: DataFrame, keys: Sequence[str]) -> DataFrame:
        """One row per session of every cut, its keys as ``_cut_…``; sections that share a cut share its rows.

        Half hours are summed before they are shuffled by session, so a hot session
        still costs one task its half hours, not its events. The number of
        partitions is stated: rows multiply after this shuffle, so its size must not
        decide how many of them one task takes.
        """
        session = [*self.scope.session, "_place"]
        own = [k for k in keys if k not in session]
        slots = half_hours(calls, _names(own, self.flags), self.scope)
        parts = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        types = {f.name: f.dataType for f in slots.schema.fields}
        shares = []
        for place, (where, cut) in enumerate(self._cuts):
            by = [(F.col(k) if k in cut else F.lit(None).cast(types[k])).alias(f"_cut_{k}") for k in own]
            shares.append(F.when(F.expr(where), F.struct(F.lit(place).alias("_cut"), *by)))
        summed = [f"_{c}" for c in ADDED]
        dealt = slots.withColumn("_place", self._place(keys, parts)).repartition(parts, "_place").select(
            *session, "_slot", *summed, "started_at", "ended_at",
            F.inline(F.filter(F.array(*shares), lambda x: x.isNotNull())),
        )
        group = ["_cut", *[f"_cut_{k}" for k in own]]
        whole = dealt.groupBy(*group, *session, "_slot").agg(
            *[F.expr(f"sum({c}) AS {c}") for c in summed],
            F.expr("min(started_at) AS started_at"),
            F.expr("max(ended_at) AS ended_at"),
        )
        return session_grain(whole, [*group, "_place"], self.scope)

    def _place(self, keys: Sequence[str], parts: int) -> Column:
        """Where a session is summed: beside others of its device and user, so that their buckets meet before the next shuffle.

        Those with more calls than a partition has on average are spread by session;
        there are fewer of them than partitions. Their calls are counted on the staged base.
        """
        session = self.scope.session
        near, alone = [c for c in session if c in keys], F.xxhash64(*session)
        if self.keep is _unstaged or len(near) in (0, len(session)):
            return alone
        beside, most = F.xxhash64(*near), self.base.count() // parts
        heavy = self.base.groupBy(beside.alias("_near")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()
        return F.when(beside.isin([r._near for r in heavy]), alone).otherwise(beside)

    def _told(self, section: Section) -> list[str]:
        """Columns whose values a bucket counts or is named by, but for its keys, which it has once."""
        told = _names([c for c, _ in self.scope.counted], [c for _, c in self.also.values()])
        return [c for c in told if c not in section.keys]

    def _dealt_sessions(self, sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Rows of sessions per section: sums, and the values of the told columns as (``_of``, ``_who``).

        A section that has one such column has it in the rows with the sums. With
        more of them each has rows of its own, which are not ``_whole``: they count
        in no sum.
        """
        types = {f.name: f.dataType for f in sessions.schema.fields}
        at = lambda k: k if k in self.scope.session else f"_cut_{k}"
        nobody = (F.lit(None).cast("string"), F.lit(None).cast("string"), True)
        rows = F.lit(None)
        for place, cut in enumerate(self._cuts):
            shares = []
            for s in (s for s in self.sections if self._cut(s) == cut):
                own = [(F.col(at(k)) if k in s.keys else F.lit(None).cast(types[at(k)])).alias(self._key(k)) for k in keys]
                told = [(F.lit(c), F.col(c), len(self._told(s)) == 1) for c in self._told(s)]
                for of, who, whole in told if len(told) == 1 else [nobody, *told]:
                    shares.append(F.struct(F.lit(s.name).alias("section"), *own, of.alias("_of"), who.alias("_who"), F.lit(whole).alias("_whole")))
            rows = F.when(F.col("_cut") == place, F.array(*shares)).otherwise(rows)
        return sessions.select(*[f"_{c}" for c in ADDED], "_active", "started_at", "ended_at", F.inline(rows))

    def _summed(self, sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Sums of every bucket, first per told value, then over them: a value counts once."""
        group = self._group(keys)
        rows = self._dealt_sessions(sessions, keys)
        added = {**{f"_{c}": c for c in ADDED}, "_sessions": "sessions", "_active": "active_seconds"}
        parts = rows.withColumn("_sessions", F.lit(1).cast("bigint"))
        told = _names(*map(self._told, self.sections))
        if told:
            parts = parts.groupBy(*group, "_of", "_who").agg(
                *[F.expr(f"sum(CASE WHEN _whole THEN {c} END) AS {c}") for c in added],
                F.expr("min(started_at) AS started_at"),
                F.expr("max(ended_at) AS ended_at"),
            )
        sums = parts.groupBy(*group).agg(
            *[F.expr(f"coalesce(sum({c}), 0L) AS {name}") for c, name in added.items()],
            F.expr("min(started_at) AS started_at"),
            F.expr("max(ended_at) AS ended_at"),
            *[F.expr(f"count_if(_of = '{c}' AND _who IS NOT NULL) AS {name}") for c, name in self.scope.counted],
            *[
                F.expr(f"{ENDS[end][0]}(CASE WHEN _of = '{c}' THEN struct({ENDS[end][1]}, _who) END)._who AS {name}")
                for name, (end, c) in self.also.items()
            ],
        )
        keyed = lambda c: F.col("section").isin([s.name for s in self.sections if c in s.keys])
        once = {name: F.col(self._key(c)).isNotNull().cast("bigint") for c, name in self.scope.counted if c in keys}
        same = {name: F.col(self._key(c)) for name, (_, c) in self.also.items() if c in keys}
        of = {**{name: c for c, name in self.scope.counted}, **{name: c for name, (_, c) in self.also.items()}}
        return sums.withColumns({name: F.when(keyed(of[name]), value).otherwise(F.col(name)) for name, value in {**once, **same}.items()})

    @property
    def facets(self) -> DataFrame:
        """(section, keys, dimension, value, raw, n) of every counted value."""
        return self._once("facets", self._facets, None if self._single else "section")

    def _facets(self) -> DataFrame:
        counted = [s for s in self.sections if s.facets]
        keys = _names(*[s.keys for s in counted])
        group = [*self._group(keys), "dimension", "value", "raw"]
        return self._dealt(self.base, counted, True).groupBy(*group).agg(F.expr("sum(usage_event_count) AS n"))

    def section(self, name: str) -> Section:
        return next(s for s in self.sections if s.name == name)

    def rollup(self, name: str) -> DataFrame:
        """All metrics per bucket of a section; a section without keys always has its one row."""
        section = self.section(name)
        counted = [n for _, n in self.scope.counted]
        own = self._of(self.rollups, name)
        if section.keys:
            rows = own.withColumnsRenamed({self._key(k): k for k in section.keys})
        else:
            zero = (*ADDED, "sessions", "active_seconds", *counted)
            rows = own.agg(
                *[F.coalesce(F.max(c), F.lit(0).cast("bigint")).alias(c) for c in zero],
                *[F.max(c).alias(c) for c in ("started_at", "ended_at", *self.also)],
            )
        return with_ratios(rows, list(section.keys), counted, list(self.also))

    def with_values(self, name: str, values: DataFrame) -> DataFrame:
        """A section's rollup with values per bucket; a bucket whose key is null has values as well."""
        keys = self.section(name).keys
        own = values.withColumnsRenamed({k: f"_of_{k}" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        return self.rollup(name).join(own, same, "left").drop(*[f"_of_{k}" for k in keys])

    def _facet_rows(self, name: str) -> DataFrame:
        keys = self.section(name).keys
        return self._of(self.facets, name).withColumnsRenamed({self._key(k): k for k in keys})

    def value_counts(self, name: str, dimensions: Sequence[str]) -> DataFrame:
        """(keys, dimension, value, n) of a section; blank values are unknown."""
        rows = self._facet_rows(name).where(F.col("dimension").isin(*dimensions))
        return rows.groupBy(*self.section(name).keys, "dimension", "value").agg(F.expr("sum(n) AS n"))

    def _heavy(self, name: str, dimensions: Sequence[str], most: int) -> DataFrame:
        """The ``most`` heaviest values per bucket and dimension, with their place; ties go by value.

        The limit on the place is applied in every task before the shuffle, so a
        bucket of a million values sends a few rows from each.
        """
        order = Window.partitionBy(*self.section(name).keys, "dimension").orderBy(F.desc("n"), F.asc("value"))
        return self.value_counts(name, dimensions).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most)

    def value_maps(self, name: str, dimensions: Sequence[str], most: int = MAP_VALUES) -> DataFrame:
        """One sorted map of value to count per bucket and dimension; blank values are unknown.

        A map holds the ``most`` heaviest values with their exact counts;
        ``values_beyond`` gives all others as rows.
        """
        return self._heavy(name, dimensions, most).groupBy(*self.section(name).keys).agg(
            *[
                F.expr(f"map_from_entries(sort_array(collect_list(CASE WHEN dimension = '{c}' THEN struct(value, n) END))) AS {c}")
                for c in dimensions
            ]
        )

    def values_beyond(self, name: str, dimensions: Sequence[str], most: int = MAP_VALUES) -> DataFrame:
        """(keys, dimension, value, n) of the values that the maps have no room for; none where all fit."""
        keys = [*self.section(name).keys, "dimension"]
        last = self._heavy(name, dimensions, most).where(F.col("_place") == most).drop("_place")
        last = last.withColumnsRenamed({c: f"_last_{c}" for c in last.columns})
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_last_{k}"))
        after = (F.col("n") < F.col("_last_n")) | ((F.col("n") == F.col("_last_n")) & (F.col("value") > F.col("_last_value")))
        rows = self.value_counts(name, dimensions)
        return rows.join(last, same).where(after).select(*rows.columns)

    def value_lists(self, name: str, lists: Mapping[str, str]) -> DataFrame:
        """One sorted array of distinct values per bucket; ``lists`` maps a dimension to a column name.

        Every value has n > 0. Naming it keeps the count in the plan, and so the
        exchange the same as that of the rollups.
        """
        return self._facet_rows(name).groupBy(*self.section(name).keys).agg(
            *[
                F.expr(f"sort_array(collect_set(CASE WHEN dimension = '{c}' AND n > 0 THEN raw END)) AS {alias}")
                for c, alias in lists.items()
            ]
        )
