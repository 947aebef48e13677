"""Rows about running: counters, cooldowns, preflight checks, phase outcomes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The phases in their order, and what privacy is looked at.
PHASES = ["channel", "history", "graph", "web", "media"]
NEEDS_CHANNEL = {"history", "graph", "media", "web"}


def cooldowns(log: DataFrame, now: Column) -> DataFrame:
    """Seconds still to wait per method: of its latest entry, none if that is past."""
    return log.groupBy("method").agg(F.max("until").alias("until")).withColumn("remaining", F.greatest(F.lit(0), F.col("until") - now))


def merged_counts(counts: DataFrame) -> DataFrame:
    """Counters summed by name."""
    return counts.groupBy("name").agg(F.sum("n").alias("n"))


def blocked(checks: DataFrame) -> DataFrame:
    """Whether any failing check fails: per profile, from (profile, severity, ok)."""
    return checks.groupBy("profile").agg(F.bool_or((F.col("severity") == "fail") & ~F.col("ok")).alias("blocked"))


PRIVACY = ["phone", "lastseen", "photo"]
OPEN_TO_ALL = "privacyvalueallowall"


def preflight(accounts: DataFrame, now: Column, least_age: float) -> DataFrame:
    """profile, name, ok, severity: seven checks of each account before anything is collected.

    accounts: profile, require_proxy, proxy, session_created (microseconds of the current
    session, NULL if there is none), has_password, username, photo, about, and for each of
    ``PRIVACY`` its rules as JSON (``phone_rules`` and so on).  No rules are open ones.
    """

    def restricted(key: str) -> Column:
        first = F.get(F.from_json(f"{key}_rules", "struct<rules:array<struct<_:string>>>")["rules"], 0)["_"]
        return first.isNotNull() & (F.lower(first) != OPEN_TO_ALL)

    def some(name: str) -> Column:
        return F.coalesce(F.length(name) > 0, F.lit(False))

    age = (now - F.col("session_created")) / F.lit(86_400_000_000)
    checks = {
        "proxy": (~F.coalesce("require_proxy", F.lit(False)) | some("proxy"), "fail"),
        "session_age": (F.coalesce(age >= least_age, F.lit(False)), "fail"),
        "two_factor_auth": (F.coalesce("has_password", F.lit(False)), "fail"),
        **{f"privacy_{key}": (restricted(key), "fail") for key in PRIVACY},
        "minimal_profile": (~some("username") & ~some("photo") & ~some("about"), "warn"),
    }
    rows = F.array(*[F.struct(F.lit(name).alias("name"), ok.alias("ok"), F.lit(severity).alias("severity")) for name, (ok, severity) in checks.items()])
    return accounts.select("profile", F.inline(rows))


def session_age_days(created: Column, now: Column) -> Column:
    """Whole days since a session began (microseconds in, days out)."""
    return F.floor((now - created) / F.lit(86_400_000_000))


def check_phases(phases: list[str]) -> list[str]:
    """The phases in running order; fails on unknown ones and on those that lack the phase they need."""
    unknown = [p for p in phases if p not in PHASES]
    if unknown:
        raise ValueError(f"unknown phases: {', '.join(unknown)}")
    lacking = sorted(NEEDS_CHANNEL & set(phases)) if "channel" not in phases else []
    if lacking:
        raise ValueError(f"{', '.join(lacking)} need the phase channel")
    return [p for p in PHASES if p in phases]


@dataclass
class Stop(Exception):
    """Raised by a phase that can't go on: ``skip``, ``phase_stop`` or ``hard_stop``."""

    kind: str
    reason: str = ""


@dataclass
class Outcome:
    phase: str
    kind: str
    counts: dict = field(default_factory=dict)
    reason: str = ""


def run_phases(phases: list[str], work: dict[str, Callable[[], dict]]) -> list[Outcome]:
    """Runs phases in order; a skip or a phase's stop lets the next one run, a hard stop ends all."""
    out = []
    for phase in check_phases(phases):
        try:
            out.append(Outcome(phase, "done", work[phase]()))
        except Stop as stop:
            out.append(Outcome(phase, stop.kind, {}, stop.reason))
            if stop.kind == "hard_stop":
                break
    return out


def run_events(spark: SparkSession, outcomes: list[Outcome], channel_id: int, at: str) -> DataFrame:
    rows = [(at, channel_id, o.phase, o.kind, o.reason) for o in outcomes]
    return spark.createDataFrame(rows, "observed_at string, channel_id bigint, phase string, kind string, reason string")


def append_events(events: DataFrame, path: str) -> None:
    """Adds the events of a run to the log, partitioned by channel."""
    events.write.mode("append").partitionBy("channel_id").parquet(path)
