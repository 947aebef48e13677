"""Instants held as text in several notations, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = r"^[+-]?\d{1,12}$"
DATED = r"^\d{4}-\d{2}-\d{2}"
COMPACT = r"^\d{14}$"
HAS_OFFSET = r"(?i)(z|[+-]\d{2}:?\d{2}|[+-]\d{2})$"
TIME_PART = r"\d[T ]\d{2}:\d{2}"


def instant_micros(text: Column) -> Column:
    """Microseconds since the epoch of a textual instant, NULL if it names none.

    Accepts whole epoch seconds, ISO-8601 with ``T`` or a blank, with or without a
    fraction, with ``Z``, any offset or none (then UTC), and 14 compact digits.
    The session time zone plays no part.
    """
    t = F.trim(text)
    timed = t.rlike(TIME_PART)
    zoned = F.when(timed & ~F.substring(t, 11, 40).rlike(HAS_OFFSET), F.concat(t, F.lit("Z"))).when(~timed, F.concat(t, F.lit("T00:00:00Z"))).otherwise(t)
    compact = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3T$4:$5:$6Z")
    return (
        F.when(t.rlike(EPOCH), t.try_cast("bigint") * F.lit(1_000_000))
        .when(t.rlike(COMPACT), F.unix_micros(compact.try_cast("timestamp")))
        .when(t.rlike(DATED), F.unix_micros(zoned.try_cast("timestamp")))
    )


def instant_sql(x: str) -> str:
    """The same for DuckDB, for the result checks."""
    return (
        f"(case when regexp_matches(trim({x}), '^[+-]?[0-9]{{1,12}}$') then cast(trim({x}) as bigint) * 1000000 "
        f"when regexp_matches(substr(trim({x}), 11), '(Z|z|[+-][0-9]{{2}}(:?[0-9]{{2}})?)$') then epoch_us(try_cast(trim({x}) as timestamptz)) "
        f"else epoch_us(try_cast(trim({x}) || '+00' as timestamptz)) end)"
    )
