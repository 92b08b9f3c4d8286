"""Backoff schedules and cron schedules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clock_diff(unit: str, start: Column, end: Column) -> Column:
    """Ticks of the clock's `unit` (SECOND, MILLISECOND) from start to end, as date_diff of SQL counts them.

    Both times are cut to the unit first: from 10.9 s to 12.0 s are two ticks, though 1.1 s have passed.
    """
    return F.timestamp_diff(unit, F.date_trunc(unit, start), F.date_trunc(unit, end))


# --------------------------------------------------------------------------- backoff
def activity_backoff(attempt: Column, base_secs: int, strategy: str = "exponential", cap: int = 60) -> Column:
    """Seconds before the next attempt; constant, or base * 2^attempt up to the cap.  A shift of 64 or more saturates."""
    if strategy == "constant":
        return F.lit(base_secs).cast("long") + attempt.cast("long") * 0
    power = F.pow(F.lit(2.0), F.least(attempt, F.lit(62)).cast("double"))
    return F.least(F.lit(float(base_secs)) * power, F.lit(float(cap))).cast("long")


def crash_backoff(crashes: Column, initial_ms: int = 500, cap_ms: int = 10_000) -> Column:
    """Milliseconds before an entity is respawned after its n-th crash in a row: initial * 1.5^(n-1), capped, whole."""
    return F.least(F.lit(float(initial_ms)) * F.pow(F.lit(1.5), F.greatest(crashes - 1, F.lit(0)).cast("double")), F.lit(float(cap_ms))).cast("long")


def singleton_backoff(crashes: Column, base_ms: int = 1000, most: int = 10) -> Column:
    return (F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.least(F.greatest(crashes - 1, F.lit(0)), F.lit(most)).cast("double"))).cast("long")


def swap_backoff(attempt: Column, most: int = 6, cap_ms: int = 100) -> Column:
    """Milliseconds before a compare-and-set is tried again."""
    return F.least(F.pow(F.lit(2.0), F.least(attempt, F.lit(most)).cast("double")), F.lit(float(cap_ms))).cast("long")


# --------------------------------------------------------------------------- cron
#: The fields of a schedule with their ranges.
FIELDS = [("second", 0, 59), ("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 1, 7), ("year", 1970, 2100)]
MONTHS = {m: k for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
#: Days of the week count from Sunday as 1.
DAYS = {d: k for k, d in enumerate("sun mon tue wed thu fri sat".split(), 1)}


def field_values(text: str, low: int, high: int, names: dict[str, int]) -> frozenset[int]:
    """The values of one field: lists of *, values, ranges, and steps."""

    def number(s: str) -> int:
        n = names[s[:3].lower()] if s[:1].isalpha() else int(s)
        if not low <= n <= high:
            raise ValueError(f"{s} is not between {low} and {high}")
        return n

    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span in ("*", "?"):
            a, b = low, high
        elif "-" in span:
            a, b = map(number, span.split("-", 1))
        else:
            a = number(span)
            b = high if step else a
        if a > b or (step and int(step) < 1):
            raise ValueError(f"{part} is empty")
        out.update(range(a, b + 1, int(step or 1)))
    return frozenset(out)


@dataclass(frozen=True)
class Schedule:
    """A parsed cron expression: seconds, minutes, hours, days, months, days of the week and, if given, years."""

    fields: tuple[frozenset[int], ...]

    @classmethod
    def parse(cls, text: str) -> Schedule:
        parts = text.split()
        if len(parts) not in (6, 7):
            raise ValueError("a schedule has 6 or 7 fields")
        names = {"month": MONTHS, "weekday": DAYS}
        return cls(tuple(field_values(p, a, b, names.get(f, {})) for p, (f, a, b) in zip([*parts, "*"], FIELDS)))

    def days(self, spark: SparkSession, start: str, end: str) -> DataFrame:
        """(day) of the dates in [start, end] that the schedule's date fields allow."""
        _, _, _, day, month, weekday, year = self.fields
        dates = spark.sql("select explode(sequence(to_date(:a), to_date(:b), interval 1 day)) as day", args={"a": start, "b": end})
        ok = F.dayofmonth("day").isin(*day) & F.month("day").isin(*month) & F.dayofweek("day").isin(*weekday) & F.year("day").isin(*year)
        return dates.filter(ok)

    def occurrences(self, spark: SparkSession, start: str, end: str) -> DataFrame:
        """(at) of all instants in (start, end]: the allowed dates times the allowed times of day, which is bounded."""
        second, minute, hour, *_ = self.fields
        times = [F.array(*map(F.lit, sorted(x))) for x in (hour, minute, second)]
        out = self.days(spark, start[:10], end[:10])
        for name, values in zip(("h", "m", "s"), times):
            out = out.withColumn(name, F.explode(values))
        at = F.expr("make_timestamp_ntz(year(day), month(day), day(day), h, m, s)")
        return out.select(at.alias("at")).filter((F.col("at") > F.lit(start).cast("timestamp_ntz")) & (F.col("at") <= F.lit(end).cast("timestamp_ntz")))


def next_after(references: DataFrame, schedule: Schedule, column: str, horizon_days: int = 366) -> DataFrame:
    """`references` with column next_at: the first occurrence strictly after `column`, null if none within the horizon.

    Occurrences by day are few, so each reference looks at its own day and then at the first allowed day after
    it: the time of day is chosen by filtering the fields, and no row is multiplied by the schedule.
    """
    second, minute, hour, day, month, weekday, year = schedule.fields
    arr = lambda v: F.array(*(F.lit(x) for x in sorted(v)))
    ref, date = F.col(column), F.to_date(F.col(column))
    allowed = lambda d: F.array_contains(arr(day), F.dayofmonth(d)) & F.array_contains(arr(month), F.month(d)) & F.array_contains(arr(weekday), F.dayofweek(d)) & F.array_contains(arr(year), F.year(d))
    first = min(hour) * 3600 + min(minute) * 60 + min(second)
    # the least second of the day after `now`: same hour and minute, else same hour, else a later hour
    least = lambda a, bound: F.array_min(F.filter(arr(a), lambda x: x > bound))
    in_hour, in_minute = F.array_contains(arr(hour), F.hour(ref)), F.array_contains(arr(minute), F.minute(ref))
    same_minute = F.when(in_hour & in_minute, F.hour(ref) * 3600 + F.minute(ref) * 60 + least(second, F.second(ref)))
    same_hour = F.when(in_hour, F.hour(ref) * 3600 + least(minute, F.minute(ref)) * 60 + min(second))
    later = least(hour, F.hour(ref)) * 3600 + min(minute) * 60 + min(second)
    today = F.when(allowed(date), F.coalesce(same_minute, same_hour, later))
    following = F.try_element_at(F.filter(F.sequence(F.date_add(date, 1), F.date_add(date, horizon_days)), allowed), F.lit(1))
    at = lambda d, s: F.timestamp_add("SECOND", s, d.cast("timestamp_ntz"))
    return references.withColumn("next_at", F.coalesce(F.when(today.isNotNull(), at(date, today)), at(following, F.lit(first))))


def cron_verdict(age_seconds: Column, skip_seconds: int) -> Column:
    """skip when the scheduled time is older than the threshold, strictly; else run."""
    return F.when(age_seconds > skip_seconds, "skip").otherwise("run")
