"""Calendar columns. Instants are UTC wall clocks (``timestamp_ntz``); the
calendar is the market's local one. Nothing here goes through the session's time
zone, so every session gives the same hours."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from noonwatt import vocab


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def hours(n: int) -> Column:
    """An interval of whole hours."""
    return F.expr(f"INTERVAL '{int(n)}' HOUR")


def instant(text: str) -> Column:
    """A UTC instant literal, e.g. ``2024-01-31 12:00:00``."""
    return F.lit(str(text)).cast("timestamp_ntz")


def hour_start(ts: Column | str) -> Column:
    """The start of the hour, still without a zone."""
    at = _c(ts).cast("timestamp_ntz")
    return at.cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(at))


def month_start(ts: Column | str) -> Column:
    """The first instant of the month."""
    return F.trunc(_c(ts).cast("date"), "MM").cast("timestamp_ntz")


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 on the UTC wall clock."""
    at = _c(ts).cast("timestamp_ntz")
    days = F.unix_date(at.cast("date")).cast("bigint")
    return days * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)


def epoch_hours(ts: Column | str) -> Column:
    return F.floor(epoch_seconds(ts) / 3600)


def to_market(ts: Column | str, tz: str = vocab.MARKET_TZ) -> Column:
    """UTC instant -> local wall clock. Ambiguous in autumn: never a join key."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(ts))


def to_utc(local: Column | str, tz: str = vocab.MARKET_TZ) -> Column:
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), _c(local))


def market_date(ts: Column | str, tz: str = vocab.MARKET_TZ) -> Column:
    return F.to_date(to_market(ts, tz))


def day_start_utc(day: Column | str, tz: str = vocab.MARKET_TZ) -> Column:
    """The instant a local day begins."""
    return to_utc(_c(day).cast("date").cast("timestamp_ntz"), tz)


def gate(
    local: Column | str,
    tz: str = vocab.MARKET_TZ,
    hour: int = vocab.GATE_HOUR,
    lead_days: int = vocab.LEAD_DAYS,
) -> Column:
    """When the forecast for a local hour had to be issued, as a UTC instant.

    The wall clock is subtracted first and converted second, so a clock change
    between gate and target moves the horizon, not the gate.
    """
    eve = F.date_sub(F.to_date(_c(local)), lead_days).cast("timestamp_ntz")
    return to_utc(eve + hours(hour), tz)


def hours_between(start: Column | str, end: Column | str) -> Column:
    """Whole hours, cut towards zero."""
    return ((epoch_seconds(end) - epoch_seconds(start)) / 3600).cast("bigint")


def minutes_between(start: Column | str, end: Column | str) -> Column:
    return ((epoch_seconds(end) - epoch_seconds(start)) / 60).cast("bigint")


def month_key(local: Column | str) -> Column:
    """First day of the local month."""
    return F.trunc(F.to_date(_c(local)), "MM")


def hour_of_week(local: Column | str) -> Column:
    """0 is Monday 00:00, 167 is Sunday 23:00."""
    local = _c(local)
    return (F.weekday(local) * 24 + F.hour(local)).cast("bigint")


def week_bucket(day_of_year: Column | str) -> Column:
    return F.floor((_c(day_of_year) - 1) / 7).cast("bigint")


def calendar_columns(local: Column | str) -> dict[str, Column]:
    """The eight calendar features; the week starts with Sunday = 1."""
    local = _c(local)
    hour, day = F.hour(local), F.dayofyear(local)
    by_hour, by_day = hour * (2 * math.pi / 24), day * (2 * math.pi / vocab.DAYS_PER_YEAR)
    return {
        "hour_of_day": hour.cast("bigint"),
        "day_of_week": F.dayofweek(local).cast("bigint"),
        "day_of_year": day.cast("bigint"),
        "month_of_year": F.month(local).cast("bigint"),
        "hour_sin": F.sin(by_hour),
        "hour_cos": F.cos(by_hour),
        "day_of_year_sin": F.sin(by_day),
        "day_of_year_cos": F.cos(by_day),
    }


def is_weekend(local: Column | str) -> Column:
    return F.dayofweek(_c(local)).isin(1, 7)


def target_day(now: Column | str, tz: str = vocab.MARKET_TZ) -> Column:
    """The local day a forecast issued ``now`` covers: always tomorrow."""
    return F.date_add(market_date(now, tz), vocab.LEAD_DAYS)


def prices_expected(now: Column | str, tz: str = vocab.MARKET_TZ) -> Column:
    return F.hour(to_market(now, tz)) >= vocab.PRICES_PUBLISHED_HOUR


def hour_spine(day: Column | str, tz: str = vocab.MARKET_TZ) -> Column:
    """Array of the 24 UTC hours from local midnight. Always 24, also on the two
    clock-change days."""
    start = day_start_utc(day, tz)
    return F.sequence(start, start + hours(vocab.HOURS_PER_DAY - 1), F.expr("INTERVAL '1' HOUR"))


def from_epoch(seconds: Column | str) -> Column:
    at = _c(seconds)
    day = F.floor(at / 86400).cast("int")
    rest = F.make_dt_interval(secs=F.pmod(at, F.lit(86400)).cast("decimal(18,6)"))
    return instant("1970-01-01 00:00:00") + F.make_dt_interval(days=day) + rest


def from_month_label(label: Column | str) -> Column:
    """``01.2022`` -> first instant of the month."""
    return F.to_timestamp_ntz(F.concat(F.lit("01."), _c(label)), F.lit("dd.MM.yyyy"))


def from_iso(text: Column | str) -> Column:
    """ISO-8601 text, with or without seconds or a trailing Z."""
    return F.regexp_replace(_c(text), "Z$", "").cast("timestamp_ntz")
