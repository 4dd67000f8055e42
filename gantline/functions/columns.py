"""Column expressions of feed data: clock times past midnight, time bands, weekday labels, distances."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER = "other"
EARTH_M = 6_371_000.0
#: Day types in the order of reports. Types by weekday stand with daily, Monday first.
DAY_ORDER = ["weekday", "saturday", "sunday_holiday", "weekend", "daily", "irregular", "inactive"]


def clock_seconds(text: Column) -> Column:
    """H:MM[:SS] as seconds after midnight, past 24 h too; null where it can't be read."""
    parts = F.split(F.trim(text), ":")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    seconds = F.when(F.size(parts) > 2, number(2)).otherwise(F.lit(0))
    return F.when(F.size(parts) >= 2, number(0) * 3600 + number(1) * 60 + seconds)


def _seconds(text: str) -> int:
    h, m = map(int, text.split(":"))
    return h * 3600 + m * 60


def time_band(seconds: Column, bands: list[str]) -> Column:
    """The first band that holds the time, or that holds it a day later; else "other"."""
    out = F.lit(None).cast("string")
    spans = [(b, *map(_seconds, b.split("-"))) for b in bands]
    for shift in (86_400, 0):
        for label, lo, hi in reversed(spans):
            out = F.when((seconds + shift >= lo) & (seconds + shift < hi), label).otherwise(out)
    return F.coalesce(out, F.lit(OTHER))


def weekday_label(flags: list[Column]) -> Column:
    """The label of seven booleans, Monday first."""
    week, sat, sun = flags[:5], flags[5], flags[6]
    every, some = functools.reduce(Column.__and__, week), functools.reduce(Column.__or__, week)
    bits = F.concat(F.lit("dow_"), *[F.when(f, "1").otherwise("0") for f in flags])
    return (
        F.when(every & ~sat & ~sun, "weekday").when(every & sat & sun, "daily")
        .when(~some & sat & sun, "weekend").when(~some & sat, "saturday").when(~some & sun, "sunday_holiday").otherwise(bits)
    )


def ymd(text: Column) -> Column:
    """YYYYMMDD as a date, null where it is none."""
    return F.try_to_date(F.trim(text), "yyyyMMdd")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points given in degrees."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def day_order(day_type: Column) -> Column:
    """A value to sort day types by; a number after @ tells several timetables of one type apart."""
    base, number = F.split(day_type, "@")[0], F.coalesce(F.get(F.split(day_type, "@"), F.lit(1)).try_cast("int"), F.lit(0))
    by_weekday = base.startswith("dow_")
    place = F.array_position(F.array(*map(F.lit, DAY_ORDER)), base) - 1
    rank = F.when(by_weekday, DAY_ORDER.index("daily")).when(place >= 0, place).otherwise(len(DAY_ORDER))
    name = F.when(by_weekday, F.translate(base, "01", "10")).when(place >= 0, "").otherwise(base)
    return F.struct(rank.cast("int").alias("rank"), by_weekday.cast("int").alias("by_weekday"), name.alias("name"), number.alias("number"))
