"""Day types of services: what days of the week a service runs, from weekday flags and dated exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import weekday_label, ymd
from ..sources.feed import Feed

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def weekdays_between(lo: Column, hi: Column, weekday: int) -> Column:
    """How often a weekday (0 Monday) falls in lo..hi."""
    ahead = F.pmod(F.lit(weekday) - F.weekday(lo), F.lit(7))
    return F.greatest(F.lit(0), F.floor((F.datediff(hi, lo) - ahead) / 7) + 1).cast("long")


def label_dates(dates: DataFrame, by: list[str], day: str = "day", few: int = 10, on: float = 0.6, stray: float = 0.1, daily: float = 0.9, majority: float = 0.8) -> DataFrame:
    """(by, days, day_type): the label that a list of dates amounts to.

    ``few`` days or fewer are irregular. Else weekdays that run at least ``on`` of the time are active; if no more than ``stray`` of
    the days fall elsewhere they give the label. Else one of weekday, saturday and sunday_holiday with ``majority`` of the days does.
    """
    distinct = dates.filter(F.col(day).isNotNull()).select(*by, day).distinct()
    hits = [F.count(F.when(F.weekday(day) == i, 1)).alias(f"h{i}") for i in range(7)]
    grouped = distinct.groupBy(*by).agg(F.count("*").alias("days"), F.min(day).alias("lo"), F.max(day).alias("hi"), *hits)
    cov = [F.when(weekdays_between(F.col("lo"), F.col("hi"), i) > 0, F.col(f"h{i}") / weekdays_between(F.col("lo"), F.col("hi"), i)).otherwise(0.0) for i in range(7)]
    grouped = grouped.select(*by, "days", *[f"h{i}" for i in range(7)], *[c.alias(f"c{i}") for i, c in enumerate(cov)])
    active = [F.col(f"c{i}") >= on for i in range(7)]
    away = sum((F.when(active[i], 0).otherwise(F.col(f"h{i}")) for i in range(7)), F.lit(0)) / F.col("days")
    n_active = sum((active[i].cast("int") for i in range(7)), F.lit(0))
    told = (n_active > 0) & (away <= stray) & ~((n_active == 7) & (F.least(*[F.col(f"c{i}") for i in range(7)]) < daily))
    week = sum((F.col(f"h{i}") for i in range(1, 5)), F.col("h0"))
    most = F.greatest(week, F.col("h5"), F.col("h6"))
    bin_label = F.when(week == most, "weekday").when(F.col("h5") == most, "saturday").otherwise("sunday_holiday")
    label = F.when(F.col("days") <= few, "irregular").when(told, weekday_label(active)).when(most / F.col("days") >= majority, bin_label).otherwise("irregular")
    return grouped.select(*by, "days", label.alias("day_type"))


EXCEPTION_COLUMNS = ("service_id", "date", "exception_type")
PERIOD = ("start_date", "end_date")


def exceptions(feed: Feed, kind: str) -> DataFrame:
    """(service_id, text) of the dates added ("1") or removed ("2")."""
    if not feed.has("calendar_dates", *EXCEPTION_COLUMNS):
        return feed.spark.createDataFrame([], "service_id string, text string")
    rows = feed.table("calendar_dates").filter(F.trim("exception_type") == kind)
    return rows.select("service_id", F.trim("date").alias("text")).distinct()


def flagged(feed: Feed) -> DataFrame:
    """(service_id, flags array<boolean>, start, end) of calendar rows; start and end are null where they can't be read."""
    if not feed.has("calendar", "service_id", *DAYS):
        return feed.spark.createDataFrame([], "service_id string, flags array<boolean>, start date, end date")
    period = [ymd(F.col(c)) if feed.has("calendar", *PERIOD) else F.lit(None).cast("date") for c in PERIOD]
    return feed.table("calendar").select("service_id", F.array(*[F.trim(d) == "1" for d in DAYS]).alias("flags"), period[0].alias("start"), period[1].alias("end"))


def feed_window(feed: Feed) -> tuple[str, str] | None:
    """The validity told by feed_info, or by the publication, as YYYYMMDD texts."""
    found: tuple[str, str] = ("", "")
    if feed.has("feed_info", "feed_start_date", "feed_end_date"):
        row = feed.table("feed_info").orderBy("_line").select(F.trim("feed_start_date"), F.trim("feed_end_date")).first()
        found = (row[0], row[1]) if row else found
    for start, end in (found, tuple(feed.meta.get(k, "").replace("-", "") for k in ("from_date", "to_date"))):
        if len(start) == len(end) == 8 and (start + end).isdigit():
            return start, end
    return None


def snapshot_window(feed: Feed) -> tuple[str, str] | None:
    """As feed_window, and failing that the first and last date of the calendars."""
    if (w := feed_window(feed)) and w[0] <= w[1]:
        return w
    dates = [feed.table("calendar").select(ymd(F.col(c)).alias("d")) for c in PERIOD] if feed.has("calendar", *PERIOD) else []
    if feed.has("calendar_dates", "date"):
        dates.append(feed.table("calendar_dates").select(ymd(F.col("date")).alias("d")))
    if not dates:
        return None
    whole = dates[0]
    for d in dates[1:]:
        whole = whole.unionByName(d)
    lo, hi = whole.agg(F.date_format(F.min("d"), "yyyyMMdd"), F.date_format(F.max("d"), "yyyyMMdd")).first()
    return (lo, hi) if lo else None


def effective_dates(feed: Feed, window: tuple[str, str] | None) -> tuple[DataFrame, DataFrame]:
    """((service_id, day) that services with flags and a period run on, (service_id, flag_days) by the flags alone), within the window.

    A period becomes its days by weekday; removed dates are taken out, added ones come in unless a flag has them already.
    """
    lo, hi = F.col("start"), F.col("end")
    if window:
        low, high = (ymd(F.lit(w)) for w in window)
        lo, hi = F.greatest(lo, low), F.least(hi, high)
    spans = flagged(feed).filter(F.exists("flags", lambda x: x) & F.col("start").isNotNull() & F.col("end").isNotNull()).select("service_id", "flags", lo.alias("lo"), hi.alias("hi"))
    days = spans.filter("lo <= hi").withColumn("day", F.explode(F.sequence("lo", "hi"))).filter(F.get("flags", F.weekday("day"))).select("service_id", "day")
    flag_days = spans.select("service_id").join(days.groupBy("service_id").agg(F.count("*").alias("n")), "service_id", "left").select("service_id", F.coalesce("n", F.lit(0)).alias("flag_days"))
    removed = exceptions(feed, "2").withColumn("day", ymd(F.col("text"))).select("service_id", "day").distinct()
    added = exceptions(feed, "1").withColumn("day", ymd(F.col("text"))).filter("day IS NOT NULL").select("service_id", "day").distinct()
    if window:
        added = added.filter(F.col("day").between(*(ymd(F.lit(w)) for w in window)))
    added = added.join(spans.select("service_id").distinct(), "service_id", "left_semi")
    return days.unionByName(added).distinct().join(removed, ["service_id", "day"], "left_anti"), flag_days


def day_types(feed: Feed, config: dict) -> DataFrame:
    """(service_id, day_type) of every service that the calendars name."""
    c = config["load"]["day_types"]
    days, flag_days = effective_dates(feed, feed_window(feed))
    runs = flag_days.join(days.groupBy("service_id").agg(F.count("*").alias("n")), "service_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = flagged(feed).withColumn("any", F.exists("flags", lambda x: x)).join(runs, "service_id", "left")
    sparse = (F.col("flag_days") > 0) & (F.col("n") / F.col("flag_days") < c["min_flag_day_ratio"])
    by_flags = F.when(F.col("n") == 0, "inactive").when(sparse, "irregular").otherwise(weekday_label([F.get("flags", F.lit(i)) for i in range(7)]))
    told = rows.filter("any").select("service_id", by_flags.alias("day_type")).dropDuplicates(["service_id"])
    dated = label_dates(
        exceptions(feed, "1").withColumn("day", ymd(F.col("text"))), ["service_id"], few=c["short_service_max_days"], on=c["dow_on"], stray=c["dow_stray_max"], daily=c["dow_daily_min_cov"], majority=c["calendar_dates_majority"]
    ).select("service_id", "day_type")
    unreadable = exceptions(feed, "1").select("service_id").distinct().join(dated, "service_id", "left_anti").withColumn("day_type", F.lit("irregular"))
    dated = dated.unionByName(unreadable).join(told, "service_id", "left_anti")
    named = told.unionByName(dated)
    idle = rows.filter("NOT any").select("service_id").distinct().join(named, "service_id", "left_anti").withColumn("day_type", F.lit("inactive"))
    return named.unionByName(idle)


def service_dates(feed: Feed, types: DataFrame) -> DataFrame:
    """(service_id, day) that each service runs on; services without flags or period run on their added dates."""
    days, flag_days = effective_dates(feed, snapshot_window(feed))
    rest = types.select("service_id").distinct().join(flag_days, "service_id", "left_anti")
    added = exceptions(feed, "1").join(exceptions(feed, "2"), ["service_id", "text"], "left_anti").join(rest, "service_id", "left_semi")
    return days.unionByName(added.select("service_id", ymd(F.col("text")).alias("day")).filter("day IS NOT NULL"))


def window_intervals(old: Feed, new: Feed) -> tuple[tuple[str, str] | None, DataFrame | None]:
    """The window that both feeds are valid in, and its intervals (lo, hi) between all starts and ends of calendar rows."""
    a, b = snapshot_window(old), snapshot_window(new)
    if not a or not b or max(a[0], b[0]) > min(a[1], b[1]):
        return None, None
    window = (max(a[0], b[0]), min(a[1], b[1]))
    lo, hi = (ymd(F.lit(w)) for w in window)
    starts = old.spark.range(1).select(lo.alias("lo"))
    for feed in (old, new):
        if feed.has("calendar", *PERIOD):
            rows = feed.table("calendar").select(*[ymd(F.col(c)).alias(c) for c in PERIOD])
            starts = starts.unionByName(rows.filter((F.col("start_date") > lo) & (F.col("start_date") <= hi)).select(F.col("start_date").alias("lo")))
            starts = starts.unionByName(rows.filter((F.col("end_date") >= lo) & (F.col("end_date") < hi)).select(F.date_add("end_date", 1).alias("lo")))
    after = F.lead("lo").over(Window.orderBy("lo"))  # calendar boundaries of one feed pair
    return window, starts.distinct().withColumn("hi", F.coalesce(F.date_sub(after, 1), hi))


def active_services(feed: Feed, intervals: DataFrame) -> DataFrame:
    """(lo, hi, service_id): services that run on some day of an interval. Intervals become days and meet service days in an equi-join;
    a service whose period can't be read is active in all."""
    days = intervals.withColumn("day", F.explode(F.sequence("lo", "hi")))
    runs, _ = effective_dates(feed, None)
    dated = exceptions(feed, "1").join(exceptions(feed, "2"), ["service_id", "text"], "left_anti").select("service_id", ymd(F.col("text")).alias("day")).filter("day IS NOT NULL")
    found = days.join(runs.unionByName(dated).distinct(), "day").select("lo", "hi", "service_id").distinct()
    always = flagged(feed).filter(F.exists("flags", lambda x: x) & (F.col("start").isNull() | F.col("end").isNull())).select("service_id").distinct()
    # The intervals of a feed pair, as an array, go to each such service.
    spans = intervals.agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    everywhere = always.join(F.broadcast(spans)).select("service_id", F.explode("spans").alias("i")).select("i.lo", "i.hi", "service_id")
    return found.unionByName(everywhere).distinct()


def comparison_units(old: Feed, new: Feed) -> tuple[tuple[str, str] | None, DataFrame | None]:
    """The common window and its units (old_services, new_services, intervals, start, days): intervals with the same services on both sides."""
    window, intervals = window_intervals(old, new)
    if window is None:
        return None, None
    side = lambda feed, name: active_services(feed, intervals).groupBy("lo", "hi").agg(F.array_sort(F.collect_set("service_id")).alias(name))
    none = F.array().cast("array<string>")
    both = intervals.join(side(old, "old_services"), ["lo", "hi"], "left").join(side(new, "new_services"), ["lo", "hi"], "left")
    both = both.withColumn("old_services", F.coalesce("old_services", none)).withColumn("new_services", F.coalesce("new_services", none))
    return window, both.groupBy("old_services", "new_services").agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("intervals"), F.min("lo").alias("start"), F.sum(F.datediff("hi", "lo") + 1).alias("days")
    )
