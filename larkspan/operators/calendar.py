"""Daily activity rollup, calendar grid and heat colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import hex_channel, intensity, opacity
from ..functions.text import col

WEEKS = 53

# Display colour per platform.
PLATFORM_COLORS = {
    "github": "#3fd67a", "leetcode": "#ffc94d", "codeforces": "#4aa3ff", "codechef": "#c96a35",
}


def platform_minutes(events: DataFrame, ts: str, platform: str, minutes: str) -> DataFrame:
    """Whole minutes per day and platform; platforms without any are absent."""
    dated = events.filter(F.to_date(ts).isNotNull())
    per = dated.groupBy(F.to_date(ts).alias("date"), F.col(platform).alias("platform")).agg(
        F.sum(F.col(minutes).cast("bigint")).alias("minutes")
    )
    return per.filter(F.col("minutes") > 0)


def daily_activity(per_platform: DataFrame) -> DataFrame:
    """One row per day: map platform -> minutes, and the total.

    The list holds one entry per platform, already summed.
    """
    entries = F.array_sort(F.collect_list(F.struct("platform", "minutes")))
    return per_platform.groupBy("date").agg(
        F.map_from_entries(entries).alias("activity"), F.sum("minutes").alias("total")
    )


def blend_colors(activity: Column | str, colors: dict[str, str]) -> Column:
    """Platform colours of a day mixed by their share of its minutes; null without any."""
    table = F.create_map(*[F.lit(x) for pair in colors.items() for x in pair])
    known = F.map_filter(col(activity), lambda k, v: F.try_element_at(table, k).isNotNull())
    entries = F.map_entries(known)

    def total(weight) -> Column:
        return F.aggregate(entries, F.lit(0).cast("bigint"), lambda acc, e: acc + weight(e) * e["value"])

    minutes = total(lambda e: F.lit(1))
    mixed = [
        F.floor(total(lambda e, i=i: hex_channel(F.try_element_at(table, e["key"]), i)) / minutes).cast("int")
        for i in range(3)
    ]
    return F.when(F.size(known) > 0, F.format_string("rgb(%d, %d, %d)", *mixed))


def last_weeks(days: DataFrame, date: str = "date", weeks: int = WEEKS) -> DataFrame:
    """Every day of the ``weeks`` weeks that end with the latest day."""
    last = days.agg(F.max(date).alias("last"))
    return last.select(F.explode(F.sequence(
        F.date_sub("last", weeks * 7 - 1), F.col("last"), F.expr("interval 1 day")
    )).alias("date"))


def month_days(days: DataFrame, date: str = "date") -> DataFrame:
    """Every day of every month that has a row."""
    months = days.select(F.trunc(date, "MM").alias("m")).distinct()
    return months.select(F.explode(F.sequence("m", F.last_day("m"), F.expr("interval 1 day"))).alias("date"))


def on_spine(spine: DataFrame, daily: DataFrame) -> DataFrame:
    """Days without activity get an empty map and total 0."""
    empty = F.create_map().cast("map<string,bigint>")
    return spine.join(daily, "date", "left").withColumns({
        "activity": F.coalesce("activity", empty),
        "total": F.coalesce("total", F.lit(0)).cast("bigint"),
    })


def grid_cells(df: DataFrame, date: str = "date") -> DataFrame:
    """Year, month, week column and Monday-based weekday inside the month."""
    first = F.weekday(F.trunc(date, "MM"))
    return df.withColumns({
        "year": F.year(date), "month": F.month(date), "month_label": F.date_format(date, "MMM"),
        "weekday": F.weekday(date),
        "week_index": F.floor((first + F.day(date) - 1) / 7).cast("int"),
    })


def activity_calendar(
    events: DataFrame, ts: str, platform: str, minutes: str, colors: dict[str, str] | None = None,
) -> DataFrame:
    """Events to calendar cells with heat level, mixed colour and opacity."""
    per = platform_minutes(events, ts, platform, minutes)
    daily = daily_activity(per)
    cells = grid_cells(on_spine(month_days(daily), daily))
    return cells.withColumns({
        "color": blend_colors("activity", colors or PLATFORM_COLORS),
        "intensity": intensity("total"),
    }).withColumn("opacity", opacity("intensity", F.size("activity") > 0))


def month_grids(cells: DataFrame) -> DataFrame:
    """One row per month with its weeks, each of seven cells (null outside the month)."""
    # Nullable fields, so that a null cell is valid in every output format.
    cell = F.struct(*[F.when(F.col(c).isNotNull(), F.col(c)).alias(c) for c in ("date", "activity", "total")])
    weeks = cells.groupBy("year", "month", "month_label", "week_index").agg(
        F.map_from_entries(F.collect_list(F.struct("weekday", cell))).alias("_days")
    )
    rows = weeks.withColumn("days", F.transform(
        F.sequence(F.lit(0), F.lit(6)), lambda d: F.try_element_at("_days", d)
    ))
    months = rows.groupBy("year", "month", "month_label").agg(
        F.map_from_entries(F.collect_list(F.struct("week_index", "days"))).alias("_weeks"),
        F.max("week_index").alias("_last"),
    )
    weeks = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda w: F.try_element_at("_weeks", w))
    return months.select("year", "month", "month_label", weeks.alias("weeks")).orderBy("year", "month")
