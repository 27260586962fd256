"""Seasons that may cross the year's end."""

from __future__ import annotations

import calendar
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Season:
    name: str
    start_month: int
    start_day: int
    end_month: int
    end_day: int

    @property
    def crosses(self) -> bool:
        return (self.end_month, self.end_day) < (self.start_month, self.start_day)


#: The three cropping seasons.
SEASONS = (Season("Kharif", 6, 1, 10, 31), Season("Rabi", 11, 1, 3, 31), Season("Summer", 4, 1, 5, 31))


def season_of(date: Column, seasons: tuple[Season, ...] = SEASONS) -> Column:
    """struct(season, year): the first season that holds the day, with the year it was planted in."""
    day = F.month(date) * 100 + F.dayofmonth(date)
    found = F.lit(None).cast("struct<season:string,year:int>")
    for s in reversed(seasons):
        start, end = s.start_month * 100 + s.start_day, s.end_month * 100 + s.end_day
        inside = (day >= start) | (day <= end) if s.crosses else day.between(start, end)
        year = F.when(F.lit(s.crosses) & (day <= end), F.year(date) - 1).otherwise(F.year(date))
        found = F.when(inside, F.struct(F.lit(s.name).alias("season"), year.alias("year"))).otherwise(found)
    return found


def _day(year: Column, month: int, day: int) -> Column:
    """A day of a month, moved back to the month's last day if there is no such day."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.least(F.last_day(first), F.date_add(first, day - 1))


def windows(years: DataFrame, year: str = "year", seasons: tuple[Season, ...] = SEASONS) -> DataFrame:
    """(season, year, start, end) for each year of ``years``."""
    one = [F.struct(F.lit(s.name).alias("season"), F.col(year).cast("int").alias("year"), _day(F.col(year), s.start_month, s.start_day).alias("start"), _day(F.col(year) + int(s.crosses), s.end_month, s.end_day).alias("end")) for s in seasons]
    return years.select(F.inline(F.array(*one)))


def months(season: Season) -> list[int]:
    """The months of a season in order, over the year's end if need be."""
    span = (season.end_month - season.start_month) % 12
    return [(season.start_month - 1 + i) % 12 + 1 for i in range(span + 1)]


class CalendarError(ValueError):
    """A season calendar that can't be used."""


def parsed(text: str) -> tuple[Season, ...]:
    """Seasons of a calendar file: a mapping whose ``seasons`` are a list of name, start_month, end_month, start_day (1) and end_day (31).

    JSON, or YAML where a YAML reader is installed. What isn't of this form raises CalendarError.
    """
    try:
        raw = json.loads(text)
    except ValueError as e:
        try:
            import yaml
        except ImportError:
            raise CalendarError(f"not JSON, and no YAML reader is installed: {e}") from None
        try:
            raw = yaml.safe_load(text)
        except yaml.YAMLError as f:
            raise CalendarError(f"malformed calendar: {f}") from None
    rows = raw.get("seasons") if isinstance(raw, dict) else None
    if not isinstance(rows, list) or not rows:
        raise CalendarError("a calendar is a mapping with a list of seasons")
    found = []
    for r in rows:
        if not isinstance(r, dict) or set(r) - {"name", "start_month", "end_month", "start_day", "end_day"} or not isinstance(r.get("name"), str) or not r["name"].strip():
            raise CalendarError(f"not a season: {r}")
        numbers = [r.get("start_month"), r.get("start_day", 1), r.get("end_month"), r.get("end_day", 31)]
        if not all(type(n) is int for n in numbers) or not (1 <= numbers[0] <= 12 and 1 <= numbers[2] <= 12 and 1 <= numbers[1] <= 31 and 1 <= numbers[3] <= 31):
            raise CalendarError(f"not days of a year: {r}")
        # A day that the month doesn't have is its last one.
        last = lambda m: calendar.monthrange(2024, m)[1]
        found.append(Season(r["name"].strip(), numbers[0], min(numbers[1], last(numbers[0])), numbers[2], min(numbers[3], last(numbers[2]))))
    if len({s.name for s in found}) < len(found):
        raise CalendarError("two seasons have one name")
    return tuple(found)


def load(spark: SparkSession, path: str) -> tuple[Season, ...]:
    """A calendar from any path that Spark can read; the three fixed seasons where there is no such file."""
    files = spark._jvm.org.apache.hadoop.fs
    where = files.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return SEASONS
    return parsed("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def calendar_days(spark: SparkSession, seasons: tuple[Season, ...]) -> DataFrame:
    """(day, season, shift) for each of the 366 days (month * 100 + day of month) in a season, the first one that holds it; shift is added to the year to get that of the start."""
    rows = []
    for month in range(1, 13):
        for d in range(1, calendar.monthrange(2024, month)[1] + 1):
            day = month * 100 + d
            for s in seasons:
                start, end = s.start_month * 100 + s.start_day, s.end_month * 100 + s.end_day
                if (day >= start or day <= end) if s.crosses else start <= day <= end:
                    rows.append((day, s.name, -1 if s.crosses and day <= end else 0))
                    break
    return spark.createDataFrame(rows, "day int, season string, shift int")


def with_season(rows: DataFrame, date: str, seasons: tuple[Season, ...]) -> DataFrame:
    """``rows`` with season and season_year, null outside all seasons: a join with the calendar's 366 days at most."""
    days = calendar_days(rows.sparkSession, seasons).withColumnRenamed("day", "_day")
    own = F.month(date) * 100 + F.dayofmonth(date)
    found = rows.join(F.broadcast(days), own == F.col("_day"), "left")
    return found.withColumn("season_year", F.when(F.col("season").isNotNull(), F.year(date) + F.col("shift"))).drop("_day", "shift")


def coverage(spark: SparkSession, seasons: tuple[Season, ...]) -> DataFrame:
    """(issue, day): days of the year in no season (gap) and in more than one (overlap)."""
    rows = []
    for month in range(1, 13):
        for d in range(1, calendar.monthrange(2024, month)[1] + 1):
            day = month * 100 + d
            n = sum((day >= s.start_month * 100 + s.start_day) + (day <= s.end_month * 100 + s.end_day) > (not s.crosses) for s in seasons)
            if n != 1:
                rows.append(("overlap" if n else "gap", day))
    return spark.createDataFrame(rows, "issue string, day int")


def version(seasons: tuple[Season, ...]) -> str:
    """A short hash that two calendars share only if they have the same seasons in the same order."""
    return hashlib.sha256(json.dumps([[s.name, s.start_month, s.start_day, s.end_month, s.end_day] for s in seasons]).encode()).hexdigest()[:16]
