"""Calendar expressions: seasons, degree days, date text, ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions.constants import (
    BIMODAL_SEASONS,
    DATE_PATTERNS,
    MAX_RANGE_DAYS,
    MONOMODAL_SEASONS,
    RAINY_SEASONS,
    REGIME_LATITUDE,
    SEASON_ORDINAL,
)
from harrow.functions.nulls import clip, col, np_round


def day_of_year(date: Column | str) -> Column:
    return F.dayofyear(col(date))


def _by_month(date: Column, seasons: dict[str, tuple[int, ...]]) -> Column:
    month_to_season = {m: s for s, months in seasons.items() for m in months}
    names = F.array(*[F.lit(month_to_season[m]) for m in range(1, 13)])
    return F.element_at(names, F.month(date))


def agricultural_season(date: Column | str, latitude: Column | str | None = None) -> Column:
    """Season name; one rainy season from 6 N on, two south of it or without latitude."""
    date = col(date)
    south = _by_month(date, BIMODAL_SEASONS)
    if latitude is None:
        return south
    return F.when(col(latitude) >= REGIME_LATITUDE, _by_month(date, MONOMODAL_SEASONS)).otherwise(south)


def growing_degree_days(tmin: Column | str, tmax: Column | str, base: float = 10.0) -> Column:
    return clip((col(tmin) + col(tmax)) / 2.0 - F.lit(float(base)), low=0)


def date_range(start: Column | str, end: Column | str) -> Column:
    """Inclusive array of days, empty when the ends are reversed."""
    start, end = col(start), col(end)
    empty = F.array().cast("array<date>")
    return F.when(start <= end, F.sequence(start, end, F.expr("interval 1 day"))).otherwise(empty)


def check_date_range(start: Column | str, end: Column | str, today: Column | str | None = None) -> Column:
    """``struct(is_valid, message)``; missing ends are accepted."""
    start, end = col(start), col(end)
    today = F.current_date() if today is None else col(today)
    message = (
        F.when(start > end, "Start date must be before end date")
        .when(F.datediff(end, start) > MAX_RANGE_DAYS, "Date range cannot exceed 10 years")
        .when(start > today, "Start date cannot be in the future")
        .when(end > today, "End date cannot be in the future")
        .otherwise("")
    )
    return F.struct((message == "").alias("is_valid"), message.alias("message"))


def parse_date(text: Column | str) -> Column:
    """First of six patterns that fits the whole text, else NULL."""
    text = col(text)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in DATE_PATTERNS]).cast("date")


def cyclic(value: Column | str, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a periodic value, 4 decimals."""
    angle = F.lit(2 * math.pi) * col(value) / F.lit(float(period))
    return np_round(F.sin(angle), 4), np_round(F.cos(angle), 4)


def season_ordinal(season: Column | str) -> Column:
    """Rank of a season by rain; unknown names count as 0."""
    pairs = [F.lit(x) for item in SEASON_ORDINAL.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(season)), F.lit(0)).cast("tinyint")


def is_rainy_season(season: Column | str) -> Column:
    return F.coalesce(col(season).isin(*RAINY_SEASONS), F.lit(False)).cast("tinyint")


def rainfall_regime_name(latitude: Column | str) -> Column:
    """Regime name; missing without latitude."""
    latitude = col(latitude)
    return F.when(latitude >= REGIME_LATITUDE, "monomodal").when(latitude.isNotNull(), "bimodal")


def rainfall_regime_flag(latitude: Column | str) -> Column:
    """1 north of the threshold, else 0 (also without latitude)."""
    return F.coalesce(col(latitude) >= REGIME_LATITUDE, F.lit(False)).cast("tinyint")
