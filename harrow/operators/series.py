"""Daily station series: sequences for models, rolling figures, runs, anomalies, gaps.

Input is one row per station and day (see ``daily_series``). A station window
therefore never holds more rows than there are days in the record, whatever
share of the raw readings the station has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.nulls import clip
from harrow.runtime import stabilise


def daily_series(df: DataFrame, station: str, date: str, aggregates: dict[str, Column]) -> DataFrame:
    """Collapse raw readings to one row per station and day."""
    return df.groupBy(station, date).agg(*[c.alias(n) for n, c in aggregates.items()])


# --- model sequences ------------------------------------------------------------
def weather_sequences(
    df: DataFrame, key: str, date: str, features: list[str], max_length: int | None = None
) -> DataFrame:
    """``sequence`` (steps x features, zero padded to the longest record) and its real ``length`` per key.

    Every day counts. With ``max_length`` all sequences have that many steps, and a longer record is an error. Without it the records
    are written once, as their longest one has to be known first.
    """
    step = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    lists = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), step.alias("v")))).alias("_steps"))
    size = F.size("_steps")
    if max_length is None:
        lists = stabilise(lists)
        steps = F.lit(lists.agg(F.max(size)).first()[0] or 0)
    else:
        too_long = F.raise_error(F.format_string(f"a record of %d days is longer than {max_length}", size)).cast("int")
        steps = F.when(size > max_length, too_long).otherwise(F.lit(max_length))
    padding = F.array_repeat(F.array(*[F.lit(0.0) for _ in features]), steps - size)
    return lists.select(key, F.concat(F.transform("_steps", lambda s: s["v"]), padding).alias("sequence"), size.alias("length"))


def sequence_samples(static: DataFrame, sequences: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(static columns, sequence, length, target) per key; all three have one row per key."""
    return static.join(sequences, key).join(targets, key)


def masked_mean(sequence: Column | str, length: Column | str, features: list[str]) -> list[Column]:
    """Mean of each feature over the real steps of a padded sequence."""
    sequence = F.col(sequence) if isinstance(sequence, str) else sequence
    length = F.col(length) if isinstance(length, str) else length
    real = F.slice(sequence, F.lit(1), length)

    def total(i: int) -> Column:
        return F.aggregate(real, F.lit(0.0), lambda acc, step: acc + step[i])

    steps = F.greatest(length, F.lit(1)).cast("double")
    return [(total(i) / steps).alias(f"mean_{f}") for i, f in enumerate(features)]


# --- rolling figures ----------------------------------------------------------------
def _day(date: str) -> Column:
    return F.unix_date(F.col(date).cast("date"))


def rolling_features(
    df: DataFrame,
    station: str,
    date: str,
    averages: dict[str, list[int]],
    lags: dict[str, list[int]],
    cumulative: list[str],
) -> DataFrame:
    """Calendar-day moving averages, lags by days, and running sums within the year."""
    by_day = Window.partitionBy(station).orderBy(_day(date))
    out = {}
    for c, spans in averages.items():
        for n in spans:
            out[f"{c}_ma{n}"] = F.avg(c).over(by_day.rangeBetween(-(n - 1), 0))
    for c, days in lags.items():
        for k in days:
            out[f"{c}_lag{k}"] = F.max(c).over(by_day.rangeBetween(-k, -k))
    year_to_date = Window.partitionBy(station, F.year(date)).orderBy(_day(date)).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    for c in cumulative:
        out[f"{c}_cum"] = F.sum(c).over(year_to_date)
    return df.withColumns(out)


def days_since_rain(df: DataFrame, station: str, date: str, rain: str, wet: float = 1.0) -> DataFrame:
    """Days since the last wet day (0 on a wet day); missing before the first one."""
    so_far = Window.partitionBy(station).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    last_wet = F.max(F.when(F.col(rain) >= wet, F.col(date))).over(so_far)
    return df.withColumn("days_since_rain", F.datediff(date, last_wet))


def _with_run(df: DataFrame, station: str, date: str, condition: Column) -> DataFrame:
    """``_run`` identifies a stretch of consecutive calendar days where the condition holds."""
    df = df.withColumn("_on", F.coalesce(condition, F.lit(False)))
    place = F.row_number().over(Window.partitionBy(station, "_on").orderBy(date))
    return df.withColumn("_run", _day(date) - place)


def consecutive_days(df: DataFrame, station: str, date: str, condition: Column, name: str) -> DataFrame:
    """Length so far of the current run of days with the condition; a missing day ends a run."""
    runs = _with_run(df, station, date, condition)
    so_far = F.row_number().over(Window.partitionBy(station, "_on", "_run").orderBy(date))
    return runs.withColumn(name, F.when(F.col("_on"), so_far).otherwise(0)).drop("_on", "_run")


def heat_waves(
    df: DataFrame, station: str, date: str, temperature: str, threshold: float, min_days: int = 3
) -> DataFrame:
    """One row per heat wave: first and last day, duration, mean excess over the threshold."""
    runs = _with_run(df, station, date, F.col(temperature) > threshold).where("_on")
    events = runs.groupBy(station, "_run").agg(
        F.min(date).alias("first_day"),
        F.max(date).alias("last_day"),
        F.count(F.lit(1)).alias("duration_days"),
        F.avg(F.col(temperature) - threshold).alias("mean_excess"),
    )
    return events.where(F.col("duration_days") >= min_days).drop("_run")


def frost_flag(tmin: Column | str) -> Column:
    return (F.col(tmin) if isinstance(tmin, str) else tmin) < 0


def high_wind_flag(speed: Column | str, threshold: float = 15.0) -> Column:
    return (F.col(speed) if isinstance(speed, str) else speed) > threshold


# --- anomalies, spikes, gaps -----------------------------------------------------------
def monthly_anomalies(
    df: DataFrame, station: str, date: str, temperature: str, rain: str, reference: tuple[int, int] = (1991, 2020)
) -> DataFrame:
    """Monthly mean temperature and rain against their normals of the reference years."""
    months = df.groupBy(station, F.trunc(date, "MM").alias("month_start")).agg(
        F.avg(temperature).alias("temperature"), F.sum(rain).alias("rain")
    ).withColumn("month", F.month("month_start"))
    # one calendar month of one station holds a row per year, so a window is small; rows without a key have no normals
    same = Window.partitionBy(station, "month")
    counted = F.year("month_start").between(*reference) & F.col(station).isNotNull() & F.col("month").isNotNull()
    joined = months.withColumns(
        {f"{c}_normal": F.avg(F.when(counted, F.col(c))).over(same) for c in ("temperature", "rain")}
    )
    return joined.withColumns(
        {
            "temperature_anomaly": F.col("temperature") - F.col("temperature_normal"),
            "rain_anomaly_pct": F.try_divide(
                F.col("rain") - F.col("rain_normal"), F.when(F.col("rain_normal") != 0, F.col("rain_normal"))
            ) * 100,
        }
    )


def flag_spikes(df: DataFrame, station: str, value: str, sigmas: float = 3.0) -> DataFrame:
    """``is_spike``: further from the station median than ``sigmas`` robust deviations.

    1.4826 x the median absolute deviation equals one standard deviation for normal data.
    """
    # a window holds the days of one station; rows without a station are in no group
    days = Window.partitionBy(station)
    known = F.col(station).isNotNull()
    centred = df.withColumn("_median", F.when(known, F.median(value).over(days))).withColumn("_dev", F.abs(F.col(value) - F.col("_median")))
    spread = centred.withColumn("_mad", F.when(known, F.median("_dev").over(days)))
    limit = F.lit(1.4826 * sigmas) * F.col("_mad")
    return spread.withColumn("is_spike", F.coalesce(F.col("_dev") > limit, F.lit(False))).drop("_median", "_dev", "_mad")


def fill_short_gaps(df: DataFrame, station: str, date: str, value: str, max_gap: int = 5) -> DataFrame:
    """Fill the days without a value in gaps up to ``max_gap`` by linear interpolation (``is_filled``).

    Every row and column stays: days of longer or open-ended gaps keep their missing value, and days
    that have no row are inserted with nothing but station, date and value.
    """
    known = df.where(F.col(value).isNotNull()).select(station, date, F.col(value).cast("double").alias(value)).distinct()
    ahead = Window.partitionBy(station).orderBy(date)
    span = F.datediff("_date", date)
    fills = (
        known.withColumn("_date", F.lead(date).over(ahead))
        .withColumn("_value", F.lead(value).over(ahead))
        .withColumn("_span", span)
        .where((F.col("_span") > 1) & (F.col("_span") - 1 <= max_gap))
        .withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_span") - 1)))
        .select(
            F.col(station).alias("_fill_station"),
            F.date_add(date, F.col("_k")).alias("_fill_date"),
            (F.col(value) + (F.col("_value") - F.col(value)) * F.col("_k") / F.col("_span")).alias("_fill"),
        )
    )
    same = (F.col(station) == F.col("_fill_station")) & (F.col(date) == F.col("_fill_date"))
    filled = {
        station: F.coalesce(station, "_fill_station"), date: F.coalesce(date, "_fill_date"),
        value: F.coalesce(F.col(value).cast("double"), "_fill"),
    }
    return df.join(fills, same, "full").select(
        *[filled.get(c, F.col(c)).alias(c) for c in df.columns],
        (F.col(value).isNull() & F.col("_fill").isNotNull()).alias("is_filled"),
    )


def water_balance(df: DataFrame, station: str, date: str, rain: str, et0: str, kc: Column) -> DataFrame:
    """Crop evapotranspiration, daily balance, and its running sum within the year."""
    crop_et = F.col(et0) * kc
    year_to_date = Window.partitionBy(station, F.year(date)).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("crop_et", crop_et).withColumn("daily_balance", F.col(rain) - F.col("crop_et"))
    return out.withColumn("cumulative_balance", F.sum("daily_balance").over(year_to_date))


def degree_days(mean: Column | str, base: float = 10.0) -> Column:
    return clip((F.col(mean) if isinstance(mean, str) else mean) - base, low=0)
