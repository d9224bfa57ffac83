"""Standardised precipitation index from monthly sums.

For each station, calendar month and time scale a gamma distribution is fitted to the sums above zero by Thom's estimate, which needs their mean and the
mean of their logarithms; the share of sums of zero is kept beside it. The probability of a sum becomes a normal
deviate by the rational approximation 26.2.23 of Abramowitz and Stegun. All of it is one aggregate, one lookup and expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.lookup import lookup_join

SCALES = (1, 3, 6)
# Above this shape the cube-root normal approximation is closer than 1e-4, and the series of the gamma function gets long
LARGEST_SHAPE = 150.0
# Coefficients of the normal deviate, and the least probability it is taken of
DEVIATE_TOP = (2.515517, 0.802853, 0.010328)
DEVIATE_BOTTOM = (1.432788, 0.189269, 0.001308)
LEAST_PROBABILITY = 1e-9
# Stirling's series in odd powers of 1/z; from z = 8 on the first term left out is below 1e-14
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def log_gamma(a: Column) -> Column:
    """ln Gamma of a positive number: Stirling's series eight steps further, and the steps back."""
    z = a + 8.0
    inverse, tail = 1 / (z * z), F.lit(0.0)
    for c in reversed(STIRLING):
        tail = tail * inverse + c
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + tail / z
    steps = a
    for k in range(1, 8):
        steps = steps * (a + float(k))
    return series - F.log(steps)


def gamma_probability(shape: Column, x: Column) -> Column:
    """Lower incomplete gamma function, regularised: the share of a gamma variable of scale 1 below ``x``.

    The series stops where its terms, which fall once their number passes ``x - shape``, are below the last digit.
    """
    terms = F.ceil(F.greatest(x - shape, F.lit(0.0)) + 12 * F.sqrt(x) + 40).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * x / (shape + n)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda acc: acc["total"])
    return F.when(x <= 0, F.lit(0.0)).otherwise(F.least(F.exp(shape * F.log(x) - x - log_gamma(shape + 1.0)) * total, F.lit(1.0)))


def normal_deviate(p: Column) -> Column:
    """The normal deviate that ``p`` of all values stay below, to 4.5e-4."""
    p = F.least(F.greatest(p, F.lit(LEAST_PROBABILITY)), F.lit(1 - LEAST_PROBABILITY))
    tail = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(tail))
    (a, b, c), (d, e, f) = DEVIATE_TOP, DEVIATE_BOTTOM
    size = t - (a + t * (b + t * c)) / (1 + t * (d + t * (e + t * f)))
    return F.when(p < 0.5, -size).otherwise(size)


def normal_probability(z: Column) -> Column:
    """Share of normal deviates below ``z``: half a gamma variable of shape 1/2 on either side."""
    half = gamma_probability(F.lit(0.5), z * z / 2) / 2
    return F.when(z < 0, 0.5 - half).otherwise(0.5 + half)


def cube_root_deviate(shape: Column, x: Column) -> Column:
    """Deviate of a gamma variable of scale 1 and a large shape, after Wilson and Hilferty."""
    return (F.cbrt(x / shape) - 1 + 1 / (9 * shape)) * 3 * F.sqrt(shape)


def running_sums(monthly: DataFrame, station: str, month: str, rain: str, scales: tuple[int, ...] = SCALES) -> DataFrame:
    """(``station``, ``month``, ``scale``, ``total``): sums of the last ``scale`` months where every one of them has a value.

    A window holds the months of one station.
    """
    number = F.year(month) * 12 + F.month(month)
    rows = monthly.where(F.col(rain).isNotNull()).withColumn("_month", number)
    each = {}
    for scale in scales:
        window = Window.partitionBy(station).orderBy("_month").rangeBetween(1 - scale, 0)
        each |= {f"_sum{scale}": F.sum(rain).over(window), f"_months{scale}": F.count("*").over(window)}
    sums = rows.withColumns(each).select(station, month, F.explode(F.array(*[
        F.struct(F.lit(scale).alias("scale"), F.col(f"_sum{scale}").alias("total"), F.col(f"_months{scale}").alias("n")) for scale in scales
    ])).alias("w"))
    return sums.where(F.col("w.n") == F.col("w.scale")).select(station, month, "w.scale", "w.total")


def standardised_precipitation(
    monthly: DataFrame, station: str = "station_id", month: str = "month", rain: str = "precipitation_monthly", scales: tuple[int, ...] = SCALES,
) -> DataFrame:
    """``station``, ``month``, ``scale``, ``total``, ``shape``, ``rate_scale``, ``zero_share``, ``spi``.

    One row per station and month in ``monthly``. A station's calendar month needs two different sums above zero; without them the index is
    null, and so are ``shape`` and ``rate_scale``. Months without rain have the probability of their share.
    """
    sums = running_sums(monthly, station, month, rain, scales).withColumn("calendar_month", F.month(month))
    wet = F.when(F.col("total") > 0, F.col("total"))
    fitted = sums.groupBy(station, "scale", "calendar_month").agg(
        F.count("*").alias("_n"), F.count(wet).alias("_wet"), F.avg(wet).alias("_mean"), F.avg(F.log(wet)).alias("_log"),
        (F.max(wet) > F.min(wet)).alias("_spread"),
    )
    gap = F.when(F.col("_spread"), F.log("_mean") - F.col("_log"))
    shape = F.when(gap > 0, (1 + F.sqrt(1 + 4 * gap / 3)) / (4 * gap))
    fitted = fitted.select(
        station, "scale", "calendar_month", shape.alias("shape"), (F.col("_mean") / shape).alias("rate_scale"),
        (1 - F.col("_wet") / F.col("_n")).alias("zero_share"),
    )
    rows = lookup_join(sums, fitted, [station, "scale", "calendar_month"])
    # each step is a column of its own: the next one uses it several times
    rows = rows.withColumn("_x", F.col("total") / F.col("rate_scale"))
    shape, zeros, x = F.col("shape"), F.col("zero_share"), F.col("_x")
    rows = rows.withColumn("_large", cube_root_deviate(shape, x))
    probability = F.when((shape <= LARGEST_SHAPE) | (x <= 0), gamma_probability(shape, x)).when(zeros > 0, normal_probability(F.col("_large")))
    rows = rows.withColumn("_below", zeros + (1 - zeros) * probability)
    rows = rows.withColumn("_below", F.least(F.greatest("_below", F.lit(LEAST_PROBABILITY)), F.lit(1 - LEAST_PROBABILITY)))
    spi = F.when(shape.isNull(), None).when((shape > LARGEST_SHAPE) & (zeros == 0), F.col("_large")).otherwise(normal_deviate(F.col("_below")))
    return rows.select(station, month, "scale", "total", "shape", "rate_scale", "zero_share", spi.alias("spi"))
