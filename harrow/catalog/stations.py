"""Stations in space and time: interpolation, autocorrelation, drought index, decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.catalog.registry import query, r6, rounded, sql_r6, sql_round
from harrow.operators import drought, spatial
from harrow.operators.grids import daily_to_monthly
from harrow.runtime import stabilise
from harrow.sources.tables import Tables, with_views

_PLACES = """select location_id, latitude, longitude, avg(temperature_mean) as temperature_mean, avg(elevation) as elevation from obs group by 1, 2, 3"""


def _places(t: Tables) -> DataFrame:
    """One row per location, written once: searches read it several times."""
    return stabilise(t.obs.groupBy("location_id", "latitude", "longitude").agg(
        F.avg("temperature_mean").alias("temperature_mean"), F.avg("elevation").alias("elevation")
    ))


@query(
    "x13_nearest_stations",
    with_views("obs", places=_PLACES)
    + """select target, station, cast(rank as int) as rank, """
    + sql_round("distance")
    + """ as distance from (
      select a.location_id as target, b.location_id as station,
        sqrt((a.latitude-b.latitude)*(a.latitude-b.latitude)+(a.longitude-b.longitude)*(a.longitude-b.longitude)) as distance,
        row_number() over (partition by a.location_id order by
          (a.latitude-b.latitude)*(a.latitude-b.latitude)+(a.longitude-b.longitude)*(a.longitude-b.longitude), b.location_id) as rank
      from places as a join places as b on a.location_id<>b.location_id) as r where rank<=3""",
)
def nearest(t: Tables) -> DataFrame:
    places = _places(t)
    stations = places.withColumnRenamed("location_id", "station")
    near = spatial.nearest_stations(places.withColumnRenamed("location_id", "target"), stations, 3, "target", "station", others_only=True)
    return rounded(near, "distance")


@query(
    "x14_inverse_distance",
    with_views(
        "obs", places=_PLACES,
        near="""select a.location_id, b.temperature_mean, (a.latitude-b.latitude)*(a.latitude-b.latitude)+(a.longitude-b.longitude)*(a.longitude-b.longitude) as d2,
          row_number() over (partition by a.location_id order by
            (a.latitude-b.latitude)*(a.latitude-b.latitude)+(a.longitude-b.longitude)*(a.longitude-b.longitude), b.location_id) as place
          from places as a join places as b on a.location_id<>b.location_id""",
        est="""select location_id, coalesce(avg(temperature_mean) filter (where d2=0),
          sum(temperature_mean/d2) filter (where d2>0)/sum(1/d2) filter (where d2>0)) as estimate, count(*) as n_stations from near where place<=8 group by 1""",
    )
    + f"""select location_id, n_stations, {sql_round('estimate')} as estimate, {sql_round('estimate-temperature_mean')} as error
      from est join places using (location_id)""",
)
def interpolation(t: Tables) -> DataFrame:
    """Each location's temperature as estimated from its eight nearest others, and the error."""
    places = _places(t)
    stations = places.select(F.col("location_id").alias("station"), "latitude", "longitude", "temperature_mean")
    estimates = spatial.inverse_distance(places.select("location_id", "latitude", "longitude"), stations, "temperature_mean", 8, "location_id", "station", others_only=True)
    known = places.select("location_id", F.col("temperature_mean").alias("known"))
    return estimates.join(known, "location_id").select(
        "location_id", "n_stations", r6("temperature_mean", "estimate"), r6(F.col("temperature_mean") - F.col("known"), "error")
    )


@query(
    "x15_morans_i",
    with_views(
        "obs", places=_PLACES,
        z="select *, temperature_mean-(select avg(temperature_mean) from places) as z from places",
        pairs="""select count(*) as n_pairs, sum(a.z*b.z) as products from z as a join z as b on a.location_id<>b.location_id
          and (a.latitude-b.latitude)*(a.latitude-b.latitude)+(a.longitude-b.longitude)*(a.longitude-b.longitude)<=0.4e0*0.4e0""",
        own="select count(*) as n_points, sum(z*z) as spread from z",
    )
    + f"""select n_points, n_pairs, {sql_round('n_points*products/(n_pairs*spread)')} as morans_i, {sql_round('-1e0/(n_points-1)')} as expected from pairs, own""",
)
def autocorrelation(t: Tables) -> DataFrame:
    return rounded(spatial.morans_i(_places(t), "temperature_mean", 0.4), "morans_i", "expected")


_SPI = ("total", "shape", "rate_scale", "zero_share", "spi")
_DEVIATE = """(t-(2.515517e0+t*(0.802853e0+t*0.010328e0))/(1+t*(1.432788e0+t*(0.189269e0+t*0.001308e0))))"""


@query(
    "x16_standardised_precipitation",
    with_views(
        "daily",
        monthly="select station_id, cast(date_trunc('month', observation_date) as date) as month, sum(precipitation_daily) as rain from daily group by 1, 2",
        numbered="select *, year(month)*12+month(month) as m from monthly",
        summed=" union all ".join(
            f"""select station_id, month, {scale} as scale, sum(rain) over w as total, count(*) over w as n from numbered
              window w as (partition by station_id order by m range between {scale - 1} preceding and current row)"""
            for scale in drought.SCALES
        ),
        sums="select station_id, month, scale, total, month(month) as c from summed where n=scale",
        moments="""select station_id, scale, c, avg(total) filter (where total>0) as mean, avg(ln(case when total>0 then total end)) as logs,
          1-count(*) filter (where total>0)/count(*) as zero_share, max(total) filter (where total>0)>min(total) filter (where total>0) as spread from sums group by 1, 2, 3""",
        gap="select *, case when spread then ln(mean)-logs end as g from moments",
        fit="select *, case when g>0 then (1+sqrt(1+4*g/3))/(4*g) end as shape from gap",
        # the incomplete gamma function from the logarithms of its terms
        below="""select sums.*, shape, mean/shape as rate_scale, zero_share, total*shape/mean as x,
          case when shape is null then null when total<=0 then 0 when shape>150e0 then null
            else least(list_sum(list_transform(range(0, 501), lambda k: exp((shape+k)*ln(total*shape/mean)-total*shape/mean-lgamma(shape+k+1)))), 1) end as p
          from sums join fit using (station_id, scale, c)""",
        bounded="select *, least(greatest(zero_share+(1-zero_share)*p, 1e-9), 1-1e-9) as h from below",
        deviate="select *, sqrt(-2*ln(least(h, 1-h))) as t from bounded",
    )
    + f"""select station_id, month, scale, {sql_r6(*_SPI[:4])}, {sql_round(f'''case when shape>150e0 then (cbrt(x/shape)-1+1/(9*shape))*3*sqrt(shape)
      when h<0.5e0 then -{_DEVIATE} else {_DEVIATE} end''', 5)} as spi from deviate""",
)
def spi(t: Tables) -> DataFrame:
    daily = t.daily.select("station_id", "observation_date", "precipitation_daily")
    monthly = daily_to_monthly(daily, cell=("station_id",), time="observation_date").withColumnRenamed("precipitation_daily", "rain")
    out = drought.standardised_precipitation(monthly, rain="rain")
    return rounded(rounded(out, *_SPI[:4]), "spi", digits=5)
