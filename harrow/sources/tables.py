"""Survey, grid and prediction views over the given parquet tables.

``VIEWS`` holds the same views as SQL text for the side-by-side check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions.geo import agroecological_zone
from harrow.runtime import configure, spread, stabilise

# The crops the parts are read as, by part key modulo 11
CROPS = (
    ("maize", "cereals"), ("rice", "cereals"), ("sorghum", "cereals"), ("cowpea", "legumes"),
    ("groundnut", "legumes"), ("cassava", "root_tubers"), ("yam", "root_tubers"), ("tomato", "vegetables"),
    ("onion", "vegetables"), ("cocoa", "tree_crops"), ("mango", "tree_crops"),
)
ZONE_BOXES = (
    ("south", 1.0, 5.0, 8.0, 17.0), ("middle", 5.0, 8.0, 8.0, 17.0), ("west", 4.0, 7.0, 8.0, 11.0),
)
POINTS = ((1, 3.8667, 11.5167), (2, 10.5833, 14.3167), (3, 4.5, 9.5))

VIEWS = {
    "crops": """select * from (values (0,'maize','cereals'),(1,'rice','cereals'),(2,'sorghum','cereals'),(3,'cowpea','legumes'),(4,'groundnut','legumes'),(5,'cassava','root_tubers'),(6,'yam','root_tubers'),(7,'tomato','vegetables'),(8,'onion','vegetables'),(9,'cocoa','tree_crops'),(10,'mango','tree_crops')) as t(crop_id, crop_name, crop_group)""",
    "obs0": """select l_orderkey*10+l_linenumber as record_id, o_custkey as location_id, l_partkey as part_id, l_suppkey as station_id,
  cast(l_shipdate as date) as observation_date,
  case l_suppkey%3 when 0 then 'field_measurement' when 1 then 'weather_station' else 'laboratory_analysis' end as data_source,
  (160+(o_custkey*37)%1151)/100e0 as latitude, (830+(o_custkey*53)%791)/100e0 as longitude,
  cast((o_custkey*97)%4096 as double) as elevation, crop_name, crop_group,
  case when month(l_shipdate) in (12,1,2) then 'grand_dry_season' when month(l_shipdate) in (3,4,5) then 'first_rainy_season'
       when month(l_shipdate) in (6,7) then 'petit_dry_season' when month(l_shipdate) in (8,9) then 'rainy_season' else 'late_rainy' end as season,
  10e0+(l_partkey%15) as temperature_min, 10e0+(l_partkey%15)+(p_size%10) as temperature_max,
  10e0+(l_partkey%15)+(p_size%10)/2e0 as temperature_mean,
  case when l_quantity<=20 then 0e0 else (l_quantity-20)*5 end as precipitation_daily,
  30e0+(l_orderkey%66) as relative_humidity, 15e0+((l_suppkey+l_linenumber)%16) as solar_radiation,
  4.5e0+(l_partkey%36)/10e0 as ph_water,
  case when l_partkey%17=0 then null else 0.3e0+((l_suppkey*7+l_partkey)%58)/10e0 end as organic_carbon,
  0.01e0+(l_partkey%100)/100e0 as total_nitrogen, 1e0+(l_orderkey%160) as available_phosphorus,
  20e0+(l_partkey%61) as sand_percentage, 15e0+(l_suppkey%46) as clay_percentage,
  l_quantity*8 as fertilizer_nitrogen, cast(l_partkey%201 as double) as fertilizer_phosphorus,
  cast(l_suppkey%51 as double) as organic_fertilizer, (l_linenumber%2=0) as irrigation_applied,
  cast((l_orderkey*3)%111 as double) as disease_incidence,
  l_extendedprice/10e0 as yield_kg_ha, l_extendedprice*0.09e0*(1+l_linenumber%4) as biomass_kg_ha,
  0.2e0+(l_orderkey%41)/100e0 as harvest_index, cast(l_orderkey%3 as int) as data_quality_flag
from lineitem join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey join crops on p_partkey%11=crop_id""",
    "obs": """select *, case when latitude>=4e0 and latitude<=4.35e0 and longitude>=9e0 and longitude<=9.35e0 and elevation>2500 then 'mont_cameroun_volcanic'
  when elevation>1200 and longitude<11.5e0 and latitude>4.5e0 and latitude<7.5e0 then 'western_highlands'
  when latitude>10 then 'sahel_savanna' when latitude>8 then 'sudan_savanna' when latitude>6 then 'guinea_savanna'
  when latitude>5 then 'forest_savanna_transition' when longitude<10 and elevation<500 then 'humid_forest_coast'
  else 'humid_forest_inland' end as agroecological_zone
from obs0""",
    "daily": """select station_id, observation_date, sum(precipitation_daily) as precipitation_daily, avg(temperature_mean) as temperature_mean, avg(relative_humidity) as relative_humidity
from obs group by station_id, observation_date""",
    "grid": """select cast(date_trunc('month', observation_date) as date) as time, cast(floor(latitude) as double) as latitude, cast(floor(longitude) as double) as longitude,
  avg(temperature_min) as temperature_min, avg(temperature_max) as temperature_max, sum(precipitation_daily) as precipitation_monthly,
  cast((max(month(observation_date))*13+max(location_id)*7)%120 as double) as potential_evapotranspiration,
  cast((max(month(observation_date))*5+max(location_id)*3)%90 as double) as actual_evapotranspiration,
  avg(relative_humidity)/50e0 as vapor_pressure, avg(solar_radiation)*10 as solar_radiation_raw
from obs group by 1, 2, 3""",
    "zones": """select * from (values ('south',1e0,5e0,8e0,17e0),('middle',5e0,8e0,8e0,17e0),('west',4e0,7e0,8e0,11e0)) as t(zone, lat_min, lat_max, lon_min, lon_max)""",
    "pts": """select * from (values (1,3.8667e0,11.5167e0),(2,10.5833e0,14.3167e0),(3,4.5e0,9.5e0)) as t(point_id, latitude, longitude)""",
    "preds": """select record_id, part_id, observation_date, agroecological_zone, crop_group, yield_kg_ha as y_true, yield_kg_ha*(0.9e0+(record_id%21)/100e0) as y_pred from obs""",
}
_NEEDS = {
    "obs0": ("crops",), "obs": ("obs0",), "daily": ("obs",), "grid": ("obs",), "preds": ("obs",),
}


def with_views(*names: str, **extra: str) -> str:
    """``with`` clause that defines the named views (and what they need) plus extra ones."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} as ({VIEWS[n]})" for n in order] + [f"{n} as ({sql})" for n, sql in extra.items()]
    return "with " + ",\n".join(parts) + "\n"


class Tables:
    """The views as DataFrames; each is a lazy plan over the parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def obs(self) -> DataFrame:
        crop = F.array(*[F.struct(F.lit(n).alias("crop_name"), F.lit(g).alias("crop_group")) for n, g in CROPS])
        parts = self.read("part").select(
            "p_partkey", "p_size", F.element_at(crop, (F.col("p_partkey") % 11 + 1).cast("int")).alias("crop")
        )
        lines = spread(self.read("lineitem"), "l_orderkey").join(
            self.read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
        ).join(parts, F.col("l_partkey") == F.col("p_partkey"))
        table = lines.selectExpr(
            "l_orderkey*10+l_linenumber as record_id",
            "o_custkey as location_id",
            "l_partkey as part_id",
            "l_suppkey as station_id",
            "cast(l_shipdate as date) as observation_date",
            "case l_suppkey%3 when 0 then 'field_measurement' when 1 then 'weather_station' else 'laboratory_analysis' end as data_source",
            "(160+(o_custkey*37)%1151)/100e0 as latitude",
            "(830+(o_custkey*53)%791)/100e0 as longitude",
            "cast((o_custkey*97)%4096 as double) as elevation",
            "crop.crop_name as crop_name",
            "crop.crop_group as crop_group",
            "case when month(l_shipdate) in (12,1,2) then 'grand_dry_season' when month(l_shipdate) in (3,4,5) then 'first_rainy_season' "
            "when month(l_shipdate) in (6,7) then 'petit_dry_season' when month(l_shipdate) in (8,9) then 'rainy_season' else 'late_rainy' end as season",
            "10e0+(l_partkey%15) as temperature_min",
            "10e0+(l_partkey%15)+(p_size%10) as temperature_max",
            "10e0+(l_partkey%15)+(p_size%10)/2e0 as temperature_mean",
            "case when l_quantity<=20 then 0e0 else (l_quantity-20)*5 end as precipitation_daily",
            "30e0+(l_orderkey%66) as relative_humidity",
            "15e0+((l_suppkey+l_linenumber)%16) as solar_radiation",
            "4.5e0+(l_partkey%36)/10e0 as ph_water",
            "case when l_partkey%17=0 then null else 0.3e0+((l_suppkey*7+l_partkey)%58)/10e0 end as organic_carbon",
            "0.01e0+(l_partkey%100)/100e0 as total_nitrogen",
            "1e0+(l_orderkey%160) as available_phosphorus",
            "20e0+(l_partkey%61) as sand_percentage",
            "15e0+(l_suppkey%46) as clay_percentage",
            "l_quantity*8 as fertilizer_nitrogen",
            "cast(l_partkey%201 as double) as fertilizer_phosphorus",
            "cast(l_suppkey%51 as double) as organic_fertilizer",
            "(l_linenumber%2=0) as irrigation_applied",
            "cast((l_orderkey*3)%111 as double) as disease_incidence",
            "l_extendedprice/10e0 as yield_kg_ha",
            "l_extendedprice*0.09e0*(1+l_linenumber%4) as biomass_kg_ha",
            "0.2e0+(l_orderkey%41)/100e0 as harvest_index",
            "cast(l_orderkey%3 as int) as data_quality_flag",
        )
        return table.withColumn("agroecological_zone", agroecological_zone("latitude", "longitude", "elevation"))

    @cached_property
    def written_obs(self) -> DataFrame:
        """``obs`` written once, for jobs that read it several times."""
        return stabilise(self.obs)

    @cached_property
    def daily(self) -> DataFrame:
        return self.obs.groupBy("station_id", "observation_date").agg(
            F.sum("precipitation_daily").alias("precipitation_daily"),
            F.avg("temperature_mean").alias("temperature_mean"),
            F.avg("relative_humidity").alias("relative_humidity"),
        )

    @cached_property
    def grid(self) -> DataFrame:
        month = F.max(F.month("observation_date"))
        place = F.max("location_id")
        return self.obs.groupBy(
            F.trunc("observation_date", "MM").alias("time"),
            F.floor("latitude").cast("double").alias("latitude"),
            F.floor("longitude").cast("double").alias("longitude"),
        ).agg(
            F.avg("temperature_min").alias("temperature_min"),
            F.avg("temperature_max").alias("temperature_max"),
            F.sum("precipitation_daily").alias("precipitation_monthly"),
            ((month * 13 + place * 7) % 120).cast("double").alias("potential_evapotranspiration"),
            ((month * 5 + place * 3) % 90).cast("double").alias("actual_evapotranspiration"),
            (F.avg("relative_humidity") / 50).alias("vapor_pressure"),
            (F.avg("solar_radiation") * 10).alias("solar_radiation_raw"),
        )

    @cached_property
    def zones(self) -> DataFrame:
        return self.spark.createDataFrame(
            list(ZONE_BOXES), "zone string, lat_min double, lat_max double, lon_min double, lon_max double"
        )

    @cached_property
    def pts(self) -> DataFrame:
        return self.spark.createDataFrame(list(POINTS), "point_id int, latitude double, longitude double")

    @cached_property
    def preds(self) -> DataFrame:
        return self.obs.selectExpr(
            "record_id", "part_id", "observation_date", "agroecological_zone", "crop_group",
            "yield_kg_ha as y_true", "yield_kg_ha*(0.9e0+(record_id%21)/100e0) as y_pred",
        )
