"""Geographic expressions: distance, zones, boxes, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions.constants import (
    COAST,
    EARTH_RADIUS_KM,
    HIGHLANDS,
    KM_PER_DEGREE,
    LAT_RANGE,
    LATITUDE_ZONES,
    LON_RANGE,
    METRES_PER_DEGREE,
    VOLCANIC_BOX,
)
from harrow.functions.nulls import col


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin((lat2 - lat1) / 2)
    half_lon = F.sin((lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(lat1) * F.cos(lat2) * half_lon * half_lon
    # rounding can push `a` past 1 for antipodes
    return 2 * F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * F.lit(EARTH_RADIUS_KM)


def slope_degrees(rise_m, run_m) -> Column:
    """Inclination over a horizontal run; 0 where the run is 0."""
    rise_m, run_m = col(rise_m), col(run_m)
    return F.when(run_m == 0, F.lit(0.0)).otherwise(F.degrees(F.atan(F.try_divide(rise_m, run_m))))


def bounding_box(lat, lon, radius_km) -> Column:
    """``struct(north, south, east, west)`` around a point; also a prefilter for radius joins."""
    lat, lon, radius_km = col(lat), col(lon), col(radius_km)
    d_lat = radius_km * F.lit(1 / KM_PER_DEGREE)
    d_lon = radius_km * F.try_divide(F.lit(1.0), F.lit(KM_PER_DEGREE) * F.cos(F.radians(lat)))
    return F.struct(
        (lat + d_lat).alias("north"), (lat - d_lat).alias("south"),
        (lon + d_lon).alias("east"), (lon - d_lon).alias("west"),
    )


def agroecological_zone(lat, lon, elevation) -> Column:
    """One of eight zones; first matching branch wins."""
    lat, lon, elevation = col(lat), col(lon), col(elevation)
    zone = F.when(
        lat.between(*VOLCANIC_BOX["lat"]) & lon.between(*VOLCANIC_BOX["lon"]) & (elevation > VOLCANIC_BOX["above"]),
        "mont_cameroun_volcanic",
    ).when(
        (elevation > HIGHLANDS["above"]) & (lon < HIGHLANDS["max_lon"])
        & (lat > HIGHLANDS["lat"][0]) & (lat < HIGHLANDS["lat"][1]),
        "western_highlands",
    )
    for above, name in LATITUDE_ZONES:
        zone = zone.when(lat > above, name)
    return zone.when(
        (lon < COAST["max_lon"]) & (elevation < COAST["max_elevation"]), "humid_forest_coast"
    ).otherwise("humid_forest_inland")


def geojson_point(lon, lat) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(col(lon), col(lat)).alias("coordinates"))


def utm_simplified(lat, lon) -> Column:
    """Zone 32N west of 12 E, else 33N, with a linear easting and northing."""
    lat, lon = col(lat), col(lon)
    zone = F.when(lon < 12.0, F.lit(32)).otherwise(F.lit(33))
    meridian = (zone - 1) * 6 - 177
    return F.struct(
        F.concat(zone.cast("string"), F.lit("N")).alias("zone"),
        ((lon - meridian) * F.lit(METRES_PER_DEGREE)).alias("easting"),
        (lat * F.lit(METRES_PER_DEGREE)).alias("northing"),
        F.lit("WGS84").alias("datum"),
    )


def check_coordinates(lat, lon) -> Column:
    """``struct(is_valid, message)``; latitude is judged first."""
    lat, lon = col(lat), col(lon)

    def outside(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label} "), value.cast("string"), F.lit(" is outside Cameroon bounds"))

    message = (
        F.when(~lat.between(*LAT_RANGE), outside("Latitude", lat))
        .when(~lon.between(*LON_RANGE), outside("Longitude", lon))
        .otherwise("")
    )
    return F.struct((message == "").alias("is_valid"), message.alias("message"))
