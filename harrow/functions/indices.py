"""Vegetation, soil and comfort indices over plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.functions.constants import HARVEST_INDEX_RANGE
from harrow.functions.nulls import col


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def vegetation_indices(
    blue="blue", green="green", red="red", red_edge1="red_edge1", red_edge3="red_edge3", nir="nir",
    swir1="swir1", swir2="swir2", soil_factor: float = 0.5,
) -> dict[str, Column]:
    blue, green, red, re1, re3, nir, s1, s2 = (
        col(c) for c in (blue, green, red, red_edge1, red_edge3, nir, swir1, swir2)
    )
    return {
        "ndvi": _ratio(nir - red, nir + red),
        "evi": 2.5 * _ratio(nir - red, nir + 6 * red - 7.5 * blue + 1),
        "savi": _ratio(nir - red, nir + red + soil_factor) * (1 + soil_factor),
        "ndre": _ratio(nir - re1, nir + re1),
        "ci_red_edge": _ratio(re3, re1) - 1,
        "mcari": ((re1 - red) - 0.2 * (re1 - green)) * _ratio(re1, red),
        "ndwi": _ratio(green - nir, green + nir),
        "msi": _ratio(s1, nir),
        "nmdi": _ratio(nir - (s1 - s2), nir + (s1 - s2)),
    }


def usable_pixel(mask: Column | str, probability: Column | str, limit: float = 20.0) -> Column:
    """Clear mask and a cloud probability up to the limit."""
    return (col(mask) == 0) & (col(probability) <= limit)


def temperature_humidity_index(temperature: Column | str, humidity_pct: Column | str) -> Column:
    t, rh = col(temperature), col(humidity_pct) / 100.0
    return 0.8 * t + rh * (t - 14.4) + 46.4


# --- Fixed values: class limits, lower bound inclusive --------------------------------
SALINITY_CLASSES = (
    (16, "very_strongly_saline"), (8, "strongly_saline"), (4, "moderately_saline"), (2, "slightly_saline"),
    (0, "non_saline"),
)
SODICITY_CLASSES = ((40, "strongly_sodic"), (25, "moderately_sodic"), (13, "slightly_sodic"), (0, "non_sodic"))
FERTILITY_WEIGHTS = {
    "ph": 0.15, "organic_matter": 0.20, "available_p": 0.15, "exchangeable_k": 0.15, "cec": 0.10,
    "base_saturation": 0.10, "available_water_capacity": 0.15,
}
HEALTH_WEIGHTS = {"chemical": 0.4, "physical": 0.4, "biological": 0.2}


def _class(value: Column, classes: tuple) -> Column:
    out = F.when(value >= classes[0][0], classes[0][1])
    for low, name in classes[1:]:
        out = out.when(value >= low, name)
    return out


def cation_indices(ca="ca", mg="mg", k="k", na="na", cec="cec") -> dict[str, Column]:
    ca, mg, k, na, cec = (col(c) for c in (ca, mg, k, na, cec))
    return {
        "ca_mg_ratio": _ratio(ca, mg),
        "mg_k_ratio": _ratio(mg, k),
        "base_saturation": _ratio(ca + mg + k + na, cec) * 100,
        "sodium_adsorption_ratio": _ratio(na, F.sqrt((ca + mg) / 2)),
    }


def salinity_class(ec: Column | str) -> Column:
    return _class(col(ec), SALINITY_CLASSES)


def sodicity_class(sar: Column | str) -> Column:
    return _class(col(sar), SODICITY_CLASSES)


def weighted_index(weights: dict[str, float]) -> Column:
    """Weighted sum of inputs already scaled to 0..1."""
    total = None
    for name, weight in weights.items():
        term = F.col(name) * F.lit(weight)
        total = term if total is None else total + term
    return total


def harvest_index_in_range(crop: Column | str, harvest_index: Column | str) -> Column:
    """Is the harvest index inside the crop's reference range; NULL for an unknown crop."""
    crop, value = col(crop), col(harvest_index)
    pairs = [x for name, lo_hi in HARVEST_INDEX_RANGE.items() for x in (F.lit(name), F.array(*map(F.lit, lo_hi)))]
    limits = F.try_element_at(F.create_map(*pairs), crop)
    return value.between(limits[0], limits[1])
