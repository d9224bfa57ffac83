"""Splits, samples, imputation, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.catalog.registry import ROW, query, r6, rounded, sql_round
from harrow.operators import cleaning, encoding, sampling
from harrow.runtime import stabilise
from harrow.sources.tables import Tables, with_views

ROW_SQL = ", ".join(ROW)
KEYS = list(ROW)
OBS = with_views("obs")
HASH = "md5(concat_ws('|', cast(record_id as varchar), cast(part_id as varchar), cast(observation_date as varchar), '42'))"


@query(
    "e1_median_imputation",
    with_views("obs", med="select quantile_cont(organic_carbon, 0.5) as oc, quantile_cont(ph_water, 0.5) as ph from obs where data_quality_flag<2")
    + f"""select {ROW_SQL}, {sql_round('coalesce(organic_carbon, oc)')} as organic_carbon,
      {sql_round('coalesce(case when station_id%6=0 then null else ph_water end, ph)')} as ph_water from obs, med where data_quality_flag=2""",
)
def e1(t: Tables) -> DataFrame:
    train = t.obs.where("data_quality_flag < 2").select("organic_carbon", "ph_water")
    _, medians = cleaning.handle_missing(train)
    test = t.obs.where("data_quality_flag = 2").select(
        *ROW, "organic_carbon", F.when(F.col("station_id") % 6 != 0, F.col("ph_water")).alias("ph_water")
    )
    return rounded(cleaning.handle_missing(test, medians)[0], "organic_carbon", "ph_water")


@query(
    "e2_group_split",
    with_views(
        "obs",
        ranked="""select agroecological_zone as z, row_number() over (order by md5(concat_ws('|', agroecological_zone, '42'))) as place,
          count(*) over () as n from (select distinct agroecological_zone from obs) as g""",
    )
    + f"select {ROW_SQL}, agroecological_zone, place<=ceil(0.2e0*n) as is_test from obs join ranked on z=agroecological_zone",
)
def e2(t: Tables) -> DataFrame:
    return sampling.group_split(t.obs.select(*ROW, "agroecological_zone"))


@query(
    "e3_stratified_split",
    with_views(
        "obs",
        hashed=f"select {ROW_SQL}, agroecological_zone, {HASH} as h from obs",
        counted="""select *, count(*) over (partition by agroecological_zone order by h range between unbounded preceding and current row) as upto,
          count(*) over (partition by agroecological_zone) as n from hashed""",
    )
    + f"select {ROW_SQL}, agroecological_zone, upto<=round_even(0.15e0*n, 0) as is_test from counted",
)
def e3(t: Tables) -> DataFrame:
    return sampling.stratified_split(stabilise(t.obs.select(*ROW, "agroecological_zone")), KEYS)


_COUNTED = with_views(
    "obs",
    hashed=f"select {ROW_SQL}, {HASH} as h from obs",
    counted="select *, count(*) over (order by h range between unbounded preceding and current row) as upto, count(*) over () as n from hashed",
)


@query("e6_validation_split", _COUNTED + f"select {ROW_SQL}, upto<=round_even(0.2e0*n, 0) as is_validation from counted")
def e6(t: Tables) -> DataFrame:
    return sampling.validation_split(stabilise(t.obs.select(*ROW)), KEYS)


@query("t5_bounded_sample", _COUNTED + f"select {ROW_SQL} from counted where upto<=1000")
def t5(t: Tables) -> DataFrame:
    return sampling.bounded_sample(t.obs.select(*ROW), KEYS, 1000)


_SCALED = ("latitude", "temperature_mean", "organic_carbon", "yield_kg_ha")


@query(
    "e4_population_scaler",
    with_views("obs", f=f"select {', '.join(f'avg({c}) as m_{c}, stddev_pop({c}) as s_{c}' for c in _SCALED)} from obs")
    + f"""select {ROW_SQL}, {', '.join(f'{sql_round(f"({c}-m_{c})/s_{c}")} as {c}' for c in _SCALED)}, 0e0 as flat from obs, f""",
)
def e4(t: Tables) -> DataFrame:
    rows = t.obs.select(*ROW, *_SCALED, F.lit(3.0).alias("flat"))
    scaler = encoding.fit_scaler(rows, [*_SCALED, "flat"])
    return rounded(encoding.apply_scaler(rows, scaler), *_SCALED)


@query(
    "m1_baseline_mean",
    with_views(
        "obs",
        ranked="""select agroecological_zone as z, row_number() over (order by md5(concat_ws('|', agroecological_zone, '42'))) as place,
          count(*) over () as n from (select distinct agroecological_zone from obs) as g""",
        split="select *, place<=ceil(0.2e0*n) as is_test from obs join ranked on z=agroecological_zone",
    )
    + f"""select {ROW_SQL}, yield_kg_ha, {sql_round('m')} as prediction from split,
      (select avg(yield_kg_ha) as m from split where not is_test) as t where is_test""",
)
def m1(t: Tables) -> DataFrame:
    from harrow.operators.models import fit_baseline

    split = sampling.group_split(stabilise(t.obs.select(*ROW, "agroecological_zone", F.col("yield_kg_ha").alias("label"))))
    model = fit_baseline(split.where(~F.col("is_test")))
    return model.transform(split.where("is_test")).select(
        *ROW, F.col("label").alias("yield_kg_ha"), r6("prediction")
    )
