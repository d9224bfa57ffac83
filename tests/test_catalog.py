"""Contract of the registry; ``check.py`` compares every query with its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare
SMALL = "/root/testdata/sf0.001"

SAMPLE = ["a2_monthly_rain_stats", "e3_stratified_split", "f14_all_features", "j2_zone_join", "p11_clean_survey", "v8_soil_documents"]


def test_entry(spark):
    df = entry.entry(spark)
    assert {"station_id", "month", "max_dry_spell", "season"} <= set(df.columns) and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    mine = entry.queries()[name](spark, SMALL).toArrow().to_pandas(date_as_object=True)
    theirs = con.sql(entry.oracle_sql()[name]).to_arrow_table().to_pandas(date_as_object=True)
    assert compare(mine, theirs) == ""
