from harrow.functions.dates import agricultural_season
from harrow.functions.geo import agroecological_zone
from harrow.operators import schemas
from harrow.streaming.rows import read_files, validated, write_available


def test_row_operators_on_a_stream(spark, tables, tmp_path):
    source, sink, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    columns = ["record_id", "observation_date", "latitude", "longitude", "elevation"]
    batch = tables.obs.select(*columns)
    batch.write.parquet(source)

    def enrich(df):
        df = validated(df, schemas.COORDINATES)
        return df.withColumn("season", agricultural_season("observation_date", "latitude")).withColumn(
            "zone", agroecological_zone("latitude", "longitude", "elevation")
        )

    query = write_available(enrich(read_files(spark, source, batch.schema)), sink, marks)
    assert query.awaitTermination(120)
    got = sorted(map(str, spark.read.parquet(sink).collect()))
    assert got == sorted(map(str, enrich(batch).select(*spark.read.parquet(sink).columns).collect()))
    again = write_available(enrich(read_files(spark, source, batch.schema)), sink, marks)
    assert again.awaitTermination(120) and spark.read.parquet(sink).count() == len(got)
