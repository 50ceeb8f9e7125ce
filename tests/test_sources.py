import pytest
from pyspark.sql import functions as F

from weekloom import functions as fn
from weekloom.operators.encoders import fit_encoder
from weekloom.operators.scalers import fit_minmax
from weekloom.operators.schema import VintageNames
from weekloom.session import materialize, scratch_path, shared_folder
from weekloom.sources import tables


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_folder(spark))


def test_materialized_table_stays_the_same(spark):
    df = materialize(spark.range(100).withColumn("r", F.rand()))
    assert sorted(df.collect()) == sorted(df.collect())


def test_catalogue_table_is_overwritten(frame, spark):
    tables.write_table(frame([(1, "a")], "i int, s string"), "kept")
    tables.write_table(frame([(2, "b"), (3, "c")], "i int, s string"), "kept", partition_by=["s"])
    assert sorted(r.i for r in tables.scan_table(spark, "kept").collect()) == [2, 3]


def test_nan_becomes_null(frame, spark, tmp_path):
    frame([(1, float("nan")), (2, 2.0)], "i int, x double").write.parquet(str(tmp_path / "t"))
    rows = tables.scan_features(spark, str(tmp_path / "t"), ["i", "x"]).orderBy("i").collect()
    assert [r.x for r in rows] == [None, 2.0]


@pytest.mark.parametrize("typed", [True, False])
def test_csv_vintages(frame, spark, tmp_path, typed):
    names = VintageNames({2016: "A_", 2017: "B_"}, {"POP": "People", "AGE": "Age"}, {2017: {"AGE": "A_AGE"}})
    frame([("k1", 5.0, 30.5)], "CODE string, A_POP double, A_AGE double").write.csv(str(tmp_path / "a"), header=True)
    frame([("k1", 31.5)], "CODE string, A_AGE double").write.csv(str(tmp_path / "b"), header=True)
    schemas = {2016: "CODE string, A_POP double, A_AGE double", 2017: "CODE string, A_AGE double"} if typed else None
    paths = {2016: str(tmp_path / "a"), 2017: str(tmp_path / "b")}
    rows = tables.scan_csv_vintages(spark, paths, names, schemas).orderBy("YEAR").collect()
    assert [(r.CODE, r.YEAR, r.People, r.Age) for r in rows] == [("k1", 2016, 5.0, 30.5), ("k1", 2017, None, 31.5)]


def test_row_operators_and_fitted_parameters_work_on_a_stream(frame, spark, tmp_path):
    rows = frame([("a", "1.5%", 10.0), ("b", "2%", 20.0)], "k string, p string, x double")
    rows.write.parquet(str(tmp_path / "in"))
    encoder, scaler = fit_encoder(rows, ["k"]), fit_minmax(rows, ["x"])
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    done = scaler.transform(encoder.transform(stream.withColumn("p", fn.parse_percent("p"))))
    writer = done.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "c"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("streamed").select("k", "p", "x", "k_code").collect())) == [
        ("a", 1.5, 1.0, 0), ("b", 2.0, 2.0, 1)]
