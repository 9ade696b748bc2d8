import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from standflow.session import scratch_path
from standflow.sources import sinks, tables


def test_arrow_files_round_trip(spark):
    df = spark.range(25000).select("id", (F.col("id") * 0.5).alias("v"), F.lit("x").alias("s"))
    path = scratch_path(spark, "t")
    written = sinks.write_arrow_files(df.repartition(3), path).agg(F.sum("rows")).first()[0]
    back = tables.ingest_arrow_files(spark, f"{path}/*.arrow", df.schema)
    assert written == back.count() == 25000
    assert back.agg(F.sum("id"), F.sum("v")).first() == df.agg(F.sum("id"), F.sum("v")).first()


def test_arrow_batches_are_dealt_to_several_tasks(spark):
    path = scratch_path(spark, "b")
    df = spark.range(0, 60000, 1, 12)
    sinks.write_arrow_files(df, path).count()
    back = tables.ingest_arrow_files(spark, f"{path}/*.arrow", df.schema, batches_per_task=1)
    filled = back.groupBy(F.spark_partition_id()).count()
    assert back.count() == 60000 and filled.count() > 4


def test_csv_as_the_study_writes_it(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"he said ""x, y"""\nNA,NA\n,z\n')
    got = tables.read_csv_table(spark, str(path), T.StructType.fromDDL("a int, b string"))
    assert got.collect() == [(1, 'he said "x, y"'), (None, None), (None, "z")]
    path.write_text("a,b\n1x,y\n")
    bad = tables.read_csv_table(spark, str(path), T.StructType.fromDDL("a int, b string"))
    with pytest.raises(Exception, match="MALFORMED"):
        bad.collect()


def test_csv_result_keeps_quotes_and_line_breaks(spark):
    df = spark.createDataFrame(
        [(1, 'a "b", c'), (2, "x\ny"), (3, "back\\slash"), (4, None)], "i int, s string"
    )
    back = sinks.write_csv_result(df, scratch_path(spark, "c"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_blank_parted_files_with_row_names(spark, tmp_path):
    (tmp_path / "abal_edges.txt").write_text(
        '"point_id" "edge" "MAT"\n"1" 7 "warm dry"   3.5\n"2" 8 NA NA\n'
    )
    (tmp_path / "fasy_edges.txt").write_text("point_id edge MAT\n9  center\t-1\n")
    schema = T.StructType.fromDDL("point_id long, edge string, MAT double")
    got = tables.read_delim_per_key(spark, f"{tmp_path}/*.txt", r"/(\w+)_edges", schema)
    assert sorted(map(tuple, got.collect())) == [
        (7, "warm dry", 3.5, "abal"), (8, None, None, "abal"), (9, "center", -1.0, "fasy")
    ]
    (tmp_path / "short_edges.txt").write_text("point_id edge MAT\n9 center\n")
    with pytest.raises(Exception, match="not 3 fields"):
        tables.read_delim_per_key(spark, f"{tmp_path}/short*.txt", "/(s)", schema).collect()


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    b = spark.createDataFrame([(2,)], "id int")
    out = tables.union_tables(spark, {"simulation_1": a, "simulation_2": b, "other": b})
    assert sorted(map(tuple, out.collect()), key=str) == [
        (1, "x", "simulation_1"), (2, None, "simulation_2")
    ]


def test_catalog_tables_by_pattern(spark):
    spark.range(3).createOrReplaceTempView("simulation_a")
    spark.range(2).createOrReplaceTempView("simulation_b")
    assert tables.union_tables(spark).count() == 5
    schema = T.StructType.fromDDL("id string")
    assert tables.read_table(spark, "simulation_a", schema).dtypes == [("id", "string")]


def test_dimensions(spark, tmp_path):
    (tmp_path / "list").write_text("# species\nFagus_sylvatica extra\n\nPicea_abies\n")
    names = tables.read_dimension_list(spark, str(tmp_path / "list"), "species")
    assert sorted(r.species for r in names.collect()) == ["Fagus_sylvatica", "Picea_abies"]
    full = tables.dimension_grid(spark, {"a": ["x", "y"], "b": ["1", "2", "3"]})
    assert full.distinct().count() == 6
    paths = spark.createDataFrame([
        ("/p/prep_Fagus_sylvatica_2071-2080_NCC-NorESM1-M_rcp_8_5_all_grids_v8.parquet",),
        ("/p/Picea_abies_1981-1990_ICHEC-EC-EARTH_historical.dat",), ("/p/readme.txt",),
    ], "path string")
    got = sorted(tuple(r)[1:] for r in tables.parse_file_dimensions(paths).collect())
    assert got == [
        ("Fagus_sylvatica", "2071-2080", "NCC-NorESM1-M_rcp_8_5", "prep"),
        ("Picea_abies", "1981-1990", "ICHEC-EC-EARTH_historical", "raw"),
    ]


def test_partial_overwrite_keeps_other_parts(spark):
    path = scratch_path(spark, "p")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.write_partitioned_dataset(df, path, ["k"])
    out = sinks.write_partitioned_dataset(
        spark.createDataFrame([("b", 3)], "k string, v int"), path, ["k"])
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("b", 3)]


def test_nulls_are_dropped_from_a_parquet_set(spark):
    path = scratch_path(spark, "n")
    spark.createDataFrame([(1, None), (2, 3)], "a int, b int").write.parquet(path)
    assert tables.read_parquet_set(spark, f"{path}/*.parquet").collect() == [(2, 3)]
