"""Rows with nulls, copies and surplus values are neither lost nor altered."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contract.bindings import dense_days, load_linear_model
from contract.sample_queries import r6
from standflow.functions.model_apply import dense
from standflow.operators import examples as ex
from standflow.operators import grid as gr
from standflow.operators import model_io as mio
from standflow.operators import niche
from standflow.operators import prune as pr
from standflow.operators import samples as sm
from standflow.plans import assembly


def test_timeline_of_a_null_unit_stays(spark):
    rows = [(u, 1, y, s) for u in (1, None) for y, s in ((2000, "A"), (2001, "B"), (2002, "B"))]
    df = spark.createDataFrame(rows, "uniqueID long, simulationID long, Year long, svd_state string")
    out = ex.with_previous(df, ["uniqueID", "simulationID"], "Year", "svd_state")
    got = {(r["uniqueID"], r["Year"], r["__prev"]) for r in out.collect()}
    assert got == {(u, y, p) for u in (1, None) for y, p in ((2000, None), (2001, "A"), (2002, "B"))}


def test_null_year_is_an_error(spark):
    df = spark.createDataFrame(
        [(1, 1, None, "A")], "uniqueID long, simulationID long, Year long, svd_state string"
    )
    with pytest.raises(Exception, match="Year is null"):
        ex.with_previous(df, ["uniqueID", "simulationID"], "Year", "svd_state").collect()


def test_surplus_year_is_an_error(spark):
    rows = [(1, s, float(s)) for s in range(1, 14)]
    df = spark.createDataFrame(rows, "id long, s int, v double")
    with pytest.raises(Exception, match="not within 1..10"):
        sm.unstack_years(df, ["id"], "s", ["v"]).collect()
    assert len(sm.unstack_years(df, ["id"], "s", ["v"], 13).columns) == 14


def test_unknown_initial_state_keeps_its_grid(spark):
    grid = spark.createDataFrame([(1, "x", "d", "s")], "point_id long, species string, decade string, scenario string")
    init = spark.createDataFrame([("x", "A"), ("x", "B")], "species string, state string")
    lookup = spark.createDataFrame([("A", 5)], "state string, stateID int")
    out = mio.cross_initial_states(grid, init, lookup)
    assert {(r["state"], r["starting_state"]) for r in out.collect()} == {("A", 5), ("B", 0)}


def test_equal_points_are_all_inside(spark):
    square = [("p", 0.0, 0.0, 2.0, 0.0), ("p", 2.0, 0.0, 2.0, 2.0), ("p", 2.0, 2.0, 0.0, 2.0), ("p", 0.0, 2.0, 0.0, 0.0)]
    edges = spark.createDataFrame(square, "poly_id string, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1.0, 1.0)] * 2 + [(1.5, 0.5), (3.0, 1.0)], "x double, y double")
    assert gr.point_in_polygon(points, edges).count() == 3
    assert gr.polygon_union_mask(points, edges, edges).count() == 3


@pytest.mark.parametrize("seed", range(4))
def test_draws_among_rows_that_differ_by_null_and_empty(spark, seed):
    df = spark.createDataFrame([(1, "A", None), (1, "A", "")], "g long, state string, v string")
    assert pr.coverage_subsample(df, ["g"], "state", 1, seed).count() == 1


@pytest.mark.parametrize("values", [[[1, 2, 3, 4], None], [[1, 2, 3], [4]], [[1, None]]])
def test_model_inputs_of_uneven_shape_are_errors(values):
    with pytest.raises(ValueError):
        dense(pa.array(values, pa.list_(pa.float64())), "float32")
    assert dense(pa.array([[1, 2], [3, 4]], pa.list_(pa.float64())), "float32").tolist() == [[1, 2], [3, 4]]


def test_missing_days_are_left_out_of_yearly_means(spark):
    days = ", ".join(f"array(1D, NULL, double('NaN'), 3D) AS {v}" for v in ("tas", "prec", "rad"))
    rows = spark.sql(f"SELECT {days}, array(CAST(NULL AS DOUBLE)) AS vpd")
    got = sm.annual_climate_means(rows).select("MAT", "Mvpd").first()
    assert tuple(got) == (2.0, None)


def test_null_groups_meet_their_center(spark):
    rows = [(g, "center", 1.0) for g in ("a", None)] + [(g, "cold-dry", 2.0) for g in ("a", None)]
    df = spark.createDataFrame(rows, "g string, edge string, csi double")
    out = niche.species_diff_to_center(df, keys=("g",)).collect()
    assert {(r["g"], r["diff_to_center"], r["n_pairs"]) for r in out} == {("a", 1.0, 1), (None, 1.0, 1)}


def test_null_groups_have_a_box(spark):
    df = spark.createDataFrame(
        [(g, float(v)) for g in ("a", None) for v in (1, 2, 3, 50)], "g string, v double"
    )
    out = niche.box_summary(df, "v", ["g"]).collect()
    assert {(r["g"], r["n"], r["median"], r["whisker_high"]) for r in out} == {
        ("a", 4, 2.5, 3.0), (None, 4, 2.5, 3.0),
    }


def test_packed_features_are_those_of_the_single_steps(spark):
    days = [f"transform(sequence(1, 365), d -> sin(id * 7 + d * {k + 1}) * {k + 3}) AS {v}"
            for k, v in enumerate(sm.VARIABLES)]
    df = spark.range(7).selectExpr("id", "id % 3 AS k", *days, "CAST(NULL AS STRING) AS features")
    steps = sm.climate_features(df.drop("features"), load_linear_model, "float64")
    want = {r["id"]: [r[n] for n in sm.feature_names()] for r in steps.collect()}
    packed = sm.packed_features(df, load_linear_model, "float64")
    assert packed.columns == ["id", "k", "features"]
    got = {r["id"]: r["features"] for r in packed.repartition(3).collect()}
    assert got.keys() == want.keys()
    for i, values in want.items():
        assert got[i] == pytest.approx(values, abs=1e-9)


def test_packed_features_of_missing_days(spark):
    day = "transform(sequence(1, 365), d -> IF(d <= 31, double('NaN'), 2D))"
    df = spark.sql(f"SELECT 1 AS id, {day} AS tas, {day} AS prec, {day} AS rad, {day} AS vpd")
    got = dict(zip(sm.feature_names(), sm.packed_features(df, load_linear_model).first()["features"]))
    assert got["MAT"] == 2 and got["tas_month1"] is None and got["prec_month2"] == 2
    short = df.withColumn("rad", F.slice("rad", 1, 9))
    with pytest.raises(Exception, match="365"):
        sm.packed_features(short, load_linear_model).collect()
    assert sm.packed_features(df.limit(0), load_linear_model).collect() == []


def test_samples_from_daily_arrays(spark):
    """Through the model: a window with a missing feature is left out, names and ids are there."""
    day = "transform(sequence(1, 365), d -> IF(sim = 2 AND y = 3 AND d <= 31, double('NaN'), y * 1D))"
    sims = spark.sql(
        f"SELECT 's' AS scenario, 1 AS uniqueID, sim AS simulationID, 2000 + y AS Year, {day} AS tas, "
        f"{day} AS prec, {day} AS rad, {day} AS vpd FROM (SELECT explode(sequence(0, 9)) AS y) "
        "CROSS JOIN (SELECT explode(array(1, 2)) AS sim)"
    )
    ex = spark.createDataFrame([("s", 1, 1, 2000, 5), ("s", 1, 2, 2000, 5)],
                               "scenario string, uniqueID int, simulationID int, Year int, grid_id int")
    wide = assembly.build_training_samples(ex, sims, load_linear_model, dtype="float64")
    assert len(wide.columns) == len(ex.columns) + 1 + 520
    rows = wide.collect()
    assert [(r["exampleID"], r["gridID"], r["Year"]) for r in rows] == [("s:1:1:2000", 5, 2000)]
    assert [rows[0][f"tas_month7_{s}"] for s in range(1, 11)] == [float(y) for y in range(10)]


def test_days_go_to_their_places(spark):
    """Gaps and nulls are 0, days 366 and null drop, a key without a kept day stays; no day is
    searched for."""
    rows = [(1, 365, 4.0), (1, 2, 3.0), (1, 366, 9.0), (1, 5, None), (2, 366, 1.0), (None, 1, 7.0),
            (3, None, 8.0)]
    days = spark.createDataFrame(rows, "id long, doy int, tas double").selectExpr(
        "*", "tas + 1 AS prec", "tas + 2 AS rad", "tas + 3 AS vpd"
    )
    out = dense_days(days, ["id"], "doy")
    got = {r["id"]: r for r in out.collect()}
    want = {1: {1: 3.0, 364: 4.0}, 2: {}, 3: {}, None: {0: 7.0}}
    assert got.keys() == want.keys()
    for k, seen in want.items():
        for j, v in enumerate(sm.VARIABLES):
            assert got[k][v] == [seen[i] + j if i in seen else 0.0 for i in range(365)]
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert "element_at" not in plan and "MapInArrow" in plan


def test_climate_features_take_one_pass(spark):
    """The same as the single steps, without lambdas over the days in the plan."""
    days = [f"transform(sequence(1, 365), d -> IF(d = 40 * id, {'1D' if v == 'tas' else '2D'}, cos(id + d * {k + 1}))) AS {v}"
            for k, v in enumerate(sm.VARIABLES)]
    df = spark.range(1, 4).selectExpr("id", *days).localCheckpoint()
    means = sm.monthly_climate_means(sm.annual_climate_means(df))
    ready = sm.constant_site(sm.climate_cube(means)).drop(*sm.VARIABLES, *sm.SITE)
    steps = sm.compress_climate(ready, load_linear_model, "float64")
    out = sm.climate_features(df, load_linear_model, "float64")
    assert out.columns == steps.columns
    want = {r["id"]: list(r) for r in steps.collect()}
    assert {r["id"]: pytest.approx(list(r), abs=1e-9) for r in out.collect()} == want
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert "lambda" not in plan


def test_rounding_by_whole_numbers(spark):
    values = [0.1234565, -0.1234565, -1e-7, 2.5e-7, 1e9, -3e12 - 1 / 3, 123456789.1234567, 0.0, None,
              float("nan"), float("inf"), float("-inf"), 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double").localCheckpoint()
    out = r6(df.select("v", F.round(F.col("v") + 1e-9, 6).alias("want")), "v")
    assert {repr(r["v"]) for r in out.collect()} == {repr(r["want"]) for r in out.collect()}
    assert all(repr(r["v"]) == repr(r["want"]) for r in out.collect())
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert "rint" in plan
