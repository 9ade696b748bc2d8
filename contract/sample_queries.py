"""Climate features and ten-year samples."""

from pyspark.sql import functions as F

from standflow.operators import samples as sm
from standflow.plans import assembly

from .bindings import (
    climate, enriched_examples, load_linear_model, query, shared, table, timeline,
)

KEYS = ["point_id", "year"]


def r6(df, *cols):
    """Rounded to six places. Means over 30 days of decimals often end in a five there; a billionth,
    here and in the SQL, keeps such a tie from going by the order of the sum. Up to a thousand
    million the millionths are a whole number that a double holds, so no decimal is built."""

    def rounded(x):
        whole = F.rint(x * 1e6) / 1e6 + 0.0  # no negative zero
        return F.when(F.abs(x) < 1e9, whole).otherwise(F.round(x, 6))

    return df.withColumns({c: rounded(F.col(c) + 1e-9) for c in cols})


_MONTH_ENDS = "[31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334, 365]"
_MONTH = f"1 + len(list_filter({_MONTH_ENDS}, lambda e: doy > e))"


def climate_point(spark, d, key: str):
    """The supplier whose climate a simulation or point has."""
    return F.col(key) % table(spark, d, "supplier").count()


_POINT = "{key} % (SELECT count(*) FROM supplier)"


def sims(spark, d):
    """Yearly climate of each simulation: point and climate year repeat."""
    years = timeline(spark, d).select("uniqueID", "simulationID", "Year")
    keyed = years.withColumn("point_id", climate_point(spark, d, "simulationID")).withColumn(
        "year_c", 1995 + F.col("Year") % 7
    )
    scenario = enriched_scenario(F.col("simulationID"))
    return keyed.withColumn("scenario", scenario)


def sim_days(spark, d):
    """Daily climate of each simulation year."""
    days = climate(spark, d).withColumnRenamed("year", "year_c")
    return sims(spark, d).join(days, ["point_id", "year_c"]).drop("point_id", "year_c")


def enriched_scenario(sim):
    from .bindings import SCENARIOS

    return F.element_at(F.array(*[F.lit(s) for s in SCENARIOS]), (sim % 3 + 1).cast("int"))


def sim_features(spark, d, features):
    """Features are computed on the distinct climate rows and then joined to the simulations."""
    yearly = sm.climate_features(climate(spark, d), load_linear_model, "float64")
    yearly = yearly.select("point_id", F.col("year").alias("year_c"), *features)
    return sims(spark, d).join(yearly, ["point_id", "year_c"]).drop("point_id", "year_c")


_TIMELINE = f"""(SELECT *, {_POINT.format(key='simulationID')} AS cell, 1995 + "Year" % 7 AS year_c
              FROM {{b_timeline}})"""
_SCEN = """CASE t.simulationID % 3 WHEN 0 THEN 'ICHEC-EC-EARTH_historical'
           WHEN 1 THEN 'MPI-M-MPI-ESM-LR_rcp_8_5' ELSE 'NCC-NorESM1-M_rcp_4_5' END"""
# rows of the years after each example, with the climate of that year
_ATTACHED = f"""
    SELECT e.*, e.Year AS example_year, t.Year AS sim_year, c.mat
    FROM {{b_examples}} e
    JOIN {_TIMELINE} t ON t.uniqueID = e.uniqueID AND t.simulationID = e.simulationID
                       AND t.Year BETWEEN e.Year AND e.Year + 9
    JOIN (SELECT point_id, year, avg(tas) AS mat FROM {{b_climate}} GROUP BY ALL) c
      ON c.point_id = t.cell AND c.year = t.year_c"""
_EX_KEYS = ["scenario", "uniqueID", "simulationID", "example_year"]


def attached(spark, d):
    ex = enriched_examples(spark, d).select(
        "scenario", "uniqueID", "simulationID", "Year", "svd_state", "target_state", "WHC"
    )
    return sm.attach_years(ex, sim_features(spark, d, ["MAT"]))


@query("attach_years", """
    SELECT scenario, uniqueID, simulationID, example_year, sim_year AS "Year", svd_state,
           target_state, WHC, round(mat + 1e-9, 6) AS "MAT" FROM (""" + _ATTACHED + ") a")
def _(spark, d):
    return r6(attached(spark, d), "MAT")


@query("complete_windows", """
    SELECT scenario, uniqueID, simulationID, example_year, "Year", svd_state, target_state, WHC,
           round(mat + 1e-9, 6) AS "MAT"
    FROM (SELECT * REPLACE (sim_year AS "Year"), count(*) OVER (PARTITION BY simulationID, example_year) AS n
          FROM (""" + _ATTACHED + """) a WHERE WHC IS NOT NULL) b
    WHERE n = 10""")
def _(spark, d):
    return r6(sm.complete_windows(attached(spark, d), _EX_KEYS), "MAT")


@query("annual_climate_means", """
    SELECT point_id, year, round(avg(tas) + 1e-9, 6) AS "MAT", round(avg(prec) + 1e-9, 6) AS "ANP",
           round(avg(rad) + 1e-9, 6) AS "Mrad", round(avg(vpd) + 1e-9, 6) AS "Mvpd"
    FROM {b_climate} GROUP BY ALL""")
def _(spark, d):
    names = list(sm.ANNUAL_NAMES.values())
    return r6(sm.annual_climate_means(climate(spark, d)).select(*KEYS, *names), *names)


@query("monthly_climate_means", "SELECT point_id, year, " + ", ".join(
    f"round(avg({v}) FILTER (m = {m}) + 1e-9, 6) AS {v}_month{m}"
    for v in ("tas", "prec") for m in range(1, 13)
) + f" FROM (SELECT *, {_MONTH} AS m FROM {{b_climate}}) c GROUP BY point_id, year")
def _(spark, d):
    names = [f"{v}_month{m}" for v in ("tas", "prec") for m in range(1, 13)]
    return r6(sm.monthly_climate_means(climate(spark, d)).select(*KEYS, *names), *names)


@query("climate_cube", """
    SELECT point_id, year, doy, round(tas / 10 + 1e-9, 6) AS tas, round(prec / 3 + 1e-9, 6) AS prec,
           round(rad / 20 + 1e-9, 6) AS rad, round(vpd / 1 + 1e-9, 6) AS vpd
    FROM {b_climate}""")
def _(spark, d):
    # a cube is never empty; asked for one that isn't, Spark would work out each cube twice
    cube = sm.climate_cube(climate(spark, d))
    cube = cube.select(*KEYS, F.posexplode_outer("cube").alias("i", "v"))
    values = [F.col("v")[i].alias(n) for i, n in enumerate(sm.VARIABLES)]
    days = cube.select(*KEYS, (F.col("i") + 1).cast("bigint").alias("doy"), *values)
    return r6(days, *sm.VARIABLES)


@query("constant_site", """
    SELECT c_custkey, 70.0::DOUBLE AS nitrogen, 90.0::DOUBLE AS depth, 45.0::DOUBLE AS "pctSand",
           30.0::DOUBLE AS "pctSilt", 25.0::DOUBLE AS "pctClay",
           round(0.7 + 0.9 + 0.45 + 0.3 + 0.25 + 1e-9, 6)::DOUBLE AS site_sum
    FROM customer""")
def _(spark, d):
    out = sm.constant_site(table(spark, d, "customer").select("c_custkey"))
    total = F.aggregate("site", F.lit(0.0), lambda a, v: a + v)
    return r6(out.withColumn("site_sum", total).drop("site"), "site_sum")


def _comp(i: int) -> str:
    var, scale = (("tas", 10), ("prec", 3), ("rad", 20), ("vpd", 1))[(i - 1) % 4]
    return f"avg({var}) / {scale} * {i} / 10"


def _npp(i: int) -> str:
    return f"avg(tas) / 10 * {i} / 10 + 2.6 * {i} / 100"


@query("compress_climate", "SELECT point_id, year, " + ", ".join(
    [f"round({_comp(i)} + 1e-9, 6) AS comp_clim_{i}" for i in range(1, 15)]
    + [f"round({_npp(i)} + 1e-9, 6) AS npp_{i}" for i in range(1, 11)]
) + " FROM {b_climate} GROUP BY point_id, year")
def _(spark, d):
    ready = sm.constant_site(sm.climate_cube(climate(spark, d))).select(*KEYS, "cube", "site")
    out = sm.compress_climate(ready, load_linear_model, "float64")
    return r6(out, *[c for c in out.columns if c not in KEYS])


@query("sequence_within_example", """
    SELECT scenario, simulationID, example_year, sim_year AS "Year",
           row_number() OVER (PARTITION BY simulationID, example_year ORDER BY sim_year) AS s
    FROM (""" + _ATTACHED + ") a")
def _(spark, d):
    out = sm.sequence_within_example(attached(spark, d), _EX_KEYS, "Year")
    return out.select("scenario", "simulationID", "example_year", "Year",
                      F.col("s").cast("bigint").alias("s"))


_WIDE = ", ".join(
    f"round(max({e}) FILTER (s = {s}) + 1e-9, 6) AS {c}_{s}"
    for c, e in (("MAT", "mat"), ("sim_year", "sim_year::DOUBLE")) for s in range(1, 11)
)


@query("unstack_years", f"""
    SELECT simulationID, example_year, {_WIDE}
    FROM (SELECT *, row_number() OVER (PARTITION BY simulationID, example_year ORDER BY sim_year)
                 AS s FROM ({_ATTACHED}) a) b
    GROUP BY simulationID, example_year""")
def _(spark, d):
    rows = sm.sequence_within_example(attached(spark, d), _EX_KEYS, "Year")
    keys = ["simulationID", "example_year"]
    wide = sm.unstack_years(
        rows.withColumn("sim_year", F.col("Year").cast("double")), keys, "s", ["MAT", "sim_year"]
    )
    return r6(wide, *[c for c in wide.columns if c not in keys])


@query("select_feature_columns", """
    SELECT point_id, year, round(avg(tas) + 1e-9, 6) AS "MAT",
           round(avg(prec) FILTER (doy <= 31) + 1e-9, 6) AS prec_month1,
           round(avg(prec) FILTER (doy > 334) + 1e-9, 6) AS prec_month12
    FROM {b_climate} GROUP BY ALL""")
def _(spark, d):
    c = sm.monthly_climate_means(sm.annual_climate_means(climate(spark, d)))
    out = sm.select_feature_columns(c, KEYS, ["MAT", "prec_month"]).select(
        *KEYS, "MAT", "prec_month1", "prec_month12"
    )
    return r6(out, "MAT", "prec_month1", "prec_month12")


@query("drop_unused_columns", """
    SELECT CAST(ID AS INTEGER) AS "ID", uniqueID, Lon, Lat FROM {b_metadata}""")
def _(spark, d):
    return sm.drop_unused_columns(shared(spark, d, "b_metadata"), casts={"ID": "int"})


_MONTH_BEGINS = [1 + sum(sm.DAYS_IN_MONTH[:m]) for m in range(13)]
_FEATURES = {n: f"avg({v})" for v, n in sm.ANNUAL_NAMES.items()} | {
    f"{v}_month{m + 1}":
        f"avg({v}) FILTER (doy BETWEEN {_MONTH_BEGINS[m]} AND {_MONTH_BEGINS[m + 1] - 1})"
    for v in sm.MONTHLY_VARIABLES for m in range(12)
} | {f"comp_clim_{i}": _comp(i) for i in range(1, 15)} | {
    f"npp_{i}": _npp(i) for i in range(1, 11)
}
_YEARLY = ("SELECT point_id, year, " + ", ".join(f"{e} AS {c}" for c, e in _FEATURES.items())
           + " FROM {b_climate} GROUP BY point_id, year")
_SPREAD = ", ".join(
    f"round(max({c}) FILTER (s = {s}) + 1e-9, 6) AS {c}_{s}" for c in _FEATURES for s in range(1, 11)
)


@query("build_training_samples", f"""
    WITH yearly AS MATERIALIZED ({_YEARLY})
    SELECT concat_ws(':', scenario, uniqueID, simulationID, example_year) AS "exampleID",
           grid_id AS "gridID", scenario, uniqueID, simulationID, example_year AS "Year", svd_state,
           target_state, residence_time, target_time, hist_state1, hist_time1, WHC, {_SPREAD}
    FROM (SELECT e.*, e.Year AS example_year, c.*,
                 row_number() OVER (PARTITION BY e.simulationID, e.Year ORDER BY t.Year) AS s,
                 count(*) OVER (PARTITION BY e.simulationID, e.Year) AS n
          FROM {{b_examples}} e
          JOIN {_TIMELINE} t ON t.simulationID = e.simulationID
                             AND t.Year BETWEEN e.Year AND e.Year + 9
          JOIN yearly c ON c.point_id = t.cell AND c.year = t.year_c
          WHERE WHC IS NOT NULL) a
    WHERE n = 10
    GROUP BY scenario, uniqueID, simulationID, example_year, grid_id, svd_state, target_state,
             residence_time, target_time, hist_state1, hist_time1, WHC""")
def _(spark, d):
    ex = enriched_examples(spark, d).select(
        "scenario", "uniqueID", "simulationID", "grid_id", "Year", "svd_state", "target_state",
        "residence_time", "target_time", "hist_state1", "hist_time1", "WHC",
    )
    out = assembly.build_training_samples(
        ex, sim_days(spark, d), load_linear_model, dtype="float64"
    )
    return r6(out, *[f"{c}_{s}" for c in _FEATURES for s in range(1, 11)])


# ten years of a point: years of the climate table, which repeat after seven
@query("prepare_prediction_input", f"""
    WITH yearly AS MATERIALIZED ({_YEARLY})
    SELECT point_id, wgs_x, wgs_y, whc_extract, sand_extract, depth_extract, r_nitro, {_SPREAD}
    FROM (SELECT m.ID AS point_id, Lon AS wgs_x, Lat AS wgs_y, WHC AS whc_extract,
                 TextureSand AS sand_extract, SoilDepth AS depth_extract,
                 CASE WHEN m.ID % 11 = 0 THEN NULL ELSE AvailableNitrogen END AS r_nitro,
                 k.s, y.* EXCLUDE (point_id)
          FROM (SELECT *, {_POINT.format(key='ID')} AS cell FROM {{b_metadata}}) m
          CROSS JOIN (SELECT unnest(range(1, 11)) AS s) k
          JOIN yearly y ON y.point_id = m.cell AND y.year = 1995 + (2070 + k.s) % 7) a
    GROUP BY point_id, wgs_x, wgs_y, whc_extract, sand_extract, depth_extract, r_nitro""")
def _(spark, d):
    points = shared(spark, d, "b_metadata").select(
        F.col("ID").alias("point_id"), F.col("Lon").alias("wgs_x"), F.col("Lat").alias("wgs_y"),
        F.col("WHC").alias("whc_extract"), F.col("TextureSand").alias("sand_extract"),
        F.col("SoilDepth").alias("depth_extract"),
        F.when(F.col("ID") % 11 != 0, F.col("AvailableNitrogen")).alias("r_nitro"),
        climate_point(spark, d, "ID").alias("cell"),
        F.explode(F.sequence(F.lit(2071), F.lit(2080))).alias("year"),
    )
    days = climate(spark, d).withColumnsRenamed({"point_id": "cell", "year": "year_c"})
    grid = points.withColumn("year_c", 1995 + F.col("year") % 7).join(days, ["cell", "year_c"])
    out = assembly.prepare_prediction_input(
        grid.drop("cell", "year_c"), load_linear_model, dtype="float64"
    )
    return r6(out, *[f"{c}_{s}" for c in _FEATURES for s in range(1, 11)])
