"""The study's input tables, derived from the driver tables (see FIXTURES.md).

Most bindings are one SQL text that both engines run: `{name}` stands for a driver table or
another binding. Those that number rows or gather arrays have a Spark form of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from standflow.functions.scans import blocked_row_number
from standflow.operators import samples as sm
from standflow.plans import extraction
from standflow.session import materialise

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SPECIES = (
    "Fagus_sylvatica", "Pinus_sylvestris", "Abies_alba", "Picea_abies", "Larix_decidua",
    "Betula_pendula", "Pinus_halepensis", "Quercus_robur", "Quercus_ilex",
)
CODES = ("fasy", "pisy", "abal", "piab", "lade", "bepe", "piha", "quro", "quil")
DECADES = ("1981-1990", "1991-2000", "2001-2010", "2071-2080", "2081-2090", "2091-2100")
SCENARIOS = ("ICHEC-EC-EARTH_historical", "MPI-M-MPI-ESM-LR_rcp_8_5", "NCC-NorESM1-M_rcp_4_5")
SOURCES = ("ICHEC-EC-EARTH", "MPI-M-MPI-ESM-LR", "NCC-NorESM1-M")
EDGES = ("center", "cold_dry", "cold_wet", "warm_dry", "warm_wet")
COMPOSITIONS40 = ("PIAB", "PIABfasy", "FASYpiab", "piabfasy", "ABALpiabfasy")

UNIT = ["uniqueID", "simulationID"]
ROWS = 256


def case(expr: str, values) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


def div(a: str, b) -> str:
    return f"CAST(floor(({a}) / {b}) AS BIGINT)"


def state40(k: str) -> str:
    return (
        f"{case(div(k, 8), COMPOSITIONS40)} || '_' || CAST(1 + ({k}) % 3 AS STRING) || '_' || "
        f"CAST(2 * (({k}) % 8) AS STRING) || '_' || CAST(2 * (({k}) % 8) + 2 AS STRING)"
    )


N_POINTS = "(SELECT CAST(floor(count(*) / 5) AS BIGINT) FROM {part})"

SHARED = {
    "b_state": f"""
        SELECT p_partkey, p_size,
               CASE WHEN p_partkey % 2 = 0 THEN upper(t1) ELSE t1 END || t2 || t3 AS composition,
               1 + p_size % 6 AS lai, 2 * (p_size % 12) AS hmin,
               CASE WHEN p_partkey % 2 = 0 THEN upper(t1) ELSE t1 END || t2 || t3 || '_'
               || CAST(1 + p_size % 6 AS STRING) || '_' || CAST(2 * (p_size % 12) AS STRING) || '_'
               || CAST(2 * (p_size % 12) + 2 AS STRING) AS state
        FROM (SELECT p_partkey, p_size, {case('p_partkey % 9', CODES)} AS t1,
                     CASE WHEN p_size % 3 >= 1
                          THEN {case('(' + div('p_partkey', 9) + ' + 1) % 9', CODES)}
                          ELSE '' END AS t2,
                     CASE WHEN p_size % 3 = 2
                          THEN {case('(' + div('p_partkey', 81) + ' + 2) % 9', CODES)}
                          ELSE '' END AS t3
              FROM {{part}}) parts""",
    "b_metadata": """
        SELECT c_custkey AS ID, c_custkey % 10 AS uniqueID, c_acctbal AS WHC,
               CAST(c_custkey % 100 AS DOUBLE) AS TextureSand,
               CAST(100 * (1 + c_nationkey) AS DOUBLE) AS SoilDepth,
               CAST(c_custkey % 50 AS DOUBLE) AS AvailableNitrogen,
               CAST((c_custkey % 40) * 0.5 AS DOUBLE) AS Lon,
               CAST(40 + (floor(c_custkey / 40) % 50) * 0.5 AS DOUBLE) AS Lat
        FROM {customer}""",
    "b_predictions": f"""
        SELECT CAST(l_partkey % {N_POINTS} AS BIGINT) AS point_id,
               {case('l_partkey % 9', SPECIES)} AS species, a.state AS state,
               CASE l_linenumber % 4 WHEN 0 THEN b.composition WHEN 3 THEN lower(a.composition)
                    ELSE a.composition END || '_' || CAST(1 + (a.p_size + l_suppkey) % 6 AS STRING)
               || '_' || CAST(greatest(0, a.hmin + 2 * (l_orderkey % 3 - 1)) AS STRING) || '_'
               || CAST(greatest(0, a.hmin + 2 * (l_orderkey % 3 - 1)) + 2 AS STRING)
               AS pred_state_1,
               {case('l_suppkey % 3', SOURCES)} AS source,
               {case('l_suppkey % 3', ('ichec', 'mpi', 'ncc'))} AS scen,
               CASE WHEN (year(l_shipdate) - 1995) % 6 < 3 THEN 'historical'
                    WHEN l_returnflag = 'A' THEN 'rcp_8_5' WHEN l_returnflag = 'N' THEN 'rcp_4_5'
                    ELSE 'rcp_2_6' END AS rcp,
               {case('(year(l_shipdate) - 1995) % 6', DECADES)} AS timestep,
               CAST(1 + (CAST(l_quantity AS BIGINT) + 1 * l_linenumber) % 10 AS BIGINT)
               AS time_index_1,
               CAST(1 + (CAST(l_quantity AS BIGINT) + 2 * l_linenumber) % 10 AS BIGINT)
               AS time_index_2,
               CAST(1 + (CAST(l_quantity AS BIGINT) + 3 * l_linenumber) % 10 AS BIGINT)
               AS time_index_3,
               CAST(0.5 + l_discount AS DOUBLE) AS time_proba_1,
               CAST(0.1 + l_tax AS DOUBLE) AS time_proba_2,
               CAST(0.05 AS DOUBLE) AS time_proba_3,
               CAST(0.5 + l_discount AS DOUBLE) AS state_proba_1,
               l_orderkey, l_linenumber
        FROM {{lineitem}} l
        JOIN {{b_state}} a ON a.p_partkey = l.l_partkey
        JOIN {{b_state}} b ON b.p_partkey = (l.l_partkey + 1) % (SELECT count(*) FROM {{part}})""",
    "b_edges": f"""
        SELECT CAST(c_custkey % {N_POINTS} AS BIGINT) AS point_id,
               {case('c_custkey % 5', EDGES)} AS edge, {case('c_nationkey % 9', SPECIES)} AS species,
               CAST(c_acctbal / 500 AS DOUBLE) AS MAT_avg, CAST(c_custkey % 97 AS DOUBLE) AS ANP_avg
        FROM {{customer}}""",
    "b_grid": """
        SELECT c_custkey AS point_id, CAST((c_custkey % 40) * 0.5 AS DOUBLE) AS x,
               CAST(40 + floor(c_custkey / 40) * 0.5 AS DOUBLE) AS y, c_custkey % 40 AS ix,
               CAST(floor(c_custkey / 40) AS BIGINT) AS iy,
               CASE WHEN c_nationkey = 7 THEN NULL ELSE CAST(1 + (c_custkey * 7) % 20 AS INT) END
               AS class
        FROM {customer}""",
    "b_paths": f"""
        SELECT s_suppkey,
               CASE WHEN s_suppkey % 7 = 3 THEN '/data/pred/notes_' || CAST(s_suppkey AS STRING)
               || '.txt' ELSE '/data/pred/' || {case('s_suppkey % 3', ('prep_', 'pred_', ''))}
               || {case('s_suppkey % 9', SPECIES)} || '_' || {case('s_nationkey % 6', DECADES)}
               || '_' || {case('s_suppkey % 3', SCENARIOS)} || '_all_grids_v8.parquet' END AS path
        FROM {{supplier}}""",
}

_TIMELINE_COLUMNS = f"""
    SELECT user_id % 10 AS uniqueID, user_id AS simulationID, Year,
           {state40('(' + div('Year - 1951', '(3 + user_id % 23)') + ' + user_id) % 40')} AS svd_state,
           event_type AS raw_state"""

DUCK_ONLY = {
    "b_timeline": _TIMELINE_COLUMNS + """
        FROM (SELECT user_id, event_type,
                     1950 + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS Year
              FROM {events}) e""",
    "b_climate": """
        SELECT k.point_id, k.year, d.doy, coalesce(tas, 0) AS tas, coalesce(prec, 0) AS prec,
               coalesce(rad, 0) AS rad, coalesce(vpd, 0) AS vpd
        FROM (SELECT DISTINCT l_suppkey AS point_id, year(l_shipdate) AS year FROM {lineitem}) k
        CROSS JOIN (SELECT unnest(range(1, 366)) AS doy) d
        LEFT JOIN (SELECT l_suppkey AS point_id, year(l_shipdate) AS year,
                          dayofyear(l_shipdate) AS doy, avg(l_quantity) AS tas,
                          avg(l_extendedprice) / 1000 AS prec, avg(100 * l_discount) AS rad,
                          avg(100 * l_tax) AS vpd
                   FROM {lineitem} GROUP BY ALL) v
          ON v.point_id = k.point_id AND v.year = k.year AND v.doy = d.doy""",
    # timeline rows with position, change mark and run number
    "t_rows": """
        SELECT *, CASE WHEN prev <> svd_state THEN 1 ELSE 0 END AS chg,
               sum(CASE WHEN prev <> svd_state THEN 1 ELSE 0 END)
               OVER (PARTITION BY simulationID ORDER BY Year) AS run
        FROM (SELECT *, lag(svd_state) OVER w AS prev, row_number() OVER w AS pos
              FROM {b_timeline} WINDOW w AS (PARTITION BY simulationID ORDER BY Year)) t""",
    # first other state among the next nine, spelled out year by year
    "t_targets": """
        SELECT uniqueID, simulationID, Year, svd_state, run,
               coalesce(prev, svd_state) AS previous_year_state,
               CAST(row_number() OVER (PARTITION BY simulationID, run ORDER BY Year) AS INT)
               AS residence_time,
               CASE """ + " ".join(f"WHEN n{i} <> svd_state THEN n{i}" for i in range(1, 10)) + """
                    WHEN n9 IS NOT NULL THEN svd_state END AS target_state,
               CAST(CASE """ + " ".join(f"WHEN n{i} <> svd_state THEN {i}" for i in range(1, 10))
    + """ WHEN n9 IS NOT NULL THEN 10 END AS INT) AS target_time
        FROM (SELECT *, """ + ", ".join(
        f"lead(svd_state, {i}) OVER (PARTITION BY simulationID ORDER BY Year) AS n{i}"
        for i in range(1, 10)
    ) + """ FROM {t_rows}) t""",
    "t_kept": """
        SELECT * FROM (
          SELECT *, CASE WHEN run = 0 AND residence_time % 10 = 0 THEN 1
                         WHEN run > 0 AND residence_time % 10 = 1 THEN 1 ELSE 0 END AS flag
          FROM {t_targets}) f
        WHERE flag = 1 AND target_time IS NOT NULL""",
    "t_examples": """
        SELECT uniqueID, simulationID, Year, svd_state, previous_year_state, residence_time,
               target_state, target_time, flag, """ + ", ".join(
        f"coalesce(lag(svd_state, {k}) OVER w, 'missing') AS hist_state{k}" for k in (1, 2, 3)
    ) + ", " + ", ".join(
        f"coalesce(lag(residence_time, {k}) OVER w, 0) AS hist_time{k}" for k in (1, 2, 3)
    ) + """ FROM {t_kept} WINDOW w AS (PARTITION BY simulationID ORDER BY Year)""",
    "b_examples": f"""
        SELECT e.*, WHC, TextureSand, SoilDepth, AvailableNitrogen, Lon, Lat,
               e.simulationID % 7 AS grid_id,
               {case('e.simulationID % 3', SCENARIOS)} AS scenario
        FROM {{t_examples}} e LEFT JOIN {{b_metadata}} m
          ON m.uniqueID = e.uniqueID AND m.ID = e.simulationID""",
    # rates per prediction row
    "g_parsed": """
        SELECT *, split_part(state, '_', 1) AS sp_init, split_part(pred_state_1, '_', 1) AS sp_pred,
               CAST(split_part(state, '_', 2) AS INT) AS lai_init,
               CAST(split_part(pred_state_1, '_', 2) AS INT) AS lai_pred,
               CAST(split_part(state, '_', 4) AS INT) AS height_init,
               CAST(split_part(pred_state_1, '_', 4) AS INT) AS height_pred,
               (time_index_1 * time_proba_1 + time_index_2 * time_proba_2
                + time_index_3 * time_proba_3)
               / (time_proba_1 + time_proba_2 + time_proba_3) AS t
        FROM {b_predictions}""",
    "g_rates": """
        SELECT *, state AS init_state,
               CASE WHEN strpos(sp_pred, sp_init) > 0 THEN 1 ELSE 0 END AS veg_same,
               CASE WHEN strpos(sp_pred, sp_init) > 0 THEN lai_pred - lai_init ELSE 0 END / t
               AS lai_diff,
               CASE WHEN strpos(sp_pred, sp_init) > 0 THEN sign(height_pred - height_init)
                    ELSE 0 END / t AS growth,
               CASE WHEN strpos(sp_pred, substr(sp_init, 1, 4)) > 0 THEN 0
                    WHEN strpos(sp_pred, lower(substr(sp_init, 1, 4))) > 0 THEN 1
                    WHEN strpos(sp_pred, upper(substr(sp_init, 5, 4))) > 0
                         OR substr(sp_init, 5, 4) = '' THEN 1 END AS veg_diff
        FROM {g_parsed}""",
    "g_all": """
        SELECT g.* EXCLUDE (rcp), r.rcp FROM {g_rates} g
        JOIN (SELECT unnest(['rcp_8_5', 'rcp_4_5', 'rcp_2_6']) AS rcp) r
          ON g.rcp = r.rcp OR g.rcp = 'historical'""",
}
_BASE = "('1981-1990', '1991-2000', '2001-2010', '1981-2010')"


def _net_sql(var: str, indicator: str, sign: str = "") -> str:
    return f"""
        SELECT point_id, count(*) FILTER (d < 0) AS net_negative,
               count(*) FILTER (d > 0) AS net_positive, avg(d) AS diff, count(*) AS "sum",
               (count(*) FILTER (d > 0) - count(*) FILTER (d < 0)) / count(*) * 100 AS net_change,
               '{indicator}' AS indicator, rcp, species
        FROM (SELECT f.*, round({sign}(f.v - b.v), 10) AS d
              FROM (SELECT species, rcp, point_id, init_state, scen, avg({var}) AS v FROM {{g_all}}
                    WHERE timestep NOT IN {_BASE} GROUP BY ALL) f
              LEFT JOIN (SELECT species, rcp, point_id, init_state, scen, avg({var}) AS v
                         FROM {{g_all}} WHERE timestep IN {_BASE} GROUP BY ALL) b
                USING (species, rcp, point_id, init_state, scen)) x
        GROUP BY species, rcp, point_id"""


DUCK_ONLY |= {
    "g_lai": _net_sql("lai_diff", "1"),
    "g_hei": _net_sql("growth", "2"),
    "g_dom": _net_sql("veg_diff", "1", "-"),
    "g_csi": """
        SELECT l.species, l.rcp, l.point_id, l.diff AS diff_lai, l.net_change AS net_change_lai,
               h.diff AS diff_hei, h.net_change AS net_change_hei,
               (l.net_change + h.net_change) / 2 AS csi
        FROM {g_lai} l LEFT JOIN {g_hei} h USING (species, rcp, point_id)""",
    "n_edges": """
        SELECT point_id, edge, species, avg(MAT_avg) AS MAT_avg, avg(ANP_avg) AS ANP_avg
        FROM {b_edges} GROUP BY ALL""",
    "n_rows": """
        SELECT c.species, c.point_id, c.rcp, c.csi, e.edge, e.MAT_avg, e.ANP_avg,
               CASE WHEN c.species IN ('Fagus_sylvatica', 'Quercus_robur', 'Betula_pendula',
                                       'Quercus_ilex') THEN 'broadleaved' ELSE 'coniferous' END
               AS sp_group
        FROM {g_csi} c JOIN {n_edges} e USING (species, point_id) WHERE c.csi IS NOT NULL""",
}


def _duck_texts() -> dict[str, str]:
    return {**SHARED, **DUCK_ONLY}


def duck(body: str) -> str:
    """The body with every binding it uses as a common table expression before it."""
    texts = _duck_texts()
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{([a-z]\w*)\}", text):
            if name in texts and name not in ordered:
                visit(texts[name])
                ordered.append(name)

    visit(body)
    plain = lambda t: re.sub(r"\{([a-z]\w*)\}", r"\1", t)
    ctes = [f"{n} AS ({plain(texts[n])})" for n in ordered]
    recursive = "RECURSIVE " if "{recursive}" in body else ""
    body = plain(body.replace("{recursive}", ""))
    if not ctes:
        return f"WITH {recursive}{body.lstrip()[5:]}" if recursive else body
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {recursive}" + ", ".join(ctes) + ", " + body.lstrip()[5:]
    return f"WITH {recursive}" + ", ".join(ctes) + " " + body


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def shared(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A binding from its SQL text."""

    def source(match) -> str:
        n = match.group(1)
        if n in SHARED:
            return "(" + re.sub(r"\{([a-z]\w*)\}", source, SHARED[n]) + ")"
        return f"parquet.`{d}/{n}.parquet`"

    return spark.sql(re.sub(r"\{([a-z]\w*)\}", source, SHARED[name]))


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """Years are positions in the event order, numbered in blocks of one hour."""
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    numbered = blocked_row_number(
        e, ["user_id"], F.date_trunc("hour", "ts"), ["ts", "event_id"], "__n"
    ).withColumn("Year", F.col("__n") + 1950)
    k = (
        F.floor((F.col("Year") - 1951) / (3 + F.col("user_id") % 23)) + F.col("user_id")
    ) % 40
    return numbered.select(
        (F.col("user_id") % 10).alias("uniqueID"),
        F.col("user_id").alias("simulationID"),
        "Year",
        state40_column(k).alias("svd_state"),
        F.col("event_type").alias("raw_state"),
    )


def state40_column(k):
    comp = F.element_at(
        F.array(*[F.lit(c) for c in COMPOSITIONS40]), (F.floor(k / 8) + 1).cast("int")
    )
    low = 2 * (k % 8)
    return F.concat_ws("_", comp, 1 + k % 3, low, low + 2)


def examples(spark: SparkSession, d: str) -> DataFrame:
    """Extracted examples, written as a table: the stages after extraction start from it."""
    tl = timeline(spark, d).drop("raw_state")
    return materialise(extraction.extract_examples(tl, UNIT, "Year", "svd_state"), "examples")


def enriched_examples(spark: SparkSession, d: str) -> DataFrame:
    site = shared(spark, d, "b_metadata").withColumnRenamed("ID", "simulationID")
    names = F.array(*[F.lit(s) for s in SCENARIOS])
    return (
        examples(spark, d)
        .join(site, UNIT, "left")
        .withColumn("grid_id", F.col("simulationID") % 7)
        .withColumn(
            "scenario", F.element_at(names, (F.col("simulationID") % 3 + 1).cast("int"))
        )
    )


def climate(spark: SparkSession, d: str) -> DataFrame:
    """Daily arrays per point and year; days without a line item are 0."""
    days = (
        table(spark, d, "lineitem")
        .select(
            F.col("l_suppkey").alias("point_id"),
            F.year("l_shipdate").cast("bigint").alias("year"),
            F.dayofyear("l_shipdate").alias("doy"),
            F.col("l_quantity").alias("tas"),
            F.col("l_extendedprice").alias("prec"),
            (100 * F.col("l_discount")).alias("rad"),
            (100 * F.col("l_tax")).alias("vpd"),
        )
        .groupBy("point_id", "year", "doy")
        .agg(
            F.avg("tas").alias("tas"), (F.avg("prec") / 1000).alias("prec"),
            F.avg("rad").alias("rad"), F.avg("vpd").alias("vpd"),
        )
    )
    return dense_days(days, ["point_id", "year"], "doy")


def dense_days(days: DataFrame, keys: list[str], doy: str) -> DataFrame:
    """Arrays of 365 days from one row per day. The days of a key are put into their places in Arrow
    batches, so no day is searched for; day 366 and null days are dropped, as in the SQL."""
    entry = F.when(F.col(doy) <= sm.DAYS, F.struct(F.col(doy).alias("at"), *sm.VARIABLES))
    by_key = days.groupBy(*keys).agg(F.collect_list(entry).alias("__seen"))
    whole = T.ArrayType(T.DoubleType(), False)
    schema = T.StructType(
        [*by_key.select(*keys).schema.fields, *[T.StructField(v, whole, False) for v in sm.VARIABLES]]
    )

    def run(batches):
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            n = batch.num_rows
            seen = batch.column(len(keys))
            at, *values = seen.flatten().flatten()
            rows = np.repeat(np.arange(n), pc.list_value_length(seen).to_numpy())
            place = rows * sm.DAYS + at.to_numpy() - 1
            offsets = pa.array(np.arange(0, n * sm.DAYS + 1, sm.DAYS, dtype="int32"))
            arrays = []
            for v in values:
                full = np.zeros(n * sm.DAYS)
                full[place] = pc.fill_null(v, 0.0).to_numpy(zero_copy_only=False)
                arrays.append(pa.ListArray.from_arrays(offsets, pa.array(full)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], *arrays], names=[*keys, *sm.VARIABLES]
            )

    return by_key.mapInArrow(run, schema)


def load_linear_model():
    """Stands in for the climate model: weighted means of the scaled days plus a soil term."""

    def model(x):
        import numpy as np

        means = x["cube"].mean(axis=1)
        i = np.arange(1, sm.N_COMPRESSED + 1)
        comp = means[:, (i - 1) % 4] * (i / 10)
        j = np.arange(1, sm.N_NPP + 1)
        npp = means[:, :1] * (j / 10) + x["site"].sum(axis=1, keepdims=True) * (j / 100)
        return {"comp_clim": comp, "npp": npp}

    return model


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Listed columns rounded to six places."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


@cache
def registry() -> dict[str, tuple[Callable, str | None]]:
    return {}


def query(name: str, sql: str | None = None):
    """Register a query and the SQL text that must give the same rows."""

    def add(fn):
        registry()[name] = (fn, None if sql is None else duck(sql))
        return fn

    return add
