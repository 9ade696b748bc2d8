"""Climate-niche tables."""

from pyspark.sql import functions as F

from standflow.functions.stats import species_group
from standflow.operators import niche as nc

from .bindings import query, r6, shared
from .csi_queries import csi


def rows(spark, d):
    return nc.csi_by_edge(csi(spark, d), nc.edge_climate(shared(spark, d, "b_edges")))


def grouped(spark, d):
    return rows(spark, d).withColumn("sp_group", species_group("species"))


def pooled(spark, d):
    return nc.pooled_group_ci(nc.species_edge_ci(rows(spark, d)))


def _ci(keys: str, source: str) -> str:
    return f"""
    SELECT {keys}, m AS mean_csi, s AS sd_csi, n AS "sum", s / sqrt(n) AS se,
           m + 1.96 * (s / sqrt(n)) AS upper, m - 1.96 * (s / sqrt(n)) AS lower
    FROM (SELECT {keys}, avg(csi) AS m, stddev_samp(csi) AS s, count(*) AS n
          FROM {source} GROUP BY ALL) b"""


_GROUP_CI = _ci("edge, sp_group, rcp", "{n_rows}")
_SPECIES_CI = _ci("species, sp_group, rcp, edge", """(
    SELECT DISTINCT * REPLACE (CASE sp_group WHEN 'broadleaved' THEN 'Broadleaved'
                               ELSE 'Coniferous' END AS sp_group) FROM {n_rows})""")
_POOLED = f"""
    SELECT *, sd_group / sqrt(total_sum) AS se_group,
           mean_csi_group + 1.96 * (sd_group / sqrt(total_sum)) AS upper,
           mean_csi_group - 1.96 * (sd_group / sqrt(total_sum)) AS lower
    FROM (SELECT sp_group, rcp, edge, avg(mean_csi) AS mean_csi_group,
                 sqrt(sum(("sum" - 1) * sd_csi * sd_csi) / (sum("sum") - 1)) AS sd_group,
                 CAST(sum("sum") AS BIGINT) AS total_sum
          FROM ({_SPECIES_CI}) s GROUP BY ALL) p"""


def _rounded(cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols.split())


_CI_COLS = "mean_csi sd_csi se upper lower"
_EDGE = """CASE edge WHEN 'center' THEN 'Core' WHEN 'cold_dry' THEN 'Cold-dry edge'
           WHEN 'cold_wet' THEN 'Cold-wet edge' WHEN 'warm_dry' THEN 'Warm-dry edge'
           ELSE 'Warm-wet edge' END AS edge"""


@query("edge_climate", f"SELECT point_id, edge, species, {_rounded('MAT_avg ANP_avg')} FROM {{n_edges}}")
def _(spark, d):
    return r6(nc.edge_climate(shared(spark, d, "b_edges")), "MAT_avg", "ANP_avg")


@query("csi_by_edge", f"""
    SELECT species, point_id, rcp, edge, {_rounded('csi MAT_avg ANP_avg')} FROM {{n_rows}}""")
def _(spark, d):
    return r6(rows(spark, d), "csi", "MAT_avg", "ANP_avg")


@query("edge_group_ci", f"""
    SELECT edge, sp_group, rcp, "sum", {_rounded(_CI_COLS)} FROM ({_GROUP_CI}) g""")
def _(spark, d):
    return r6(nc.edge_group_ci(rows(spark, d)), *_CI_COLS.split())


@query("diff_to_center", f"""
    SELECT e.edge, e.sp_group, e.rcp,
           CASE WHEN e.edge LIKE 'warm%' THEN 'warm' ELSE 'cold' END AS x,
           CASE WHEN e.edge LIKE '%dry' THEN 'dry' ELSE 'wet' END AS y,
           round(e.mean_csi - c.mean_csi, 6) AS diff_to_center
    FROM ({_GROUP_CI}) e
    LEFT JOIN (SELECT * FROM ({_GROUP_CI}) k WHERE edge = 'center') c
      ON c.sp_group = e.sp_group AND c.rcp = e.rcp
    WHERE e.edge <> 'center'""")
def _(spark, d):
    return r6(nc.diff_to_center(nc.edge_group_ci(rows(spark, d))), "diff_to_center")


@query("species_edge_ci", f"""
    SELECT species, sp_group, rcp, edge, "sum", {_rounded(_CI_COLS)} FROM ({_SPECIES_CI}) g""")
def _(spark, d):
    return r6(nc.species_edge_ci(rows(spark, d)), *_CI_COLS.split())


@query("pooled_group_ci", f"""
    SELECT sp_group, rcp, edge, total_sum,
           {_rounded('mean_csi_group sd_group se_group upper lower')} FROM ({_POOLED}) g""")
def _(spark, d):
    return r6(pooled(spark, d), "mean_csi_group", "sd_group", "se_group", "upper", "lower")


def _wide(rcps, cell) -> str:
    return ", ".join(
        cell(r, g) for r in rcps for g in nc.GROUPS
    )


def _pick(value: str, r: str, g: str) -> str:
    return f"max({value}) FILTER (rcp = '{r}' AND sp_group = '{g}')"


def _number(r, g):
    return (
        f"round_even({_pick('mean_csi_group', r, g)}, 1) + 0.0 AS {r}_{g}, "
        f"round_even({_pick('se_group', r, g)}, 1) + 0.0 AS {r}_{g}_SE"
    )


def _text(r, g):
    cell = lambda v: (
        f"coalesce(printf('%.1f', round_even({_pick(v, r, g)}, 1) + 0.0), 'NA')"
    )
    return f"{cell('mean_csi_group')} || ' ±' || {cell('se_group')} AS {r}_{g}"


@query("niche_table_wide", f"""
    SELECT replace(edge, '_', '-') AS edge, {_wide(nc.RCPS, _number)}
    FROM ({_POOLED}) g GROUP BY g.edge""")
def _(spark, d):
    return nc.niche_table_wide(pooled(spark, d))


@query("niche_table_formatted", f"""
    SELECT {_EDGE.replace('CASE edge', 'CASE g.edge')}, {_wide(nc.RCPS, _text)}
    FROM ({_POOLED}) g GROUP BY g.edge""")
def _(spark, d):
    return nc.niche_table_formatted(nc.niche_table_wide(pooled(spark, d)))


@query("niche_table_two_scenarios", f"""
    SELECT {_EDGE.replace('CASE edge', 'CASE g.edge')}, {_wide(('rcp_2_6', 'rcp_8_5'), _text)}
    FROM ({_POOLED}) g GROUP BY g.edge""")
def _(spark, d):
    return nc.niche_table_two_scenarios(pooled(spark, d))


@query("bin_2d_mean", """
    SELECT species, point_id, rcp, edge, round(csi, 6) AS csi, x_bin, y_bin,
           round(bin_mean, 6) AS bin_mean, n, unique_id
    FROM (SELECT *, avg(csi) OVER (PARTITION BY x_bin, y_bin) AS bin_mean,
                 count(*) OVER (PARTITION BY x_bin, y_bin) AS n,
                 dense_rank() OVER (ORDER BY x_bin, y_bin) AS unique_id
          FROM (SELECT r.*, lo_x + floor((MAT_avg - lo_x) / 1) * 1 AS x_bin,
                       lo_y + floor((ANP_avg - lo_y) / 5) * 5 AS y_bin
                FROM {n_rows} r,
                     (SELECT floor(min(MAT_avg)) AS lo_x, floor(min(ANP_avg)) AS lo_y
                      FROM {n_rows}) m) b) c
    WHERE n > 10""")
def _(spark, d):
    x = nc.bin_2d_mean(rows(spark, d), "MAT_avg", "ANP_avg", "csi", 1.0, 5.0)
    return r6(x.select("species", "point_id", "rcp", "edge", "csi", "x_bin", "y_bin", "bin_mean",
                       "n", "unique_id"), "csi", "bin_mean")


_PAIRS = """
    SELECT e.species, e.sp_group, e.rcp, e.edge, round(e.csi - c.csi, 6) AS diff_to_center
    FROM {n_rows} e LEFT JOIN (SELECT * FROM {n_rows} WHERE edge = 'center') c
      ON c.species = e.species AND c.sp_group = e.sp_group AND c.rcp = e.rcp
    WHERE e.edge <> 'center'"""


@query("species_diff_to_center", f"""
    SELECT species, sp_group, rcp, edge, diff_to_center, count(*) AS n_pairs
    FROM ({_PAIRS}) p GROUP BY ALL""")
def _(spark, d):
    # values that differ by the order of summation only are put together
    out = nc.species_diff_to_center(grouped(spark, d))
    return r6(out, "diff_to_center").groupBy(
        "species", "sp_group", "rcp", "edge", "diff_to_center"
    ).agg(F.sum("n_pairs").alias("n_pairs"))


def _box(value: str, keys: str, source: str) -> str:
    return f"""
    SELECT {keys}, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
           round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)), 6)
           AS whisker_low,
           round(max(v) FILTER (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)), 6)
           AS whisker_high
    FROM (SELECT {keys}, v, count(*) OVER w AS n, quantile_cont(v, 0.25) OVER w AS q1,
                 quantile_cont(v, 0.5) OVER w AS median, quantile_cont(v, 0.75) OVER w AS q3
          FROM (SELECT {keys}, {value} AS v FROM {source}) a
          WHERE v IS NOT NULL WINDOW w AS (PARTITION BY {keys})) b
    GROUP BY {keys}, n, q1, median, q3"""


_BOX_COLS = ("q1", "median", "q3", "whisker_low", "whisker_high")


# one scenario is null here: its rows are groups like any others
@query("box_summary", _box(
    "csi", "rcp, sp_group, edge",
    "(SELECT * REPLACE (nullif(rcp, 'rcp_4_5') AS rcp) FROM {n_rows}) r",
))
def _(spark, d):
    named = grouped(spark, d).withColumn("rcp", F.nullif("rcp", F.lit("rcp_4_5")))
    out = nc.box_summary(named, "csi", ("rcp", "sp_group", "edge"))
    return r6(out, *_BOX_COLS)


@query("box_summary_of_differences",
       _box("diff_to_center", "rcp, sp_group, edge", f"({_PAIRS}) p"))
def _(spark, d):
    diffs = r6(nc.species_diff_to_center(grouped(spark, d)), "diff_to_center")
    out = nc.box_summary(diffs, "diff_to_center", ("rcp", "sp_group", "edge"), weight="n_pairs")
    return r6(out, *_BOX_COLS)


@query("linear_trend", """
    SELECT species, rcp, round(regr_slope(csi, MAT_avg), 6) AS slope,
           round(regr_intercept(csi, MAT_avg), 6) AS intercept,
           CAST(regr_count(csi, MAT_avg) AS BIGINT) AS n
    FROM {n_rows} GROUP BY ALL""")
def _(spark, d):
    out = nc.linear_trend(rows(spark, d), "MAT_avg", "csi", ("species", "rcp"))
    return r6(out, "slope", "intercept")
