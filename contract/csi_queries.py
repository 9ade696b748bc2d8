"""Competitive-strength summaries."""

from pyspark.sql import functions as F

from standflow.operators import competition as cp
from standflow.plans import change
from standflow.session import materialise

from .bindings import query, r6, shared

_LABEL = """CASE rcp WHEN 'rcp_2_6' THEN 'RCP2.6' WHEN 'rcp_4_5' THEN 'RCP4.5' ELSE 'RCP8.5' END
            AS "RCP", replace(species, '_', ' ') AS species"""


def csi(spark, d):
    """The result table between the scripts of the study: written once, then summarised."""
    return materialise(change.csi_from_predictions(shared(spark, d, "b_predictions")), "csi")


def labelled(spark, d):
    return cp.relabel(csi(spark, d))


def _ci(value: str, source: str, mean: str, sd: str) -> str:
    return f"""
    SELECT species, "RCP", round(m, 6) AS {mean}, round(s, 6) AS {sd}, n AS "sum",
           round(s / sqrt(n), 6) AS se, round(m + 1.96 * (s / sqrt(n)), 6) AS upper,
           round(m - 1.96 * (s / sqrt(n)), 6) AS lower
    FROM (SELECT species, "RCP", avg(v) AS m, stddev_samp(v) AS s, count(*) AS n
          FROM (SELECT {_LABEL}, {value} AS v FROM {source}) a GROUP BY ALL) b"""


@query("csi", """
    SELECT species, rcp, point_id, round(diff_lai, 6) AS diff_lai,
           round(net_change_lai, 6) AS net_change_lai, round(diff_hei, 6) AS diff_hei,
           round(net_change_hei, 6) AS net_change_hei, round(csi, 6) AS csi FROM {g_csi}""")
def _(spark, d):
    p = shared(spark, d, "b_predictions")
    out = cp.csi(change.lai_net_change(p), change.growth_net_change(p))
    return r6(out, "diff_lai", "net_change_lai", "diff_hei", "net_change_hei", "csi")


@query("csi_from_predictions", """
    SELECT species, rcp, point_id, round(diff_lai, 6) AS diff_lai,
           round(net_change_lai, 6) AS net_change_lai, round(diff_hei, 6) AS diff_hei,
           round(net_change_hei, 6) AS net_change_hei, round(csi, 6) AS csi FROM {g_csi}""")
def _(spark, d):
    out = change.csi_from_predictions(shared(spark, d, "b_predictions"))
    return r6(out, "diff_lai", "net_change_lai", "diff_hei", "net_change_hei", "csi")


@query("relabel", f"SELECT {_LABEL}, point_id, round(csi, 6) AS csi FROM {{g_csi}}")
def _(spark, d):
    return r6(labelled(spark, d).select("RCP", "species", "point_id", "csi"), "csi")


@query("species_order", """
    SELECT replace(species, '_', ' ') AS species,
           CASE WHEN count(csi) = count(*) THEN round(avg(csi), 6) END AS avg
    FROM {g_csi} GROUP BY ALL""")
def _(spark, d):
    return r6(cp.species_order(labelled(spark, d)), "avg")


@query("group_mean_of_means", """
    SELECT CASE WHEN species IN ('Fagus_sylvatica', 'Quercus_robur', 'Betula_pendula',
                                 'Quercus_ilex') THEN 'broadleaved' ELSE 'coniferous' END
           AS sp_group, round(avg(m), 6) AS avg
    FROM (SELECT species, avg(csi) AS m FROM {g_csi} GROUP BY ALL) s GROUP BY ALL""")
def _(spark, d):
    return r6(cp.group_mean_of_means(labelled(spark, d)), "avg")


@query("area_share_by_sign", """
    SELECT species, net_negative, net_positive, "sum",
           round(100.0 * net_negative / "sum", 6) AS pct_neg,
           round(100.0 * net_positive / "sum", 6) AS pct_pos
    FROM (SELECT replace(species, '_', ' ') AS species, count(*) FILTER (csi < 0) AS net_negative,
                 count(*) FILTER (csi > 0) AS net_positive, count(*) AS "sum"
          FROM {g_csi} GROUP BY ALL) s""")
def _(spark, d):
    return r6(cp.area_share_by_sign(labelled(spark, d)), "pct_neg", "pct_pos")


@query("mean_ci", _ci("csi", "{g_csi}", "mean_csi", "sd_csi"))
def _(spark, d):
    return r6(cp.csi_ci(labelled(spark, d)), "mean_csi", "sd_csi", "se", "upper", "lower")


@query("lai_component_ci", _ci("net_change", "{g_lai}", "mean", "sd"))
def _(spark, d):
    out = cp.component_ci(change.lai_net_change(shared(spark, d, "b_predictions")))
    return r6(out, "mean", "sd", "se", "upper", "lower")


@query("height_component_ci", _ci("net_change", "{g_hei}", "mean", "sd"))
def _(spark, d):
    out = cp.component_ci(change.growth_net_change(shared(spark, d, "b_predictions")))
    return r6(out, "mean", "sd", "se", "upper", "lower")


@query("join_range_size", f"""
    SELECT c.species, c."RCP", mean_csi, c."sum", dom_range, whole_range,
           round(whole_range / 100, 6) AS range_area
    FROM ({_ci("csi", "{g_csi}", "mean_csi", "sd_csi")}) c
    LEFT JOIN (SELECT replace(species, '_', ' ') AS species,
                      count(*) FILTER (edge = 'center') AS dom_range, count(*) AS whole_range
               FROM {{b_edges}} WHERE species <> 'Quercus_ilex' GROUP BY ALL) r USING (species)""")
def _(spark, d):
    ranges = (
        shared(spark, d, "b_edges")
        .where("species <> 'Quercus_ilex'")
        .groupBy(F.col("species").alias("species_name"))
        .agg(
            F.count_if(F.col("edge") == "center").alias("dom_range"),
            F.count(F.lit(1)).alias("whole_range"),
        )
    )
    out = cp.join_range_size(cp.csi_ci(labelled(spark, d)), ranges)
    return r6(
        out.select("species", "RCP", "mean_csi", "sum", "dom_range", "whole_range", "range_area"),
        "mean_csi", "range_area",
    )
