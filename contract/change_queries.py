"""Prediction indicators and net changes."""

from pyspark.sql import functions as F

from standflow.operators import indicators as ind
from standflow.plans import change

from .bindings import query, r6, shared

_ID = "l_orderkey, l_linenumber, point_id"
ID = _ID.split(", ")


def preds(spark, d):
    return shared(spark, d, "b_predictions")


@query("expected_transition_time", f"SELECT {_ID}, round(t, 6) AS t_time_est FROM {{g_parsed}}")
def _(spark, d):
    return r6(ind.expected_transition_time(preds(spark, d)).select(*ID, "t_time_est"), "t_time_est")


@query("parse_prediction", f"""
    SELECT {_ID}, sp_init, sp_pred, lai_init, lai_pred, height_init, height_pred
    FROM {{g_parsed}}""")
def _(spark, d):
    return ind.parse_prediction(preds(spark, d)).select(
        *ID, "sp_init", "sp_pred", "lai_init", "lai_pred", "height_init", "height_pred"
    )


@query("same_vegetation", f"SELECT {_ID}, sp_init, sp_pred, veg_same FROM {{g_rates}}")
def _(spark, d):
    return ind.same_vegetation(ind.parse_prediction(preds(spark, d))).select(
        *ID, "sp_init", "sp_pred", "veg_same"
    )


@query("lai_change_rate", f"SELECT {_ID}, round(lai_diff, 6) AS lai_diff FROM {{g_rates}}")
def _(spark, d):
    return r6(change.rates(preds(spark, d)).select(*ID, "lai_diff"), "lai_diff")


@query("growth_rate", f"SELECT {_ID}, round(growth, 6) AS growth FROM {{g_rates}}")
def _(spark, d):
    return r6(change.rates(preds(spark, d)).select(*ID, "growth"), "growth")


@query("dominance_shift", f"""
    SELECT {_ID}, sp_init, sp_pred, veg_diff, round(veg_diff / t, 6) AS veg_diff_rate
    FROM {{g_rates}}""")
def _(spark, d):
    out = ind.dominance_shift(
        ind.parse_prediction(ind.expected_transition_time(preds(spark, d)))
    ).select(*ID, "sp_init", "sp_pred", "veg_diff", "veg_diff_rate")
    return r6(out, "veg_diff_rate")


@query("climate_model_tag", f"SELECT {_ID}, source, scen FROM {{b_predictions}}")
def _(spark, d):
    return ind.climate_model_tag(preds(spark, d).drop("scen")).select(*ID, "source", "scen")


# rows that agree in everything are interchangeable, so only the order columns are shown
@query("row_ids_and_tags", """
    SELECT species, timestep, scen, point_id, l_orderkey, l_linenumber, 'run1' AS run,
           row_number() OVER (PARTITION BY species, timestep, scen
                              ORDER BY point_id, l_orderkey, l_linenumber) AS id
    FROM {b_predictions}""")
def _(spark, d):
    part = ["species", "timestep", "scen"]
    order = ["point_id", "l_orderkey", "l_linenumber"]
    # a point with very many rows is cut further, along the order
    block = F.struct("point_id", F.floor(F.col("l_orderkey") / 10_000))
    tagged = ind.row_ids_and_tags(preds(spark, d), part, order, block, {"run": F.lit("run1")})
    return tagged.select(*part, *order, "run", "id")


@query("scenario_fanout", f"""
    SELECT {_ID}, timestep, rcp FROM {{g_all}}""")
def _(spark, d):
    return ind.scenario_fanout(preds(spark, d)).select(*ID, "timestep", "rcp")


@query("baseline_future_means", """
    SELECT f.species, f.rcp, f.point_id, f.init_state, f.scen, round(b.v, 6) AS var_base,
           round(f.v, 6) AS var_fut
    FROM (SELECT species, rcp, point_id, init_state, scen, avg(lai_diff) AS v FROM {g_all}
          WHERE timestep >= '2071' GROUP BY ALL) f
    LEFT JOIN (SELECT species, rcp, point_id, init_state, scen, avg(lai_diff) AS v FROM {g_all}
               WHERE timestep < '2071' GROUP BY ALL) b
      USING (species, rcp, point_id, init_state, scen)""")
def _(spark, d):
    rows = ind.scenario_fanout(change.rates(preds(spark, d)))
    return r6(ind.baseline_future_means(rows, "lai_diff"), "var_base", "var_fut")


_NET = """point_id, net_negative, net_positive, round(diff, 6) AS diff, "sum",
          round(net_change, 6) AS net_change"""


@query("net_change", f"SELECT species, rcp, {_NET} FROM {{g_lai}}")
def _(spark, d):
    rows = ind.scenario_fanout(change.rates(preds(spark, d)))
    return r6(ind.net_change(ind.baseline_future_means(rows, "lai_diff")), "diff", "net_change")


@query("lai_net_change", f"SELECT {_NET}, indicator, rcp, species FROM {{g_lai}}")
def _(spark, d):
    return r6(change.lai_net_change(preds(spark, d)), "diff", "net_change")


@query("growth_net_change", f"SELECT {_NET}, indicator, rcp, species FROM {{g_hei}}")
def _(spark, d):
    return r6(change.growth_net_change(preds(spark, d)), "diff", "net_change")


@query("dominance_net_change", f"SELECT {_NET}, indicator, rcp, species FROM {{g_dom}}")
def _(spark, d):
    return r6(change.dominance_net_change(preds(spark, d)), "diff", "net_change")


@query("prediction_uncertainty", """
    SELECT species, rcp, CASE WHEN timestep < '2071' THEN 'historical' ELSE 'future' END AS period,
           point_id,
           CASE WHEN count(s) = count(*) THEN round(avg(s), 6) END AS mean_state_proba,
           CASE WHEN count(p) = count(*) THEN round(avg(p), 6) END AS mean_time_proba
    FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN NULL ELSE state_proba_1 END AS s,
                 time_proba_1 AS p FROM {g_all}) g
    GROUP BY ALL""")
def _(spark, d):
    some_null = preds(spark, d).withColumn(
        "state_proba_1", F.when(F.col("l_linenumber") != 7, F.col("state_proba_1"))
    )
    out = ind.prediction_uncertainty(some_null)
    return r6(out, "mean_state_proba", "mean_time_proba")
