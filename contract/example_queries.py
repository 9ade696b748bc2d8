"""Timeline to example operators."""

from pyspark.sql import functions as F

from standflow.operators import examples as ex
from standflow.plans import extraction

from .bindings import UNIT, examples, query, timeline

ARGS = (UNIT, "Year", "svd_state")


def _tl(spark, d):
    return timeline(spark, d).drop("raw_state")


@query("residence_time", """
    SELECT uniqueID, simulationID, Year, svd_state, residence_time FROM {t_targets}""")
def _(spark, d):
    return ex.residence_time(_tl(spark, d), *ARGS)


@query("residence_time_short_runs", """
    SELECT uniqueID, simulationID, Year, raw_state,
           CAST(row_number() OVER (PARTITION BY simulationID, run ORDER BY Year) AS INT)
           AS residence_time
    FROM (SELECT *, sum(c) OVER (PARTITION BY simulationID ORDER BY Year) AS run
          FROM (SELECT *, CASE WHEN lag(raw_state) OVER (PARTITION BY simulationID ORDER BY Year)
                               <> raw_state THEN 1 ELSE 0 END AS c FROM {b_timeline}) a) b""")
def _(spark, d):
    return ex.residence_time(timeline(spark, d).drop("svd_state"), UNIT, "Year", "raw_state")


@query("previous_state", """
    SELECT uniqueID, simulationID, Year, svd_state,
           coalesce(lag(svd_state) OVER (PARTITION BY simulationID ORDER BY Year), svd_state)
           AS previous_year_state
    FROM {b_timeline}""")
def _(spark, d):
    return ex.previous_state(_tl(spark, d), *ARGS)


@query("target_time", """
    SELECT uniqueID, simulationID, Year, svd_state, target_time FROM {t_targets}""")
def _(spark, d):
    return ex.target_time(_tl(spark, d), *ARGS)


@query("target_state", """
    SELECT uniqueID, simulationID, Year, svd_state, target_state FROM {t_targets}""")
def _(spark, d):
    return ex.target_state(_tl(spark, d), *ARGS)


# the SQL walks each timeline row by row and counts the rows since the last flag
@query("example_flag", """
    WITH walk AS (
      SELECT simulationID, pos, 0 AS flag, 1 AS since FROM {t_rows} WHERE pos = 1
      UNION ALL
      SELECT t.simulationID, t.pos, CASE WHEN t.chg = 1 OR w.since >= 9 THEN 1 ELSE 0 END,
             CASE WHEN t.chg = 1 OR w.since >= 9 THEN 0 ELSE w.since + 1 END
      FROM walk w JOIN {t_rows} t ON t.simulationID = w.simulationID AND t.pos = w.pos + 1)
    SELECT t.uniqueID, t.simulationID, t.Year, t.svd_state, w.flag
    FROM {t_rows} t JOIN walk w USING (simulationID, pos) {recursive}""")
def _(spark, d):
    return ex.example_flag(_tl(spark, d), *ARGS)


@query("complete_flagged_rows", """
    SELECT uniqueID, simulationID, Year, svd_state, previous_year_state, residence_time,
           target_state, target_time, flag FROM {t_kept}""")
def _(spark, d):
    d = ex.with_changes(_tl(spark, d), *ARGS)
    rows = d.select(
        *UNIT, "Year", "svd_state", F.coalesce("__prev", "svd_state").alias("previous_year_state"),
        ex._residence().alias("residence_time"),
        ex._target_state("svd_state", ex.HORIZON).alias("target_state"),
        ex._target_time(ex.HORIZON).alias("target_time"),
        ex._flag(ex.QUIET_YEARS).alias("flag"),
    )
    return ex.complete_flagged_rows(rows)


@query("example_history", """
    SELECT uniqueID, simulationID, Year, hist_state1, hist_state2, hist_state3, hist_time1,
           hist_time2, hist_time3 FROM {t_examples}""")
def _(spark, d):
    kept = ex.flagged_examples(_tl(spark, d), *ARGS)
    return ex.example_history(kept, *ARGS).select(
        *UNIT, "Year", *[f"hist_state{k}" for k in (1, 2, 3)],
        *[f"hist_time{k}" for k in (1, 2, 3)],
    )


@query("extract_examples", "SELECT * FROM {t_examples}")
def _(spark, d):
    return extraction.extract_examples(_tl(spark, d), *ARGS)


@query("augmentation_candidates", """
    SELECT * FROM {t_examples} WHERE target_time NOT IN (1, 10)""")
def _(spark, d):
    return ex.augmentation_candidates(examples(spark, d))


_DRAW = """1 + (('0x' || substr(md5(concat_ws('|', uniqueID, simulationID, Year, '1')), 1, 8))::BIGINT
           % (target_time - 1))"""


@query("augmentation_shift", f"""
    SELECT uniqueID, simulationID, Year, CAST(residence_time + {_DRAW} AS INT) AS residence_time,
           CAST(target_time - ({_DRAW}) AS INT) AS target_time, hist_state1, hist_time1
    FROM {{t_examples}} WHERE target_time NOT IN (1, 10)""")
def _(spark, d):
    moved = ex.augmentation_shift(
        ex.augmentation_candidates(examples(spark, d)), [*UNIT, "Year"], seed=1
    )
    return moved.select(*UNIT, "Year", "residence_time", "target_time", "hist_state1", "hist_time1")


@query("extract_augmentation", f"""
    SELECT * REPLACE (CAST(residence_time + {_DRAW} AS INT) AS residence_time,
                      CAST(target_time - ({_DRAW}) AS INT) AS target_time)
    FROM {{t_examples}} WHERE target_time NOT IN (1, 10)""")
def _(spark, d):
    return extraction.extract_augmentation(_tl(spark, d), *ARGS, seed=1)


@query("transition_qa", """
    SELECT count(*) AS n_rows, count(*) FILTER (contains(svd_state, 'NA')) AS n_na_state,
           count(DISTINCT target_state) AS n_targets,
           count(*) FILTER (svd_state = target_state) AS n_no_change,
           round(avg(CASE WHEN svd_state = target_state THEN 1 ELSE 0 END), 6) AS share_no_change
    FROM {t_examples}""")
def _(spark, d):
    qa = ex.transition_qa(examples(spark, d))
    return qa.withColumn("share_no_change", F.round("share_no_change", 6))


@query("transition_counts", """
    SELECT svd_state, target_state, count(*) AS n, min(target_time) AS min_time,
           round(avg(target_time), 6) AS mean_time
    FROM {t_examples} GROUP BY ALL""")
def transition_counts(spark, d):
    """Examples by state and target: the smallest whole path through the library."""
    return (
        extraction.extract_examples(_tl(spark, d), *ARGS)
        .groupBy("svd_state", "target_state")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("target_time").alias("min_time"),
            F.round(F.avg("target_time"), 6).alias("mean_time"),
        )
    )
