"""Sampling, state space and pruning."""

from pyspark.sql import functions as F

from standflow.functions import statecode as sc
from standflow.operators import prune as pr
from standflow.plans import pruning

from .bindings import CODES, enriched_examples, examples, query, r6, shared

# --- coverage_subsample: the SQL repeats the hash draws over whole groups -------------------------

_COLS = ("grid_id", "uniqueID", "svd_state", "simulationID", "Year", "residence_time")
_CAP = 12


def _subsampled(cols, cap: int, seed: int) -> str:
    own = ", ".join(cols)
    return f"""
    base AS (SELECT {own} FROM {{b_examples}}),
    cells AS (SELECT grid_id, uniqueID, svd_state, count(*) AS n FROM base GROUP BY ALL),
    big AS (SELECT grid_id, uniqueID, CAST(ceil({cap} / count(*)) AS BIGINT) AS draws
            FROM cells GROUP BY ALL HAVING sum(n) > {cap}),
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY grid_id, uniqueID, svd_state
             ORDER BY md5(concat_ws('|', {own}, '{seed}'))) AS i FROM base),
    picked AS (
      SELECT DISTINCT grid_id, uniqueID, svd_state,
             1 + ('0x' || substr(md5(concat_ws('|', grid_id, uniqueID, svd_state, j, '{seed}')), 1, 8))
                 ::BIGINT % n AS i
      FROM (SELECT c.*, unnest(range(1, draws + 1)) AS j FROM cells c
            JOIN big USING (grid_id, uniqueID)) d),
    sampled AS (
      SELECT {own} FROM numbered
      WHERE (grid_id, uniqueID) NOT IN (SELECT (grid_id, uniqueID) FROM big)
         OR (grid_id, uniqueID, svd_state, i) IN
            (SELECT (grid_id, uniqueID, svd_state, i) FROM picked))"""


@query("coverage_subsample", f"WITH {_subsampled(_COLS, _CAP, 5)} SELECT * FROM sampled")
def _(spark, d):
    rows = enriched_examples(spark, d).select(*_COLS)
    return pr.coverage_subsample(rows, ["grid_id", "uniqueID"], "svd_state", _CAP, seed=5)


_STATES = "unnest([svd_state, target_state, hist_state1, hist_state2, hist_state3])"


@query("state_lookup", f"""
    SELECT state, row_number() OVER (ORDER BY state) AS "stateID"
    FROM (SELECT DISTINCT state FROM (
            SELECT {_STATES} AS state FROM {{t_examples}}
            UNION ALL SELECT state FROM {{b_state}}) u WHERE state <> 'missing') s
    UNION ALL SELECT 'missing', 0""")
def _(spark, d):
    parts = shared(spark, d, "b_state").select(F.col("state").alias("svd_state"))
    return pr.state_lookup([examples(spark, d), parts])


_TOKENS = "regexp_extract_all(split_part(state, '_', 1), '....')"


@query("parse_state", f"""
    SELECT state, split_part(state, '_', 1) AS composition,
           array_to_string({_TOKENS}, ',') AS tokens,
           array_to_string(list_transform({_TOKENS}, lambda x: lower(x)), ',') AS species_list,
           CAST(split_part(state, '_', 2) AS INT) AS fct,
           CAST(split_part(state, '_', 3) AS INT) AS structure
    FROM (SELECT DISTINCT state FROM {{b_state}} UNION ALL SELECT 'nope_0_0_0') s""")
def _(spark, d):
    states = pr.with_invalid(shared(spark, d, "b_state").select("state").distinct())
    return pr.parse_state(states).withColumns({
        c: F.array_join(c, ",") for c in ("tokens", "species_list")
    })


# shares by rule, one row per state and token position
_SHARES = """
    SELECT state, lower(tok) AS species,
           sum(CASE n WHEN 1 THEN 1.0
             WHEN 2 THEN CASE WHEN first <> lower(first) THEN [0.66, 0.34][i] ELSE 0.5 END
             WHEN 3 THEN CASE WHEN first <> lower(first) THEN [0.66, 0.17, 0.17][i]
                              ELSE [0.34, 0.33, 0.33][i] END
             ELSE 1.0 / n END::DOUBLE) AS prop
    FROM (SELECT state, toks[1] AS first, len(toks) AS n, unnest(toks) AS tok,
                 unnest(range(1, len(toks) + 1)) AS i
          FROM (SELECT state, [x FOR x, j IN all_toks IF list_position(all_toks, x) = j] AS toks
                FROM (SELECT DISTINCT state,
                             regexp_extract_all(split_part(state, '_', 1), '....') AS all_toks
                      FROM {source}) a) b) c GROUP BY ALL"""


@query("species_proportions", f"""
    SELECT state, species, round(prop, 6) AS prop
    FROM ({_SHARES.replace("{source}", "{b_state}")}) s""")
def _(spark, d):
    states = shared(spark, d, "b_state").select("state").distinct()
    return r6(pr.species_proportions(states), "prop")


@query("species_matrix", f"""
    SELECT state, {', '.join(
        f"round(coalesce(sum(prop) FILTER (species = '{c}'), 0), 6) AS {c}" for c in CODES)},
           round(sum(prop), 6) AS row_sum
    FROM ({_SHARES.replace("{source}", "{b_state}")}) s GROUP BY state""")
def _(spark, d):
    states = shared(spark, d, "b_state").select("state").distinct()
    return r6(pr.species_matrix(pr.species_proportions(states), CODES), *CODES, "row_sum")


# dense pairs with summed absolute differences of shares
_SIM = f"""
    SELECT a.state AS state_from, b.state AS state_to,
           (1 - (coalesce(d.diff, 0) / 2) * (1 - exp(-0.5 * a.h)))
           * CASE WHEN b.h - a.h < -2 OR b.h - a.h > 2 THEN 0 ELSE 1 END
           * (1 - least(pow(abs(b.lai - a.lai) / 2, 4), 1)) AS sim
    FROM codes a CROSS JOIN codes b
    JOIN (SELECT x.state AS f, y.state AS t, sum(abs(coalesce(p.prop, 0) - coalesce(q.prop, 0)))
                 AS diff
          FROM codes x CROSS JOIN codes y
          CROSS JOIN (SELECT DISTINCT species FROM shares) s
          LEFT JOIN shares p ON p.state = x.state AND p.species = s.species
          LEFT JOIN shares q ON q.state = y.state AND q.species = s.species
          GROUP BY ALL) d ON d.f = a.state AND d.t = b.state"""
_CODES = f"""
    WITH used AS (SELECT DISTINCT state FROM (
             SELECT unnest([svd_state, target_state]) AS state FROM {{t_examples}}) u),
    codes AS (SELECT state, CAST(split_part(state, '_', 2) AS DOUBLE) AS lai,
                     CAST(split_part(state, '_', 3) AS DOUBLE) AS h FROM used),
    shares AS ({_SHARES.replace("{source}", "used")}),
    sims AS ({_SIM})"""


@query("state_similarity", f"""
    {_CODES} SELECT state_from, state_to, round(sim, 6) AS sim FROM sims WHERE sim > 0""")
def _(spark, d):
    states = pr.distinct_states([examples(spark, d)], ["svd_state", "target_state"])
    return r6(pr.state_similarity(states), "sim")


@query("similar_states", f"""
    {_CODES} SELECT state_from, state_to, round(sim, 6) AS sim FROM sims WHERE sim >= 0.5""")
def _(spark, d):
    states = pr.distinct_states([examples(spark, d)], ["svd_state", "target_state"])
    return r6(pr.state_similarity(states, min_sim=0.5), "sim")


_NEAR = """SELECT e.*, 1 - s.sim AS dist FROM {t_examples} e
           JOIN sims s ON s.state_from = e.svd_state AND s.state_to = e.target_state
           WHERE 1 - s.sim <= 0.9"""
_EXAMPLE_COLS = """uniqueID, simulationID, Year, svd_state, previous_year_state, residence_time,
    target_state, target_time, flag, hist_state1, hist_state2, hist_state3, hist_time1, hist_time2,
    hist_time3"""


@query("transition_distance_filter", f"""
    {_CODES}, near AS ({_NEAR})
    SELECT {_EXAMPLE_COLS}, round(dist, 6) AS dist FROM near""")
def _(spark, d):
    return r6(pr.transition_distance_filter(examples(spark, d)), "dist")


_FREQUENT = """
    SELECT * EXCLUDE (count_svd_state, count_target_state) FROM (
      SELECT *, count(*) OVER (PARTITION BY svd_state) AS count_svd_state,
             count(*) OVER (PARTITION BY target_state) AS count_target_state FROM near) c
    WHERE count_svd_state > 10 AND count_target_state > 10"""


@query("rare_state_filter", f"""
    SELECT {_EXAMPLE_COLS}, count_svd_state, count_target_state FROM (
      SELECT *, count(*) OVER (PARTITION BY svd_state) AS count_svd_state,
             count(*) OVER (PARTITION BY target_state) AS count_target_state
      FROM {{t_examples}}) c
    WHERE count_svd_state > 32 AND count_target_state > 32""")
def _(spark, d):
    return pr.rare_state_filter(examples(spark, d), min_count=32)


def _rounds(source: str, n: int) -> str:
    """The fixpoint written out: each round keeps rows whose states are all in the last set."""
    cols = "svd_state, target_state, hist_state1, hist_state2, hist_state3".split(", ")
    out, last = [], source
    for i in range(n):
        known = f"(SELECT svd_state FROM {last} UNION ALL SELECT 'missing')"
        where = " AND ".join(f"{c} IN {known}" for c in cols)
        out.append(f"r{i} AS MATERIALIZED (SELECT * FROM {source} WHERE {where})")
        last = f"r{i}"
    return ", ".join(out)


@query("closed_state_set", f"""
    {_CODES}, near AS ({_NEAR}), frequent AS ({_FREQUENT}), {_rounds("frequent", 6)}
    SELECT {_EXAMPLE_COLS} FROM r5""")
def _(spark, d):
    near = pr.transition_distance_filter(examples(spark, d))
    frequent = pr.rare_state_filter(near)
    return pr.closed_state_set(frequent).drop("dist", "count_svd_state", "count_target_state")


# allowed states: spruce, pure or with admixed beech
@query("conform_to_states", """
    SELECT * FROM {t_examples} WHERE """ + " AND ".join(
    f"{c} IN (SELECT svd_state FROM {{t_examples}} WHERE svd_state LIKE 'PIAB%' "
    "UNION ALL SELECT 'missing')" for c in pr.STATE_COLUMNS
))
def _(spark, d):
    ex = examples(spark, d)
    return pr.conform_to_states(ex, ex.where("svd_state LIKE 'PIAB%'"))


_ORPHANS = """
    SELECT "column", state FROM (
      SELECT DISTINCT unnest(['target_state', 'hist_state1', 'hist_state2', 'hist_state3'])
             AS "column",
             unnest([target_state, hist_state1, hist_state2, hist_state3]) AS state
      FROM {t_examples}) u
    WHERE state NOT IN (SELECT svd_state FROM {t_examples})"""


@query("orphan_states", _ORPHANS)
@query("orphan_states_all", _ORPHANS)
def _(spark, d):
    return pr.orphan_states(examples(spark, d))


@query("prune_examples", f"""
    {_CODES}, near AS ({_NEAR}), frequent AS ({_FREQUENT}), {_rounds("frequent", 6)}
    SELECT {_EXAMPLE_COLS}, round(dist, 6) AS dist FROM r5
    WHERE uniqueID NOT IN (1005, 1015)""")
def _(spark, d):
    return r6(pruning.prune_examples(examples(spark, d)), "dist")


@query("pair_similarity", f"""
    {_CODES} SELECT e.svd_state, e.target_state, e.n, round(s.sim, 6) AS sim
    FROM (SELECT svd_state, target_state, count(*) AS n FROM {{t_examples}} GROUP BY ALL) e
    JOIN sims s ON s.state_from = e.svd_state AND s.state_to = e.target_state""")
def _(spark, d):
    pairs = examples(spark, d).groupBy("svd_state", "target_state").agg(
        F.count(F.lit(1)).alias("n")
    )
    return r6(pairs.withColumn("sim", sc.state_similarity_of("svd_state", "target_state")), "sim")


# --- both training tables: thin, prune, conform, look up -------------------------------------------

_JOINT = ("grid_id", "uniqueID", "simulationID", "Year", *pr.STATE_COLUMNS, "residence_time",
          "target_time")
_JOINT_CAP, _JOINT_COUNT = 15, 3
_NEAR_SAMPLED = _NEAR.replace("{t_examples}", "sampled")
_FREQUENT_SAMPLED = _FREQUENT.replace("> 10", f"> {_JOINT_COUNT}")
_KNOWN = "(SELECT svd_state FROM kept UNION ALL SELECT 'missing')"


@query("prune_training_tables", f"""
    {_CODES}, {_subsampled(_JOINT, _JOINT_CAP, 5)}, near AS ({_NEAR_SAMPLED}),
    frequent AS ({_FREQUENT_SAMPLED}), {_rounds("frequent", 8)},
    kept AS (SELECT {', '.join(_JOINT)} FROM r7 WHERE uniqueID NOT IN (1005, 1015)),
    kept_aug AS (
      SELECT {', '.join('e.' + c for c in _JOINT)}
      FROM (SELECT * REPLACE (target_time - 1 AS target_time, residence_time + 1 AS residence_time)
            FROM {{b_examples}} WHERE target_time NOT IN (1, 10)) e
      JOIN sims s ON s.state_from = e.svd_state AND s.state_to = e.target_state
      WHERE 1 - s.sim <= 0.9 AND uniqueID NOT IN (1005, 1015)
        AND {' AND '.join(f'e.{c} IN {_KNOWN}' for c in pr.STATE_COLUMNS)}),
    both_tables AS (SELECT 0 AS augmented, * FROM kept UNION ALL SELECT 1, * FROM kept_aug),
    lookup AS (
      SELECT state, row_number() OVER (ORDER BY state) AS id FROM (
        SELECT DISTINCT state FROM (SELECT {_STATES} AS state FROM both_tables) u
        WHERE state <> 'missing') v
      UNION ALL SELECT 'missing', 0)
    SELECT b.*, {', '.join(f'l{i}.id AS {c}_id' for i, c in enumerate(pr.STATE_COLUMNS))}
    FROM both_tables b {' '.join(
        f'LEFT JOIN lookup l{i} ON l{i}.state = b.{c}' for i, c in enumerate(pr.STATE_COLUMNS))}""")
def _(spark, d):
    ex = enriched_examples(spark, d).select(*_JOINT)
    aug = ex.where("target_time NOT IN (1, 10)").withColumns(
        {"target_time": F.col("target_time") - 1, "residence_time": F.col("residence_time") + 1}
    )
    kept, kept_aug, lookup = pruning.prune_training_tables(
        ex, aug, min_count=_JOINT_COUNT, group=["grid_id", "uniqueID"], cap=_JOINT_CAP, seed=5
    )
    both = kept.withColumn("augmented", F.lit(0)).unionByName(
        kept_aug.withColumn("augmented", F.lit(1))
    )
    return pruning.with_state_ids(both, lookup, pr.STATE_COLUMNS)
