"""Model input, scoring, evaluation and initial states."""

from pyspark.sql import functions as F

from standflow.operators import init_states as ist
from standflow.operators import model_io as mio
from standflow.operators import prune as pr
from standflow.operators import samples as sm
from standflow.plans import prediction

from .bindings import (
    DECADES, SCENARIOS, SPECIES, case, enriched_examples, examples, query, r6, shared, table,
    timeline,
)

_SPLIT = """CASE WHEN ('0x' || substr(md5(concat_ws('|', scenario, uniqueID, '1')), 1, 8))::BIGINT
            / 4294967296 < 0.8 THEN 'train' ELSE 'val' END"""


@query("train_val_split", f"""
    SELECT scenario, uniqueID, simulationID, Year, {_SPLIT} AS split FROM {{b_examples}}""")
def _(spark, d):
    ex = enriched_examples(spark, d).select("scenario", "uniqueID", "simulationID", "Year")
    return mio.train_val_split(ex, ["scenario", "uniqueID"])


# all examples split, so that every augmented one has a key of the split
_PAIRED = f"""
    WITH base AS (SELECT scenario, uniqueID, simulationID, Year, {_SPLIT} AS split, 0 AS augmented
                  FROM {{b_examples}})
    SELECT * FROM base UNION ALL
    SELECT scenario, uniqueID, simulationID, Year, {_SPLIT}, 1 FROM {{b_examples}}
    WHERE target_time NOT IN (1, 10)
      AND (scenario, uniqueID) IN (SELECT (scenario, uniqueID) FROM base)"""


@query("pair_augmentation", _PAIRED)
@query("pair_augmentation_all", _PAIRED)
def _(spark, d):
    return _pairs(spark, d)


def _pairs(spark, d):
    keys = ["scenario", "uniqueID"]
    ex = enriched_examples(spark, d).select(
        *keys, "simulationID", "Year", "target_time", F.lit(0).alias("augmented")
    )
    split = mio.train_val_split(ex.drop("target_time"), keys)
    aug = ex.where("target_time NOT IN (1, 10)").drop("target_time").withColumn(
        "augmented", F.lit(1)
    )
    return mio.pair_augmentation(split, aug, keys)


# states from the timeline, without one composition, so that some codes are unknown
_LOOKUP = """
    lookup AS (SELECT state, row_number() OVER (ORDER BY state) AS id FROM (
        SELECT DISTINCT svd_state AS state FROM {b_timeline}
        WHERE svd_state NOT LIKE 'ABAL%') s UNION ALL SELECT 'missing', 0)"""


def lookup(spark, d):
    tl = timeline(spark, d).where(~F.col("svd_state").startswith("ABAL"))
    return pr.state_lookup([tl], ["svd_state"])


@query("encode_states", f"""
    WITH {_LOOKUP}
    SELECT simulationID, Year, """ + ", ".join(
    f"{c}, coalesce(l{i}.id, 0) AS {c}_id" for i, c in enumerate(pr.STATE_COLUMNS)
) + ", target_time, target_time - 1 AS target_time_index FROM {t_examples} e " + " ".join(
    f"LEFT JOIN lookup l{i} ON l{i}.state = e.{c}" for i, c in enumerate(pr.STATE_COLUMNS)
))
def _(spark, d):
    ex = examples(spark, d).select("simulationID", "Year", *pr.STATE_COLUMNS, "target_time")
    return mio.encode_states(ex, lookup(spark, d), pr.STATE_COLUMNS, target_time="target_time")


@query("scale_features", """
    SELECT simulationID, Year, round(residence_time / 10, 6) AS residence_time,
           round(hist_time1 / 10, 6) AS hist_time1, round(WHC / 1000, 6) AS WHC,
           round(TextureSand / 100, 6) AS TextureSand, round(SoilDepth / 10000, 6) AS SoilDepth,
           round(AvailableNitrogen / 100, 6) AS AvailableNitrogen,
           round(Lon / 20, 6) AS "MAT_1", round(Lat / 10, 6) AS "ANP_1",
           round(Lon / 30, 6) AS tas_month3_1, round(Lat / 20, 6) AS prec_month3_1,
           round(Lat / 1, 6) AS npp_10_1
    FROM {b_examples}""")
def _(spark, d):
    ex = enriched_examples(spark, d).select(
        "simulationID", "Year", "residence_time", "hist_time1", "WHC", "TextureSand", "SoilDepth",
        "AvailableNitrogen", F.col("Lon").alias("MAT_1"), F.col("Lat").alias("ANP_1"),
        F.col("Lon").alias("tas_month3_1"), F.col("Lat").alias("prec_month3_1"),
        F.col("Lat").alias("npp_10_1"),
    )
    out = mio.scale_features(ex)
    return r6(out, *out.columns[2:])


# three features over four years; column j holds feature j div 4 of year j % 4
@query("feature_cube", "SELECT c_custkey, y AS year, " + ", ".join(
    f"round(c_acctbal + 4 * {f} + y, 6) AS f{f}" for f in range(3)
) + " FROM customer, (SELECT unnest(range(4)) AS y) t")
def _(spark, d):
    wide = table(spark, d, "customer").select(
        "c_custkey", *[(F.col("c_acctbal") + j).alias(f"x_{j}") for j in range(12)]
    )
    cube = mio.feature_cube(wide, [f"x_{j}" for j in range(12)], 4, 3)
    return cube.select("c_custkey", F.posexplode("climate").alias("i", "v")).select(
        "c_custkey", F.col("i").cast("bigint").alias("year"),
        *[F.round(F.col("v")[f], 6).alias(f"f{f}") for f in range(3)],
    )


# all features, ten years of each
_CLIMATE = [f"{f}_{y}" for f in sm.feature_names() for y in range(1, 11)]
_SITE = ["whc_extract", "sand_extract", "depth_extract", "r_nitro"]


def grid(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("point_id"),
        ((F.col("c_custkey") % 40) * 0.5).cast("double").alias("wgs_x"),
        (40 + F.floor(F.col("c_custkey") / 40) * 0.5).cast("double").alias("wgs_y"),
        F.element_at(F.array(*[F.lit(s) for s in SPECIES]),
                     (F.col("c_nationkey") % 9 + 1).cast("int")).alias("species"),
        F.element_at(F.array(*[F.lit(s) for s in DECADES]),
                     (F.col("c_custkey") % 6 + 1).cast("int")).alias("decade"),
        F.element_at(F.array(*[F.lit(s) for s in SCENARIOS]),
                     (F.col("c_custkey") % 3 + 1).cast("int")).alias("scenario"),
        (100 + F.col("c_custkey") % 50).cast("double").alias("whc_extract"),
        (F.col("c_custkey") % 100).cast("double").alias("sand_extract"),
        (100 * (1 + F.col("c_nationkey"))).cast("double").alias("depth_extract"),
        (F.col("c_custkey") % 50).cast("double").alias("r_nitro"),
        *[(F.col("c_acctbal") / 1000 + j).alias(c) for j, c in enumerate(_CLIMATE, 1)],
    )


_GRID = f"""
    grid AS (SELECT c_custkey AS point_id, CAST((c_custkey % 40) * 0.5 AS DOUBLE) AS wgs_x,
                    CAST(40 + floor(c_custkey / 40) * 0.5 AS DOUBLE) AS wgs_y,
                    {case('c_nationkey % 9', SPECIES)} AS species,
                    {case('c_custkey % 6', DECADES)} AS decade,
                    {case('c_custkey % 3', SCENARIOS)} AS scenario, c_acctbal, c_nationkey
             FROM customer)"""


def init_states(spark, d):
    """Initial states of both kinds from the timeline, under full species names."""
    tl = [timeline(spark, d).select("svd_state")]
    both = ist.initial_states_single(tl).unionByName(ist.initial_states_mixed(tl))
    names = spark.createDataFrame([(s,) for s in SPECIES], "name string")
    codes = ist.species_code(names, "name").select(F.col("code").alias("species"), "name")
    return both.join(codes, ["species"]).select(F.col("name").alias("species"), "state").distinct()


_SPECIES_TABLE = "(VALUES " + ", ".join(
    f"('{c}', '{s}', {list(ist.HEIGHT_CLASSES[c])})"
    for c, s in (("".join(w[:2] for w in s.split("_")).upper(), s) for s in SPECIES)
) + ") v(code, species, heights)"
_COUNTED = f"""
    SELECT v.code, v.species, s.state, s.n
    FROM (SELECT svd_state AS state, count(*) AS n FROM {{source}} GROUP BY ALL) s
    JOIN {_SPECIES_TABLE} ON contains(s.state, v.code)
     AND list_contains(v.heights, split_part(s.state, '_', 3) || '_' || split_part(s.state, '_', 4))"""
_SINGLE = "SELECT * FROM ({counted}) c WHERE contains(state, code || '_') AND n >= 10"
_MIXED = """SELECT * EXCLUDE (k) FROM (SELECT *, rank() OVER (PARTITION BY code ORDER BY n DESC) AS k
            FROM ({counted}) c WHERE NOT contains(state, code || '_')) r WHERE k <= 10 AND n >= 5"""
_TL = _COUNTED.replace("{source}", "{b_timeline}")
_INIT = f"""init AS (SELECT DISTINCT species, state FROM (
    {_SINGLE.replace('{counted}', _TL)} UNION ALL {_MIXED.replace('{counted}', _TL)}) b)"""
_PRED = _COUNTED.replace("{source}", "(SELECT state AS svd_state FROM {b_predictions})")


@query("initial_states_single", f"""
    SELECT code AS species, state, n FROM ({_SINGLE.replace('{counted}', _PRED)}) s""")
def _(spark, d):
    ex = shared(spark, d, "b_predictions").select(F.col("state").alias("svd_state"))
    return ist.initial_states_single([ex])


@query("initial_states_mixed", f"""
    SELECT code AS species, state, n FROM ({_MIXED.replace('{counted}', _PRED)}) s""")
def _(spark, d):
    ex = shared(spark, d, "b_predictions").select(F.col("state").alias("svd_state"))
    return ist.initial_states_mixed([ex])


@query("species_code", """
    SELECT s_suppkey, species,
           CASE species WHEN 'Pinus_pinea' THEN 'PIPN' ELSE upper(substr(species, 1, 2)
           || substr(split_part(species, '_', 2), 1, 2)) END AS code,
           CASE species WHEN 'Fagus_sylvatica' THEN 'Fagus_sylvatica_sylvatica'
           WHEN 'Larix_decidua' THEN 'Larix_decidua_decidua'
           WHEN 'Quercus_ilex' THEN 'Quercus_ilex_ilex' ELSE species END AS range_name
    FROM (SELECT s_suppkey, """ + case("s_suppkey % 10", (*SPECIES, "Pinus_pinea"))
    + """ AS species FROM supplier) s""")
def _(spark, d):
    names = F.array(*[F.lit(s) for s in (*SPECIES, "Pinus_pinea")])
    df = table(spark, d, "supplier").select(
        "s_suppkey", F.element_at(names, (F.col("s_suppkey") % 10 + 1).cast("int")).alias("species")
    )
    return ist.species_code(df)


def _draw(k: int) -> str:
    return (f"1 + ('0x' || substr(md5(concat_ws('|', species, decade, scenario, state, {k}, '1')), "
            "1, 8))::BIGINT % 10")


@query("cross_initial_states", f"""
    WITH {_GRID}, {_LOOKUP}, {_INIT}
    SELECT g.point_id, g.species, g.decade, g.scenario, i.state,
           coalesce(l.id, 0) AS starting_state,
           1 AS residence_time, CAST({_draw(1)} AS INT) AS hist_time1,
           CAST({_draw(2)} AS INT) AS hist_time2, CAST({_draw(3)} AS INT) AS hist_time3,
           0 AS hist_state1_id, 0 AS hist_state2_id, 0 AS hist_state3_id
    FROM grid g JOIN init i USING (species) LEFT JOIN lookup l USING (state)""")
def _(spark, d):
    g = grid(spark, d).select("point_id", "species", "decade", "scenario")
    return mio.cross_initial_states(g, init_states(spark, d), lookup(spark, d))


# --- class probabilities: softmax of the stored vectors -------------------------------------------


def load_softmax():
    def model(x):
        import numpy as np

        e = np.exp(x["embedding"])
        p = e / e.sum(axis=1, keepdims=True)
        return {"p_state": p, "p_time": p[:, :10] / p[:, :10].sum(axis=1, keepdims=True)}

    return model


def scored(spark, d):
    return mio.batch_score(
        table(spark, d, "embeddings"), load_softmax, ["embedding"], 64, drop=["embedding"],
        dtype="float64",
    )


_PROBS = """
    SELECT vec_id, label, i, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p
    FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v,
                 unnest(range(len(embedding))) AS i FROM embeddings) e"""


@query("batch_score", f"""
    SELECT vec_id, label, i, round(p, 6) AS p FROM ({_PROBS}) q""")
def _(spark, d):
    rows = scored(spark, d).select("vec_id", "label", F.posexplode("p_state").alias("i", "p"))
    return r6(rows.withColumn("i", F.col("i").cast("bigint")), "p")


_TOP = ", ".join(
    f"max(i + 1) FILTER (r = {j}) AS c_{j}, round(max(p) FILTER (r = {j}), 6) AS p_{j}"
    for j in range(1, 6)
)


@query("top_k_predictions", f"""
    SELECT vec_id, {_TOP}
    FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS r
          FROM ({_PROBS}) q) t GROUP BY vec_id""")
def _(spark, d):
    out = mio.top_k_predictions(
        scored(spark, d).select("vec_id", "p_state"), "p_state", "c", "p", base=1
    ).drop("p_state")
    out = out.withColumns({f"c_{j}": F.col(f"c_{j}").cast("bigint") for j in range(1, 6)})
    return r6(out, *[f"p_{j}" for j in range(1, 6)])


@query("classification_metrics", f"""
    SELECT count(*) AS n_rows,
           round(avg(CASE WHEN r <= 1 THEN 1 ELSE 0 END), 6) AS top1_accuracy,
           round(avg(CASE WHEN r <= 2 THEN 1 ELSE 0 END), 6) AS top2_accuracy,
           round(avg(-ln(p)), 6) AS cross_entropy
    FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS r
          FROM ({_PROBS}) q) t WHERE i = label""")
def _(spark, d):
    out = mio.classification_metrics(scored(spark, d), "p_state", "label")
    return r6(out, "top1_accuracy", "top2_accuracy", "cross_entropy")


@query("decode_states", f"""
    WITH {_LOOKUP}
    SELECT vec_id, l.state FROM embeddings e LEFT JOIN lookup l ON l.id = (e.label * 5)""")
def _(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", (F.col("label") * 5).alias("state"))
    return mio.decode_states(df, lookup(spark, d), ["state"])


_HIST = ", ".join(
    f"CASE WHEN keep >= {k} THEN hist_state{k} ELSE 'missing' END AS hist_state{k}" for k in (1, 2, 3)
)


@query("mask_history", f"""
    SELECT simulationID, Year, {_HIST}
    FROM (SELECT *, CASE WHEN u < 0.4 THEN 3 WHEN u < 0.4 + 0.2 THEN 2 WHEN u < 0.4 + 0.2 + 0.2 THEN 1
                         ELSE 0 END AS keep
          FROM (SELECT *, ('0x' || substr(md5(concat_ws('|', simulationID, Year, '3')), 1, 8))::BIGINT
                          / 4294967296 AS u FROM {{t_examples}}) e) f""")
def _(spark, d):
    cols = [f"hist_state{k}" for k in (1, 2, 3)]
    ex = examples(spark, d).select("simulationID", "Year", *cols)
    return mio.mask_history(ex, cols, ["simulationID", "Year"], seed=3, missing="missing")


# --- whole grid, with a stand-in classifier of whole-number scores --------------------------------

N_STATES = 41


def load_counting_model():
    """Scores are small whole numbers, so ties are common; only their ratio is a fraction."""

    def model(x):
        import numpy as np

        s = x["starting_state"][:, None]
        warm = np.floor(x["climate"] * 1000).sum(axis=(1, 2))
        place = (warm + sum(np.floor(x[c] * 1000) for c in _SITE))[:, None]
        state = 1 + (s * 3 + np.arange(N_STATES)[None, :] * 7 + place) % 11
        hist = np.round(x["hist_time1"] * 10)[:, None]
        time = 1 + (s + np.arange(10)[None, :] * 3 + hist) % 7
        return {
            "p_state": state / state.sum(axis=1, keepdims=True),
            "p_time": time / time.sum(axis=1, keepdims=True),
        }

    return model


def _head(name: str, score: str, n: int) -> str:
    return f"""{name} AS (
      SELECT point_id, state, i, p, row_number() OVER (PARTITION BY point_id, state
             ORDER BY p DESC, i) AS r
      FROM (SELECT point_id, state, i, sc / sum(sc) OVER (PARTITION BY point_id, state) AS p
            FROM (SELECT *, {score} AS sc FROM crossed, (SELECT unnest(range({n})) AS i) k) a) b)"""


_SITE_SQL = {
    "whc_extract": "(100 + point_id % 50)", "sand_extract": "(point_id % 100)",
    "depth_extract": "(100 * (1 + c_nationkey))", "r_nitro": "(point_id % 50)",
}
_PLACE = "CAST(list_sum([" + ", ".join(
    [f"floor((c_acctbal / 1000 + {j}) / {mio.scale_of(c)}::DOUBLE * 1000)"
     for j, c in enumerate(_CLIMATE, 1)]
    + [f"floor({e}::DOUBLE / {mio.scale_of(c)}::DOUBLE * 1000)" for c, e in _SITE_SQL.items()]
) + "]) AS BIGINT)"


@query("predict_grid", f"""
    WITH {_GRID}, {_LOOKUP}, {_INIT},
    crossed AS (SELECT g.*, i.state, coalesce(l.id, 0) AS s0, {_draw(1)} AS h1
                FROM (SELECT *, {_PLACE} AS place FROM grid) g JOIN init i USING (species) LEFT JOIN lookup l USING (state)),
    {_head("ps", f"1 + (((s0 * 3 + i * 7 + place) % 11) + 11) % 11", N_STATES)},
    {_head("pt", "1 + (s0 + i * 3 + h1) % 7", 10)},
    sw AS (SELECT point_id, state, """ + ", ".join(
    f"max(l.state_name) FILTER (r = {j}) AS pred_state_{j}, "
    f"round(max(p) FILTER (r = {j}), 6) AS state_proba_{j}" for j in range(1, 6)
) + """ FROM ps LEFT JOIN (SELECT state AS state_name, id FROM lookup) l ON l.id = ps.i
        WHERE r <= 5 GROUP BY point_id, state),
    tw AS (SELECT point_id, state, """ + ", ".join(
    f"max(i + 1) FILTER (r = {j}) AS time_index_{j}, "
    f"round(max(p) FILTER (r = {j}), 6) AS time_proba_{j}" for j in range(1, 6)
) + """ FROM pt WHERE r <= 5 GROUP BY point_id, state)
    SELECT c.point_id, c.wgs_x, c.wgs_y, c.species, c.decade, c.scenario, c.state,
           c.s0 AS starting_state, sw.* EXCLUDE (point_id, state), tw.* EXCLUDE (point_id, state)
    FROM crossed c JOIN sw USING (point_id, state) JOIN tw USING (point_id, state)""")
def _(spark, d):
    out = prediction.predict_grid(
        grid(spark, d), init_states(spark, d), lookup(spark, d), load_counting_model,
        _CLIMATE, _SITE, N_STATES, dtype="float64",
    )
    out = out.withColumns({f"time_index_{j}": F.col(f"time_index_{j}").cast("bigint")
                           for j in range(1, 6)})
    return r6(out, *[f"{n}_proba_{j}" for n in ("state", "time") for j in range(1, 6)])


