"""Model input, batch scoring and what is made of the scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_int, hash_unit
from ..functions.model_apply import ModelLoader, apply_model
from ..session import materialise

# Fixed values of the study.
TRAIN_SHARE = 0.8
TOP_K = 5
N_TIMES = 10
MISSING_ID = 0
KEEP_HISTORY = {3: 0.4, 2: 0.2, 1: 0.2, 0: 0.2}
TIME_SCALE = 10.0
SITE_SCALES = {
    "WHC": 1000.0, "TextureSand": 100.0, "SoilDepth": 10000.0, "AvailableNitrogen": 100.0,
    "whc_extract": 1000.0, "sand_extract": 100.0, "depth_extract": 10000.0, "r_nitro": 100.0,
}
CLIMATE_SCALES = {
    "MAT": 20.0, "ANP": 10.0, "Mrad": 20.0, "Mvpd": 1.0, "tas_month": 30.0, "prec_month": 20.0,
    "comp_clim": 1.0, "npp": 1.0,
}


def train_val_split(
    df: DataFrame, keys: Sequence[str], frac: float = TRAIN_SHARE, seed: int = 1
) -> DataFrame:
    """`split` is train or val, by hash of the key: a key is never in both."""
    return df.withColumn(
        "split", F.when(hash_unit(*keys, seed=seed) < frac, "train").otherwise("val")
    )


def pair_augmentation(split: DataFrame, augmentation: DataFrame, keys: Sequence[str]):
    """The split with the augmented rows of its own keys, in the key's part of the split."""
    parts = split.select(*keys, "split").distinct()
    return split.unionByName(augmentation.join(parts, list(keys)), allowMissingColumns=True)


def encode_states(
    df: DataFrame,
    lookup: DataFrame,
    cols: Sequence[str],
    unknown: int = MISSING_ID,
    target_time: str | None = None,
) -> DataFrame:
    """`<col>_id` for each state column, unknown codes to `unknown`; times count from 0. The lookup
    is written first: the planner knows its size, and shuffles the rows only if it is too large to
    broadcast."""
    out, lookup = df, materialise(lookup.select("state", "stateID"), "lookup")
    for c in cols:
        ids = lookup.select(F.col("state").alias(c), F.col("stateID").alias(f"{c}_id"))
        out = out.join(ids, [c], "left").withColumn(
            f"{c}_id", F.coalesce(f"{c}_id", F.lit(unknown))
        )
    out = out.select(*df.columns, *[f"{c}_id" for c in cols])
    if target_time is not None:
        out = out.withColumn(f"{target_time}_index", F.col(target_time) - 1)
    return out


def scale_of(name: str) -> float | None:
    """Divisor of a feature column, by name; None for a column that is not scaled."""
    if name.startswith(("residence_time", "hist_time")):
        return TIME_SCALE
    for prefix, scale in {**SITE_SCALES, **CLIMATE_SCALES}.items():
        if name.startswith(prefix):
            return scale
    return None


def scale_features(df: DataFrame, scales: Mapping[str, float] | None = None) -> DataFrame:
    """Feature columns divided by their scale; other columns unchanged."""
    if scales is None:
        scales = {c: s for c in df.columns if (s := scale_of(c)) is not None}
    return df.select(
        *[(F.col(c) / scales[c]).alias(c) if c in scales else F.col(c) for c in df.columns]
    )


def feature_cube(
    df: DataFrame, cols: Sequence[str], years: int = 10, features: int = 52, name: str = "climate"
) -> DataFrame:
    """[years][features] from columns ordered by feature, then year."""
    if len(cols) != years * features:
        raise ValueError("need one column per year and feature")
    # written out: an array made first and indexed in a lambda is made again for each element
    by_year = [cols[i::years] for i in range(years)]
    return df.withColumn(
        name, F.array(*[F.array(*[F.col(c).cast("double") for c in year]) for year in by_year])
    )


def cross_initial_states(
    grid: DataFrame,
    init_states: DataFrame,
    lookup: DataFrame,
    part: Sequence[str] = ("species", "decade", "scenario"),
    seed: int = 1,
) -> DataFrame:
    """Every grid row with every initial state of its species, encoded; a state that the lookup does
    not have gets the id of a missing one. History is missing, residence time is 1, and the three
    history times are drawn once per input part and state.

    The states are stored as one row per species, so that the planner knows their size and the wide
    grid is shuffled by species only if they are too many to broadcast."""
    known = lookup.select("state", F.col("stateID").alias("starting_state"))
    one = F.struct(
        "state", F.coalesce("starting_state", F.lit(MISSING_ID)).alias("starting_state")
    )
    states = materialise(
        init_states.select("species", "state")
        .join(known, ["state"], "left")
        .groupBy("species")
        .agg(F.collect_list(one).alias("__states")),
        "init_states",
    )
    draw = lambda k: (
        1 + F.pmod(hash_int(*part, "state", F.lit(k), seed=seed), F.lit(10))
    ).cast("int")
    return (
        grid.join(states, ["species"])
        .withColumn("__state", F.explode("__states"))
        .select(*grid.columns, "__state.*")
        .withColumns({
            **{f"hist_state{k}_id": F.lit(MISSING_ID) for k in (1, 2, 3)},
            "residence_time": F.lit(1),
        })
        .withColumns({f"hist_time{k}": draw(k) for k in (1, 2, 3)})
    )


def batch_score(
    df: DataFrame,
    load_model: ModelLoader,
    inputs: Sequence[str],
    n_states: int,
    n_times: int = N_TIMES,
    drop: Sequence[str] = (),
    dtype: str = "float32",
) -> DataFrame:
    """Appends `p_state` and `p_time`, the class probabilities of the two model heads."""
    return apply_model(
        df, load_model, inputs, {"p_state": n_states, "p_time": n_times}, drop, dtype
    )


def top_k(proba: Column | str, k: int = TOP_K) -> Column:
    """The k largest as ARRAY<STRUCT<neg, i>>; the lower index wins ties. One walk over the vector
    with the best k so far: a value is compared with the last of them, and only a better one is put
    in its place."""
    vector = F.col(proba) if isinstance(proba, str) else proba
    entries = F.transform(vector, lambda p, i: F.struct((-p).alias("neg"), i.alias("i")))

    def step(best: Column, x: Column) -> Column:
        better = (F.size(best) < k) | (x < F.get(best, F.lit(k - 1)))
        grown = F.slice(F.array_sort(F.concat(best, F.array(x))), 1, k)
        return F.when(better, grown).otherwise(best)

    return F.aggregate(entries, F.slice(entries, 1, 0), step)


def top_k_predictions(
    df: DataFrame,
    proba: str,
    index_name: str,
    proba_name: str,
    k: int = TOP_K,
    base: int = 0,
) -> DataFrame:
    """`<index_name>_<j>` and `<proba_name>_<j>` of the j-th best class; `base` is added to the
    class index."""
    ranked = df.withColumn("__top", top_k(proba, k))
    return ranked.select(
        *df.columns,
        *[(F.get("__top", F.lit(j))["i"] + base).alias(f"{index_name}_{j + 1}") for j in range(k)],
        *[(-F.get("__top", F.lit(j))["neg"]).alias(f"{proba_name}_{j + 1}") for j in range(k)],
    )


def spread_best(
    df: DataFrame, best: str, index_name: str, proba_name: str, k: int = TOP_K, base: int = 0
) -> DataFrame:
    """The columns of `top_k_predictions`, from a column of the best classes as `apply_model` gives
    it, which goes."""
    at = lambda j: F.get(best, F.lit(j))
    return df.select(
        *[c for c in df.columns if c != best],
        *[(at(j)["i"] + base).alias(f"{index_name}_{j + 1}") for j in range(k)],
        *[at(j)["p"].alias(f"{proba_name}_{j + 1}") for j in range(k)],
    )


def decode_states(df: DataFrame, lookup: DataFrame, cols: Sequence[str]) -> DataFrame:
    """State ids back to codes, in place. The lookup is written first, as in `encode_states`."""
    out, lookup = df, materialise(lookup.select("state", "stateID"), "lookup")
    for c in cols:
        names = lookup.select(F.col("stateID").cast(df.schema[c].dataType).alias(c),
                              F.col("state").alias("__state"))
        out = out.join(names, [c], "left").withColumn(c, F.col("__state")).drop("__state")
    return out.select(*df.columns)


def mask_history(
    df: DataFrame,
    hist_cols: Sequence[str],
    keys: Sequence[str],
    probs: Mapping[int, float] = KEEP_HISTORY,
    seed: int = 1,
    missing=0,
) -> DataFrame:
    """Keep only the latest 3, 2, 1 or 0 history values, drawn per row with the given
    probabilities; the others become `missing`."""
    u = hash_unit(*keys, seed=seed)
    bounds = list(accumulate(probs.values()))
    keep = F.when(F.lit(False), F.lit(0))
    for n, bound in list(zip(probs, bounds))[:-1]:
        keep = keep.when(u < bound, n)
    d = df.withColumn("__keep", keep.otherwise(list(probs)[-1]))
    return d.withColumns({
        c: F.when(F.col("__keep") >= j, F.col(c)).otherwise(F.lit(missing).cast(df.schema[c].dataType))
        for j, c in enumerate(hist_cols, 1)
    }).drop("__keep")


def classification_metrics(
    df: DataFrame, proba: str, label: str, k: Sequence[int] = (1, 2)
) -> DataFrame:
    """Rows, share of labels among the k likeliest classes for each k, and mean cross-entropy."""
    p = F.get(proba, F.col(label))
    ahead = F.size(
        F.filter(
            F.transform(proba, lambda v, i: (v > p) | ((v == p) & (i < F.col(label)))), lambda b: b
        )
    )
    d = df.withColumn("__rank", ahead + 1).withColumn("__loss", -F.log(p))
    return d.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.avg((F.col("__rank") <= n).cast("int")).alias(f"top{n}_accuracy") for n in k],
        F.avg("__loss").alias("cross_entropy"),
    )

