"""Wide ten-year samples for training and for prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model_apply import ModelLoader
from ..operators import samples as sm

ID_CASTS = {"uniqueID": "bigint", "simulationID": "bigint", "Year": "bigint"}
POINT_KEYS = (
    "point_id", "wgs_x", "wgs_y", "whc_extract", "sand_extract", "depth_extract", "r_nitro",
)


PACKED = "__features"


def _yearly(
    climate: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    load_model: ModelLoader | None,
    dtype: str,
) -> DataFrame:
    """The keys and one array of the features. With a model they come from the daily arrays in one
    Arrow pass; without, from columns of their names."""
    if load_model is None:
        packed = F.array(*[F.col(f).cast("double") for f in features])
        return climate.select(*keys, packed.alias(PACKED))
    known = sm.feature_names()
    days = climate.select(*keys, *sm.VARIABLES)
    yearly = sm.packed_features(days, load_model, dtype, PACKED)
    if list(features) == known:
        return yearly
    chosen = F.array(*[F.col(PACKED)[known.index(f)] for f in features])
    return yearly.withColumn(PACKED, chosen)


def _wide(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], span: int):
    """One row per key with exactly `span` years; the packed features become columns with the years
    as suffixes in order. The window, the running number and the reshaping are one aggregation over
    the few rows of a key."""
    gathered = (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.sort_array(F.collect_set(F.struct(order, PACKED))).alias("__years"),
        )
        .where((F.col("__n") == span) & (F.size("__years") == span))
    )
    at = F.col("__years")
    return gathered.select(
        *keys,
        *[at[s][PACKED][i].alias(f"{c}_{s + 1}") for i, c in enumerate(cols) for s in range(span)],
    )


def build_training_samples(
    examples: DataFrame,
    sims: DataFrame,
    load_model: ModelLoader | None = None,
    keys: Sequence[str] = sm.EXAMPLE_KEYS,
    span: int = sm.SPAN,
    features: Sequence[str] | None = None,
    dtype: str = "float32",
) -> DataFrame:
    """Examples of all scenarios and units with the features of their years, complete ones only.

    `sims` holds one row per simulation year with daily arrays, or the features already when no
    model is given. Features are computed once per simulation year, before examples that share
    years repeat them, and travel as one array until the last step. Equal examples are assembled
    once and repeated at the end. `exampleID` names an example by its keys and year; a `grid_id` of
    the examples becomes `gridID`."""
    features = list(features or sm.feature_names())
    yearly = _yearly(sm.drop_unused_columns(sims), [*keys, "Year"], features, load_model, dtype)
    complete = F.forall(PACKED, lambda v: v.isNotNull() & ~F.isnan(v))
    yearly = yearly.dropna(subset=[*keys, "Year"]).where(complete)
    if "grid_id" in examples.columns:
        examples = examples.withColumnRenamed("grid_id", "gridID")
    static = [c for c in examples.columns if c != "Year"]
    counted = examples.dropna().groupBy(*examples.columns).agg(F.count(F.lit(1)).alias("__copies"))
    rows = sm.attach_years(counted, yearly, keys, span=span)
    wide = _wide(rows, [*static, "example_year", "__copies"], "Year", features, span)
    repeated = wide.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "__copies")))
    named = repeated.drop("__copies", "__copy").withColumnRenamed("example_year", "Year")
    return named.select(F.concat_ws(":", *keys, "Year").alias("exampleID"), "*")


def prepare_prediction_input(
    grid_climate: DataFrame,
    load_model: ModelLoader | None = None,
    keys: Sequence[str] = POINT_KEYS,
    year: str = "year",
    span: int = sm.SPAN,
    features: Sequence[str] | None = None,
    dtype: str = "float32",
) -> DataFrame:
    """The same features for grid points, keyed by point, coordinates and soil (null soil is kept);
    years 1..span in order, missing ones null."""
    features = list(features or sm.feature_names())
    yearly = _yearly(grid_climate, [*keys, year], features, load_model, dtype)
    numbered = sm.sequence_within_example(yearly, keys, year)
    packed = sm.unstack_years(numbered, keys, "s", [PACKED], span)
    wide = packed.select(
        *keys,
        *[
            F.col(f"{PACKED}_{s}")[i].alias(f"{c}_{s}")
            for i, c in enumerate(features)
            for s in range(1, span + 1)
        ],
    )
    return sm.select_feature_columns(wide, keys)
