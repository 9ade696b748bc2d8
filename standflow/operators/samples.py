"""Multi-year climate features and their attachment to examples.

Yearly climate is four arrays of 365 daily values: tas, prec, rad, vpd.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.model_apply import ModelLoader, apply_model, dense

# Fixed values of the study.
VARIABLES = ("tas", "prec", "rad", "vpd")
ANNUAL_NAMES = {"tas": "MAT", "prec": "ANP", "rad": "Mrad", "vpd": "Mvpd"}
MONTHLY_VARIABLES = ("tas", "prec")
DAYS_IN_MONTH = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
DAYS = 365
CLIMATE_SCALE = (10.0, 3.0, 20.0, 1.0)
SITE = {"nitrogen": 70.0, "depth": 90.0, "pctSand": 45.0, "pctSilt": 30.0, "pctClay": 25.0}
SITE_SCALE = 100.0
N_COMPRESSED, N_NPP = 14, 10
SPAN = 10
MODEL_ROWS = 256
FEATURE_GROUPS = ("MAT", "ANP", "Mrad", "Mvpd", "month", "comp_clim", "npp")
EXAMPLE_KEYS = ("scenario", "uniqueID", "simulationID")
UNUSED_COLUMNS = (
    "sp_comp", "lai_class", "dom_height", "veg_state", "WHC", "TextureSand", "TextureSilt",
    "TextureClay", "SoilDepth", "AvailableNitrogen", "svd_state",
)


def _mean(values: Column) -> Column:
    """Missing days are left out; without any day the mean is null."""
    days = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.try_divide(F.aggregate(days, F.lit(0.0), lambda acc, v: acc + v), F.size(days))


def feature_names() -> list[str]:
    """The 52 yearly features in model order."""
    return [
        *ANNUAL_NAMES.values(),
        *[f"{v}_month{m}" for v in MONTHLY_VARIABLES for m in range(1, 13)],
        *[f"comp_clim_{i}" for i in range(1, N_COMPRESSED + 1)],
        *[f"npp_{i}" for i in range(1, N_NPP + 1)],
    ]


def attach_years(
    examples: DataFrame,
    sims: DataFrame,
    keys: Sequence[str] = EXAMPLE_KEYS,
    year: str = "Year",
    span: int = SPAN,
) -> DataFrame:
    """Each example with its simulation's rows of the years y..y+span-1. The example's own year
    becomes `example_year`. The interval is spelled out as years, so the join is by equality and
    a long simulation spreads over its years."""
    spread = examples.withColumnRenamed(year, "example_year").withColumn(
        year, F.explode(F.sequence(F.col("example_year"), F.col("example_year") + (span - 1)))
    )
    return spread.join(sims, [*keys, year])


def complete_windows(
    df: DataFrame, example_keys: Sequence[str], span: int = SPAN
) -> DataFrame:
    """Rows without nulls, of examples that have exactly `span` of them."""
    per_example = Window.partitionBy(*example_keys)
    return (
        df.dropna()
        .withColumn("__n", F.count(F.lit(1)).over(per_example))
        .where(F.col("__n") == span)
        .drop("__n")
    )


def annual_climate_means(climate: DataFrame) -> DataFrame:
    """MAT, ANP, Mrad, Mvpd: yearly means of the daily values (precipitation too)."""
    return climate.withColumns({n: _mean(F.col(v)) for v, n in ANNUAL_NAMES.items()})


def monthly_climate_means(climate: DataFrame) -> DataFrame:
    """Twelve means each for temperature and precipitation; months of fixed length."""
    columns = {}
    for v in MONTHLY_VARIABLES:
        start = 1
        for m, days in enumerate(DAYS_IN_MONTH, 1):
            columns[f"{v}_month{m}"] = _mean(F.slice(v, start, days))
            start += days
    return climate.withColumns(columns)


def climate_cube(climate: DataFrame, scale: Sequence[float] = CLIMATE_SCALE) -> DataFrame:
    """`cube`: 365 days of four scaled values."""
    return climate.withColumn(
        "cube",
        F.transform(
            F.arrays_zip(*VARIABLES),
            lambda d: F.array(*[d[v] / s for v, s in zip(VARIABLES, scale)]),
        ),
    )


def constant_site(df: DataFrame, values: Mapping[str, float] = SITE) -> DataFrame:
    """Constant soil columns and `site`, the same values scaled, as an array."""
    return df.withColumns({
        **{n: F.lit(v) for n, v in values.items()},
        "site": F.array(*[F.lit(v / SITE_SCALE) for v in values.values()]),
    })


def compress_climate(
    df: DataFrame, load_model: ModelLoader, dtype: str = "float32"
) -> DataFrame:
    """Replace `cube` and `site` by the model's compressed climate and productivity columns. The
    model takes {cube: (n, 365, 4), site: (n, 5)} and returns {comp_clim: (n, 14), npp: (n, 10)}."""
    out = apply_model(
        df, load_model, ["cube", "site"], {"comp_clim": N_COMPRESSED, "npp": N_NPP},
        drop=["cube", "site"], dtype=dtype,
    )
    return out.select(
        *[c for c in out.columns if c not in ("comp_clim", "npp")],
        *[F.col("comp_clim")[i].alias(f"comp_clim_{i + 1}") for i in range(N_COMPRESSED)],
        *[F.col("npp")[i].alias(f"npp_{i + 1}") for i in range(N_NPP)],
    )


def climate_features(
    climate: DataFrame, load_model: ModelLoader, dtype: str = "float32"
) -> DataFrame:
    """All 52 features of each climate row; the daily arrays are dropped."""
    names = feature_names()
    rows = climate.drop(*SITE, "cube", "site", *names)
    packed = packed_features(rows, load_model, dtype, "__features", days=None)
    return packed.select(
        *[c for c in packed.columns if c != "__features"],
        *[F.col("__features")[i].alias(n) for i, n in enumerate(names)],
    )


def _day_means(days: np.ndarray) -> np.ndarray:
    """Means over the last axis; missing days are left out, without any day NaN."""
    seen = ~np.isnan(days)
    if days.shape[-1] and seen.all():
        return days.mean(axis=-1)
    n = seen.sum(axis=-1)
    total = np.where(seen, days, 0.0).sum(axis=-1)
    return np.divide(total, n, out=np.full(total.shape, np.nan), where=n > 0)


def packed_features(
    climate: DataFrame,
    load_model: ModelLoader,
    dtype: str = "float32",
    name: str = "features",
    days: int | None = DAYS,
) -> DataFrame:
    """The features of `climate_features` as one array in the order of `feature_names`, in place of
    the daily arrays (and of a column called `name`), from one pass over Arrow batches: the days go
    to the worker once, and 52 numbers a row come back. Batches are worked in pieces of MODEL_ROWS
    rows, which stay in the processor's cache. Means without any day are null; a null day or arrays
    of another length than `days` are errors, as for the model (None: any one length)."""
    kept = [f for f in climate.schema.fields if f.name not in (*VARIABLES, name)]
    schema = T.StructType([*kept, T.StructField(name, T.ArrayType(T.DoubleType()))])
    names = [f.name for f in kept]
    ends = np.cumsum(DAYS_IN_MONTH)
    months = [slice(int(e - n), int(e)) for e, n in zip(ends, DAYS_IN_MONTH)]
    width = len(feature_names())
    expected = days

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model()
        site = np.array(list(SITE.values())) / SITE_SCALE
        for batch in (b.slice(i, MODEL_ROWS) for b in batches for i in range(0, b.num_rows, MODEL_ROWS)):
            n = batch.num_rows
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            days = [dense(column[v], "float64").reshape(n, -1) for v in VARIABLES]
            lengths = {d.shape[1] for d in days}
            if len(lengths) > 1 or (expected is not None and lengths != {expected}):
                raise ValueError(f"{expected or 'equally many'} daily values expected")
            cube = np.empty((n, *lengths, len(VARIABLES)), dtype)
            for i, (d, s) in enumerate(zip(days, CLIMATE_SCALE)):
                cube[:, :, i] = d / s
            soil = np.broadcast_to(site, (n, len(site)))
            out = model({"cube": cube, "site": soil.astype(dtype)})
            by_name = dict(zip(VARIABLES, days))
            means = [_day_means(d) for d in days]
            means += [_day_means(by_name[v][:, m]) for v in MONTHLY_VARIABLES for m in months]
            values = np.hstack([
                np.stack(means, axis=1),
                np.asarray(out["comp_clim"], dtype="float64").reshape(n, N_COMPRESSED),
                np.asarray(out["npp"], dtype="float64").reshape(n, N_NPP),
            ])
            empty = np.isnan(values)
            empty[:, len(means) :] = False  # the model's own NaN stay
            flat = pa.array(values.ravel(), mask=empty.ravel())
            offsets = pa.array(np.arange(0, n * width + 1, width, dtype="int32"))
            arrays = [column[c] for c in names] + [pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, name])

    return climate.mapInArrow(run, schema)


def sequence_within_example(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "s"
) -> DataFrame:
    """Running number of the rows of an example in year order, from 1; keys may be null. An
    example has one row per year of its span, so the window stays small."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def unstack_years(
    df: DataFrame, keys: Sequence[str], seq: str, cols: Sequence[str], n: int = SPAN
) -> DataFrame:
    """`<col>_<s>` for s = 1..n, one row per key. The n rows of a key are gathered once as a map
    from s, instead of one aggregate per output column. A number outside 1..n is an error: no row is
    left out in silence."""
    entry = F.struct(F.col(seq).alias("k"), F.struct(*cols).alias("v"))
    surplus = F.raise_error(F.concat(F.lit(f"{seq} is not within 1..{n}: "), F.col(seq)))
    entry = F.when(F.col(seq).between(1, n), entry).otherwise(surplus)
    rows = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("__rows"))
    at = {s: F.try_element_at("__rows", F.lit(s).cast(df.schema[seq].dataType)) for s in range(1, n + 1)}
    return rows.select(
        *keys, *[at[s][c].alias(f"{c}_{s}") for c in cols for s in range(1, n + 1)]
    )


def select_feature_columns(
    df: DataFrame, static: Sequence[str], groups: Sequence[str] = FEATURE_GROUPS
) -> DataFrame:
    """Static columns, then the columns whose name holds each group's fragment, in group order."""
    chosen = [c for g in groups for c in df.columns if g in c and c not in static]
    return df.select(*static, *chosen)


def drop_unused_columns(
    df: DataFrame, drop: Sequence[str] = UNUSED_COLUMNS, casts: Mapping[str, str] | None = None
) -> DataFrame:
    """Without the listed columns, where present; listed ids cast."""
    kept = df.drop(*drop)
    return kept.withColumns({c: F.col(c).cast(t) for c, t in (casts or {}).items()})
