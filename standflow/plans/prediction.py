"""Scoring of a whole grid: all inputs and initial states at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.model_apply import ModelLoader, apply_model
from ..operators import model_io as mio


def predict_grid(
    grid: DataFrame,
    init_states: DataFrame,
    lookup: DataFrame,
    load_model: ModelLoader,
    climate_cols: Sequence[str],
    site_cols: Sequence[str],
    n_states: int,
    years: int = 10,
    part: Sequence[str] = ("species", "decade", "scenario"),
    k: int = mio.TOP_K,
    seed: int = 1,
    dtype: str = "float32",
) -> DataFrame:
    """Prediction rows: point and dimensions, initial state, and the k best states and times.

    The grid is scaled and folded into arrays before it is crossed with the initial states, so
    this work is done once per point."""
    ids = [c for c in grid.columns if c not in (*climate_cols, *site_cols)]
    features = len(climate_cols) // years
    scaled = mio.scale_features(grid, {
        c: s for c in (*climate_cols, *site_cols) if (s := mio.scale_of(c)) is not None
    })
    folded = mio.feature_cube(scaled, climate_cols, years, features).select(
        *ids, *site_cols, "climate"
    )
    crossed = mio.cross_initial_states(folded, init_states, lookup, part, seed)
    times = ["residence_time", "hist_time1", "hist_time2", "hist_time3"]
    crossed = mio.scale_features(crossed, {t: mio.TIME_SCALE for t in times})
    inputs = [
        "starting_state", "hist_state1_id", "hist_state2_id", "hist_state3_id", *times,
        *site_cols, "climate",
    ]
    # only the k best classes of each head leave the batch
    scored = apply_model(
        crossed, load_model, inputs, {"p_state": n_states, "p_time": mio.N_TIMES},
        drop=[c for c in inputs if c != "starting_state"], dtype=dtype, best=k,
    )
    states = mio.spread_best(scored, "p_state", "pred_state", "state_proba", k)
    both = mio.spread_best(states, "p_time", "time_index", "time_proba", k, base=1)
    return mio.decode_states(both, lookup, [f"pred_state_{j}" for j in range(1, k + 1)])
