"""From raw examples to the pruned training set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import enrich, prune
from ..session import materialise


def prune_examples(
    df: DataFrame,
    max_dist: float = prune.MAX_DISTANCE,
    min_count: int = prune.MIN_COUNT,
    keep_missing: bool = True,
) -> DataFrame:
    """Plausible transitions between frequent states with a closed history; yearly sources only.
    What passes the first two filters is written out, as the last one reads it several times."""
    near = prune.transition_distance_filter(df, max_dist)
    frequent = materialise(prune.rare_state_filter(near, min_count=min_count), "frequent")
    closed = prune.closed_state_set(frequent, keep_missing=keep_missing)
    return enrich.exclude_ids(closed).select(*df.columns, "dist")


def prune_training_tables(
    examples: DataFrame,
    augmented: DataFrame,
    max_dist: float = prune.MAX_DISTANCE,
    min_count: int = prune.MIN_COUNT,
    keep_missing: bool = True,
    group: Sequence[str] = (),
    cap: int = prune.GROUP_CAP,
    seed: int = 1,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both training tables and the lookup of their states (state, stateID).

    The examples are thinned per `group` (if one is given) and pruned. The augmented ones follow:
    plausible transitions of yearly sources whose states all begin an example that was kept. Their
    rare states are not counted again; only the kept states, a table written once, bound them. Both
    tables are written, as the lookup reads them too."""
    state = prune.STATE_COLUMNS[0]
    if group:
        examples = prune.coverage_subsample(examples, group, state, cap, seed)
    pruned = prune_examples(examples, max_dist, min_count, keep_missing)
    kept = materialise(pruned.select(*examples.columns), "pruned")
    states = materialise(kept.select(state).where(F.col(state).isNotNull()).distinct(), "states")
    # the semi joins on states are cheaper than the similarity, so they come first
    known = prune.conform_to_states(augmented, states)
    near = prune.transition_distance_filter(enrich.exclude_ids(known), max_dist)
    kept_augmented = materialise(near.select(*augmented.columns), "pruned_augmented")
    return kept, kept_augmented, prune.state_lookup([kept, kept_augmented])


def with_state_ids(df: DataFrame, lookup: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The rows with `<col>_id` for each listed state column; states are in the lookup."""
    for c in cols:
        ids = lookup.select(F.col("state").alias(c), F.col("stateID").alias(f"{c}_id"))
        df = df.join(ids, [c], "left")
    return df
