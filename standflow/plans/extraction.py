"""Simulation tables to training examples and to their augmented copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import examples as ex


def extract_examples(
    df: DataFrame,
    unit: Sequence[str],
    order: str,
    state: str,
    horizon: int = ex.HORIZON,
    n_hist: int = ex.HISTORY,
    block_years: int = ex.BLOCK_YEARS,
) -> DataFrame:
    """Examples of all timelines, with history. Timelines without examples yield no rows."""
    kept = ex.flagged_examples(
        df, unit, order, state, horizon, block_years=block_years, keep_block=True
    )
    return ex.example_history(kept, unit, order, state, n=n_hist, block_years=block_years)


def extract_augmentation(
    df: DataFrame,
    unit: Sequence[str],
    order: str,
    state: str,
    seed: int = 1,
    horizon: int = ex.HORIZON,
    block_years: int = ex.BLOCK_YEARS,
) -> DataFrame:
    """Examples moved to a random year between their own and their change."""
    found = extract_examples(df, unit, order, state, horizon, block_years=block_years)
    candidates = ex.augmentation_candidates(found, drop=(1, horizon))
    return ex.augmentation_shift(candidates, [*unit, order], seed)
