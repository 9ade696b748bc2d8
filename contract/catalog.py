"""All registered queries."""

from . import (  # noqa: F401
    change_queries,
    csi_queries,
    enrich_queries,
    example_queries,
    grid_queries,
    model_queries,
    niche_queries,
    prune_queries,
    sample_queries,
    source_queries,
)
from .bindings import registry

__all__ = ["registry"]
