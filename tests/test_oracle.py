"""Registered queries against their SQL on the smallest data; `python -m contract.compare` runs
all of them on any data directory."""

from pathlib import Path

import pytest

from contract.catalog import registry
from contract.compare import differences, duck_connection

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = (
    "transition_counts", "example_flag", "extract_augmentation", "add_soil", "prune_examples",
    "coverage_subsample", "state_similarity", "build_training_samples", "predict_grid",
    "lai_net_change", "dominance_net_change", "niche_table_formatted", "box_summary",
    "modal_block", "hex_clip", "write_predictions",
)

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_DIR)


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, con, name):
    fn, sql = registry()[name]
    _, diff = differences(fn(spark, SF_DIR), con, sql)
    assert not diff, diff
