"""Queries over all examples next to those of the same operator over a part."""

from pathlib import Path

import pytest

from contract.bindings import enriched_examples, examples
from contract.catalog import registry
from contract.compare import differences, duck_connection

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.mark.parametrize("name", ["pair_augmentation_all", "orphan_states_all"])
def test_same_rows_as_sql(spark, name):
    fn, sql = registry()[name]
    _, diff = differences(fn(spark, SF_DIR), duck_connection(SF_DIR), sql)
    assert not diff, diff


def test_every_example_is_in_the_split(spark):
    rows = registry()["pair_augmentation_all"][0](spark, SF_DIR)
    ex = enriched_examples(spark, SF_DIR)
    assert rows.where("augmented = 0").count() == ex.count()
    changing = ex.where("target_time NOT IN (1, 10)").count()
    assert rows.where("augmented = 1").count() == changing
    assert rows.where("uniqueID >= 6").count() > 0


def test_orphans_of_all_compositions(spark):
    rows = registry()["orphan_states_all"][0](spark, SF_DIR).collect()
    ex = examples(spark, SF_DIR).collect()
    known = {x["svd_state"] for x in ex}
    columns = ("target_state", "hist_state1", "hist_state2", "hist_state3")
    want = {(c, x[c]) for x in ex for c in columns if x[c] is not None and x[c] not in known}
    assert {tuple(x) for x in rows} == want and want
