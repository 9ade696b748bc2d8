import random

import pytest
from pyspark.sql import functions as F

from standflow.functions import statecode as sc
from standflow.operators import prune as pr
from standflow.plans import pruning


def shares(spark, comp):
    df = spark.createDataFrame([(comp,)], "c string").select(sc.species_shares("c").alias("s"))
    return {x["species"]: round(x["prop"], 6) for x in df.first().s}


@pytest.mark.parametrize("comp,want", [
    ("PIAB", {"piab": 1.0}),
    ("PIABfasy", {"piab": 0.66, "fasy": 0.34}),
    ("piabfasy", {"piab": 0.5, "fasy": 0.5}),
    ("FASYabalpiab", {"fasy": 0.66, "abal": 0.17, "piab": 0.17}),
    ("fasyabalpiab", {"fasy": 0.34, "abal": 0.33, "piab": 0.33}),
    ("fasyabalpiablade", {"fasy": 0.25, "abal": 0.25, "piab": 0.25, "lade": 0.25}),
    ("fasyfasyabal", {"fasy": 0.5, "abal": 0.5}),
    ("QUROquro", {"quro": 1.0}),
])
def test_shares(spark, comp, want):
    assert shares(spark, comp) == want


def test_similarity_by_hand(spark):
    cases = [
        ("PIAB_2_4_6", "PIAB_2_4_6", 1.0),
        ("PIAB_2_4_6", "PIAB_3_4_6", 1 - 0.0625),
        ("PIAB_2_4_6", "PIAB_4_4_6", 0.0),
        ("PIAB_2_4_6", "PIAB_2_8_10", 0.0),
        ("PIAB_2_0_2", "FASY_2_0_2", 1.0),
        ("PIAB_2_4_6", "FASY_2_4_6", 0.1353352832),
        ("PIAB_2_4_6", "FASY_2_6_8", 0.1353352832),
        ("FASY_2_6_8", "PIAB_2_4_6", 0.0497870684),
    ]
    df = spark.createDataFrame(cases, "a string, b string, want double")
    for r in df.withColumn("sim", sc.state_similarity_of("a", "b")).collect():
        assert abs(r.sim - r.want) < 1e-9, r


def test_sparse_similarity_equals_all_pairs(spark):
    rng = random.Random(3)
    comps = ["PIAB", "PIABfasy", "fasypiab", "ABALpiabfasy", "pisyabalfasypiab"]
    codes = sorted({
        f"{rng.choice(comps)}_{rng.randint(1, 5)}_{rng.randint(0, 9)}_9" for _ in range(60)
    })
    states = spark.createDataFrame([(c,) for c in codes], "state string")
    got = {(r.state_from, r.state_to): r.sim for r in pr.state_similarity(states).collect()}
    pairs = spark.createDataFrame([(a, b) for a in codes for b in codes], "a string, b string")
    dense = pairs.withColumn("sim", sc.state_similarity_of("a", "b")).collect()
    assert len(got) < len(dense)
    for r in dense:
        assert abs(got.get((r.a, r.b), 0.0) - r.sim) < 1e-12
    for limit in (0.1, 0.5, 0.93, 0.97):
        rows = pr.state_similarity(states, min_sim=limit).collect()
        assert {(r.state_from, r.state_to) for r in rows} == {
            (r.a, r.b) for r in dense if r.sim >= limit
        }
        assert len({(r.state_from, r.state_to) for r in rows}) == len(rows)


def brute_closed(rows, keep_missing):
    known, first = {r[0] for r in rows} | {"missing"}, True
    while True:
        kept = [r for r in rows if all(s in known for s in r)]
        new = {r[0] for r in kept} | ({"missing"} if keep_missing else set())
        if new == known and not first:
            return kept
        if new == known:
            return kept
        known, first = new, False


@pytest.mark.parametrize("keep_missing", [True, False])
def test_closed_state_set(spark, keep_missing):
    rng = random.Random(11)
    names = [f"S{i}" for i in range(14)]
    rows = []
    for i in range(13):  # a chain: each state needs the next one, the last is never a first state
        rows += [(names[i], names[i + 1], "missing" if i % 3 else names[i], names[i], names[i])]
    rows += [(rng.choice("XYZ"),) + tuple(rng.choice(["X", "Y", "Z", "missing"]) for _ in range(4))
             for _ in range(60)]
    df = spark.createDataFrame(rows, list(pr.STATE_COLUMNS))
    got = sorted(tuple(r) for r in pr.closed_state_set(df, keep_missing=keep_missing).collect())
    assert got == sorted(brute_closed(rows, keep_missing))
    assert all(r[0] in "XYZ" for r in got)


def test_rounds_read_only_users_of_lost_states(spark, monkeypatch):
    """One state falls after the other along a chain; each round reads a bucket or two."""
    rows = [(f"C{i}", f"C{i + 1}", "missing", "missing", "missing") for i in range(6)]
    rows += [(f"S{i}", f"S{(i + 7) % 400}", "missing", "missing", "missing") for i in range(400)]
    df = spark.createDataFrame(rows, list(pr.STATE_COLUMNS))
    read, users = [], pr._users

    def counted(uses, lost, own):
        buckets = {r["b"] for r in lost.select(pr._bucket(own).alias("b")).collect()}
        part = uses.where(F.col("__bucket").isin(list(buckets)))
        read.append((part.count(), uses.count()))
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [__bucket" in plan or "PartitionFilters: [isnotnull(__bucket" in plan
        return users(uses, lost, own)

    monkeypatch.setattr(pr, "_users", counted)
    assert pr.closed_state_set(df).count() == 400
    assert 5 <= len(read) <= 7
    assert all(n < 0.5 * every for n, every in read)


def test_rare_states_and_orphans(spark):
    rows = [("A", "B")] * 12 + [("A", "C")] * 3 + [("B", "B")] * 11 + [("D", None)] * 20
    df = spark.createDataFrame(rows, "svd_state string, target_state string")
    out = pr.rare_state_filter(df)
    # a null state is counted like any other
    assert out.count() == 43 and {r.count_svd_state for r in out.collect()} == {15, 11, 20}
    orphans = pr.orphan_states(df, other_cols=["target_state"]).collect()
    assert [(r.column, r.state) for r in orphans] == [("target_state", "C")]


def test_lookup(spark):
    df = spark.createDataFrame([("B_1", "A_1"), ("missing", "C_1"), (None, "A_1")], "a string, b string")
    rows = {r.state: r.stateID for r in pr.state_lookup([df], ["a", "b"]).collect()}
    assert rows == {"missing": 0, "A_1": 1, "B_1": 2, "C_1": 3}


def test_subsample_keeps_every_state_and_small_groups(spark):
    rows = [(1, "S%d" % (i % 4 if i < 900 else 4), i) for i in range(1000)]
    rows += [(2, "S0", i) for i in range(30)] + [(None, "S1", i) for i in range(100)]
    df = spark.createDataFrame(rows, "g int, state string, v int")
    take = lambda n: sorted(
        map(tuple, pr.coverage_subsample(df.repartition(n), ["g"], "state", 50, seed=2).collect()),
        key=str,
    )
    one = take(1)
    assert one == take(7)
    assert len(set(one)) == len(one) and set(one) <= set(rows)
    assert sum(r[0] == 2 for r in one) == 30
    big = [r for r in one if r[0] == 1]
    assert {r[1] for r in big} == {f"S{i}" for i in range(5)} and 25 <= len(big) <= 50
    assert 25 <= sum(r[0] is None for r in one) <= 50


def test_subsample_of_copies(spark):
    """One row that makes up most of a cell is drawn once and does not crowd out its state."""
    rows = [(1, "A", 0)] * 900 + [(1, "A", i) for i in range(1, 40)] + [(1, "B", i) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, state string, v int")
    got = [tuple(r) for r in pr.coverage_subsample(df, ["g"], "state", 200, seed=3).collect()]
    assert len(got) == len(set(got)) and set(got) <= set(rows)
    assert (1, "A", 0) in got
    assert 30 < sum(r[1] == "B" for r in got) <= 60 and 1 <= sum(r[1] == "A" for r in got) < 25


def test_pruned_set_has_no_orphans(spark):
    rows = []
    for i in range(600):
        s = f"PIAB_{1 + i % 3}_{2 * (i % 4)}_{2 * (i % 4) + 2}"
        t = f"PIAB_{1 + i % 3}_{2 * ((i + i % 2) % 4)}_{2 * ((i + i % 2) % 4) + 2}"
        rows.append((i, 1005 if i % 50 == 0 else i % 9, s, t, "missing", s, t))
    df = spark.createDataFrame(
        rows, "id int, uniqueID int, svd_state string, target_state string, hist_state1 string, "
        "hist_state2 string, hist_state3 string"
    )
    out = pruning.prune_examples(df).cache()
    assert 0 < out.count() < 600
    assert out.where("dist > 0.9 or uniqueID = 1005").count() == 0
    assert pr.orphan_states(out).where(F.col("state") != "missing").count() == 0
