"""Window forms against literal row-by-row walks, with blocks shorter than the timelines."""

import random

import pytest

from standflow.operators import examples as ex
from standflow.plans import extraction

UNIT = ["table", "sim"]


def make_timelines(seed, n=40, states="ABCD"):
    rng = random.Random(seed)
    rows = []
    for sim in range(n):
        year, state = rng.randint(1900, 2050), rng.choice(states)
        length = rng.choice([1, 2, 9, 10, 11, 12, 25, 60, 90])
        change = rng.choice([0.0, 0.03, 0.15, 0.5])
        for _ in range(length):
            rows.append(("t%d" % (sim % 2), sim, year, state))
            year += rng.choice([1, 1, 1, 1, 3, 40])  # gaps may skip whole blocks
            if rng.random() < change:
                state = rng.choice(states)
    rng.shuffle(rows)
    return rows


def walk(timeline, horizon=10):
    """One timeline in year order, row by row; plain dictionaries out."""
    states = [s for _, s in timeline]
    n, out, flags = len(states), [], []
    for i, (year, state) in enumerate(timeline):
        res = out[-1]["res"] + 1 if i and states[i - 1] == state else 1
        window = states[i:min(i + horizon, n)]
        gaps = [k for k, s in enumerate(window) if s != state]
        time = gaps[0] if gaps else (horizon if len(window) == horizon else None)
        target = None if time is None else state if time == horizon else states[i + time]
        prev = states[i - 1] if i else state
        flag = int(prev != state)
        if i >= 9 and flag + sum(flags[i - 9:i]) == 0:
            flag = 1
        flags.append(flag)
        out.append(dict(year=year, state=state, res=res, prev=prev, time=time, target=target,
                        flag=flag))
    kept = [r for r in out if r["flag"] == 1 and r["time"] is not None]
    for i, r in enumerate(kept):
        r["hist"] = [
            (kept[i - k]["state"], kept[i - k]["res"]) if i >= k else ("missing", 0)
            for k in (1, 2, 3)
        ]
    return out, kept


def by_timeline(rows):
    groups = {}
    for t, sim, year, state in rows:
        groups.setdefault((t, sim), []).append((year, state))
    return {k: sorted(v) for k, v in groups.items()}


@pytest.mark.parametrize("seed,block", [(1, 7), (2, 16), (3, 256)])
def test_columns_match_walk(spark, seed, block):
    rows = make_timelines(seed)
    df = spark.createDataFrame(rows, "table string, sim int, year int, state string")
    args = (UNIT, "year", "state")
    got = {}
    for fn, col, key in (
        (ex.residence_time, "residence_time", "res"),
        (ex.previous_state, "previous_year_state", "prev"),
        (ex.target_time, "target_time", "time"),
        (ex.target_state, "target_state", "target"),
        (ex.example_flag, "flag", "flag"),
    ):
        for r in fn(df, *args, block_years=block).collect():
            got.setdefault((r.table, r.sim, r.year), {})[key] = r[col]
    want = {}
    for (t, sim), timeline in by_timeline(rows).items():
        for r in walk(timeline)[0]:
            want[(t, sim, r["year"])] = {k: r[k] for k in ("res", "prev", "time", "target", "flag")}
    assert got == want


@pytest.mark.parametrize("seed,block", [(4, 7), (5, 16), (6, 256)])
def test_examples_match_walk(spark, seed, block):
    rows = make_timelines(seed)
    df = spark.createDataFrame(rows, "table string, sim int, year int, state string")
    got = {}
    for r in extraction.extract_examples(df, UNIT, "year", "state", block_years=block).collect():
        hist = [(r[f"hist_state{k}"], r[f"hist_time{k}"]) for k in (1, 2, 3)]
        got[(r.table, r.sim, r.year)] = (r.state, r.residence_time, r.target_state, r.target_time,
                                         hist)
    want = {}
    for (t, sim), timeline in by_timeline(rows).items():
        for r in walk(timeline)[1]:
            want[(t, sim, r["year"])] = (r["state"], r["res"], r["target"], r["time"], r["hist"])
    assert got == want and len(want) > 50


def test_one_timeline_with_most_rows_is_split(spark):
    """A single timeline of many blocks: same result as with one block."""
    rows = [("t", 1, y, "AB"[(y // 7) % 2 if y % 97 > 5 else 0]) for y in range(3000)]
    df = spark.createDataFrame(rows, "table string, sim int, year int, state string")
    a = extraction.extract_examples(df, UNIT, "year", "state", block_years=50).collect()
    b = extraction.extract_examples(df, UNIT, "year", "state", block_years=5000).collect()
    assert sorted(a) == sorted(b) and len(a) > 300


def test_augmentation_draw(spark):
    rows = [("t", i, 2000, 5, 2 + i % 8) for i in range(400)]
    df = spark.createDataFrame(
        rows, "table string, sim int, year int, residence_time int, target_time int"
    )
    one = ex.augmentation_shift(df.repartition(1), UNIT, seed=7).collect()
    many = ex.augmentation_shift(df.repartition(8), UNIT, seed=7).collect()
    assert sorted(one) == sorted(many)
    by_sim = {r.sim: r for r in one}
    moved = set()
    for _, sim, _, res, time in rows:
        r = by_sim[sim].residence_time - res
        assert 1 <= r <= time - 1 and by_sim[sim].target_time == time - r
        moved.add(r)
    assert moved == set(range(1, 9))


def test_qa(spark):
    df = spark.createDataFrame(
        [("A", "A"), ("NA_1", "B"), ("A", "B"), ("B", "B")], "svd_state string, target_state string"
    )
    r = ex.transition_qa(df).first()
    assert (r.n_rows, r.n_na_state, r.n_targets, r.n_no_change, r.share_no_change) == (4, 1, 2, 2, 0.5)
