"""State space, sampling and pruning of examples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import statecode as sc
from ..functions.hashing import digest, hash_int
from ..functions.joins import null_safe_join, tiled_join
from ..functions.scans import BLOCK, blocked_row_number, carry, key_names, preceding, unkeyed
from ..session import materialise, scratch_path
from .enrich import all_in
from .examples import MISSING

STATE_COLUMNS = ("svd_state", "target_state", "hist_state1", "hist_state2", "hist_state3")

# Fixed values of the study.
GROUP_CAP = 100_000
MAX_DISTANCE = 0.9
MIN_COUNT = 10

# Folders the state combinations are kept in, by the states they use.
STATE_BUCKETS = 64

# Pieces the positions of a cell are cut into, to look up draws by equality.
RANGE_PIECES = 4096


def coverage_subsample(
    df: DataFrame, group: Sequence[str], state: str, cap: int = GROUP_CAP, seed: int = 1
) -> DataFrame:
    """Groups above `cap` rows are replaced by ceil(cap / #states) draws per state, with
    replacement, then made distinct; other groups pass unchanged.

    Draws are hashes of (group, state, draw number) and name a position among the rows of their
    cell, ordered by row digest. Equal rows are counted first and fill a range of positions, so
    neither a large cell nor a mass of copies meets in one task."""
    keys = [*group, state]
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    groups = cells.groupBy(*group).agg(
        F.sum("__n").alias("__rows"), F.count(F.lit(1)).alias("__states")
    )
    large = groups.where(F.col("__rows") > cap)
    small = null_safe_join(df, large, group, "left_anti")

    sized = null_safe_join(cells, large, group).select(
        *keys, "__n", F.ceil(F.lit(cap) / F.col("__states")).alias("__draws"),
        F.ceil(F.col("__n") / RANGE_PIECES).alias("__width"),
    )
    rows = (
        null_safe_join(df, sized.drop("__n", "__draws"), keys)
        .groupBy(*df.columns, "__width")
        .agg(F.count(F.lit(1)).alias("__copies"))
        .withColumn("__digest", digest(*df.columns, seed=seed))
    )
    ranged = _position_ranges(rows, keys)
    # a draw and a range meet in pieces of equal width, then the range decides
    last = F.floor((F.col("__start") + F.col("__copies") - 1) / F.col("__width"))
    pieces = ranged.withColumn(
        "__piece", F.explode(F.sequence(F.floor(F.col("__start") / F.col("__width")), last))
    )
    draws = sized.select(
        *keys, "__n", "__width",
        F.explode(F.sequence(F.lit(1), F.col("__draws").cast("int"))).alias("__i"),
    )
    picked = (
        draws.withColumn("__at", F.pmod(hash_int(*keys, "__i", seed=seed), F.col("__n")))
        .select(*keys, "__at", F.floor(F.col("__at") / F.col("__width")).alias("__piece"))
        .distinct()
    )
    hit = null_safe_join(pieces, picked, [*keys, "__piece"]).where(
        (F.col("__at") >= F.col("__start")) & (F.col("__at") < F.col("__start") + F.col("__copies"))
    )
    return small.select(*df.columns).unionByName(hit.select(*df.columns).distinct())


def _position_ranges(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`__start`: how many rows (copies counted) of the same cell have a smaller digest."""
    # different rows may have one digest (null and ''); their values then decide
    own = [c for c in rows.columns if not c.startswith("__")]
    within = preceding(Window.partitionBy(*key_names(keys), BLOCK).orderBy("__digest", *own))
    ranged = carry(
        rows.withColumn(BLOCK, F.substring("__digest", 1, 3)),
        keys,
        {"__rows": F.sum("__copies")},
        {"__before": lambda w: F.coalesce(F.sum("__rows").over(preceding(w)), F.lit(0))},
    ).withColumn(
        "__start", F.col("__before") + F.coalesce(F.sum("__copies").over(within), F.lit(0))
    )
    return unkeyed(ranged)


def distinct_states(dfs: Sequence[DataFrame], cols: Sequence[str], name: str = "state"):
    """All states in the given columns of the given tables."""
    parts = [
        df.select(F.explode(F.array(*[F.col(c) for c in cols if c in df.columns])).alias(name))
        for df in dfs
    ]
    return reduce(DataFrame.unionByName, parts).where(F.col(name).isNotNull()).distinct()


def state_lookup(
    dfs: Sequence[DataFrame], cols: Sequence[str] = STATE_COLUMNS, missing: str = MISSING
) -> DataFrame:
    """(state, stateID): ids 1..n in sorted order, and the sentinel with id 0."""
    states = distinct_states(dfs, cols).where(F.col("state") != missing)
    numbered = blocked_row_number(states, [], F.substring("state", 1, 4), ["state"], "stateID")
    sentinel = states.sparkSession.range(1).select(
        F.lit(missing).alias("state"), F.lit(0).cast("bigint").alias("stateID")
    )
    return numbered.select("state", F.col("stateID").cast("bigint")).unionByName(sentinel)


def parse_state(df: DataFrame, state: str = "state") -> DataFrame:
    """Code columns: composition, tokens, lower-case species, leaf-area class and lower height."""
    comp = sc.composition(state)
    return df.select(
        "*",
        comp.alias("composition"),
        sc.tokens(comp).alias("tokens"),
        F.transform(sc.tokens(comp), F.lower).alias("species_list"),
        sc.lai_class(state).alias("fct"),
        sc.height_low(state).alias("structure"),
    )


def with_invalid(states: DataFrame, state: str = "state") -> DataFrame:
    """Adds the pseudo-state for invalid codes, of height and leaf area 0."""
    row = states.sparkSession.range(1).select(
        F.lit(f"{sc.INVALID_COMPOSITION}_0_0_0").alias(state)
    )
    return states.select(state).unionByName(row)


def species_proportions(states: DataFrame, state: str = "state") -> DataFrame:
    """Long table (state, species, prop) of the shares in each state."""
    shares = sc.species_shares(sc.composition(state))
    return states.select(state, F.inline(shares)).select(state, "species", "prop")


def species_matrix(props: DataFrame, species: Sequence[str], state: str = "state") -> DataFrame:
    """One row per state and one column per species, absent species 0, and the row sum."""
    wide = props.groupBy(state).pivot("species", list(species)).agg(F.sum("prop")).fillna(0.0)
    return wide.withColumn("row_sum", reduce(lambda a, b: a + b, [F.col(s) for s in species]))


def state_similarity(
    states: DataFrame, state: str = "state", min_sim: float = 0.0
) -> DataFrame:
    """(state_from, state_to, sim) for all pairs, a state with itself included, with sim > 0 and
    sim >= `min_sim`; a pair not listed has less.

    Only states within two height units and less than two leaf-area classes are alike at all, so
    the pairs come from an equi-join on the cells of that neighbourhood. Above some height, a
    limit asks for a least overlap of the species shares. Such pairs meet by a prefix filter: the
    species of a state, in name order, belong to its prefix while they and those after them
    make up that overlap, so the first species of two alike states is in both prefixes. Crowded
    cells are dealt into tiles."""
    s = materialise(
        states.select(
            F.col(state).alias("s"),
            F.array_sort(sc.species_shares(sc.composition(state))).alias("sh"),
            sc.lai_class(state).alias("lai"),
            sc.height_low(state).alias("h"),
        ).where(F.col("lai").isNotNull() & F.col("h").isNotNull()),
        "states",
    )
    left = s.select(*[F.col(c).alias(f"{c}_from") for c in s.columns]).withColumn(
        "__lai", F.explode(F.sequence(F.col("lai_from") - 1, F.col("lai_from") + 1))
    )
    least = sc.least_overlap(min_sim, F.col("lai_from"), F.col("__lai"), F.col("h_from"))
    left = left.withColumn("__h", F.explode(F.sequence(F.col("h_from") - 2, F.col("h_from") + 2)))
    left = left.withColumn(
        "__prefix_from",
        F.when(least <= 0, F.array(F.lit(""))).otherwise(_prefix(F.col("sh_from"), least)),
    )
    # the empty name is for those that ask for no overlap; the others come from heights of two units
    # less on, where the least overlap is smallest
    lowest = F.greatest(F.col("h_to") - 2, F.lit(0))
    smallest = sc.least_overlap(min_sim, F.col("lai_to"), F.col("lai_to"), lowest)
    right = s.select(*[F.col(c).alias(f"{c}_to") for c in s.columns]).withColumns({
        "__lai": F.col("lai_to"), "__h": F.col("h_to"),
        "__prefix_to": F.array_append(_prefix(F.col("sh_to"), smallest), F.lit("")),
    })
    left = left.withColumn("__sp", F.explode("__prefix_from"))
    right = right.withColumn("__sp", F.explode("__prefix_to"))
    sim = sc.similarity(
        sc.share_overlap(F.col("sh_from"), F.col("sh_to")),
        F.col("lai_from"), F.col("lai_to"), F.col("h_from"), F.col("h_to"),
    )
    first = F.array_intersect("__prefix_from", "__prefix_to")[0]
    return (
        tiled_join(left, right, ["__lai", "__h", "__sp"])
        .where(F.col("__sp") == first)
        .select(F.col("s_from").alias("state_from"), F.col("s_to").alias("state_to"),
                sim.alias("sim"))
        .where((F.col("sim") > 0) & (F.col("sim") >= min_sim))
    )


def _prefix(shares: Column, least: Column) -> Column:
    """Species of sorted shares up to the last one from which on they add up to `least`."""
    rest = lambda i: F.aggregate(
        F.slice(shares, i + 1, F.size(shares)), F.lit(0.0), lambda acc, x: acc + x["prop"]
    )
    return F.filter(shares, lambda x, i: rest(i) >= least - 1e-9)["species"]


def transition_distance_filter(
    df: DataFrame,
    max_dist: float = MAX_DISTANCE,
    state: str = "svd_state",
    target: str = "target_state",
) -> DataFrame:
    """Adds `dist` = 1 - similarity and keeps rows up to `max_dist`. The similarity is computed
    once per observed pair of states, and pairs beyond the limit are gone before the join."""
    pairs = df.select(state, target).distinct()
    near = pairs.withColumn(
        "dist", F.lit(1.0) - sc.state_similarity_of(state, target)
    ).where(F.col("dist") <= max_dist)
    return df.join(near, [state, target]).select(*df.columns, "dist")


def rare_state_filter(
    df: DataFrame,
    cols: Sequence[str] = ("svd_state", "target_state"),
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """Rows whose states occur more than `min_count` times in each column, counted on the input.
    Rows are counted per combination; the totals per state are taken among the combinations, and
    the rows meet the surviving ones in one join."""
    combos = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    totals = {f"count_{c}": F.sum("__n").over(Window.partitionBy(c)) for c in cols}
    frequent = combos.withColumns(totals).drop("__n")
    for name in totals:
        frequent = frequent.where(F.col(name) > min_count)
    return null_safe_join(df, frequent, list(cols)).select(*df.columns, *totals)


def closed_state_set(
    df: DataFrame,
    state_cols: Sequence[str] = STATE_COLUMNS,
    keep_missing: bool = True,
    missing: str = MISSING,
) -> DataFrame:
    """Largest subset of rows whose state columns only use states that are themselves a row's
    first state column (and the sentinel, unless `keep_missing` is off: then it counts in the
    first round only).

    The distinct state combinations that the first round leaves are written once, by the states
    they use. A round takes the states lost in the round before, reads the buckets of these
    states, and finds the combinations that fall with them; a state is lost when the last
    combination that begins with it has fallen. The rows themselves are filtered once, at the end."""
    own = state_cols[0]
    spark = df.sparkSession
    sentinel = spark.range(1).select(F.lit(missing).alias(own))
    combos = materialise(df.select(*state_cols).distinct(), "combinations")
    states = materialise(combos.select(own).unionByName(sentinel).distinct(), "states")
    first = materialise(
        all_in(combos, state_cols, states, own).withColumn(
            "__id", F.monotonically_increasing_id()
        ),
        "combinations",
    )
    uses = _by_state(first, state_cols, own)
    support = materialise(first.groupBy(own).agg(F.count(F.lit(1)).alias("__n")), "support")

    lasting = F.lit(keep_missing) & (F.col(own) == missing)
    lost = materialise(
        states.join(support, [own], "left_anti").where(~lasting), "lost_states"
    )
    all_lost, fallen = lost, None
    while not lost.isEmpty():
        hit = _users(uses, lost, own).select("__id", own).distinct()
        if fallen is not None:
            hit = hit.join(fallen.select("__id"), ["__id"], "left_anti")
        newly = materialise(hit, "fallen")
        fallen = newly if fallen is None else fallen.unionByName(newly)
        gone = fallen.join(newly.select(own).distinct(), [own], "left_semi")
        gone = gone.groupBy(own).agg(F.count(F.lit(1)).alias("__gone"))
        lost = materialise(
            support.join(gone, [own])
            .where(F.col("__gone") == F.col("__n"))
            .select(own)
            .where(~lasting)
            .join(all_lost, [own], "left_anti"),
            "lost_states",
        )
        all_lost = all_lost.unionByName(lost)
    return all_in(df, state_cols, states.join(all_lost, [own], "left_anti"), own)


def _bucket(state: str) -> Column:
    return F.pmod(F.xxhash64(state), F.lit(STATE_BUCKETS)).cast("int")


def _by_state(combos: DataFrame, state_cols: Sequence[str], own: str) -> DataFrame:
    """(__state, __id, first state) for each state a combination uses, in folders by state bucket."""
    used = combos.select(
        F.explode(F.array_distinct(F.array(*state_cols))).alias("__state"), "__id", own
    ).withColumn("__bucket", _bucket("__state"))
    path = scratch_path(combos.sparkSession, "uses")
    used.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(path)
    return combos.sparkSession.read.schema(used.schema).parquet(path)


def _users(uses: DataFrame, lost: DataFrame, own: str) -> DataFrame:
    """The uses of lost states; only their buckets are read (at most STATE_BUCKETS numbers pass
    through the driver)."""
    buckets = [r["b"] for r in lost.select(_bucket(own).alias("b")).distinct().collect()]
    return uses.where(F.col("__bucket").isin(buckets)).join(
        lost.withColumnRenamed(own, "__state"), ["__state"], "left_semi"
    )


def conform_to_states(
    df: DataFrame,
    states: DataFrame,
    state_cols: Sequence[str] = STATE_COLUMNS,
    state: str = "svd_state",
    missing: str = MISSING,
) -> DataFrame:
    """Rows whose state columns lie in the first table's states or are the sentinel."""
    sentinel = df.sparkSession.range(1).select(F.lit(missing).alias(state))
    allowed = states.select(state).unionByName(sentinel).distinct()
    return all_in(df, state_cols, allowed, state)


def orphan_states(
    df: DataFrame,
    key_col: str = "svd_state",
    other_cols: Sequence[str] = STATE_COLUMNS[1:],
    lookup: DataFrame | None = None,
) -> DataFrame:
    """(column, state) for states that never occur in `key_col`, or in the lookup if given."""
    known = (
        df.select(F.col(key_col).alias("state"))
        if lookup is None
        else lookup.select(F.col("state"))
    ).distinct()
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("state")) for c in other_cols])
    )
    used = df.select(pairs.alias("p")).select("p.*").where(F.col("state").isNotNull()).distinct()
    return used.join(known, ["state"], "left_anti").select("column", "state")
