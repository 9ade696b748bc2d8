"""Initial states per species, taken from the examples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import statecode as sc

# Species of the study with the height classes their initial states may have.
HEIGHT_CLASSES = {
    "FASY": ("6_8", "8_10", "10_12", "12_14"),
    "PISY": ("6_8", "8_10", "10_12", "12_14"),
    "ABAL": ("10_12", "12_14", "14_16", "16_18", "18_20"),
    "PIAB": ("10_12", "12_14", "14_16", "16_18"),
    "LADE": ("8_10", "10_12", "12_14", "14_16"),
    "BEPE": ("4_6", "6_8", "8_10"),
    "PIHA": ("4_6", "6_8"),
    "QURO": ("6_8", "8_10", "10_12", "12_14"),
    "QUIL": ("4_6", "6_8"),
}

# The short code that breaks the rule, and species whose range files have other names.
CODE_EXCEPTIONS = {"Pinus_pinea": "PIPN"}
RANGE_NAMES = {
    "Fagus_sylvatica": "Fagus_sylvatica_sylvatica",
    "Larix_decidua": "Larix_decidua_decidua",
    "Quercus_ilex": "Quercus_ilex_ilex",
}
SINGLE_MIN, MIXED_MIN, MIXED_TOP = 10, 5, 10


def _counted(
    examples: Sequence[DataFrame], classes: Mapping[str, Sequence[str]], state: str
) -> DataFrame:
    """(species, state, n) for the species written in upper case in a state of a fitting height.
    States are counted before they meet the species."""
    stacked = reduce(DataFrame.unionByName, [e.select(F.col(state).alias("state")) for e in examples])
    counts = stacked.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    table = F.array(*[
        F.struct(
            F.lit(s).alias("species"), F.array(*[F.lit(h) for h in hs]).alias("heights")
        )
        for s, hs in classes.items()
    ])
    height = F.concat_ws("_", sc.part("state", 2), sc.part("state", 3))
    return (
        counts.select("state", "n", F.explode(table).alias("sp"))
        .where(
            F.contains("state", F.col("sp.species")) & F.array_contains("sp.heights", height)
        )
        .select(F.col("sp.species").alias("species"), "state", "n")
    )


def _ends_with_species() -> Column:
    return F.contains("state", F.concat("species", F.lit("_")))


def initial_states_single(
    examples: Sequence[DataFrame],
    classes: Mapping[str, Sequence[str]] = HEIGHT_CLASSES,
    min_n: int = SINGLE_MIN,
    state: str = "svd_state",
) -> DataFrame:
    """States that end in the dominant species, seen at least `min_n` times."""
    return _counted(examples, classes, state).where(_ends_with_species() & (F.col("n") >= min_n))


def initial_states_mixed(
    examples: Sequence[DataFrame],
    classes: Mapping[str, Sequence[str]] = HEIGHT_CLASSES,
    top: int = MIXED_TOP,
    min_n: int = MIXED_MIN,
    state: str = "svd_state",
) -> DataFrame:
    """Mixtures with the species as dominant: the `top` most frequent per species, ties kept, seen
    at least `min_n` times."""
    frequent = Window.partitionBy("species").orderBy(F.desc("n"))
    return (
        _counted(examples, classes, state)
        .where(~_ends_with_species())
        .withColumn("__rank", F.rank().over(frequent))
        .where((F.col("__rank") <= top) & (F.col("n") >= min_n))
        .drop("__rank")
    )


def species_code(df: DataFrame, species: str = "species") -> DataFrame:
    """`code`, two letters of genus and epithet each, and `range_name`, the name in range files."""
    words = F.split(F.col(species), "_")
    code = F.upper(F.concat(F.substring(words[0], 1, 2), F.substring(words[1], 1, 2)))

    def mapped(table: Mapping[str, str], default: Column) -> Column:
        return reduce(
            lambda acc, kv: acc.when(F.col(species) == kv[0], kv[1]),
            table.items(),
            F.when(F.lit(False), ""),
        ).otherwise(default)

    return df.withColumns({
        "code": mapped(CODE_EXCEPTIONS, code),
        "range_name": mapped(RANGE_NAMES, F.col(species)),
    })
