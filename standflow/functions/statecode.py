"""State codes such as `PIABfasy_2_28_30`: composition, leaf-area class, lower and upper height.

The composition is a run of four-letter species tokens; upper case marks a dominant species.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shares of the species of a mixed state, by number of species and dominance.
SHARES_DOMINANT = {2: (0.66, 0.34), 3: (0.66, 0.17, 0.17)}
SHARES_EVEN = {2: (0.5, 0.5), 3: (0.34, 0.33, 0.33)}

# Fixed value: composition of the state that stands for an invalid code.
INVALID_COMPOSITION = "nope"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def part(state: Column | str, i: int) -> Column:
    return F.get(F.split(_col(state), "_"), F.lit(i))


def composition(state: Column | str) -> Column:
    return part(state, 0)


def lai_class(state: Column | str) -> Column:
    return part(state, 1).try_cast("int")


def height_low(state: Column | str) -> Column:
    return part(state, 2).try_cast("int")


def height_high(state: Column | str) -> Column:
    return part(state, 3).try_cast("int")


def tokens(comp: Column | str) -> Column:
    return F.regexp_extract_all(_col(comp), F.lit(r"(\w{4})"), 1)


def shares(specs: Column) -> Column:
    """Shares of the distinct tokens, in token order."""
    n = F.size(specs)
    dominant = F.get(specs, F.lit(0)) != F.lower(F.get(specs, F.lit(0)))
    rule = F.when(n == 1, F.array(F.lit(1.0)))
    for k in (2, 3):
        rule = rule.when((n == k) & dominant, F.array(*map(F.lit, SHARES_DOMINANT[k])))
        rule = rule.when(n == k, F.array(*map(F.lit, SHARES_EVEN[k])))
    return rule.otherwise(F.transform(specs, lambda _: F.lit(1.0) / n))


def species_shares(comp: Column | str) -> Column:
    """ARRAY<STRUCT<species, prop>> of a composition. A species written in both cases takes part
    in the rule twice and has the sum of its shares."""
    specs = F.array_distinct(tokens(comp))
    parts = F.transform(
        F.arrays_zip(specs.alias("s"), shares(specs).alias("p")),
        lambda x: F.struct(F.lower(x["s"]).alias("species"), x["p"].alias("prop")),
    )
    return F.transform(
        F.array_distinct(F.transform(specs, F.lower)),
        lambda s: F.struct(s.alias("species"), share_of(parts, s).alias("prop")),
    )


def share_of(parts: Column, species: Column) -> Column:
    """Summed share of one species in ARRAY<STRUCT<species, prop>>."""
    return F.aggregate(
        F.filter(parts, lambda y: y["species"] == species),
        F.lit(0.0),
        lambda acc, y: acc + y["prop"],
    )


def share_overlap(a: Column, b: Column) -> Column:
    """Sum over species of the smaller share. Shares sum to one on both sides, so this equals
    one minus half the summed absolute differences."""
    return F.aggregate(
        a, F.lit(0.0), lambda acc, x: acc + F.least(x["prop"], share_of(b, x["species"]))
    )


def _height_weight(height_from: Column) -> Column:
    return F.lit(1.0) - F.exp(F.lit(-0.5) * height_from)


def _lai_factor(lai_from: Column, lai_to: Column) -> Column:
    return F.lit(1.0) - F.least(F.pow(F.abs(lai_to - lai_from) / 2, F.lit(4.0)), F.lit(1.0))


def least_overlap(
    min_sim: float, lai_from: Column, lai_to: Column, height_from: Column
) -> Column:
    """The share overlap that a similarity of `min_sim` needs; 0 if it needs none."""
    weight, factor = _height_weight(height_from), _lai_factor(lai_from, lai_to)
    needed = F.lit(1.0) - (F.lit(1.0) - F.lit(min_sim) / factor) / weight
    return F.when((weight > 0) & (factor > 0), F.greatest(needed, F.lit(0.0))).otherwise(0.0)


def similarity(
    overlap: Column, lai_from: Column, lai_to: Column, height_from: Column, height_to: Column
) -> Column:
    """Similarity of two states; not symmetric, because the weight uses the height of the first."""
    weight = _height_weight(height_from)
    height_ok = F.when(F.abs(height_to - height_from) > 2, F.lit(0.0)).otherwise(F.lit(1.0))
    lai_ok = _lai_factor(lai_from, lai_to)
    return (F.lit(1.0) - (F.lit(1.0) - overlap) * weight) * height_ok * lai_ok


def state_similarity_of(state_from: Column | str, state_to: Column | str) -> Column:
    """Similarity straight from two code columns."""
    return similarity(
        share_overlap(
            species_shares(composition(state_from)), species_shares(composition(state_to))
        ),
        lai_class(state_from),
        lai_class(state_to),
        height_low(state_from),
        height_low(state_to),
    )
