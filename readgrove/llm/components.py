"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readgrove.session import materialise


def _stars(edges: DataFrame, centre: str, other: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Each centre with the smallest id of its star, itself included, and the edges beside it.

    The smallest ids are written first: a join of two plain shuffles lets Spark split a centre that
    holds a large part of all edges.
    """
    smallest = edges.groupBy(F.col(centre).alias("centre")).agg(F.min(other).alias("m"))
    smallest = materialise(smallest.select("centre", F.least("centre", "m").alias("m")), name)
    joined = edges.join(smallest, edges[centre] == smallest["centre"]).select(
        F.col(centre).alias("c"), F.col(other).alias("o"), "m"
    )
    return smallest, joined


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    _, joined = _stars(both, "hi", "lo", "large_star")
    return joined.where(F.col("o") > F.col("c")).select(F.col("o").alias("hi"), F.col("m").alias("lo"))


def _small(edges: DataFrame) -> DataFrame:
    smallest, joined = _stars(edges, "hi", "lo", "small_star")
    links = joined.select(F.col("o").alias("hi"), F.col("m").alias("lo"))
    own = smallest.select(F.col("centre").alias("hi"), F.col("m").alias("lo"))
    return links.unionByName(own).where("hi != lo").distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and order-free sums that change whenever a round changes the edges."""
    mix = F.xxhash64("hi", "lo")
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.shiftright(mix, 20)), F.sum(mix.bitwiseAND(F.lit((1 << 40) - 1)))
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every id that has an edge to another one; component is its smallest id.

    Alternates large-star and small-star steps until the edges stand still, so every id ends with one
    edge to the smallest id of its component; the number of rounds grows with the logarithm of the
    ids. Ids are bigint. Each step is written to the shared folder, which cuts the lineage. Nulls
    and self-links are ignored; an empty table gives an empty result.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    pairs = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("hi != lo").distinct()
    now = materialise(pairs, "edges")
    state = _state(now)
    while state[0]:
        now = materialise(_large(now).distinct(), "large")
        now = materialise(_small(now), "small")
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
