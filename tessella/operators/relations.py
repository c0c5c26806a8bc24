"""Relational operators with a defined order: windows, samples, merges, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut_lineage


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order; the order should end in a key, else ties are arbitrary."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Like ``keep_first`` in ascending order, as an aggregation with map-side combine: a hot key is no hot task."""
    least = F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("__first")
    return df.groupBy(*keys).agg(least).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in columns])


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(rank) <= k)


def shuffled(key: Column, seed: int | str) -> Column:
    """A random-looking order that every engine agrees on."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), key.cast("string")))


def sample_uniform(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement; the same rows for the same seed."""
    return df.orderBy(shuffled(F.col(key), seed), key).limit(n)


def sample_strata(df: DataFrame, stratum: str, key: str, sizes: dict, seed: int = 42, rank: str = "rn") -> DataFrame:
    """So many rows of each stratum, with their rank in it; strata not named give none."""
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col(stratum))
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(stratum).orderBy(shuffled(F.col(key), seed), key)))
    # the literal bound lets Spark drop rows before they are shuffled, however large a stratum is
    return ranked.where((F.col(rank) <= max(sizes.values(), default=0)) & (F.col(rank) <= wanted))


def allocate_with_floor(counts: DataFrame, total: int, floor: int) -> DataFrame:
    """Adds ``wanted``: rows in proportion to ``n``, at least ``floor``, at most ``n``."""
    whole = counts.agg(F.sum("n").alias("__whole"))
    share = F.floor(F.lit(total) * F.col("n") / F.col("__whole"))
    return counts.join(F.broadcast(whole)).withColumn("wanted", F.least(F.col("n"), F.greatest(share, F.lit(floor))).cast("bigint")).drop("__whole")


def upsert(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], take: Column) -> DataFrame:
    """Rows of ``old`` with ``columns`` replaced from ``new`` where ``take`` (over ``new_...`` columns) holds."""
    renamed = new.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = old.join(renamed, key, "left")
    chosen = [F.when(F.coalesce(take, F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return joined.select(*[c for c in old.columns if c not in columns], *chosen)


def connected_components(edges: DataFrame, *, rounds: int = 50) -> DataFrame:
    """``id, component`` of an undirected graph given as ``a, b``: the least id that a node is linked to.

    Alternates large-star and small-star steps, which need a number of rounds logarithmic in the size of a component and
    never gather a component in one place; each round is written to the shared checkpoint folder. Rows
    with a null end are left out; a self-loop makes a component of one.
    """
    ends = cut_lineage(edges.where("a is not null and b is not null").select("a", "b"))
    nodes = ends.select(F.col("a").alias("id")).union(ends.select(F.col("b").alias("id"))).distinct()
    links = ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour is linked to the least neighbour
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # small star: every smaller neighbour and the node itself are linked to the least one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut_lineage(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        # links settle when their number and the sum of their hashes do
        after = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    found = links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
