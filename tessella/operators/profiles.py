"""Aggregate profiles of a corpus by country, outlet, language or any other group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_values(df: DataFrame, column: str, k: int, name: str) -> DataFrame:
    """The ``k`` most frequent values with their counts; ties in order of the value."""
    return df.groupBy(column).agg(F.count("*").alias(name)).orderBy(F.desc(name), column).limit(k)


def distribution(df: DataFrame, column: str, count: str, percent: str) -> DataFrame:
    """Counts and percentages. Groups are counted first, so the window sees one row per value."""
    counted = df.groupBy(column).agg(F.count("*").alias(count))
    return counted.withColumn(percent, F.col(count) * 100.0 / F.sum(count).over(Window.partitionBy()))


def country_cube(enriched: DataFrame) -> DataFrame:
    def count(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    stance = F.col("stance")
    cube = enriched.groupBy("country").agg(
        F.count("*").alias("total"), count(stance == "Support", "support"), count(stance == "Backlash", "backlash"), count(stance == "Mixed", "mixed"),
        count(F.col("type") == "Opinion/Editorial", "opinion"), count(F.col("has_hashtag_term"), "hashtags"),
    )
    return cube.withColumn("backlash_pct", F.col("backlash") * 100.0 / F.col("total")).withColumn("hashtag_pct", F.col("hashtags") * 100.0 / F.col("total"))


def hashtag_profile(df: DataFrame, group: str) -> DataFrame:
    tagged = F.count_if("has_hashtag_term")
    percent = tagged * 100.0 / F.count("*")
    return df.groupBy(group).agg(F.count("*").alias("articles"), tagged.alias("hashtag_matched"), percent.alias("hashtag_pct"), (100 - percent).alias("generic_pct"))


def concentration(df: DataFrame, group: str, member: str) -> DataFrame:
    """How much of a group its largest members hold, with the sum of squared shares. Windows run over counts, not rows."""
    counted = df.groupBy(group, member).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    ranked = counted.withColumn("rn", F.row_number().over(whole.orderBy(F.desc("n"), member))).withColumn("total", F.sum("n").over(whole))

    def top(k: int) -> Column:
        return F.sum(F.when(F.col("rn") <= k, F.col("n"))) * 100.0 / F.max("total")

    part = F.col("n") / F.col("total")
    return ranked.groupBy(group).agg(
        F.max("total").alias("articles"), F.count("*").alias(f"unique_{member}s"), (F.max("total") / F.count("*")).alias(f"articles_per_{member}"),
        top(1).alias("top1_pct"), top(3).alias("top3_pct"), top(10).alias("top10_pct"), F.round(F.sum(part * part), 9).alias("hhi"),
        F.min(F.when(F.col("rn") == 1, F.col(member))).alias(f"largest_{member}"),
    )


def suspect_groups(df: DataFrame, group: str, member: str, ending: str, limit: float) -> DataFrame:
    """Groups of which more than ``limit`` have a member name with this ending, with their four largest members."""
    counted = df.groupBy(group, member).agg(F.count("*").alias("n"))
    ranked = counted.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), member)))
    hit = F.sum(F.when(F.col(member).endswith(ending), F.col("n")).otherwise(0))
    few = F.array_sort(F.collect_list(F.when(F.col("rn") <= 4, F.struct("rn", member))))
    found = ranked.groupBy(group).agg(F.sum("n").alias("articles"), (hit * 100.0 / F.sum("n")).alias("pct"), few.alias("few"))
    return found.where(F.col("pct") > limit * 100).select(group, "articles", "pct", F.array_join(F.transform("few", lambda x: x[member]), ", ").alias("examples"))


def share_shift(df: DataFrame, group: str, kept: Column) -> DataFrame:
    """Share of each group among all rows and among those kept, in one pass."""
    counted = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(kept).alias("k"))
    every = Window.partitionBy()
    before, after = F.col("n") * 100.0 / F.sum("n").over(every), F.col("k") * 100.0 / F.sum("k").over(every)
    return counted.select(group, before.alias("before"), after.alias("after")).withColumn("change", F.col("after") - F.col("before"))
