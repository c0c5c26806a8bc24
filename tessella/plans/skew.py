"""Queries of problem 2: per-key results over keys of which a few hold most rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import skew as K
from tessella.plans.registry import query
from tessella.sources.tables import load

#: Share of all rows from which a value is reported.
LEAST_SHARE = 0.04

FOUND = " UNION ALL ".join(
    f"SELECT '{c}' AS key_field, lower(trim({c})) AS key_value FROM articles_v3 WHERE {c} IS NOT NULL GROUP BY 2 HAVING count(*) >= {LEAST_SHARE} * (SELECT count(*) FROM articles_v3)"
    for c in ("outlet", "source_country")
)


def _tasks(spark) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


@query("p2_found", FOUND)
def p2_found(spark, base):
    return K.heavy_values(load(spark, base, "articles_v3", ["outlet", "source_country"]), ["outlet", "source_country"], least_share=LEAST_SHARE)


@query("p2_outlets", "SELECT lower(trim(outlet)) AS outlet, count(*) AS articles, count(DISTINCT url) AS urls FROM articles_v3 WHERE outlet IS NOT NULL GROUP BY 1")
def p2_outlets(spark, base):
    df = load(spark, base, "articles_v3", ["outlet", "url"]).where("outlet is not null")
    made = K.per_key_distinct(df, key=F.lower(F.trim("outlet")), value="url", tasks=_tasks(spark))
    return made.select(F.col("key").alias("outlet"), F.col("rows").alias("articles"), F.col("distinct").alias("urls"))


@query("p2_country_terms", """SELECT lower(trim(a.source_country)) AS country, k.stance_primary AS stance, count(*) AS pairs, count(DISTINCT a.url) AS urls FROM articles_v3 a JOIN metoo_keywords_v3 k ON lower(trim(a.source_country)) = lower(trim(k.keyword_country)) GROUP BY 1, 2""")
def p2_country_terms(spark, base):
    articles = load(spark, base, "articles_v3", ["source_country", "url"]).where("source_country is not null")
    terms = load(spark, base, "metoo_keywords_v3", ["keyword_country", "stance_primary"]).where("keyword_country is not null")
    country = F.lower(F.trim("source_country"))
    joined, _ = K.balanced_join(articles, terms, key=country, matching_key=F.lower(F.trim("keyword_country")), row=F.col("url"), tasks=_tasks(spark))
    once = joined.groupBy("__task", "__key", "__shard", "stance_primary", "url").agg(F.count("*").alias("n"))
    by_shard = once.groupBy("__task", "__key", "__shard", "stance_primary").agg(F.sum("n").alias("pairs"), F.count("*").alias("urls"))
    return by_shard.groupBy(F.col("__key").alias("country"), F.col("stance_primary").alias("stance")).agg(F.sum("pairs").alias("pairs"), F.sum("urls").alias("urls"))
