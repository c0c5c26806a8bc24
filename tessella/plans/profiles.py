"""Queries of aggregations and profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import resources as R
from tessella.functions import text as X
from tessella.functions.stats import share, wilson
from tessella.operators import columns as C
from tessella.operators import matching as M
from tessella.operators import profiles as P
from tessella.plans.columns import CLASS_CASE, GROUP_CASE, SQL_KEYWORDS, STANCE_CASE, TYPE_CASE, USABLE, WILSON, quoted
from tessella.plans.registry import query
from tessella.plans.relations import BORDER, FULLTEXT, TERMS
from tessella.sources.tables import load, load_spread

OK = f"fetch_status IN ({quoted(R.USABLE_STATUS)})"
KNOWN = "source_country IS NOT NULL AND source_country <> 'UNKNOWN'"


def known(df):
    return df.where("source_country is not null and source_country <> 'UNKNOWN'")


@query("agg_article_rollup", """WITH h AS (SELECT DISTINCT url, keyword, stance FROM (SELECT url, regexp_extract(trim(p), '^(.*) \\[(.+)\\]$', 1) AS keyword, regexp_extract(trim(p), '^(.*) \\[(.+)\\]$', 2) AS stance FROM (SELECT url, unnest(string_split(keyword_stances, ' | ')) AS p FROM articles_v3)) WHERE keyword <> ''),
k AS (SELECT url, keyword, max(stance) AS stance FROM h GROUP BY 1, 2)
SELECT url, string_agg(keyword, ' | ' ORDER BY keyword, stance) AS keywords_matched, string_agg(keyword || ' [' || stance || ']', ' | ' ORDER BY keyword, stance) AS keyword_stances, CAST(count(*) AS INT) AS n_keywords,
CAST(count(*) FILTER (WHERE stance = 'Support') AS INT) AS n_support, CAST(count(*) FILTER (WHERE stance = 'Backlash') AS INT) AS n_backlash, coalesce(bool_or(starts_with(keyword, '#')), FALSE) AS has_hashtag_term FROM k GROUP BY url""")
def agg_article_rollup(spark, base):
    df = load(spark, base, "articles_v3", ["url", "keyword_stances"])
    hits = df.select("url", F.explode(C.stance_map(F.col("keyword_stances"))).alias("p")).select("url", "p.keyword", F.col("p.stance").alias("stance_primary"))
    return M.article_rollup(hits.where("keyword <> ''").withColumn("is_hashtag", F.col("keyword").startswith("#")))


@query("agg_recount", """SELECT url, CAST(len(p) AS INT) AS n_keywords, CAST(len(list_filter(p, lambda x: ends_with(x, ' [Support]'))) AS INT) AS n_support, CAST(len(list_filter(p, lambda x: ends_with(x, ' [Backlash]'))) AS INT) AS n_backlash
FROM (SELECT url, CASE WHEN keyword_stances IS NULL THEN [] ELSE list_distinct(list_filter(list_transform(string_split(keyword_stances, ' | '), lambda x: trim(x)), lambda x: regexp_full_match(x, '.* \\[.+\\]'))) END AS p FROM articles_v3)""")
def agg_recount(spark, base):
    df = load(spark, base, "articles_v3", ["url", "keyword_stances"]).select("url", C.stance_map(F.col("keyword_stances")).alias("p"))

    def count(stance):
        return F.size(F.filter("p", lambda x: x["stance"] == stance))

    return df.select("url", F.size("p").alias("n_keywords"), count("Support").alias("n_support"), count("Backlash").alias("n_backlash"))


@query("agg_country_cube", f"""SELECT source_country AS country, count(*) AS total, count(*) FILTER (WHERE {STANCE_CASE} = 'Support') AS support, count(*) FILTER (WHERE {STANCE_CASE} = 'Backlash') AS backlash, count(*) FILTER (WHERE {STANCE_CASE} = 'Mixed') AS mixed,
count(*) FILTER (WHERE {TYPE_CASE} = 'Opinion/Editorial') AS opinion, count(*) FILTER (WHERE has_hashtag_term) AS hashtags, count(*) FILTER (WHERE {STANCE_CASE} = 'Backlash') * 100.0 / count(*) AS backlash_pct, count(*) FILTER (WHERE has_hashtag_term) * 100.0 / count(*) AS hashtag_pct FROM articles_v3 WHERE {KNOWN} GROUP BY 1""")
def agg_country_cube(spark, base):
    df = known(load(spark, base, "articles_v3", ["url", "title", "n_support", "n_backlash", "has_hashtag_term", "source_country"]))
    enriched = df.select(F.col("source_country").alias("country"), C.article_stance(F.col("n_support"), F.col("n_backlash")).alias("stance"), C.article_type(F.col("url"), F.col("title")).alias("type"), "has_hashtag_term")
    return P.country_cube(enriched)


@query("agg_monthly_pivot", f"""SELECT strftime(published, '%Y-%m') AS month, count(*) FILTER (WHERE {STANCE_CASE} = 'Support') AS Support, count(*) FILTER (WHERE {STANCE_CASE} = 'Backlash') AS Backlash, count(*) FILTER (WHERE {STANCE_CASE} = 'Mixed') AS Mixed, count(*) FILTER (WHERE {STANCE_CASE} = 'Other') AS Other FROM articles_v3 WHERE published IS NOT NULL GROUP BY 1""")
def agg_monthly_pivot(spark, base):
    df = load(spark, base, "articles_v3", ["published", "n_support", "n_backlash"]).where("published is not null")
    rows = df.select(F.date_format("published", "yyyy-MM").alias("month"), C.article_stance(F.col("n_support"), F.col("n_backlash")).alias("stance"))
    return rows.groupBy("month").pivot("stance", ["Support", "Backlash", "Mixed", "Other"]).count().fillna(0)


@query("agg_topk_keywords", f"""WITH e AS (SELECT unnest(list_distinct({SQL_KEYWORDS})) AS keyword FROM articles_v3), c AS (SELECT keyword, count(*) AS articles FROM e GROUP BY 1 ORDER BY articles DESC, keyword LIMIT 25),
s AS (SELECT regexp_extract(trim(p), '^(.*) \\[(.+)\\]$', 1) AS keyword, max(regexp_extract(trim(p), '^(.*) \\[(.+)\\]$', 2)) AS stance FROM (SELECT unnest(string_split(keyword_stances, ' | ')) AS p FROM articles_v3) GROUP BY 1)
SELECT c.keyword, articles, coalesce(stance, '?') AS stance FROM c LEFT JOIN s ON c.keyword = s.keyword""")
def agg_topk_keywords(spark, base):
    df = load(spark, base, "articles_v3", ["keywords_matched", "keyword_stances"])
    top = P.top_values(df.select(F.explode(F.array_distinct(X.kw_list(F.col("keywords_matched")))).alias("keyword")), "keyword", 25, "articles")
    stances = df.select(F.explode(C.stance_map(F.col("keyword_stances"))).alias("p")).groupBy(F.col("p.keyword").alias("keyword")).agg(F.max("p.stance").alias("stance"))
    return top.join(stances, "keyword", "left").select("keyword", "articles", F.coalesce("stance", F.lit("?")).alias("stance"))


@query("agg_topk_outlets", "SELECT lower(trim(outlet)) AS outlet, count(*) AS articles FROM articles_v3 WHERE outlet IS NOT NULL GROUP BY 1 ORDER BY articles DESC, outlet LIMIT 15")
def agg_topk_outlets(spark, base):
    df = load(spark, base, "articles_v3", ["outlet"]).where("outlet is not null").select(F.lower(F.trim("outlet")).alias("outlet"))
    return P.top_values(df, "outlet", 15, "articles")


@query("agg_summary", "SELECT count(*) AS total, count(DISTINCT outlet) AS outlets, min(published) AS first_date, max(published) AS last_date, count(*) FILTER (WHERE source_country = 'UNKNOWN') AS unknown_country, count(*) FILTER (WHERE has_hashtag_term) AS hashtags FROM articles_v3")
def agg_summary(spark, base):
    df = load(spark, base, "articles_v3", ["outlet", "published", "source_country", "has_hashtag_term"])
    return df.agg(F.count("*").alias("total"), F.count_distinct("outlet").alias("outlets"), F.min("published").alias("first_date"), F.max("published").alias("last_date"), F.count_if(F.col("source_country") == "UNKNOWN").alias("unknown_country"), F.count_if("has_hashtag_term").alias("hashtags"))


PROFILE = "count(*) AS articles, count(*) FILTER (WHERE has_hashtag_term) AS hashtag_matched, count(*) FILTER (WHERE has_hashtag_term) * 100.0 / count(*) AS hashtag_pct, 100 - count(*) FILTER (WHERE has_hashtag_term) * 100.0 / count(*) AS generic_pct"


@query("prof_hashtag_country", f"SELECT source_country AS country, {PROFILE} FROM articles_v3 WHERE {KNOWN} GROUP BY 1")
def prof_hashtag_country(spark, base):
    return P.hashtag_profile(known(load(spark, base, "articles_v3", ["source_country", "has_hashtag_term"])).withColumnRenamed("source_country", "country"), "country")


@query("prof_match_classes", f"SELECT {CLASS_CASE} AS match_class, count(*) AS articles, count(*) * 100.0 / (SELECT count(*) FROM articles_v3) AS pct FROM articles_v3 GROUP BY 1")
def prof_match_classes(spark, base):
    df = load(spark, base, "articles_v3", ["keywords_matched"]).select(C.match_class(X.kw_list(F.col("keywords_matched"))).alias("match_class"))
    return P.distribution(df, "match_class", "articles", "pct")


@query("prof_hashtag_langgroup", f"SELECT language_group, {PROFILE} FROM (SELECT {GROUP_CASE} AS language_group, has_hashtag_term FROM articles_v3) WHERE language_group IS NOT NULL GROUP BY 1")
def prof_hashtag_langgroup(spark, base):
    df = load(spark, base, "articles_v3", ["source_country", "has_hashtag_term"]).withColumn("language_group", C.language_group(F.col("source_country")))
    return P.hashtag_profile(df.where("language_group is not null"), "language_group")


@query("prof_codebook_langgroup", f"SELECT language_group, count(keyword) AS terms, count(*) FILTER (WHERE is_hashtag) AS hashtags, count(*) FILTER (WHERE is_hashtag) * 100.0 / count(keyword) AS hashtag_pct FROM (SELECT {GROUP_CASE.replace('source_country', 'keyword_country')} AS language_group, keyword, is_hashtag FROM metoo_keywords_v3) WHERE language_group IS NOT NULL GROUP BY 1")
def prof_codebook_langgroup(spark, base):
    df = load(spark, base, "metoo_keywords_v3").withColumn("language_group", C.language_group(F.col("keyword_country"))).where("language_group is not null")
    tags = F.count_if("is_hashtag")
    return df.groupBy("language_group").agg(F.count("keyword").alias("terms"), tags.alias("hashtags"), (tags * 100.0 / F.count("keyword")).alias("hashtag_pct"))


@query("prof_language", "SELECT lang, count(*) AS documents, count(*) * 100.0 / (SELECT count(*) FROM documents WHERE lang IS NOT NULL) AS pct FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def prof_language(spark, base):
    return P.distribution(load(spark, base, "documents", ["lang"]).where("lang is not null"), "lang", "documents", "pct")


@query("prof_outlet_conc", f"""WITH o AS (SELECT source_country AS country, lower(trim(outlet)) AS outlet, count(*) AS n FROM articles_v3 WHERE {KNOWN} AND outlet IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, outlet) AS rn, sum(n) OVER (PARTITION BY country) AS total FROM o)
SELECT country, CAST(max(total) AS BIGINT) AS articles, count(*) AS unique_outlets, max(total) / count(*) AS articles_per_outlet, sum(n) FILTER (WHERE rn <= 1) * 100.0 / max(total) AS top1_pct, sum(n) FILTER (WHERE rn <= 3) * 100.0 / max(total) AS top3_pct, sum(n) FILTER (WHERE rn <= 10) * 100.0 / max(total) AS top10_pct,
round(sum((n / total) * (n / total)), 9) AS hhi, min(outlet) FILTER (WHERE rn = 1) AS largest_outlet FROM r GROUP BY country""")
def prof_outlet_conc(spark, base):
    df = known(load(spark, base, "articles_v3", ["source_country", "outlet"])).where("outlet is not null")
    return P.concentration(df.select(F.col("source_country").alias("country"), F.lower(F.trim("outlet")).alias("outlet")), "country", "outlet")


@query("prof_suspect_country", """WITH o AS (SELECT source_country AS country, lower(trim(outlet)) AS outlet, count(*) AS n FROM articles_v3 WHERE source_country <> 'UNKNOWN' AND outlet IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, outlet) AS rn FROM o)
SELECT country, CAST(sum(n) AS BIGINT) AS articles, sum(CASE WHEN ends_with(outlet, '.test') THEN n ELSE 0 END) * 100.0 / sum(n) AS pct, string_agg(outlet, ', ' ORDER BY rn) FILTER (WHERE rn <= 4) AS examples FROM r GROUP BY 1 HAVING sum(CASE WHEN ends_with(outlet, '.test') THEN n ELSE 0 END) / sum(n) > 0.25""")
def prof_suspect_country(spark, base):
    df = load(spark, base, "articles_v3", ["source_country", "outlet"]).where("source_country <> 'UNKNOWN' and outlet is not null")
    return P.suspect_groups(df.select(F.col("source_country").alias("country"), F.lower(F.trim("outlet")).alias("outlet")), "country", "outlet", ".test", 0.25)


@query("agg_fetch_rate", f"SELECT source_country AS country, CAST(year(published) AS INT) AS year, count(*) AS attempted, avg(CASE WHEN {OK} THEN 1.0 ELSE 0.0 END) AS rate FROM labeled_articles WHERE {KNOWN} GROUP BY 1, 2 HAVING count(*) >= 8")
def agg_fetch_rate(spark, base):
    df = known(load(spark, base, "labeled_articles", ["source_country", "published", "fetch_status"]))
    rated = df.groupBy(F.col("source_country").alias("country"), F.year("published").alias("year")).agg(F.count("*").alias("attempted"), share(F.col("fetch_status").isin(*R.USABLE_STATUS)).alias("rate"))
    return rated.where("attempted >= 8")


@query("agg_share_shift", f"""WITH b AS (SELECT source_country AS country, count(*) * 100.0 / (SELECT count(*) FROM labeled_articles WHERE {KNOWN}) AS pct FROM labeled_articles WHERE {KNOWN} GROUP BY 1), a AS (SELECT source_country AS country, count(*) * 100.0 / (SELECT count(*) FROM labeled_articles WHERE {KNOWN} AND {OK}) AS pct FROM labeled_articles WHERE {KNOWN} AND {OK} GROUP BY 1)
SELECT coalesce(b.country, a.country) AS country, coalesce(b.pct, 0) AS before, coalesce(a.pct, 0) AS after, coalesce(a.pct, 0) - coalesce(b.pct, 0) AS change FROM b FULL JOIN a ON b.country = a.country""")
def agg_share_shift(spark, base):
    df = known(load(spark, base, "labeled_articles", ["source_country", "fetch_status"])).withColumnRenamed("source_country", "country")
    return P.share_shift(df, "country", F.col("fetch_status").isin(*R.USABLE_STATUS))


@query("agg_dup_domains", f"""WITH m AS (SELECT DISTINCT cluster_id, url FROM dedupe_map), z AS (SELECT cluster_id FROM m GROUP BY 1 HAVING count(*) > 1), j AS (SELECT m.cluster_id, m.url, lower(trim(l.outlet)) AS outlet FROM m JOIN z ON m.cluster_id = z.cluster_id JOIN (SELECT DISTINCT url, outlet FROM labeled_articles WHERE {OK}) l ON m.url = l.url WHERE outlet IS NOT NULL)
SELECT outlet, count(*) AS copies, count(DISTINCT cluster_id) AS stories, count(*) - count(DISTINCT cluster_id) AS redundant FROM j GROUP BY 1 ORDER BY redundant DESC, outlet LIMIT 18""")
def agg_dup_domains(spark, base):
    mapped = load(spark, base, "dedupe_map", ["cluster_id", "url"]).distinct()
    several = mapped.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1").select("cluster_id")
    pages = load(spark, base, "labeled_articles", ["url", "outlet", "fetch_status"]).where(F.col("fetch_status").isin(*R.USABLE_STATUS)).select("url", "outlet").distinct()
    joined = mapped.join(several, "cluster_id", "left_semi").join(pages, "url").select("cluster_id", "url", F.lower(F.trim("outlet")).alias("outlet")).where("outlet is not null")
    counted = joined.groupBy("outlet").agg(F.count("*").alias("copies"), F.countDistinct("cluster_id").alias("stories"))
    return counted.withColumn("redundant", F.col("copies") - F.col("stories")).orderBy(F.desc("redundant"), "outlet").limit(18)


@query("prof_both_rate", f"SELECT length(coalesce(title, '')) > 15 AS has_title, count(*) AS articles, avg(CASE WHEN {CLASS_CASE} = 'both' THEN 1.0 ELSE 0.0 END) AS both_rate, avg(len({SQL_KEYWORDS})) AS mean_keywords FROM articles_v3 GROUP BY 1")
def prof_both_rate(spark, base):
    df = load(spark, base, "articles_v3", ["title", "keywords_matched"]).withColumn("k", X.kw_list(F.col("keywords_matched")))
    titled = F.length(F.coalesce("title", F.lit(""))) > 15
    return df.groupBy(titled.alias("has_title")).agg(F.count("*").alias("articles"), share(C.match_class(F.col("k")) == "both").alias("both_rate"), F.avg(F.size("k")).alias("mean_keywords"))


@query("agg_split_reasons", "SELECT regexp_replace(trim(r), '\\(.*\\)', '') AS reason, count(*) AS n FROM (SELECT unnest(string_split(split_reason, ';')) AS r FROM (SELECT DISTINCT url, cluster_id, split_reason FROM dedupe_map WHERE split_reason IS NOT NULL AND split_reason <> '')) GROUP BY 1")
def agg_split_reasons(spark, base):
    df = load(spark, base, "dedupe_map", ["url", "cluster_id", "split_reason"]).where("split_reason is not null and split_reason <> ''").distinct()
    return df.select(F.explode(F.split("split_reason", ";")).alias("r")).groupBy(F.regexp_replace(F.trim("r"), "\\(.*\\)", "").alias("reason")).agg(F.count("*").alias("n"))


@query("agg_largest_clusters", "SELECT cluster_id, count(DISTINCT url) AS members FROM dedupe_map GROUP BY 1 ORDER BY members DESC, cluster_id LIMIT 5")
def agg_largest_clusters(spark, base):
    return load(spark, base, "dedupe_map", ["cluster_id", "url"]).groupBy("cluster_id").agg(F.countDistinct("url").alias("members")).orderBy(F.desc("members"), "cluster_id").limit(5)


@query("agg_status_counts", f"SELECT fetch_status, count(*) AS n, count(*) FILTER (WHERE {OK} AND article_text IS NOT NULL) AS usable FROM labeled_articles GROUP BY 1")
def agg_status_counts(spark, base):
    df = load_spread(spark, base, "labeled_articles", ["fetch_status", "article_text"])
    return df.groupBy("fetch_status").agg(F.count("*").alias("n"), F.count_if(C.usable(F.col("fetch_status"), F.col("article_text"))).alias("usable"))


@query("agg_stance_dist", f"SELECT language_group, stance, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY language_group) AS pct FROM (SELECT coalesce({GROUP_CASE}, 'Other') AS language_group, lower(trim(stance)) AS stance FROM labeled_articles WHERE stance IS NOT NULL AND is_about_movement) GROUP BY 1, 2")
def agg_stance_dist(spark, base):
    df = load(spark, base, "labeled_articles", ["source_country", "stance", "is_about_movement"]).where("stance is not null and is_about_movement")
    rows = df.select(F.coalesce(C.language_group(F.col("source_country")), F.lit("Other")).alias("language_group"), F.lower(F.trim("stance")).alias("stance"))
    counted = rows.groupBy("language_group", "stance").agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("language_group")))


@query("agg_stratum_ci", f"WITH c AS (SELECT has_hashtag_term AS stratum, coalesce({GROUP_CASE}, 'Other') AS language_group, CAST(count(*) FILTER (WHERE is_about_movement) AS DOUBLE) AS k, CAST(count(is_about_movement) AS DOUBLE) AS n FROM labeled_articles GROUP BY 1, 2 HAVING count(is_about_movement) >= 15) SELECT stratum, language_group, k, n, {WILSON} FROM c")
def agg_stratum_ci(spark, base):
    df = load(spark, base, "labeled_articles", ["has_hashtag_term", "source_country", "is_about_movement"])
    group = F.coalesce(C.language_group(F.col("source_country")), F.lit("Other"))
    counted = df.groupBy(F.col("has_hashtag_term").alias("stratum"), group.alias("language_group")).agg(F.count_if("is_about_movement").cast("double").alias("k"), F.count("is_about_movement").cast("double").alias("n")).where("n >= 15")
    low, high = wilson(F.col("k"), F.col("n"))
    return counted.select("stratum", "language_group", "k", "n", low.alias("low"), high.alias("high"))


@query("agg_stale_share", f"SELECT avg(CASE WHEN regexp_matches(substring(coalesce(text, ''), 1, 6000), '(?:^|[^\\p{{L}}\\p{{N}}_]){R.STALE_YEARS}(?:[^\\p{{L}}\\p{{N}}_]|$)') THEN 1.0 ELSE 0.0 END) AS stale_share, count(*) AS documents FROM documents")
def agg_stale_share(spark, base):
    return load_spread(spark, base, "documents", ["text"]).agg(share(C.stale(F.col("text"))).alias("stale_share"), F.count("*").alias("documents"))


@query("agg_crosstab", "SELECT article_type, count(*) FILTER (WHERE article_stance = 'Support') AS Support, count(*) FILTER (WHERE article_stance = 'Backlash') AS Backlash, count(*) FILTER (WHERE article_stance = 'Mixed') AS Mixed, count(*) FILTER (WHERE article_stance = 'Other') AS Other FROM labeled_articles GROUP BY 1")
def agg_crosstab(spark, base):
    df = load(spark, base, "labeled_articles", ["article_type", "article_stance"])
    return df.groupBy("article_type").pivot("article_stance", ["Support", "Backlash", "Mixed", "Other"]).count().fillna(0)


@query("agg_before_after", f"SELECT source_country AS country, count(*) AS n, avg(CASE WHEN has_hashtag_term THEN 100.0 ELSE 0.0 END) AS before, avg(CASE WHEN has_hashtag_term OR contains(coalesce(article_text, ''), '#') THEN 100.0 ELSE 0.0 END) AS after FROM labeled_articles WHERE {KNOWN} GROUP BY 1 HAVING count(*) >= 30")
def agg_before_after(spark, base):
    df = known(load_spread(spark, base, "labeled_articles", ["source_country", "has_hashtag_term", "article_text"]))
    tag = F.coalesce("has_hashtag_term", F.lit(False))
    body = tag | F.coalesce(F.contains("article_text", F.lit("#")), F.lit(False))
    return df.groupBy(F.col("source_country").alias("country")).agg(F.count("*").alias("n"), (share(tag) * 100).alias("before"), (share(body) * 100).alias("after")).where("n >= 30")


@query("agg_body_only_terms", f"""WITH {TERMS}, {FULLTEXT}, h AS MATERIALIZED (SELECT url, term FROM docs JOIN terms ON contains(doc, term) WHERE {BORDER}), k AS (SELECT DISTINCT url, lower(trim(k)) AS term FROM (SELECT url, unnest(string_split(keywords_matched, ' | ')) AS k FROM labeled_articles))
SELECT term, count(*) AS articles FROM (SELECT url, term FROM h EXCEPT SELECT url, term FROM k) GROUP BY 1 ORDER BY articles DESC, term LIMIT 20""")
def agg_body_only_terms(spark, base):
    df = load_spread(spark, base, "labeled_articles", ["url", "article_text", "keywords_matched"]).dropDuplicates(["url"])
    body = M.match_terms(df, M.codebook_terms(load(spark, base, "metoo_keywords_v3")), key="url", doc=F.substring("article_text", 1, R.FULLTEXT_PREFIX))
    head = df.select("url", F.explode(X.kw_list(F.col("keywords_matched"))).alias("k")).select("url", F.lower(F.trim("k")).alias("term"))
    return P.top_values(body.join(head, ["url", "term"], "left_anti").select("term"), "term", 20, "articles")


@query("agg_term_before_after", "SELECT count(*) FILTER (WHERE contains(lower(coalesce(keywords_matched, '')), 'hush clause')) AS before, count(*) FILTER (WHERE contains(lower(coalesce(article_text, '')), 'hush clause')) AS after FROM labeled_articles")
def agg_term_before_after(spark, base):
    df = load_spread(spark, base, "labeled_articles", ["keywords_matched", "article_text"])
    return df.agg(*[F.count_if(F.lower(F.coalesce(c, F.lit(""))).contains("hush clause")).alias(n) for c, n in (("keywords_matched", "before"), ("article_text", "after"))])


@query("qa_regression", """SELECT (SELECT count(*) FROM metoo_keywords_v3 WHERE trim(kw_match_lower) = 'generic') AS generic_terms, (SELECT count(*) FROM articles_v3 WHERE n_keywords <> len(string_split(keywords_matched, ' | '))) AS miscounted, (SELECT count(*) FROM articles_v3 WHERE title_was_encoded AND NOT regexp_matches(coalesce(title, ''), '&#?[0-9A-Za-z]{1,8};')) AS wrongly_encoded""")
def qa_regression(spark, base):
    generic = load(spark, base, "metoo_keywords_v3").agg(F.count_if(F.trim("kw_match_lower") == "generic").alias("generic_terms"))
    articles = load(spark, base, "articles_v3").agg(
        F.count_if(F.col("n_keywords") != F.size(X.kw_list(F.col("keywords_matched")))).alias("miscounted"),
        F.count_if(F.col("title_was_encoded") & ~F.coalesce("title", F.lit("")).rlike(X.ENTITY)).alias("wrongly_encoded"),
    )
    return generic.join(articles)  # one row each


@query("qa_spotcheck", "WITH u AS (SELECT DISTINCT url, article_type, article_stance FROM labeled_articles) SELECT article_type, article_stance, url FROM u QUALIFY row_number() OVER (PARTITION BY article_type, article_stance ORDER BY md5('42:' || url), url) <= 4")
def qa_spotcheck(spark, base):
    from tessella.operators.relations import shuffled, top_per_group

    rows = load(spark, base, "labeled_articles", ["url", "article_type", "article_stance"]).distinct()
    return top_per_group(rows, ["article_type", "article_stance"], [shuffled(F.col("url"), 42), "url"], 4).select("article_type", "article_stance", "url")


FLOW = f"""WITH {TERMS}, docs AS MATERIALIZED (SELECT url, source_country, lower(coalesce(title, '') || ' ' || coalesce(article_text, '')) AS doc FROM (SELECT DISTINCT url, title, source_country, article_text FROM labeled_articles)),
h AS MATERIALIZED (SELECT url, source_country, term FROM docs JOIN terms ON contains(doc, term) WHERE {BORDER}), k AS (SELECT url, source_country, bool_or(is_hashtag) AS has_hashtag_term FROM h JOIN metoo_keywords_v3 ON term = kw_match_lower GROUP BY 1, 2)
SELECT source_country AS country, {PROFILE} FROM k WHERE {KNOWN} GROUP BY 1"""


@query("flow_match_to_profile", FLOW)
def flow_match_to_profile(spark, base):
    """From matching the codebook over title and text to one row per article and the profile by country."""
    df = load_spread(spark, base, "labeled_articles", ["url", "title", "source_country", "article_text"]).dropDuplicates(["url"])
    doc = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("article_text", F.lit("")))
    codebook = load(spark, base, "metoo_keywords_v3")
    hits = M.attach_codebook(M.match_terms(df, M.codebook_terms(codebook), key="url", doc=doc, unescape=False), codebook)
    articles = M.article_rollup(hits).join(df.select("url", "source_country"), "url")
    return P.hashtag_profile(known(articles).withColumnRenamed("source_country", "country"), "country")
