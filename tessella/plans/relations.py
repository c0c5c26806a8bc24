"""Queries of joins, windows, sorting, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import resources as R
from tessella.functions import text as X
from tessella.operators import columns as C
from tessella.operators import matching as M
from tessella.operators import relations as O
from tessella.plans.columns import STANCE_CASE, USABLE, quoted, sql_norm
from tessella.plans.registry import query
from tessella.sources.tables import load, load_spread

TERMS = f"""terms AS (SELECT kw_match_lower AS term, max(match_mode) AS mode FROM metoo_keywords_v3
WHERE trim(kw_match_lower) NOT IN ({quoted(R.CODEBOOK_NOTES)}) AND NOT regexp_full_match(kw_match, '\\(.*\\)') GROUP BY 1)"""
BORDER = "(mode = 'substr' OR regexp_matches(doc, '(?:^|[^\\p{L}\\p{N}_])' || regexp_escape(term) || '(?:[^\\p{L}\\p{N}_]|$)'))"
DOCUMENTS = "docs AS MATERIALIZED (SELECT doc_id, lower(coalesce(title, '') || ' ' || coalesce(text, '')) AS doc FROM documents)"
HITS = f"hits AS MATERIALIZED (SELECT doc_id, term FROM docs JOIN terms ON contains(doc, term) WHERE {BORDER})"


def _titled_documents(spark, base):
    df = load_spread(spark, base, "documents", ["doc_id", "title", "text"])
    return df, F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))


@query("join_codebook_theta", f"WITH {TERMS}, {DOCUMENTS}, {HITS} SELECT doc_id, term FROM hits")
def join_codebook_theta(spark, base):
    df, doc = _titled_documents(spark, base)
    return M.theta_join(df, M.codebook_terms(load(spark, base, "metoo_keywords_v3")), key="doc_id", doc=doc)


@query("join_codebook_multi", f"WITH {TERMS}, {DOCUMENTS}, {HITS} SELECT doc_id, term FROM hits")
def join_codebook_multi(spark, base):
    df, doc = _titled_documents(spark, base)
    return M.match_terms(df, M.codebook_terms(load(spark, base, "metoo_keywords_v3")), key="doc_id", doc=doc)


FULLTEXT = f"docs AS (SELECT DISTINCT url, lower(substring(article_text, 1, {R.FULLTEXT_PREFIX})) AS doc FROM labeled_articles WHERE article_text IS NOT NULL)"


@query("join_fulltext", f"WITH {TERMS}, {FULLTEXT} SELECT url, term FROM docs JOIN terms ON contains(doc, term) WHERE {BORDER}")
def join_fulltext(spark, base):
    df = load_spread(spark, base, "labeled_articles", ["url", "article_text"]).dropDuplicates(["url"])
    return M.match_terms(df, M.codebook_terms(load(spark, base, "metoo_keywords_v3")), key="url", doc=F.substring("article_text", 1, R.FULLTEXT_PREFIX))


@query("join_codebook_fanout", f"WITH {TERMS}, {DOCUMENTS}, {HITS} SELECT doc_id, term, kw_id, keyword, keyword_country, stance_primary FROM hits LEFT JOIN metoo_keywords_v3 ON term = kw_match_lower")
def join_codebook_fanout(spark, base):
    hits = join_codebook_multi(spark, base)
    rows = load(spark, base, "metoo_keywords_v3").select(F.col("kw_match_lower").alias("term"), "kw_id", "keyword", "keyword_country", "stance_primary")
    return hits.join(rows, "term", "left").select("doc_id", "term", "kw_id", "keyword", "keyword_country", "stance_primary")


LOOKUP = """look AS (SELECT lower(trim(outlet)) AS domain, min(source_country) AS country FROM labeled_articles WHERE outlet IS NOT NULL AND source_country IS NOT NULL AND source_country <> 'UNKNOWN' GROUP BY 1)"""


@query("join_country_lookup", f"WITH {LOOKUP} SELECT url, coalesce(country, 'UNKNOWN') AS country FROM articles_v3 a LEFT JOIN look ON lower(trim(a.outlet)) = domain")
def join_country_lookup(spark, base):
    known = load(spark, base, "labeled_articles", ["outlet", "source_country"]).where("outlet is not null and source_country is not null and source_country <> 'UNKNOWN'")
    look = known.groupBy(F.lower(F.trim("outlet")).alias("domain")).agg(F.min("source_country").alias("country"))
    articles = load(spark, base, "articles_v3", ["url", "outlet"]).withColumn("domain", F.lower(F.trim("outlet")))
    return articles.join(look, "domain", "left").select("url", C.known_country(F.col("country")).alias("country"))


@query("join_back_text", "WITH s AS (SELECT url FROM (SELECT DISTINCT url FROM articles_v3) ORDER BY md5('7:' || url), url LIMIT 500) SELECT s.url, l.text_chars FROM s LEFT JOIN (SELECT url, max(text_chars) AS text_chars FROM labeled_articles GROUP BY url) l ON s.url = l.url")
def join_back_text(spark, base):
    sample = O.sample_uniform(load(spark, base, "articles_v3", ["url"]).distinct(), "url", 500, seed=7)
    texts = load(spark, base, "labeled_articles", ["url", "text_chars"]).groupBy("url").agg(F.max("text_chars").alias("text_chars"))
    return sample.join(texts, "url", "left")


@query("join_anti_done", f"SELECT DISTINCT url FROM articles_v3 a WHERE NOT EXISTS (SELECT 1 FROM labeled_articles l WHERE l.url = a.url AND {USABLE})")
def join_anti_done(spark, base):
    done = load_spread(spark, base, "labeled_articles", ["url", "fetch_status", "article_text"]).where(C.usable(F.col("fetch_status"), F.col("article_text"))).select("url")
    return load(spark, base, "articles_v3", ["url"]).distinct().join(done, "url", "left_anti")


@query("join_map_reps", "SELECT DISTINCT m.cluster_id, m.url, l.text_chars FROM dedupe_map m JOIN labeled_articles l ON m.url = l.url WHERE m.is_representative")
def join_map_reps(spark, base):
    mapped = load(spark, base, "dedupe_map", ["cluster_id", "url", "is_representative"]).where("is_representative").select("cluster_id", "url").distinct()
    return mapped.join(load(spark, base, "labeled_articles", ["url", "text_chars"]).distinct(), "url").select("cluster_id", "url", "text_chars")


@query("join_outer_compare", """WITH o AS (SELECT source_country AS country, count(DISTINCT url) AS n FROM articles_v3 WHERE source_country IS NOT NULL GROUP BY 1), n AS (SELECT source_country AS country, count(DISTINCT url) AS n FROM labeled_articles WHERE source_country IS NOT NULL GROUP BY 1)
SELECT coalesce(o.country, n.country) AS country, coalesce(o.n, 0) AS before, coalesce(n.n, 0) AS after, coalesce(n.n, 0) - coalesce(o.n, 0) AS delta, CASE WHEN coalesce(o.n, 0) > 0 THEN (coalesce(n.n, 0) - o.n) * 100.0 / o.n END AS pct FROM o FULL JOIN n ON o.country = n.country""")
def join_outer_compare(spark, base):
    def counted(table, name):
        return load(spark, base, table, ["url", "source_country"]).where("source_country is not null").groupBy(F.col("source_country").alias("country")).agg(F.countDistinct("url").alias(name))

    both = counted("articles_v3", "before").join(counted("labeled_articles", "after"), "country", "full_outer").fillna(0, ["before", "after"])
    delta = F.col("after") - F.col("before")
    return both.select("country", "before", "after", delta.alias("delta"), F.when(F.col("before") > 0, delta * 100.0 / F.col("before")).alias("pct"))


@query("join_upsert", "SELECT url, CASE WHEN starts_with(fetch_status, 'FAILED:') AND n.status <> 'WAYBACK_ERR' THEN n.status ELSE fetch_status END AS fetch_status FROM (SELECT DISTINCT url, fetch_status FROM labeled_articles) o LEFT JOIN (SELECT url AS u, CASE WHEN max(n_keywords) > 1 THEN 'OK_WAYBACK' ELSE 'WAYBACK_ERR' END AS status FROM articles_v3 GROUP BY url) n ON o.url = n.u")
def join_upsert(spark, base):
    old = load(spark, base, "labeled_articles", ["url", "fetch_status"]).distinct()
    retried = load(spark, base, "articles_v3", ["url", "n_keywords"]).groupBy("url").agg(F.when(F.max("n_keywords") > 1, "OK_WAYBACK").otherwise("WAYBACK_ERR").alias("fetch_status"))
    take = F.col("fetch_status").startswith("FAILED:") & (F.col("new_fetch_status") != "WAYBACK_ERR")
    return O.upsert(old, retried, "url", ["fetch_status"], take)


# windows

@query("win_dedup_earliest", "SELECT url, published, ingested_at FROM articles_v3 QUALIFY row_number() OVER (PARTITION BY url ORDER BY published NULLS LAST, ingested_at) = 1")
def win_dedup_earliest(spark, base):
    df = load(spark, base, "articles_v3", ["url", "published", "ingested_at"])
    return O.keep_first(df, ["url"], [F.col("published").asc_nulls_last(), "ingested_at"])


@query("win_dedup_hits", "WITH h AS (SELECT url, trim(k) AS keyword, ingested_at FROM (SELECT url, ingested_at, unnest(string_split(keywords_matched, ' | ')) AS k FROM articles_v3)) SELECT url, keyword, min(ingested_at) AS first_seen FROM h GROUP BY url, keyword")
def win_dedup_hits(spark, base):
    df = load(spark, base, "articles_v3", ["url", "keywords_matched", "ingested_at"])
    hits = df.select("url", F.explode(X.kw_list(F.col("keywords_matched"))).alias("keyword"), "ingested_at")
    return hits.groupBy("url", "keyword").agg(F.min("ingested_at").alias("first_seen"))


@query("win_row_normalise", "WITH c AS (SELECT source_country AS country, CAST(year(published) AS INT) AS year, count(*) AS n FROM articles_v3 WHERE source_country IS NOT NULL AND published IS NOT NULL GROUP BY 1, 2) SELECT country, year, n / max(n) OVER (PARTITION BY country) AS share FROM c")
def win_row_normalise(spark, base):
    df = load(spark, base, "articles_v3", ["source_country", "published"]).where("source_country is not null and published is not null")
    counted = df.groupBy(F.col("source_country").alias("country"), F.year("published").alias("year")).agg(F.count("*").alias("n"))
    return counted.select("country", "year", (F.col("n") / F.max("n").over(Window.partitionBy("country"))).alias("share"))


@query("win_daily_timeline", f"SELECT CAST(published AS DATE) AS day, count(*) AS articles FROM labeled_articles WHERE {USABLE} AND published IS NOT NULL GROUP BY 1")
def win_daily_timeline(spark, base):
    df = load_spread(spark, base, "labeled_articles", ["published", "fetch_status", "article_text"]).where(C.usable(F.col("fetch_status"), F.col("article_text")) & F.col("published").isNotNull())
    return df.groupBy(F.to_date("published").alias("day")).agg(F.count("*").alias("articles"))


@query("win_rep_pick", f"SELECT outlet, url FROM (SELECT lower(trim(outlet)) AS outlet, url, {sql_norm('title')} AS t FROM articles_v3 WHERE outlet IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY outlet ORDER BY length(t) DESC, url) = 1")
def win_rep_pick(spark, base):
    df = load(spark, base, "articles_v3", ["outlet", "url", "title"]).where("outlet is not null")
    keyed = df.select(F.lower(F.trim("outlet")).alias("outlet"), (-F.length(X.norm_title(F.col("title")))).alias("shortness"), "url")
    return O.first_by(keyed, ["outlet"], ["shortness", "url"], ["url"])


@query("win_topk_per_group", """WITH k AS (SELECT source_country AS country, trim(k) AS keyword, count(*) AS articles FROM (SELECT source_country, unnest(string_split(keywords_matched, ' | ')) AS k FROM articles_v3 WHERE source_country IS NOT NULL AND source_country <> 'UNKNOWN') WHERE trim(k) <> '' GROUP BY 1, 2)
SELECT country, keyword, articles, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY articles DESC, keyword) AS rank FROM k) WHERE rank <= 10""")
def win_topk_per_group(spark, base):
    df = load(spark, base, "articles_v3", ["source_country", "keywords_matched"]).where("source_country is not null and source_country <> 'UNKNOWN'")
    counted = df.select(F.col("source_country").alias("country"), F.explode(X.kw_list(F.col("keywords_matched"))).alias("keyword")).where("keyword <> ''").groupBy("country", "keyword").agg(F.count("*").alias("articles"))
    return O.top_per_group(counted, ["country"], [F.desc("articles"), "keyword"], 10)


# sorting and sampling

@query("sort_multi", "SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey")
def sort_multi(spark, base):
    return load(spark, base, "supplier", ["s_nationkey", "s_suppkey", "s_acctbal"]).orderBy("s_nationkey", F.desc("s_acctbal"), "s_suppkey")


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def topk(spark, base):
    return load(spark, base, "orders", ["o_orderkey", "o_totalprice"]).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40)


@query("dedupe_keep_first", "SELECT url, min(ingested_at) AS ingested_at FROM articles_v3 GROUP BY url")
def dedupe_keep_first(spark, base):
    return O.first_by(load(spark, base, "articles_v3", ["url", "ingested_at"]), ["url"], ["ingested_at"], ["ingested_at"])


@query("samp_uniform", "SELECT doc_id FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 200")
def samp_uniform(spark, base):
    return O.sample_uniform(load(spark, base, "documents", ["doc_id"]), "doc_id", 200)


@query("samp_two_strata_interleave", """WITH u AS (SELECT url, max(has_hashtag_term) AS tag FROM articles_v3 GROUP BY url), r AS (SELECT url, tag, row_number() OVER (PARTITION BY tag ORDER BY md5('42:' || url), url) AS rn FROM u)
SELECT url, tag, CAST(row_number() OVER (ORDER BY rn, tag) AS INT) AS place FROM r WHERE rn <= 100""")
def samp_two_strata_interleave(spark, base):
    rows = load(spark, base, "articles_v3", ["url", "has_hashtag_term"]).groupBy("url").agg(F.max("has_hashtag_term").alias("tag"))
    taken = O.sample_strata(rows, "tag", "url", {True: 100, False: 100})
    return taken.select("url", "tag", F.row_number().over(Window.orderBy("rn", "tag")).alias("place"))  # at most 200 rows


@query("samp_prop_floor", """WITH d AS (SELECT DISTINCT doc_id, lang FROM documents WHERE lang IS NOT NULL), c AS (SELECT lang, count(*) AS n FROM d GROUP BY lang), w AS (SELECT lang, least(n, greatest(CAST(floor(300 * n / (SELECT sum(n) FROM c)) AS BIGINT), 20)) AS wanted FROM c)
SELECT doc_id, d.lang FROM d JOIN w ON d.lang = w.lang QUALIFY row_number() OVER (PARTITION BY d.lang ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) <= max(wanted) OVER (PARTITION BY d.lang)""")
def samp_prop_floor(spark, base):
    rows = load(spark, base, "documents", ["doc_id", "lang"]).where("lang is not null").distinct()
    wanted = O.allocate_with_floor(rows.groupBy("lang").agg(F.count("*").alias("n")), 300, 20).select("lang", "wanted")
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(O.shuffled(F.col("doc_id"), 42), "doc_id")))
    return ranked.where("rn <= 300").join(wanted, "lang").where("rn <= wanted").select("doc_id", "lang")  # no stratum wants more than all


@query("samp_per_group", "WITH u AS (SELECT DISTINCT url, source_country AS country FROM labeled_articles WHERE source_country IS NOT NULL) SELECT country, url FROM u QUALIFY row_number() OVER (PARTITION BY country ORDER BY md5('42:' || url), url) <= 3")
def samp_per_group(spark, base):
    rows = load(spark, base, "labeled_articles", ["url", "source_country"]).where("source_country is not null").select("url", F.col("source_country").alias("country")).distinct()
    return O.top_per_group(rows, ["country"], [O.shuffled(F.col("url"), 42), "url"], 3).select("country", "url")


@query("samp_spread_fill", """WITH u AS (SELECT url, min(source_country) AS country, max(has_hashtag_term) AS tag FROM articles_v3 WHERE source_country IS NOT NULL GROUP BY url), t AS (SELECT country FROM u GROUP BY country ORDER BY count(*) DESC, country LIMIT 20),
s AS (SELECT url FROM u WHERE country IN (SELECT country FROM t) QUALIFY row_number() OVER (PARTITION BY country, tag ORDER BY md5('42:' || url), url) <= 2), f AS (SELECT url FROM u WHERE url NOT IN (SELECT url FROM s) ORDER BY md5('43:' || url), url LIMIT 100)
SELECT url, 'spread' AS part FROM s UNION ALL SELECT url, 'fill' AS part FROM f""")
def samp_spread_fill(spark, base):
    rows = load(spark, base, "articles_v3", ["url", "source_country", "has_hashtag_term"]).where("source_country is not null").groupBy("url").agg(F.min("source_country").alias("country"), F.max("has_hashtag_term").alias("tag"))
    top = rows.groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(20).select("country")
    spread = O.top_per_group(rows.join(top, "country", "left_semi"), ["country", "tag"], [O.shuffled(F.col("url"), 42), "url"], 2).select("url")
    fill = O.sample_uniform(rows.join(spread, "url", "left_anti").select("url"), "url", 100, seed=43)
    return spread.withColumn("part", F.lit("spread")).unionByName(fill.withColumn("part", F.lit("fill")))


# sets

@query("set_union", "SELECT url, outlet FROM articles_v3 UNION ALL SELECT url, outlet FROM labeled_articles")
def set_union(spark, base):
    return load(spark, base, "articles_v3", ["url", "outlet"]).unionByName(load(spark, base, "labeled_articles", ["url", "outlet"]))


WORD_SETS = f"(SELECT url, list_distinct(string_split({sql_norm('title')}, ' ')) AS a, list_distinct(string_split({sql_norm('fetched_title')}, ' ')) AS b FROM labeled_articles)"


def _word_sets(spark, base):
    def words(c):
        return F.array_distinct(F.split(X.norm_title(F.col(c)), " "))

    return load(spark, base, "labeled_articles", ["url", "title", "fetched_title"]).select("url", words("title").alias("a"), words("fetched_title").alias("b"))


@query("set_except_row", f"SELECT url, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS words FROM {WORD_SETS}")
def set_except_row(spark, base):
    return _word_sets(spark, base).select("url", F.array_sort(F.array_except("b", "a")).alias("words"))


@query("set_union_row", f"SELECT url, array_to_string(list_sort(list_distinct(list_concat(a, b))), ' | ') AS words FROM {WORD_SETS}")
def set_union_row(spark, base):
    return _word_sets(spark, base).select("url", F.array_join(F.array_sort(F.array_union("a", "b")), " | ").alias("words"))


@query("set_intersect_row", """WITH s AS (SELECT DISTINCT cluster_id, m.url, unnest(list_distinct(string_split(""" + sql_norm("l.title") + """, ' '))) AS word FROM dedupe_map m JOIN labeled_articles l ON m.url = l.url), n AS (SELECT cluster_id, count(DISTINCT url) AS members FROM s GROUP BY 1)
SELECT s.cluster_id, word FROM s JOIN n ON s.cluster_id = n.cluster_id GROUP BY s.cluster_id, word, members HAVING count(DISTINCT url) = members AND members > 1""")
def set_intersect_row(spark, base):
    mapped = load(spark, base, "dedupe_map", ["cluster_id", "url"]).distinct()
    titles = load(spark, base, "labeled_articles", ["url", "title"]).distinct()
    words = mapped.join(titles, "url").select("cluster_id", "url", F.explode(F.array_distinct(F.split(X.norm_title(F.col("title")), " "))).alias("word"))
    members = words.select("cluster_id", "url").distinct().groupBy("cluster_id").agg(F.count("*").alias("members")).where("members > 1")
    shared = words.groupBy("cluster_id", "word").agg(F.countDistinct("url").alias("n"))
    return shared.join(members, "cluster_id").where("n = members").select("cluster_id", "word")
