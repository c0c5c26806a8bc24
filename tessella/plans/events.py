"""Queries of event propagation over the labelled articles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import resources as R
from tessella.operators import columns as C
from tessella.operators import events as V
from tessella.plans.columns import USABLE, sql_accents
from tessella.plans.registry import query
from tessella.sources.tables import load, load_spread


#: The invented corpus is small: fewer articles than by default make a country count.
LEAST, RELIABLE = 2, 4


def _text(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


EVENTS = "e(event, date, origin, words, blind) AS (VALUES " + ", ".join(
    f"({_text(k)}, DATE '{d}', {_text(o)}, [{', '.join(_text(w) for w in words)}], {str(b).upper()})" for k, d, o, _, words, b in R.CORPUS_EVENTS
) + ")"
ARTICLES = f"a AS MATERIALIZED (SELECT DISTINCT url, source_country AS country, CAST(published AS DATE) AS day, regexp_replace(lower({sql_accents('substring(article_text, 1, 6000)')}), '[^\\p{{L}}\\p{{N}}_\\s#]', ' ', 'g') AS doc FROM labeled_articles WHERE {USABLE} AND published IS NOT NULL)"
MATCHES = "m AS MATERIALIZED (SELECT event, url, country, CAST(day - date AS INT) AS off FROM a JOIN e ON day BETWEEN date - 7 AND date + 45 AND len(list_filter(words, lambda w: contains(doc, w))) > 0)"
DAILY = "dc AS MATERIALIZED (SELECT event, country, off, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY event, country) AS BIGINT) AS articles FROM m WHERE country IS NOT NULL AND country <> 'UNKNOWN' GROUP BY 1, 2, 3 QUALIFY sum(count(*)) OVER (PARTITION BY event, country) >= 2)"
DENSE = "de AS MATERIALIZED (SELECT k.event, k.country, k.articles, o.off, coalesce(dc.n, 0) AS n FROM (SELECT event, country, max(articles) AS articles FROM dc GROUP BY 1, 2) k CROSS JOIN (SELECT CAST(unnest(range(-7, 46)) AS INT) AS off) o LEFT JOIN dc ON dc.event = k.event AND dc.country = k.country AND dc.off = o.off)"
SMOOTH = "sm AS MATERIALIZED (SELECT *, avg(n) OVER w AS mean3, CAST(sum(n) OVER w * 6 / count(*) OVER w AS BIGINT) AS six, max(n) OVER (PARTITION BY event, country) AS top FROM de WINDOW w AS (PARTITION BY event, country ORDER BY off ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"
SUMMARY = "su AS MATERIALIZED (SELECT event, country, max(articles) AS articles, coalesce(min(off) FILTER (WHERE n >= greatest(2.0, top * 0.2)), arg_min(off, (-six, off))) AS onset_day, arg_min(off, (-six, off)) AS peak_day, max(top) AS peak_articles, max(articles) >= 4 AS reliable FROM sm GROUP BY 1, 2)"


def _matches(spark, base):
    df = load_spread(spark, base, "labeled_articles", ["url", "source_country", "published", "article_text", "fetch_status"])
    rows = df.where(C.usable(F.col("fetch_status"), F.col("article_text")) & F.col("published").isNotNull())
    articles = rows.select("url", F.col("source_country").alias("country"), F.to_date("published").alias("day"), F.col("article_text").alias("text")).dropDuplicates(["url"])
    return V.event_matches(articles, V.event_table(spark, R.CORPUS_EVENTS))


def _dense(spark, base):
    return V.densified(V.daily_counts(_matches(spark, base), least=LEAST))


@query("join_event_window", f"WITH {EVENTS}, {ARTICLES}, {MATCHES} SELECT event, url, country, off AS day_offset FROM m")
def join_event_window(spark, base):
    return _matches(spark, base).withColumnRenamed("offset", "day_offset")


@query("ev_subset", f"WITH {EVENTS}, {ARTICLES}, {MATCHES} SELECT event, count(DISTINCT url) AS articles, count(DISTINCT country) AS countries FROM m GROUP BY 1")
def ev_subset(spark, base):
    """How many articles and countries the subset of each event has."""
    return _matches(spark, base).groupBy("event").agg(F.countDistinct("url").alias("articles"), F.countDistinct("country").alias("countries"))


@query("win_densify", f"WITH {EVENTS}, {ARTICLES}, {MATCHES}, {DAILY}, {DENSE} SELECT event, country, off AS day_offset, n FROM de")
def win_densify(spark, base):
    return _dense(spark, base).select("event", "country", F.col("offset").alias("day_offset"), "n")


@query("win_rolling3", f"WITH {EVENTS}, {ARTICLES}, {MATCHES}, {DAILY}, {DENSE}, {SMOOTH} SELECT event, country, off AS day_offset, mean3 FROM sm")
def win_rolling3(spark, base):
    return V.smoothed(_dense(spark, base)).select("event", "country", F.col("offset").alias("day_offset"), "mean3")


@query("win_peak", f"WITH {EVENTS}, {ARTICLES}, {MATCHES}, {DAILY}, {DENSE}, {SMOOTH}, {SUMMARY} SELECT event, country, peak_day FROM su")
def win_peak(spark, base):
    return V.summary(_dense(spark, base), reliable=RELIABLE).select("event", "country", "peak_day")


@query("win_onset", f"WITH {EVENTS}, {ARTICLES}, {MATCHES}, {DAILY}, {DENSE}, {SMOOTH}, {SUMMARY} SELECT event, country, onset_day FROM su")
def win_onset(spark, base):
    return V.summary(_dense(spark, base), reliable=RELIABLE).select("event", "country", "onset_day")


@query("ev_heatmap", f"WITH {EVENTS}, {ARTICLES}, {MATCHES}, {DAILY}, {DENSE} SELECT event, country, off AS day_offset, n / max(n) OVER (PARTITION BY event, country) AS share FROM de")
def ev_heatmap(spark, base):
    share = F.col("n") / F.max("n").over(Window.partitionBy("event", "country"))
    return _dense(spark, base).select("event", "country", F.col("offset").alias("day_offset"), share.alias("share"))


@query("ev_summary", f"WITH {EVENTS}, {ARTICLES}, {MATCHES}, {DAILY}, {DENSE}, {SMOOTH}, {SUMMARY} SELECT * FROM su")
def ev_summary(spark, base):
    return V.summary(_dense(spark, base), reliable=RELIABLE)


@query("agg_median_lag", f"""WITH {EVENTS}, {ARTICLES}, {MATCHES}, {DAILY}, {DENSE}, {SMOOTH}, {SUMMARY}, o AS (SELECT su.event, peak_day AS origin_peak FROM su JOIN e ON su.event = e.event AND su.country = e.origin AND NOT blind), l AS (SELECT su.event, origin_peak, peak_day - origin_peak AS lag FROM su JOIN o ON su.event = o.event JOIN e ON e.event = su.event AND e.origin <> su.country WHERE reliable)
SELECT event, max(origin_peak) AS origin_peak, median(lag) AS median_lag, count(*) FILTER (WHERE lag <= 1) AS within_a_day, count(*) FILTER (WHERE lag BETWEEN 2 AND 6) AS within_a_week, count(*) FILTER (WHERE lag >= 7) AS later FROM l GROUP BY event""")
def agg_median_lag(spark, base):
    return V.lags(V.summary(_dense(spark, base), reliable=RELIABLE), V.event_table(spark, R.CORPUS_EVENTS))


@query("agg_reach", f"WITH {EVENTS}, {ARTICLES}, {MATCHES}, {DAILY}, {DENSE}, {SMOOTH}, {SUMMARY} SELECT event, count(*) AS countries FROM su GROUP BY event")
def agg_reach(spark, base):
    return V.reach(V.summary(_dense(spark, base), reliable=RELIABLE))
