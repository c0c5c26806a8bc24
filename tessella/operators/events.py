"""How coverage of events spreads over time between groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import resources as R
from tessella.functions.text import norm_event

#: Events are a catalogue; a larger one is joined without a broadcast.
MOST_BROADCAST_EVENTS = 10_000


def event_table(spark: SparkSession, events: Sequence[tuple]) -> DataFrame:
    """``key, date, origin, label, words, blind``."""
    return spark.createDataFrame(events, "key string, date string, origin string, label string, words array<string>, blind boolean").withColumn("date", F.to_date("date"))


def event_matches(articles: DataFrame, events: DataFrame, *, window: int = R.EVENT_WINDOW, lead: int = R.EVENT_LEAD, prefix: int = 6000) -> DataFrame:
    """``event, url, country, offset``: articles within days of an event whose start holds one of its words.

    An article may belong to several events. ``articles`` has ``url, country, day, text``. The interval join is an
    equi-join on 64-day bins of which an event meets two or three, so it stays a hash join whatever the number of
    events; text is normalised once per article that lies near any event.
    """
    width = 64
    spread = events.withColumn("lo", F.date_sub("date", lead)).withColumn("hi", F.date_add("date", window))
    bins = F.sequence(F.floor(F.unix_date("lo") / width), F.floor(F.unix_date("hi") / width))
    binned = spread.select(F.col("key").alias("event"), "date", "words", "lo", "hi", F.explode(bins).alias("bin"))
    dated = articles.where("day is not null and text is not null").withColumn("bin", F.floor(F.unix_date("day") / width))
    small = events.limit(MOST_BROADCAST_EVENTS + 1).count() <= MOST_BROADCAST_EVENTS
    joined = dated.join(F.broadcast(binned) if small else binned, "bin").where(F.col("day").between(F.col("lo"), F.col("hi")))

    def held(head: Column) -> Column:
        return F.exists("words", lambda w: head.contains(w))

    hit = F.transform(F.array(norm_event(F.substring("text", 1, prefix))), held)[0]
    return joined.where(hit).select("event", "url", F.col("country"), F.datediff("day", "date").alias("offset"))


def daily_counts(matches: DataFrame, *, least: int = R.MIN_ARTICLES) -> DataFrame:
    """``event, country, offset, n, articles`` of known countries with enough articles."""
    known = matches.where(F.col("country").isNotNull() & (F.col("country") != R.UNKNOWN))
    daily = known.groupBy("event", "country", "offset").agg(F.count("*").alias("n"))
    return daily.withColumn("articles", F.sum("n").over(Window.partitionBy("event", "country"))).where(F.col("articles") >= least)


def densified(daily: DataFrame, *, window: int = R.EVENT_WINDOW, lead: int = R.EVENT_LEAD) -> DataFrame:
    """A row for every day of the window, 0 where there is nothing."""
    days = F.explode(F.sequence(F.lit(-lead), F.lit(window))).alias("offset")
    every = daily.groupBy("event", "country").agg(F.max("articles").alias("articles")).select("event", "country", "articles", days)
    return every.join(daily.select("event", "country", "offset", "n"), ["event", "country", "offset"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def smoothed(dense: DataFrame) -> DataFrame:
    """Adds the centred mean of three days, of two at the edges, and six times that mean as a whole number."""
    near = Window.partitionBy("event", "country").orderBy("offset").rowsBetween(-1, 1)
    return dense.withColumn("mean3", F.avg("n").over(near)).withColumn("six", (F.sum("n").over(near) * 6 / F.count("n").over(near)).cast("bigint"))


def summary(dense: DataFrame, *, reliable: int = R.RELIABLE_ARTICLES) -> DataFrame:
    """Per event and country: onset (first day of a fifth of the peak, at least two), peak of the smoothed counts, size."""
    top = F.max("n").over(Window.partitionBy("event", "country"))
    rows = smoothed(dense).withColumn("top", top)
    found = rows.groupBy("event", "country").agg(
        F.max("articles").alias("articles"), F.min(F.when(F.col("n") >= F.greatest(F.lit(2.0), F.col("top") * 0.2), F.col("offset"))).alias("onset"),
        F.min(F.struct((-F.col("six")).alias("s"), "offset")).alias("p"), F.max("top").alias("peak_articles"),
    )
    return found.select("event", "country", "articles", F.coalesce("onset", "p.offset").alias("onset_day"), F.col("p.offset").alias("peak_day"), "peak_articles", (F.col("articles") >= reliable).alias("reliable"))


def lags(found: DataFrame, events: DataFrame) -> DataFrame:
    """Per event with an origin that the corpus can see: how long after the origin's peak the other reliable countries peaked."""
    origins = events.where("not blind and origin is not null").select(F.col("key").alias("event"), "origin")
    first = found.join(origins, "event").where("country = origin").select("event", F.col("peak_day").alias("origin_peak"))
    others = found.join(origins, "event").where("country <> origin and reliable").join(first, "event")
    lag = F.col("peak_day") - F.col("origin_peak")
    return others.withColumn("lag", lag).groupBy("event").agg(
        F.max("origin_peak").alias("origin_peak"), F.median("lag").alias("median_lag"), F.count_if(F.col("lag") <= 1).alias("within_a_day"),
        F.count_if(F.col("lag").between(2, 6)).alias("within_a_week"), F.count_if(F.col("lag") >= 7).alias("later"),
    )


def reach(found: DataFrame) -> DataFrame:
    return found.groupBy("event").agg(F.count("*").alias("countries"))
