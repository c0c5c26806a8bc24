"""Duplicates: address and title variants, exact and near bodies, groups, an editorial guard, representatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import norm_body, norm_title, norm_url, shingle_hashes
from tessella.operators.relations import connected_components
from tessella.operators.similar import described_sets, prefixes, sizes_agree, verified
from tessella.session import cut_lineage, write_stage

MIN_TITLE = 15
OPINION_TYPES = ("opinion_editorial", "feature_analysis", "Opinion/Editorial", "Analysis")
NO_STANCE = ("", "not_applicable")


def star_edges(df: DataFrame, id: str, key: Sequence[Column]) -> DataFrame:
    """Edges ``a, b`` from every row to the least id of its key: as many edges as rows, however large a key is."""
    named = df.select(F.col(id).alias("a"), *[k.alias(f"k{i}") for i, k in enumerate(key)])
    names = [f"k{i}" for i in range(len(key))]
    least = named.groupBy(*names).agg(F.min("a").alias("b"))
    return named.join(least, names).select("a", "b")


def address_edges(articles: DataFrame) -> DataFrame:
    """Addresses that differ in scheme, www., query, fragment or closing slash only."""
    return star_edges(articles, "url", [norm_url(F.col("url"))])


def title_edges(articles: DataFrame) -> DataFrame:
    """The same title of some length in the same outlet."""
    keyed = articles.select("url", norm_title(F.col("title")).alias("t"), F.lower(F.trim("outlet")).alias("o")).where((F.length("t") > MIN_TITLE) & F.col("o").isNotNull())
    return star_edges(keyed, "url", [F.col("t"), F.col("o")])


def syndicated(articles: DataFrame) -> DataFrame:
    """``url`` of articles whose title of some length appears in two outlets or more."""
    keyed = articles.select("url", norm_title(F.col("title")).alias("t"), F.lower(F.trim("outlet")).alias("o")).where(F.length("t") > MIN_TITLE)
    many = keyed.groupBy("t").agg(F.min("o").alias("first"), F.max("o").alias("last")).where("first <> last").select("t")
    return keyed.join(many, "t", "left_semi").select("url").distinct()


def prefetch_clusters(articles: DataFrame) -> DataFrame:
    """``url, cluster_id, is_representative``: groups by address and title; the longest title stands for its group."""
    rows = articles.groupBy("url").agg(F.min("title").alias("title"), F.min("outlet").alias("outlet"))
    found = connected_components(address_edges(rows).union(title_edges(rows)))
    labelled = rows.join(found.select(F.col("id").alias("url"), F.col("component").alias("cluster_id")), "url")
    best = labelled.groupBy("cluster_id").agg(F.min(F.struct((-F.length(norm_title(F.col("title")))).alias("n"), "url")).alias("b"))
    return labelled.join(best, "cluster_id").select("url", "cluster_id", (F.col("url") == F.col("b.url")).alias("is_representative"))


def bodies(articles: DataFrame, key: str, text: str, least: int = 200) -> DataFrame:
    """``id, rep, norm`` of every row with a body longer than ``least``: ``rep`` is the least id with the same normalised body."""
    rows = articles.where(F.length(text) > least).groupBy(F.col(key).alias("id")).agg(F.min(text).alias("text")).select("id", norm_body(F.col("text")).alias("norm"))
    first = rows.groupBy(F.md5("norm").alias("digest")).agg(F.min("id").alias("rep"))
    return rows.withColumn("digest", F.md5("norm")).join(first, "digest").select("id", "rep", "norm")


def distinct_bodies(articles: DataFrame, key: str, text: str, least: int = 200) -> DataFrame:
    """``id, norm`` of the representatives of ``bodies``; each text is normalised once and travels once more."""
    rows = articles.where(F.length(text) > least).groupBy(F.col(key).alias("id")).agg(F.min(text).alias("text")).select("id", norm_body(F.col("text")).alias("norm"))
    return rows.groupBy(F.md5("norm").alias("digest")).agg(F.min("id").alias("id"), F.min("norm").alias("norm")).select("id", "norm")


def similar_pairs(units: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``a, b, similarity`` of all pairs ``a < b`` of ``id, norm`` whose shingle sets are at least this similar.

    Prefix filtering, which loses nothing: shingles are ordered from rare to common, and two sets of that similarity
    share one of the first ``n - ceil(threshold * n) + 1`` of theirs. Common shingles are so never joined on unless a
    set has no rarer ones. Sizes must agree within the threshold, and after the first shared shingle enough others
    must be left in both. Candidates are compared by sketches, which lose nothing either, and those left in full. The inputs are
    class representatives: equal bodies are joined before by their digest, so no group of copies is paired.
    """
    sets = described_sets(units)
    prefix = prefixes(sets, threshold)
    left, right = (prefix.select(F.col("num").alias(x), F.col("n").alias(f"n{x}"), F.col("place").alias(f"p{x}"), "s") for x in "ab")
    shared = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    enough = shared >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9
    candidates = left.join(right, "s").where((F.col("a") < F.col("b")) & sizes_agree(threshold) & enough).select("a", "b")
    return verified(candidates, sets, threshold)


def near_clusters(articles: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """``id, cluster_id``: exact copies by digest, near copies by verified similarity, closed transitively."""
    units = bodies(articles, key, text)
    pairs = similar_pairs(units.where("id = rep").select("id", "norm"), threshold).select("a", "b")
    edges = units.select(F.col("id").alias("a"), F.col("rep").alias("b")).union(pairs)
    return connected_components(edges).select("id", F.col("component").alias("cluster_id"))


#: Share of a text's shingles outside the core of its cluster from which it is kept apart.
UNIQUE_TEXT = 0.35


def editorial_splits(members: DataFrame) -> DataFrame:
    """Reasons to keep a member of a cluster apart: ``cluster_id, url, reasons``.

    ``members`` has ``cluster_id, url, article_type, stance, words, norm`` (evaluative words as an array, the normalised body)
    with one row per member. A member is kept apart if it is opinion among news, if its stance isn't the most frequent one of the
    others (ties go to the smaller), if it has two evaluative words that not all others share, or if enough of its
    shingles are missing from some member. Everything is counted per cluster and value, so the size of a cluster doesn't matter.
    """
    kinds = members.select("cluster_id", F.coalesce(F.col("article_type").isin(*OPINION_TYPES), F.lit(False)).alias("opinion"))
    sizes = kinds.groupBy("cluster_id").agg(F.count("*").alias("size"), F.count_if(~F.col("opinion")).alias("news")).where("size > 1")
    # read six times below, so written once, without the texts and without what is alone in its cluster
    rows = write_stage(members.join(sizes, "cluster_id").select(
        "cluster_id", "url", "size", "news", F.coalesce(F.col("article_type").isin(*OPINION_TYPES), F.lit(False)).alias("opinion"),
        F.lower(F.trim(F.coalesce("stance", F.lit("")))).alias("stance"), F.coalesce("words", F.array().cast("array<string>")).alias("words"),
        shingle_hashes(F.coalesce("norm", F.lit(""))).alias("sh"),
    ), "guard")
    stances = rows.where("stance <> ''").groupBy("cluster_id", "stance").agg(F.count("*").alias("n"))
    by_count = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "stance")
    top = stances.withColumn("rn", F.row_number().over(by_count)).where("rn <= 2").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rn", "n", "stance"))).alias("top"))
    # the core is what all members hold, so counting it tells how much of each lies outside
    held = rows.select("cluster_id", "size", F.explode("sh").alias("s")).groupBy("cluster_id", "s").agg(F.count("*").alias("k"), F.max("size").alias("size"))
    core = held.where("k = size").groupBy("cluster_id").agg(F.count("*").alias("core"))
    joined = rows.select("cluster_id", "url", "news", "opinion", "stance", F.size("sh").alias("shingles")).join(top, "cluster_id", "left").join(core, "cluster_id", "left")
    first, second = F.get("top", 0), F.get("top", 1)
    # without the member itself its own stance counts one less
    own = first["stance"] == F.col("stance")
    second_wins = own & second.isNotNull() & ((second["n"] > first["n"] - 1) | ((second["n"] == first["n"] - 1) & (second["stance"] < first["stance"])) | (first["n"] == 1))
    majority = F.when(second_wins, second["stance"]).when(own & (first["n"] == 1), F.lit(None)).otherwise(first["stance"])
    word_counts = rows.select("cluster_id", F.explode("words").alias("w")).groupBy("cluster_id", "w").agg(F.count("*").alias("k"))
    with_words = rows.select("cluster_id", "url", "size", F.explode("words").alias("w")).join(word_counts, ["cluster_id", "w"])
    unique = with_words.where(F.col("k") - 1 < F.col("size") - 1).groupBy("cluster_id", "url").agg(F.count("*").alias("unique_words"))
    outside = (F.col("shingles") - F.coalesce("core", F.lit(0))) / F.col("shingles")
    judged = joined.withColumn("majority", majority).withColumn("outside", outside).join(unique, ["cluster_id", "url"], "left")
    reasons = F.filter(F.array(
        F.when(F.col("opinion") & (F.col("news") > 0), F.lit("opinion_overlay")),
        F.when((~F.col("stance").isin(*NO_STANCE)) & F.col("majority").isNotNull() & (F.col("stance") != F.col("majority")), F.concat(F.lit("stance_differs("), "stance", F.lit("_vs_"), "majority", F.lit(")"))),
        F.when(F.coalesce("unique_words", F.lit(0)) >= 2, F.concat(F.lit("added_evaluative_language("), F.col("unique_words").cast("string"), F.lit(")"))),
        F.when(F.col("outside") >= UNIQUE_TEXT, F.lit("unique_text")),
    ), lambda r: r.isNotNull())
    return judged.select("cluster_id", "url", reasons.alias("reasons"))


def representatives(mapped: DataFrame, articles: DataFrame, text: str = "article_text") -> DataFrame:
    """Per cluster the member with the longest text (then the least url), how many members it has, and all of them joined.

    The joined list is the result asked for; lengths travel instead of texts.
    """
    lengths = articles.groupBy("url").agg(F.max(F.length(F.coalesce(text, F.lit("")))).alias("chars"))
    joined = mapped.select("cluster_id", "url").distinct().join(lengths, "url")
    return joined.groupBy("cluster_id").agg(
        F.min(F.struct((-F.col("chars")).alias("c"), "url")).alias("b"), F.count("*").alias("dup_count"), F.array_join(F.array_sort(F.collect_list("url")), " ; ").alias("dup_urls")
    ).select("cluster_id", F.col("b.url").alias("url"), "dup_count", "dup_urls")


def threshold_table(articles: DataFrame, key: str, text: str, thresholds: Sequence[float] = (1.0, 0.9, 0.8)) -> DataFrame:
    """Unique bodies left at each threshold. Pairs are scored once at the lowest; components are found for each."""
    units = bodies(articles, key, text)
    lowest = min(t for t in thresholds if t < 1.0) if any(t < 1.0 for t in thresholds) else 1.0
    # each threshold reads them, so written once
    scored = cut_lineage(similar_pairs(units.where("id = rep").select("id", "norm"), lowest)) if lowest < 1.0 else None
    copies = units.select(F.col("id").alias("a"), F.col("rep").alias("b"))
    out = None
    for t in thresholds:
        edges = copies if t >= 1.0 or scored is None else copies.union(scored.where(F.col("similarity") >= t).select("a", "b"))
        groups = edges.select("a", F.col("b").alias("component")) if t >= 1.0 else connected_components(edges).select(F.col("id").alias("a"), "component")
        row = groups.agg(F.lit(float(t)).alias("threshold"), F.countDistinct("component").alias("unique_bodies"), (F.count("*") - F.countDistinct("component")).alias("removed"))
        out = row if out is None else out.unionByName(row)
    return out
