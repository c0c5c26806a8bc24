"""The pN_ queries of this package: each takes (spark, folder of tables) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import encoding, languages, lookalikes, packing, residue, sentences, shared_spans, site_lines, survivors
from tessella.sources.tables import load, load_spread

#: Bundles of the built record of problem 1 and the dependencies between them.
RECORD_BUNDLES = {
    "headline": ("title", "published"),
    "place": ("outlet",),
    "origin": ("source_country",),
    "page": ("fetched_title", "fetch_status"),
    "judgement": ("stance", "stance_confidence", "evidence"),
}
RECORD_DEPENDENCIES = (("outlet", "source_country"), ("title", "fetched_title"))
#: Problem 1 asks for each field by itself: every field is a bundle and none depends on another.
FOUND_BUNDLES = {f: (f,) for f in survivors.FOUND_FIELDS}
#: Budgets come from a table of a few rows; more than this is an error, not a plan.
MOST_BUDGETS = 1000
#: The codebook doesn't grow with the corpus; a larger one is an error, not cut short.
MOST_KEYWORDS = 200_000


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    fields = survivors.FOUND_FIELDS
    members = survivors.cluster_members(load(spark, base, "dedupe_map", ["cluster_id", "url"]), load(spark, base, "labeled_articles"), fields)
    chosen = survivors.surviving_bundles(members, group="cluster_id", member="url", bundles=FOUND_BUNDLES)
    return chosen.select("cluster_id", F.col("bundle").alias("field_name"), "url")


def p1_records(spark: SparkSession, base: str) -> DataFrame:
    fields = [f for fields in RECORD_BUNDLES.values() for f in fields]
    members = survivors.cluster_members(load(spark, base, "dedupe_map", ["cluster_id", "url"]), load(spark, base, "labeled_articles"), fields)
    chosen = survivors.surviving_bundles(members, group="cluster_id", member="url", bundles=RECORD_BUNDLES, dependencies=RECORD_DEPENDENCIES, carry=True)
    return survivors.surviving_records(chosen, RECORD_BUNDLES, group="cluster_id", member="url")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return residue.residue_documents(load_spread(spark, base, "labeled_articles", ["url", "article_text"]), key="url", text="article_text")


def p3_kept(spark: SparkSession, base: str) -> DataFrame:
    """Key and length of what is left when residue is excluded."""
    articles = load_spread(spark, base, "labeled_articles", ["url", "fetch_status", "text_chars", "article_text"])
    return residue.without_residue(articles, key="url", text="article_text").select("url", "fetch_status", "text_chars").distinct()


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    articles = load_spread(spark, base, "labeled_articles", ["url", "article_text", "fetched_title", "language"])
    found = languages.document_languages(articles, key="url", text="article_text", title="fetched_title", label="language")
    pages = residue.residue_documents(articles, key="url", text="article_text")
    return languages.mislabelled(found, key="url").join(pages, "url", "left_anti").distinct()


def p4_languages(spark: SparkSession, base: str) -> DataFrame:
    articles = load_spread(spark, base, "labeled_articles", ["url", "article_text", "fetched_title", "language"])
    found = languages.document_languages(articles, key="url", text="article_text", title="fetched_title", label="language")
    return found.select("url", "lang", "share", "confidence").distinct()


def p4_segments(spark: SparkSession, base: str) -> DataFrame:
    return languages.language_segments(load_spread(spark, base, "labeled_articles", ["url", "article_text"]).dropDuplicates(["url"]), key="url", text="article_text")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return site_lines.repeated_lines(load_spread(spark, base, "labeled_articles", ["url", "outlet", "article_text"]), key="url", source="outlet", text="article_text")


def p5_near(spark: SparkSession, base: str) -> DataFrame:
    return site_lines.near_repeated_lines(load_spread(spark, base, "labeled_articles", ["url", "outlet", "article_text"]), key="url", source="outlet", text="article_text")


def p5_cleaned_equal(spark: SparkSession, base: str) -> DataFrame:
    """Texts without the lines of p5_found alone, as plain SQL can say it too."""
    articles = load_spread(spark, base, "labeled_articles", ["url", "outlet", "article_text"]).dropDuplicates(["url"])
    removed = site_lines.repeated_lines(articles, key="url", source="outlet", text="article_text")
    return site_lines.without_lines(articles, removed, key="url", text="article_text")


def p5_cleaned(spark: SparkSession, base: str) -> DataFrame:
    """Texts without the lines of all clusters that many documents of a source have, equal or near."""
    articles = load_spread(spark, base, "labeled_articles", ["url", "outlet", "article_text"]).dropDuplicates(["url"])
    return site_lines.without_repeated(articles, key="url", source="outlet", text="article_text")


def _codebook(spark: SparkSession, base: str) -> list[tuple[int, str]]:
    rows = load(spark, base, "metoo_keywords_v3", ["kw_id", "keyword"]).limit(MOST_KEYWORDS + 1).collect()
    if len(rows) > MOST_KEYWORDS:
        raise ValueError("the codebook is too large to be held on the driver")
    return [(r.kw_id, r.keyword) for r in rows]


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return lookalikes.hidden_mentions(load_spread(spark, base, "labeled_articles", ["url", "article_text"]), _codebook(spark, base), key="url", text="article_text")


def p6_mentions(spark: SparkSession, base: str) -> DataFrame:
    return lookalikes.mention_counts(load_spread(spark, base, "labeled_articles", ["url", "article_text"]), _codebook(spark, base), key="url", text="article_text")


def p6_rewritten(spark: SparkSession, base: str) -> DataFrame:
    return lookalikes.rewritten_texts(load_spread(spark, base, "labeled_articles", ["url", "article_text"]), _codebook(spark, base), key="url", text="article_text")


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    runs = shared_spans.shared_runs(load_spread(spark, base, "deduped_articles", ["cluster_id", "article_text"]), key="cluster_id", text="article_text")
    return shared_spans.sharing_pairs(runs).select(F.col("id_a").alias("cluster_a"), F.col("id_b").alias("cluster_b"))


def p7_classes(spark: SparkSession, base: str) -> DataFrame:
    """The records of each class that share a run, one row per member; pairs are ``p7_found``."""
    runs = shared_spans.shared_runs(load_spread(spark, base, "deduped_articles", ["cluster_id", "article_text"]), key="cluster_id", text="article_text")
    return shared_spans.sharing_classes(runs).withColumnRenamed("id", "cluster_id")


def p7_shared(spark: SparkSession, base: str) -> DataFrame:
    records = load_spread(spark, base, "deduped_articles", ["cluster_id", "article_text"])
    runs = shared_spans.shared_runs(records, key="cluster_id", text="article_text")
    return shared_spans.shared_share(records, runs, key="cluster_id", text="article_text")


def p7_removals(spark: SparkSession, base: str) -> DataFrame:
    runs = shared_spans.shared_runs(load_spread(spark, base, "deduped_articles", ["cluster_id", "article_text"]), key="cluster_id", text="article_text")
    return shared_spans.shared_parts(runs, lost_only=True).withColumnRenamed("id", "cluster_id")


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return encoding.encode_column(load_spread(spark, base, "documents", ["doc_id", "text"]), "doc_id", "text").select(F.col("key").alias("doc_id"), F.col("value").alias("ids"))


def _budgets(spark: SparkSession, base: str) -> list[tuple[str, int]]:
    rows = load(spark, base, "context_budgets", ["budget_name", "capacity_tokens"]).where("capacity_tokens > 0").distinct().limit(MOST_BUDGETS + 1).collect()
    if len(rows) > MOST_BUDGETS:
        raise ValueError("context_budgets holds too many rows to be a list of budgets")
    return sorted((str(r.budget_name), r.capacity_tokens) for r in rows)


def p9_containers(spark: SparkSession, base: str) -> DataFrame:
    documents = load_spread(spark, base, "documents", ["doc_id", "text"])
    sizes = encoding.encode_column(documents, "doc_id", "text", only_count=True).select(F.col("key").alias("doc_id"), F.col("value").alias("tokens"))
    return packing.container_plan(sizes, key="doc_id", size="tokens", budgets=_budgets(spark, base), item_count=load(spark, base, "documents", ["doc_id"]).count())


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return sentences.sentence_units(load_spread(spark, base, "documents", ["doc_id", "text"]), "doc_id", "text")


def queries() -> dict:
    made = {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
    return dict(sorted(made.items(), key=lambda kv: (int(kv[0][1:].split("_")[0]), kv[0])))
