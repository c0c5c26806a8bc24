"""Queries of duplicate detection, text repair, topics and labelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import resources as R
from tessella.functions import text as X
from tessella.operators import columns as C
from tessella.operators import dedupe as D
from tessella.operators import repair, topics
from tessella.operators.relations import connected_components
from tessella.plans.columns import sql_norm, sql_tokens
from tessella.plans.registry import query
from tessella.session import cut_lineage
from tessella.sources.tables import load, load_spread

NORM_URL = "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', ''), '[?#][\\s\\S]*$', ''), '/+$', ''))"
@query("dd_url_variant", f"SELECT url, min(url) OVER (PARTITION BY {NORM_URL}) AS first_url FROM (SELECT DISTINCT url FROM articles_v3)")
def dd_url_variant(spark, base):
    return D.address_edges(load(spark, base, "articles_v3", ["url"]).distinct()).select(F.col("a").alias("url"), F.col("b").alias("first_url"))


@query("dd_title_outlet", "WITH t AS (SELECT url, " + sql_norm("min(title)") + " AS t, lower(trim(min(outlet))) AS o FROM articles_v3 GROUP BY url) SELECT url, min(url) OVER (PARTITION BY t, o) AS first_url FROM t WHERE length(t) > 15 AND o IS NOT NULL")
def dd_title_outlet(spark, base):
    rows = load(spark, base, "articles_v3", ["url", "title", "outlet"]).groupBy("url").agg(F.min("title").alias("title"), F.min("outlet").alias("outlet"))
    return D.title_edges(rows).select(F.col("a").alias("url"), F.col("b").alias("first_url"))


@query("dd_syndication", f"WITH k AS (SELECT DISTINCT url, {sql_norm('title')} AS t, lower(trim(outlet)) AS o FROM articles_v3) SELECT DISTINCT url FROM k WHERE length(t) > 15 AND t IN (SELECT t FROM k WHERE length(t) > 15 GROUP BY t HAVING count(DISTINCT o) > 1)")
def dd_syndication(spark, base):
    return D.syndicated(load(spark, base, "articles_v3", ["url", "title", "outlet"]))


COMPONENTS = """WITH RECURSIVE t AS MATERIALIZED (SELECT url, """ + NORM_URL + """ AS nu, """ + sql_norm("min(title)") + """ AS t, lower(trim(min(outlet))) AS o FROM articles_v3 GROUP BY url), e AS MATERIALIZED (
SELECT url AS a, min(url) OVER (PARTITION BY nu) AS b FROM t UNION SELECT url, min(url) OVER (PARTITION BY t, o) FROM t WHERE length(t) > 15 AND o IS NOT NULL), g AS MATERIALIZED (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
w AS (SELECT a AS id, a AS seen FROM e UNION SELECT w.id, g.b FROM w JOIN g ON w.seen = g.a), c AS (SELECT id AS url, min(seen) AS cluster_id FROM w GROUP BY id)"""


@query("dd_components", f"{COMPONENTS} SELECT url, cluster_id FROM c")
def dd_components(spark, base):
    rows = load(spark, base, "articles_v3", ["url", "title", "outlet"]).groupBy("url").agg(F.min("title").alias("title"), F.min("outlet").alias("outlet"))
    found = connected_components(D.address_edges(rows).union(D.title_edges(rows)))
    return found.select(F.col("id").alias("url"), F.col("component").alias("cluster_id"))


@query("dd_prefetch", f"{COMPONENTS} SELECT c.url, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY length(t.t) DESC, c.url) = 1 AS is_representative FROM c JOIN t ON c.url = t.url")
def dd_prefetch(spark, base):
    return D.prefetch_clusters(load(spark, base, "articles_v3", ["url", "title", "outlet"]))


BODIES = f"b AS MATERIALIZED (SELECT url AS id, {sql_norm('min(article_text)', True)} AS norm FROM labeled_articles WHERE length(article_text) > 200 GROUP BY url)"


@query("dd_exact", f"WITH {BODIES} SELECT id, min(id) OVER (PARTITION BY norm) AS rep FROM b")
def dd_exact(spark, base):
    return D.bodies(load_spread(spark, base, "labeled_articles", ["url", "article_text"]), "url", "article_text").select("id", "rep")


SHINGLE_SETS = f"""{BODIES}, u AS MATERIALIZED (SELECT id, norm FROM (SELECT id, norm, min(id) OVER (PARTITION BY norm) AS rep FROM b) WHERE id = rep), w AS (SELECT id, string_split(norm, ' ') AS w FROM u),
s AS MATERIALIZED (SELECT id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE list_distinct(w) END AS sh FROM w), x AS MATERIALIZED (SELECT id, len(sh) AS n, unnest(sh) AS s FROM s)"""
PAIRS = "p AS MATERIALIZED (SELECT a.id AS a, b.id AS b, count(*) / (max(a.n) + max(b.n) - count(*)) AS similarity FROM x a JOIN x b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)"


@query("dd_jaccard_pairs", f"WITH {SHINGLE_SETS}, {PAIRS} SELECT a, b, similarity FROM p WHERE similarity >= 0.8")
def dd_jaccard_pairs(spark, base):
    """Pairs of class representatives: equal bodies are one class, given by dd_exact."""
    units = D.distinct_bodies(load_spread(spark, base, "labeled_articles", ["url", "article_text"]), "url", "article_text")
    return D.similar_pairs(units)


@query("join_self_jaccard", f"WITH {SHINGLE_SETS}, {PAIRS} SELECT a, b, similarity FROM p WHERE similarity >= 0.5")
def join_self_jaccard(spark, base):
    units = D.distinct_bodies(load_spread(spark, base, "labeled_articles", ["url", "article_text"]), "url", "article_text")
    return D.similar_pairs(units, 0.5)


@query("dd_near_components", f"""WITH RECURSIVE {SHINGLE_SETS}, {PAIRS}, e AS MATERIALIZED (SELECT a, b FROM p WHERE similarity >= 0.8 UNION SELECT id, rep FROM (SELECT id, min(id) OVER (PARTITION BY norm) AS rep FROM b)),
g AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), walk AS (SELECT a AS id, a AS seen FROM g UNION SELECT walk.id, g.b FROM walk JOIN g ON walk.seen = g.a) SELECT id, min(seen) AS cluster_id FROM walk GROUP BY id""")
def dd_near_components(spark, base):
    return D.near_clusters(load_spread(spark, base, "labeled_articles", ["url", "article_text"]), "url", "article_text")


THRESHOLDS = SHINGLE_SETS.replace("labeled_articles", "deduped_articles")


def _walk(name: str, edges: str) -> str:
    return f"{name}g AS MATERIALIZED (SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges})), {name} AS (SELECT a AS id, a AS seen FROM {name}g UNION SELECT {name}.id, {name}g.b FROM {name} JOIN {name}g ON {name}.seen = {name}g.a)"


COPIES = "SELECT id AS a, min(id) OVER (PARTITION BY norm) AS b FROM b"


@query("dd_threshold_table", f"""WITH RECURSIVE {THRESHOLDS}, {PAIRS}, {_walk("t9", COPIES + " UNION ALL SELECT a, b FROM p WHERE similarity >= 0.9")}, {_walk("t8", COPIES + " UNION ALL SELECT a, b FROM p WHERE similarity >= 0.8")},
c AS (SELECT 1.0 AS threshold, id, min(id) OVER (PARTITION BY norm) AS component FROM b UNION ALL SELECT 0.9, id, min(seen) FROM t9 GROUP BY id UNION ALL SELECT 0.8, id, min(seen) FROM t8 GROUP BY id)
SELECT CAST(threshold AS DOUBLE) AS threshold, count(DISTINCT component) AS unique_bodies, count(*) - count(DISTINCT component) AS removed FROM c GROUP BY threshold""")
def dd_threshold_table(spark, base):
    return D.threshold_table(load_spread(spark, base, "deduped_articles", ["url", "article_text"]), "url", "article_text")


GUARD = f"""WITH l AS (SELECT url, min(article_type) AS article_type, min(stance) AS stance, min(evaluative_language) AS words, min(article_text) AS article_text FROM labeled_articles GROUP BY url),
m AS MATERIALIZED (SELECT DISTINCT cluster_id, d.url, coalesce(article_type IN ('opinion_editorial', 'feature_analysis', 'Opinion/Editorial', 'Analysis'), FALSE) AS opinion, lower(trim(coalesce(stance, ''))) AS stance,
coalesce(list_distinct(list_transform(words, lambda w: lower(trim(w)))), []) AS words, string_split({sql_norm("article_text", True)}, ' ') AS w FROM dedupe_map d JOIN l ON d.url = l.url),
z AS MATERIALIZED (SELECT cluster_id, count(*) AS size, count(*) FILTER (WHERE NOT opinion) AS news FROM m GROUP BY 1 HAVING count(*) > 1), r AS MATERIALIZED (SELECT m.*, size, news FROM m JOIN z ON m.cluster_id = z.cluster_id),
v AS (SELECT a.cluster_id, a.url, b.stance, count(*) AS n FROM r a JOIN r b ON a.cluster_id = b.cluster_id AND a.url <> b.url WHERE b.stance <> '' GROUP BY 1, 2, 3), j AS (SELECT cluster_id, url, arg_min(stance, (-n, stance)) AS majority FROM v GROUP BY 1, 2),
q AS (SELECT cluster_id, url, size, unnest(words) AS word FROM r), k AS (SELECT cluster_id, word, count(*) AS k FROM q GROUP BY 1, 2), u AS (SELECT q.cluster_id, q.url, count(*) AS n FROM q JOIN k ON q.cluster_id = k.cluster_id AND q.word = k.word WHERE k.k < q.size GROUP BY 1, 2),
s AS (SELECT cluster_id, url, size, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE list_distinct(w) END) AS sh FROM r), h AS (SELECT cluster_id, sh, count(*) AS k FROM s GROUP BY 1, 2),
o AS (SELECT s.cluster_id, s.url, avg(CASE WHEN h.k < s.size THEN 1.0 ELSE 0.0 END) AS outside FROM s JOIN h ON s.cluster_id = h.cluster_id AND s.sh = h.sh GROUP BY 1, 2)
SELECT r.cluster_id, r.url, list_filter([CASE WHEN opinion AND news > 0 THEN 'opinion_overlay' END, CASE WHEN stance NOT IN ('', 'not_applicable') AND majority IS NOT NULL AND stance <> majority THEN 'stance_differs(' || stance || '_vs_' || majority || ')' END,
CASE WHEN coalesce(u.n, 0) >= 2 THEN 'added_evaluative_language(' || u.n || ')' END, CASE WHEN outside >= 0.35 THEN 'unique_text' END], lambda x: x IS NOT NULL) AS reasons FROM r LEFT JOIN j ON r.cluster_id = j.cluster_id AND r.url = j.url LEFT JOIN u ON r.cluster_id = u.cluster_id AND r.url = u.url LEFT JOIN o ON r.cluster_id = o.cluster_id AND r.url = o.url"""


@query("dd_editorial_guard", GUARD)
def dd_editorial_guard(spark, base):
    labelled = load_spread(spark, base, "labeled_articles", ["url", "article_type", "stance", "evaluative_language", "article_text"])
    mapped = load(spark, base, "dedupe_map", ["cluster_id", "url"]).distinct().join(labelled.select("url"), "url", "left_semi")
    # texts are read for clusters of two or more only
    several = cut_lineage(mapped.join(mapped.groupBy("cluster_id").count().where("count > 1"), "cluster_id", "left_semi"))
    rows = labelled.join(several, "url", "left_semi").groupBy("url").agg(*[F.min(c).alias(c) for c in labelled.columns[1:]])
    words = F.transform("evaluative_language", lambda w: F.lower(F.trim(w)))
    members = several.join(rows, "url").select("cluster_id", "url", "article_type", "stance", F.array_distinct(words).alias("words"), X.norm_body(F.col("article_text")).alias("norm"))
    return D.editorial_splits(members)


@query("dd_representative", """WITH m AS (SELECT DISTINCT cluster_id, url FROM dedupe_map), l AS (SELECT url, max(length(coalesce(article_text, ''))) AS chars FROM labeled_articles GROUP BY url), j AS (SELECT cluster_id, m.url, chars FROM m JOIN l ON m.url = l.url)
SELECT cluster_id, arg_min(url, (-chars, url)) AS url, count(*) AS dup_count, string_agg(url, ' ; ' ORDER BY url) AS dup_urls FROM j GROUP BY cluster_id""")
def dd_representative(spark, base):
    return D.representatives(load(spark, base, "dedupe_map", ["cluster_id", "url"]), load_spread(spark, base, "labeled_articles", ["url", "article_text"]))


@query("dd_minhash_lsh")
def dd_minhash_lsh(spark, base):
    units = D.distinct_bodies(load_spread(spark, base, "labeled_articles", ["url", "article_text"]), "url", "article_text")
    return topics.minhash_pairs(units)


@query("fn_repair_rot47", """SELECT url, substring(md5(url), 1, 1) IN ('0', '1', '2', '3') AS changed, md5(min(article_text)) AS digest FROM labeled_articles WHERE article_text IS NOT NULL GROUP BY url""")
def fn_repair_rot47(spark, base):
    """Every fourth of the bodies is turned first, so that there is something to repair: all come back as they were."""
    df = load_spread(spark, base, "labeled_articles", ["url", "article_text"]).where("article_text is not null").groupBy("url").agg(F.min("article_text").alias("article_text"))
    turned = F.when(F.substring(F.md5("url"), 1, 1).isin("0", "1", "2", "3"), X.rot47(F.concat(F.lit("<p>"), "article_text", F.lit("</p>")))).otherwise(F.col("article_text"))
    return repair.repaired(df.select("url", turned.alias("body")), "url", "body").select("url", "changed", F.md5("repaired").alias("digest"))


@query("fn_fix_mojibake")
def fn_fix_mojibake(spark, base):
    df = load_spread(spark, base, "labeled_articles", ["url", "article_text"]).where("article_text is not null").dropDuplicates(["url"])
    return df.select("url", F.md5(repair.fix_mojibake(F.col("article_text"))).alias("digest"))


DETECT = "s(lang, word) AS (VALUES " + ", ".join(f"('{c}', '{w}')" for c in sorted(R.STOP_WORDS) for w in sorted(set(R.STOP_WORDS[c].split()))) + ")"


_SHARES = ", ".join(f"length(regexp_replace(t, '[^{signs}]', '', 'g')) / l AS s_{code}" for code, signs in topics.SCRIPTS.items())


@query("fn_detect_lang", f"""WITH {DETECT}, h AS (SELECT doc_id, t, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS l FROM (SELECT doc_id, substring(coalesce(text, ''), 1, 700) AS t FROM documents)), p AS (SELECT doc_id, t, l, {_SHARES} FROM h WHERE l > 0),
t AS (SELECT doc_id, unnest({sql_tokens('t')}) AS w FROM p), c AS (SELECT doc_id, lang, count(*) AS n FROM t JOIN s ON w = word GROUP BY 1, 2), b AS (SELECT doc_id, arg_min(lang, (-n, lang)) AS voted FROM c GROUP BY 1)
SELECT d.doc_id, CASE WHEN s_ja + s_zh > 0.5 AND s_ja > 0.1 THEN 'ja' WHEN s_ja + s_zh > 0.5 THEN 'zh' WHEN s_ar > 0.5 THEN 'ar' WHEN s_hi > 0.5 THEN 'hi' WHEN s_ru > 0.5 THEN 'ru' ELSE voted END AS detected FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN b ON d.doc_id = b.doc_id""")
def fn_detect_lang(spark, base):
    return load_spread(spark, base, "documents", ["doc_id", "text"]).select("doc_id", topics.stop_word_language(F.col("text")).alias("detected"))


@query("tx_lda")
def tx_lda(spark, base):
    df = load_spread(spark, base, "labeled_articles", ["url", "language", "article_text", "fetch_status", "text_chars"]).where(C.usable(F.col("fetch_status"), F.col("article_text"))).dropDuplicates(["url"])
    docs = df.withColumn("lang", topics.stop_word_language(F.col("article_text"))).where("lang is not null and text_chars >= 800")
    return topics.topics_by_language(docs, key="url", lang="lang", text="article_text", least_documents=30)


@query("tx_top_words")
def tx_top_words(spark, base):
    df = load_spread(spark, base, "labeled_articles", ["url", "article_text", "text_chars"]).where("article_text is not null and text_chars >= 800").dropDuplicates(["url"])
    docs = df.withColumn("lang", topics.stop_word_language(F.col("article_text"))).where("lang is not null")
    return topics.top_words_by_language(docs, lang="lang", text="article_text", least_documents=30)


@query("llm_label")
def llm_label(spark, base):
    from tessella.sources.web import label_rows

    df = load_spread(spark, base, "labeled_articles", ["url", "article_text"]).where("article_text is not null").dropDuplicates(["url"])
    return label_rows(df, "url", "article_text")


RULES = "(VALUES (1, 'en', 'tribunal', 'Hearings'), (2, 'en', 'staff', 'Staff matters'), (3, 'en', 'letter', 'Staff matters'), (4, 'fr', 'tribunal', 'Audiences'), (5, 'en', 'hotel', 'DROP  (hotels)')) AS r(rule, lang, word, name)"


@query("fn_suggest_name", f"""WITH t AS (SELECT doc_id, lang, {sql_norm('title')} AS t FROM documents WHERE lang IN ('en', 'fr')), h AS (SELECT doc_id, name, min(rule) AS rule, count(*) AS hits FROM t JOIN {RULES} ON t.lang = r.lang AND contains(t.t, r.word) GROUP BY 1, 2)
SELECT doc_id, name FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, rule) = 1""")
def fn_suggest_name(spark, base):
    titles = load(spark, base, "documents", ["doc_id", "lang", "title"]).where("lang in ('en', 'fr')")
    return topics.suggested_names(titles.select("doc_id", "lang", X.norm_title(F.col("title")).alias("words")), key="doc_id")


@query("tx_name_template", f"""WITH w AS (SELECT lang, CAST(doc_id % 8 + 1 AS INT) AS topic, unnest(string_split({sql_norm('title')}, ' ')) AS word FROM documents WHERE lang IN ('en', 'fr')), c AS (SELECT lang, topic, word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2, 3),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, topic ORDER BY n DESC, word) <= 15), t AS (SELECT lang, topic, string_agg(word, ' ' ORDER BY n DESC, word) AS top_words FROM k GROUP BY 1, 2),
h AS (SELECT t.lang, topic, name, min(rule) AS rule, count(*) AS hits FROM t JOIN {RULES} ON t.lang = r.lang AND contains(t.top_words, r.word) GROUP BY 1, 2, 3), s AS (SELECT lang, topic, name FROM h QUALIFY row_number() OVER (PARTITION BY lang, topic ORDER BY hits DESC, rule) = 1)
SELECT t.lang, t.topic, top_words, coalesce(s.name, '') AS suggested_name, '' AS your_name FROM t LEFT JOIN s ON t.lang = s.lang AND t.topic = s.topic""")
def tx_name_template(spark, base):
    """Over the titles of all documents: the 15 most frequent words of each language and topic."""
    df = load(spark, base, "documents", ["doc_id", "lang", "title"]).where("lang in ('en', 'fr')")
    titles = df.select("lang", (F.col("doc_id") % 8 + 1).cast("int").alias("topic"), X.norm_title(F.col("title")).alias("words"))
    return topics.name_template(topics.most_frequent_words(titles))


@query("join_topic_names", f"WITH t AS (SELECT doc_id, CAST(doc_id % 8 + 1 AS INT) AS topic, lang FROM documents WHERE lang IS NOT NULL), n(lang, topic, your_name, suggested) AS (VALUES ('en', 1, 'Courts', 'x'), ('en', 2, NULL, 'Staff matters'), ('fr', 1, NULL, 'DROP  (noise)')) SELECT doc_id, coalesce(your_name, suggested, 'Topic ' || t.topic) AS name FROM t LEFT JOIN n ON t.lang = n.lang AND t.topic = n.topic")
def join_topic_names(spark, base):
    docs = load(spark, base, "documents", ["doc_id", "lang"]).where("lang is not null").withColumn("topic", (F.col("doc_id") % 8 + 1).cast("int"))
    return topics.named_topics(docs, _names(spark)).select("doc_id", "name")


def _names(spark):
    return spark.createDataFrame([("en", 1, "Courts", "x"), ("en", 2, None, "Staff matters"), ("fr", 1, None, "DROP  (noise)")], "lang string, topic int, your_name string, suggested string")


@query("proj_topic_drop", "WITH t AS (SELECT doc_id, CAST(doc_id % 8 + 1 AS INT) AS topic, lang FROM documents WHERE lang IS NOT NULL) SELECT doc_id FROM t WHERE NOT (lang = 'fr' AND topic = 1)")
def proj_topic_drop(spark, base):
    docs = load(spark, base, "documents", ["doc_id", "lang"]).where("lang is not null").withColumn("topic", (F.col("doc_id") % 8 + 1).cast("int"))
    named = topics.named_topics(docs, _names(spark))
    return named.where(~F.col("name").startswith("DROP")).select("doc_id")


@query("agg_topic_mix", "WITH d AS (SELECT source_country AS country, [n_chars % 7 / 7.0, 1 - n_chars % 7 / 7.0] AS w FROM documents WHERE source_country IS NOT NULL) SELECT country, count(*) AS n, avg(w[1]) AS topic_1, avg(w[2]) AS topic_2 FROM d GROUP BY 1 HAVING count(*) >= 10")
def agg_topic_mix(spark, base):
    df = load(spark, base, "documents", ["source_country", "n_chars"]).where("source_country is not null")
    part = (F.col("n_chars") % 7) / F.lit(7.0)
    weighted = df.select(F.col("source_country").alias("country"), F.array(part, 1 - part).alias("w"))
    return topics.topic_mix(weighted, "country", "w", 2, 10)
