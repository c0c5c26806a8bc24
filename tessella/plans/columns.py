"""Queries of sources, filters, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import resources as R
from tessella.functions import text as X
from tessella.functions.stats import wilson
from tessella.operators import columns as C
from tessella.plans.registry import query
from tessella.sources import tables as S


def quoted(words) -> str:
    return ", ".join("'" + str(w).replace("'", "''") + "'" for w in words)


def sql_accents(expression: str) -> str:
    made = f"translate(regexp_replace({expression}, '{X.MARKS}', '', 'g'), '{X.ACCENTED.replace(chr(39), chr(39) * 2)}', '{X.PLAIN.replace(chr(39), chr(39) * 2)}')"
    for sign, letters in X.LIGATURES:
        made = f"replace({made}, '{sign}', '{letters}')"
    return made


def sql_norm(expression: str, addresses: bool = False) -> str:
    plain = f"lower({sql_accents(f'coalesce({expression}, {chr(39)}{chr(39)})')})"
    if addresses:
        plain = f"regexp_replace({plain}, 'https?://\\S+', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def sql_lower(expression: str) -> str:
    """Lower case with the full mapping of the dotted capital I, which DuckDB shortens."""
    return f"lower(replace({expression}, chr(304), 'i' || chr(775)))"


def sql_tokens(expression: str) -> str:
    return f"list_filter(regexp_extract_all({sql_lower(f'coalesce({expression}, {chr(39)}{chr(39)})')}, '([\\p{{L}}\\p{{Nl}}\\p{{No}}]+)'), lambda w: length(w) >= 2)"


USABLE = f"fetch_status IN ({quoted(R.USABLE_STATUS)}) AND article_text IS NOT NULL"


@query("src_partition_scan", "SELECT url, published FROM articles_v3 WHERE published >= TIMESTAMP '2018-01-01' AND published < TIMESTAMP '2018-07-01'")
def src_partition_scan(spark, base):
    return S.scan_between(S.load(spark, base, "articles_v3", ["url", "published"]), "published", "2018-01-01 00:00:00", "2018-07-01 00:00:00")


@query("src_chunked_projection", f"SELECT url, outlet, text_chars FROM labeled_articles WHERE {USABLE}")
def src_chunked_projection(spark, base):
    df = S.load(spark, base, "labeled_articles")
    return S.usable_projection(df, ["url", "outlet", "text_chars"], C.usable(F.col("fetch_status"), F.col("article_text")))


@query("src_schema_tolerant", "SELECT doc_id, title, 'UNKNOWN' AS outlet, source_country FROM documents")
def src_schema_tolerant(spark, base):
    return S.tolerant(S.load(spark, base, "documents"), ["doc_id", "title", "outlet", "source_country"], {"outlet": R.UNKNOWN, "source_country": R.UNKNOWN})


@query("src_fallback", "SELECT cluster_id, url, dup_count FROM deduped_articles")
def src_fallback(spark, base):
    return S.first_available(spark, base, ["deduped_articles_v0", "deduped_articles", "labeled_articles"]).select("cluster_id", "url", "dup_count")


@query("src_xml_tag_title", "SELECT url, regexp_extract('<X><PAGE_TITLE>' || title || '</PAGE_TITLE><PAGE_TITLE>b</PAGE_TITLE></X>', '<PAGE_TITLE>(.+?)</PAGE_TITLE>', 1) AS page_title FROM articles_v3 WHERE title IS NOT NULL")
def src_xml_tag_title(spark, base):
    df = S.load(spark, base, "articles_v3", ["url", "title"]).where("title is not null")
    extras = F.concat(F.lit("<X><PAGE_TITLE>"), "title", F.lit("</PAGE_TITLE><PAGE_TITLE>b</PAGE_TITLE></X>"))
    return df.select("url", F.regexp_extract(extras, "<PAGE_TITLE>(.+?)</PAGE_TITLE>", 1).alias("page_title"))


@query("geo_project", "SELECT n_nationkey, CAST(round_even((n_nationkey * 13.7 - 160 + 180) / 360 * 960, 0) AS INT) AS x, CAST(round_even((90 - (n_regionkey * 31.3 - 60)) / 180 * 440, 0) AS INT) AS y FROM nation")
def geo_project(spark, base):
    x, y = C.map_position(F.col("n_nationkey") * F.lit(13.7) - 160, F.col("n_regionkey") * F.lit(31.3) - 60)
    return S.load(spark, base, "nation").select("n_nationkey", x.alias("x"), y.alias("y"))


@query("filt_usable", f"SELECT url, fetch_status FROM labeled_articles WHERE {USABLE}")
def filt_usable(spark, base):
    return S.load(spark, base, "labeled_articles").where(C.usable(F.col("fetch_status"), F.col("article_text"))).select("url", "fetch_status")


@query("filt_min_chars", f"SELECT url, text_chars FROM labeled_articles WHERE text_chars >= {R.MIN_CHARS} AND length(article_text) > {R.MIN_COMPARABLE_CHARS}")
def filt_min_chars(spark, base):
    df = S.load(spark, base, "labeled_articles", ["url", "text_chars", "article_text"])
    return df.where((F.col("text_chars") >= R.MIN_CHARS) & (F.length("article_text") > R.MIN_COMPARABLE_CHARS)).select("url", "text_chars")


@query("filt_stale", f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(substring(text, 1, {R.STALE_PREFIX}), '(?:^|[^\\p{{L}}\\p{{N}}_]){R.STALE_YEARS}(?:[^\\p{{L}}\\p{{N}}_]|$)')")
def filt_stale(spark, base):
    return S.load(spark, base, "documents", ["doc_id", "text"]).where(F.col("text").isNotNull() & ~C.stale(F.col("text"))).select("doc_id")


@query("filt_unreadable", f"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN TRUE ELSE (length(substring(text, 1, 2000)) - length(translate(substring(text, 1, 2000), '{R.MOJIBAKE_SIGNS}', ''))) / length(substring(text, 1, 2000)) > {R.MOJIBAKE_SHARE} END AS unreadable FROM documents")
def filt_unreadable(spark, base):
    return S.load(spark, base, "documents", ["doc_id", "text"]).select("doc_id", C.unreadable(F.col("text")).alias("unreadable"))


@query("filt_junk", "SELECT url FROM labeled_articles WHERE article_text IS NOT NULL AND (" + " OR ".join(f"contains(lower(substring(article_text, 1, 1500)), '{p}')" for p in R.JUNK_PHRASES) + ")")
def filt_junk(spark, base):
    return S.load(spark, base, "labeled_articles", ["url", "article_text"]).where(F.col("article_text").isNotNull() & C.junk(F.col("article_text"))).select("url")


@query("filt_codebook_guard", f"SELECT kw_id, kw_match_lower FROM metoo_keywords_v3 WHERE trim(kw_match_lower) NOT IN ({quoted(R.CODEBOOK_NOTES)}) AND NOT regexp_full_match(kw_match, '\\(.*\\)')")
def filt_codebook_guard(spark, base):
    return S.load(spark, base, "metoo_keywords_v3").where(C.is_term(F.col("kw_match"), F.col("kw_match_lower"))).select("kw_id", "kw_match_lower")


@query("filt_lang_known", f"SELECT lang, count(*) AS docs FROM documents WHERE lang IN ({quoted(R.STOP_WORDS)}) GROUP BY lang HAVING count(*) >= 30")
def filt_lang_known(spark, base):
    df = S.load(spark, base, "documents", ["lang"]).where(F.col("lang").isin(*R.STOP_WORDS))
    return df.groupBy("lang").agg(F.count("*").alias("docs")).where("docs >= 30")


@query("proj_country_coalesce", "SELECT url, coalesce(source_country, 'UNKNOWN') AS country FROM articles_v3")
def proj_country_coalesce(spark, base):
    return S.load(spark, base, "articles_v3", ["url", "source_country"]).select("url", C.known_country(F.col("source_country")).alias("country"))


STANCE_CASE = "CASE WHEN n_support > 0 AND n_backlash > 0 THEN 'Mixed' WHEN n_backlash > 0 THEN 'Backlash' WHEN n_support > 0 THEN 'Support' ELSE 'Other' END"


@query("proj_article_stance", f"SELECT url, {STANCE_CASE} AS article_stance FROM articles_v3")
def proj_article_stance(spark, base):
    return S.load(spark, base, "articles_v3", ["url", "n_support", "n_backlash"]).select("url", C.article_stance(F.col("n_support"), F.col("n_backlash")).alias("article_stance"))


def _sql_pattern(p: str) -> str:
    return p.replace("(?iu)", "(?i)").replace("'", "''")


TYPE_CASE = (
    f"CASE WHEN regexp_matches(url, '{_sql_pattern(C.ANALYSIS_PATTERN)}') THEN 'Analysis' WHEN regexp_matches(url, '{_sql_pattern(C.OPINION_PATTERN)}') "
    f"OR regexp_matches(coalesce(title, ''), '{_sql_pattern(C.TITLE_PATTERNS[0])}') OR regexp_matches(coalesce(title, ''), '{_sql_pattern(C.TITLE_PATTERNS[1])}') "
    "THEN 'Opinion/Editorial' ELSE 'News/Reporting' END"
)


@query("proj_article_type", f"SELECT url, {TYPE_CASE} AS article_type FROM articles_v3")
def proj_article_type(spark, base):
    return S.load(spark, base, "articles_v3", ["url", "title"]).select("url", C.article_type(F.col("url"), F.col("title")).alias("article_type"))


SQL_KEYWORDS = "CASE WHEN keywords_matched IS NULL THEN [] ELSE list_transform(string_split(keywords_matched, ' | '), lambda k: trim(k)) END"
CLASS_CASE = (
    f"CASE WHEN len(list_filter({SQL_KEYWORDS}, lambda k: starts_with(k, '#'))) > 0 AND len(list_filter({SQL_KEYWORDS}, lambda k: NOT starts_with(k, '#'))) > 0 THEN 'both' "
    f"WHEN len(list_filter({SQL_KEYWORDS}, lambda k: starts_with(k, '#'))) > 0 THEN 'hashtag_only' WHEN len(list_filter({SQL_KEYWORDS}, lambda k: NOT starts_with(k, '#'))) > 0 THEN 'generic_only' ELSE 'none' END"
)


@query("proj_match_class", f"SELECT url, {CLASS_CASE} AS match_class FROM articles_v3")
def proj_match_class(spark, base):
    return S.load(spark, base, "articles_v3", ["url", "keywords_matched"]).select("url", C.match_class(X.kw_list(F.col("keywords_matched"))).alias("match_class"))


@query("proj_fetch_outcome", f"""SELECT count(*) FILTER (WHERE fetch_status IN ({quoted(R.USABLE_STATUS)})) AS downloaded, count(*) FILTER (WHERE fetch_status IN ({quoted(R.GONE_STATUS)})) AS gone,
count(*) FILTER (WHERE fetch_status IN ({quoted(R.BLOCKED_STATUS)})) AS blocked, count(*) FILTER (WHERE regexp_matches(fetch_status, '{R.NETWORK_PATTERN}')) AS network,
count(*) FILTER (WHERE fetch_status IN ({quoted(R.NO_TEXT_STATUS)})) AS no_text FROM labeled_articles""")
def proj_fetch_outcome(spark, base):
    return S.load(spark, base, "labeled_articles", ["fetch_status"]).agg(*[F.count_if(c).alias(n) for n, c in C.fetch_outcomes(F.col("fetch_status")).items()])


@query("proj_unresolved", "SELECT url, fetch_status FROM labeled_articles WHERE " + " OR ".join(f"starts_with(fetch_status, '{p}')" for p in R.UNRESOLVED_PREFIXES))
def proj_unresolved(spark, base):
    return S.load(spark, base, "labeled_articles", ["url", "fetch_status"]).where(C.unresolved(F.col("fetch_status")))


DIAGNOSIS = (
    "CASE WHEN fetch_status = 'OK' THEN CASE WHEN coalesce(text_chars, 0) < 400 THEN 'SHORT_browser' ELSE 'RECOVERED_browser' END "
    "WHEN fetch_status = 'OK_WAYBACK' THEN CASE WHEN coalesce(text_chars, 0) < 400 THEN 'WAYBACK_THIN' ELSE 'RECOVERED_wayback' END "
    f"WHEN fetch_status IN ({quoted(R.NO_TEXT_STATUS)}) THEN 'NO_TEXT_browser' ELSE 'DEAD_no_archive' END"
)


@query("proj_fetch_diag", f"SELECT coalesce(source_country, 'UNKNOWN') AS country, count(*) AS tried, avg(CASE WHEN starts_with({DIAGNOSIS}, 'RECOVERED') THEN 1.0 ELSE 0.0 END) AS recovered FROM labeled_articles GROUP BY 1 HAVING count(*) >= 8")
def proj_fetch_diag(spark, base):
    df = S.load(spark, base, "labeled_articles", ["source_country", "fetch_status", "text_chars"])
    won = C.diagnosis(F.col("fetch_status"), F.col("text_chars")).startswith("RECOVERED")
    return df.groupBy(C.known_country(F.col("source_country")).alias("country")).agg(F.count("*").alias("tried"), F.avg(won.cast("double")).alias("recovered")).where("tried >= 8")


@query("proj_error_class", "SELECT url, CASE WHEN contains(lower(fetch_status), '429') THEN '429' WHEN contains(lower(fetch_status), '403') THEN '403' WHEN contains(lower(fetch_status), 'timeout') THEN 'timeout' ELSE 'other' END AS error_class FROM labeled_articles WHERE fetch_status LIKE '%:%'")
def proj_error_class(spark, base):
    df = S.load(spark, base, "labeled_articles", ["url", "fetch_status"]).where(F.col("fetch_status").contains(":"))
    return df.select("url", C.error_class(F.col("fetch_status")).alias("error_class"))


@query("proj_dates", "SELECT url, strftime(published, '%Y-%m') AS month, CAST(year(published) AS INT) AS year, CAST(published AS DATE) AS day, CAST(try_cast(split_part(url, '/', 5) || '-01-01' AS DATE) AS DATE) AS parsed FROM articles_v3")
def proj_dates(spark, base):
    df = S.load(spark, base, "articles_v3", ["url", "published"])
    part = F.element_at(F.split("url", "/"), 5)
    parsed = F.when(part.rlike("^[0-9]{4}$"), F.try_to_date(F.concat(part, F.lit("-01-01")), "yyyy-MM-dd"))
    return df.select("url", F.date_format("published", "yyyy-MM").alias("month"), F.year("published").alias("year"), F.to_date("published").alias("day"), parsed.alias("parsed"))


@query("proj_vanity_tld", """SELECT source_country AS country, right(lower(trim(outlet)), 8) AS tld, count(*) AS articles, avg(CASE WHEN ends_with(lower(trim(outlet)), '.example') THEN 1.0 ELSE 0.0 END) AS share
FROM articles_v3 WHERE source_country <> 'UNKNOWN' AND outlet IS NOT NULL GROUP BY 1, 2 HAVING avg(CASE WHEN ends_with(lower(trim(outlet)), '.example') THEN 1.0 ELSE 0.0 END) > 0.5""")
def proj_vanity_tld(spark, base):
    df = S.load(spark, base, "articles_v3", ["source_country", "outlet"]).where("source_country <> 'UNKNOWN' and outlet is not null")
    name = F.lower(F.trim("outlet"))
    flag = F.avg(name.endswith(".example").cast("double"))
    return df.groupBy(F.col("source_country").alias("country"), F.right(name, F.lit(8)).alias("tld")).agg(F.count("*").alias("articles"), flag.alias("share")).where("share > 0.5")


@query("fn_norm_url", "SELECT url, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', ''), '[?#][\\s\\S]*$', ''), '/+$', '')) AS norm FROM articles_v3")
def fn_norm_url(spark, base):
    return S.load(spark, base, "articles_v3", ["url"]).select("url", X.norm_url(F.col("url")).alias("norm"))


@query("fn_norm_title", f"SELECT url, {sql_norm('title')} AS norm FROM articles_v3")
def fn_norm_title(spark, base):
    return S.load(spark, base, "articles_v3", ["url", "title"]).select("url", X.norm_title(F.col("title")).alias("norm"))


@query("fn_norm_body", f"SELECT doc_id, md5({sql_norm('text', True)}) AS norm FROM documents")
def fn_norm_body(spark, base):
    return S.load(spark, base, "documents", ["doc_id", "text"]).select("doc_id", F.md5(X.norm_body(F.col("text"))).alias("norm"))


EVENT_NORM = f"regexp_replace(lower({sql_accents('coalesce(article_text, ' + chr(39) + chr(39) + ')')}), '[^\\p{{L}}\\p{{N}}_\\s#]', ' ', 'g')"


@query("fn_norm_event", f"SELECT url, md5({EVENT_NORM}) AS norm FROM labeled_articles")
def fn_norm_event(spark, base):
    return S.load(spark, base, "labeled_articles", ["url", "article_text"]).select("url", F.md5(X.norm_event(F.col("article_text"))).alias("norm"))


def _unescape_sql(column: str) -> str:
    names = ", ".join(f"'{n}': '{c.replace(chr(39), chr(39) * 2)}'" for n, c in X.NAMED_ENTITIES.items())
    controls = ", ".join(f"{n}: '{c}'" for n, c in X.CONTROL_ENTITIES.items())
    code = "CASE WHEN lower(p[3:3]) = 'x' THEN CAST('0x' || p[4:-2] AS BIGINT) ELSE CAST(p[3:-2] AS BIGINT) END"
    sign = f"CASE WHEN {code} = 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343 THEN chr(65533) ELSE coalesce(MAP {{{controls}}}[{code}], chr(CAST({code} AS INT))) END"
    piece = f"CASE WHEN NOT starts_with(p, '&') OR length(p) < 3 THEN p WHEN starts_with(p, '&#') THEN {sign} ELSE coalesce((SELECT m[p[2:-2]] FROM names), p) END"
    return f"WITH names AS (SELECT MAP {{{names}}} AS m), q AS (SELECT row_number() OVER () AS i, url, {column} FROM articles_v3 WHERE {column} IS NOT NULL), w AS (SELECT i, unnest(regexp_extract_all({column}, '{X.ENTITY_PIECES}')) AS p, unnest(range(len(regexp_extract_all({column}, '{X.ENTITY_PIECES}')))) AS n FROM q), j AS (SELECT i, string_agg({piece}, '' ORDER BY n) AS plain FROM w GROUP BY i) SELECT url, regexp_matches({column}, '&#?[0-9A-Za-z]{{1,8}};') AS encoded, coalesce(plain, '') AS plain FROM q LEFT JOIN j USING (i)"


@query("fn_html_unescape", _unescape_sql("title"))
def fn_html_unescape(spark, base):
    df = S.load(spark, base, "articles_v3", ["url", "title"]).where("title is not null")
    return df.select("url", F.col("title").rlike(X.ENTITY).alias("encoded"), X.html_unescape(F.col("title")).alias("plain"))


@query("fn_boundary_match", "SELECT url, regexp_matches(lower(title), '(?:^|[^\\p{L}\\p{N}_])staff(?:[^\\p{L}\\p{N}_]|$)') AS hit FROM articles_v3 WHERE title IS NOT NULL")
def fn_boundary_match(spark, base):
    df = S.load(spark, base, "articles_v3", ["url", "title"]).where("title is not null")
    return df.select("url", X.bounded_contains(F.lower("title"), F.lit("staff")).alias("hit"))


@query("fn_tokenize", f"SELECT doc_id, len({sql_tokens('text')}) AS n, md5(array_to_string({sql_tokens('text')}, ' ')) AS digest FROM documents")
def fn_tokenize(spark, base):
    df = S.load(spark, base, "documents", ["doc_id", "text"]).select("doc_id", X.tokens(F.col("text")).alias("t"))
    return df.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("fn_tokenize3", "SELECT doc_id, md5(array_to_string(list_filter(regexp_extract_all(lower(replace(coalesce(text, ''), chr(304), 'i' || chr(775))), '([\\p{L}\\p{N}_]+)'), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '[\\p{Nd}_]')), ' ')) AS digest FROM documents")
def fn_tokenize3(spark, base):
    return S.load(spark, base, "documents", ["doc_id", "text"]).select("doc_id", F.md5(F.array_join(X.tokens3(F.col("text")), " ")).alias("digest"))


SHINGLES = ("(SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE list_distinct(w) END AS s "
            f"FROM (SELECT doc_id, string_split({sql_norm('title')}, ' ') AS w FROM documents))")


@query("fn_shingles", f"SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS digest FROM {SHINGLES}")
def fn_shingles(spark, base):
    df = S.load(spark, base, "documents", ["doc_id", "title"]).select("doc_id", X.shingles(X.norm_title(F.col("title"))).alias("s"))
    return df.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join(F.array_sort("s"), "|")).alias("digest"))


@query("fn_jaccard", f"""WITH t AS (SELECT url, CASE WHEN {sql_norm('title')} = '' THEN [] ELSE list_distinct(string_split({sql_norm('title')}, ' ')) END AS a, CASE WHEN {sql_norm('fetched_title')} = '' THEN [] ELSE list_distinct(string_split({sql_norm('fetched_title')}, ' ')) END AS b FROM labeled_articles)
SELECT url, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END AS similarity FROM t""")
def fn_jaccard(spark, base):
    def words(c):
        return F.filter(F.array_distinct(F.split(X.norm_title(F.col(c)), " ")), lambda w: w != "")

    df = S.load(spark, base, "labeled_articles", ["url", "title", "fetched_title"]).select("url", words("title").alias("a"), words("fetched_title").alias("b"))
    return df.select("url", X.jaccard(F.col("a"), F.col("b")).alias("similarity"))


SENTENCES = "string_split(regexp_replace(coalesce(text, ''), '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query("fn_sentence_split", f"SELECT doc_id, len({SENTENCES}) AS n, md5(array_to_string({SENTENCES}, '|')) AS digest FROM documents")
def fn_sentence_split(spark, base):
    df = S.load(spark, base, "documents", ["doc_id", "text"]).select("doc_id", X.sentences(F.coalesce("text", F.lit(""))).alias("s"))
    return df.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("fn_alpha_share", "SELECT doc_id, CASE WHEN length(regexp_replace(substring(coalesce(text, ''), 1, 1200), '\\s', '', 'g')) > 0 THEN length(regexp_replace(substring(text, 1, 1200), '[^\\p{L}]', '', 'g')) / length(regexp_replace(substring(text, 1, 1200), '\\s', '', 'g')) ELSE 0.0 END AS share FROM documents")
def fn_alpha_share(spark, base):
    return S.load(spark, base, "documents", ["doc_id", "text"]).select("doc_id", X.alpha_share(F.col("text")).alias("share"))


@query("fn_rot47", f"SELECT url, translate(title, '{X._ROT47_FROM.replace(chr(39), chr(39) * 2)}', '{X._ROT47_TO.replace(chr(39), chr(39) * 2)}') AS turned FROM articles_v3")
def fn_rot47(spark, base):
    return S.load(spark, base, "articles_v3", ["url", "title"]).select("url", X.rot47(F.col("title")).alias("turned"))


@query("fn_kw_list", f"SELECT url, {SQL_KEYWORDS} AS keywords FROM articles_v3")
def fn_kw_list(spark, base):
    return S.load(spark, base, "articles_v3", ["url", "keywords_matched"]).select("url", X.kw_list(F.col("keywords_matched")).alias("keywords"))


@query("fn_json_list", "SELECT url, coalesce(list_sort(list_distinct(list_transform(evaluative_language, lambda x: lower(trim(x))))), []) AS words FROM labeled_articles")
def fn_json_list(spark, base):
    df = S.load(spark, base, "labeled_articles", ["url", "evaluative_language"])
    return df.select("url", F.array_sort(X.json_list(F.to_json("evaluative_language"))).alias("words"))


GROUP_CASE = "CASE " + " ".join(f"WHEN source_country IN ({quoted(c)}) THEN '{g}'" for g, c in R.LANGUAGE_GROUPS.items()) + " END"


@query("fn_language_group", f"SELECT url, {GROUP_CASE} AS language_group FROM articles_v3")
def fn_language_group(spark, base):
    return S.load(spark, base, "articles_v3", ["url", "source_country"]).select("url", C.language_group(F.col("source_country")).alias("language_group"))


@query("fn_truncate", "SELECT doc_id, md5(substring(coalesce(text, ''), 1, 700)) AS head FROM documents")
def fn_truncate(spark, base):
    return S.load(spark, base, "documents", ["doc_id", "text"]).select("doc_id", F.md5(F.substring(F.coalesce("text", F.lit("")), 1, 700)).alias("head"))


WILSON = ("CASE WHEN n > 0 THEN greatest(0.0, round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 12)) ELSE 0.0 END AS low, "
          "CASE WHEN n > 0 THEN least(1.0, round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 12)) ELSE 0.0 END AS high")


@query("stat_wilson", f"WITH c AS (SELECT coalesce(source_country, 'UNKNOWN') AS country, CAST(count(*) FILTER (WHERE is_about_movement) AS DOUBLE) AS k, CAST(count(is_about_movement) AS DOUBLE) AS n FROM labeled_articles GROUP BY 1) SELECT country, k, n, {WILSON} FROM c")
def stat_wilson(spark, base):
    df = S.load(spark, base, "labeled_articles", ["source_country", "is_about_movement"])
    counted = df.groupBy(C.known_country(F.col("source_country")).alias("country")).agg(F.count_if("is_about_movement").cast("double").alias("k"), F.count("is_about_movement").cast("double").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return counted.select("country", "k", "n", low.alias("low"), high.alias("high"))


@query("stat_extrapolate", "WITH s AS (SELECT avg(CASE WHEN is_about_movement THEN 1.0 ELSE 0.0 END) AS rate FROM labeled_articles WHERE is_about_movement IS NOT NULL), p AS (SELECT count(*) AS n FROM labeled_articles) SELECT rate, CAST(floor(rate * n) AS BIGINT) AS expected, rate + (1 - rate) * 0.25 AS projected FROM s, p")
def stat_extrapolate(spark, base):
    df = S.load(spark, base, "labeled_articles", ["is_about_movement"])
    both = df.agg(F.avg(F.col("is_about_movement").cast("double")).alias("rate"), F.count("*").alias("n"))
    return both.select("rate", F.floor(F.col("rate") * F.col("n")).cast("bigint").alias("expected"), (F.col("rate") + (1 - F.col("rate")) * 0.25).alias("projected"))


@query("fn_math", "SELECT l_orderkey, l_linenumber, log2(l_quantity + 1) AS a, ln(l_extendedprice) AS b, sqrt(l_quantity) AS c, abs(l_discount - l_tax) AS d FROM lineitem")
def fn_math(spark, base):
    df = S.load(spark, base, "lineitem")
    return df.select("l_orderkey", "l_linenumber", F.log2(F.col("l_quantity") + 1).alias("a"), F.ln("l_extendedprice").alias("b"), F.sqrt("l_quantity").alias("c"), F.abs(F.col("l_discount") - F.col("l_tax")).alias("d"))


@query("proj_month", "SELECT url, strftime(published, '%Y-%m') AS month FROM articles_v3")
def proj_month(spark, base):
    return S.load(spark, base, "articles_v3", ["url", "published"]).select("url", F.date_format("published", "yyyy-MM").alias("month"))


@query("proj_year", "SELECT url, CAST(year(published) AS INT) AS year FROM articles_v3")
def proj_year(spark, base):
    return S.load(spark, base, "articles_v3", ["url", "published"]).select("url", F.year("published").alias("year"))


@query("proj_day", "SELECT url, CAST(published AS DATE) AS day FROM articles_v3")
def proj_day(spark, base):
    return S.load(spark, base, "articles_v3", ["url", "published"]).select("url", F.to_date("published").alias("day"))


@query("fn_left", "SELECT doc_id, left(title, 12) AS head FROM documents")
def fn_left(spark, base):
    return S.load(spark, base, "documents", ["doc_id", "title"]).select("doc_id", F.left("title", F.lit(12)).alias("head"))


@query("fn_digest64", f"SELECT lang, count(DISTINCT {sql_norm('title')}) AS titles FROM documents GROUP BY lang")
def fn_digest64(spark, base):
    """Distinct digests of 64 bits, which here are as many as distinct titles."""
    df = S.load(spark, base, "documents", ["lang", "title"])
    return df.groupBy("lang").agg(F.countDistinct(F.xxhash64(X.norm_title(F.col("title")))).alias("titles"))


@query("fn_stable_sort_key", "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY md5('42:' || CAST(s_suppkey AS VARCHAR)), s_suppkey) AS INT) AS place FROM supplier QUALIFY place <= 50")
def fn_stable_sort_key(spark, base):
    from tessella.operators.relations import shuffled, top_per_group

    rows = S.load(spark, base, "supplier", ["s_suppkey"]).withColumn("all", F.lit(1))
    # a top-k report: the first fifty in the stable order
    first = rows.orderBy(shuffled(F.col("s_suppkey"), 42), "s_suppkey").limit(50)
    return top_per_group(first, ["all"], [shuffled(F.col("s_suppkey"), 42), "s_suppkey"], 50, "place").select("s_suppkey", "place")


@query("src_csv_glob", "SELECT url, outlet, published FROM articles_v3")
def src_csv_glob(spark, base):
    """The table written as many CSV files into the shared folder and read back as one."""
    from tessella.session import shared_folder
    from tessella.sources import sinks

    folder = shared_folder(spark, "csv")
    sinks.write_csv(S.load(spark, base, "articles_v3", ["url", "outlet", "published"]), folder)
    return S.read_csv(spark, f"{folder}/*.csv", "url string, outlet string, published timestamp_ntz")


def _pages(spark, base):
    df = S.load_spread(spark, base, "labeled_articles", ["url", "fetched_title", "article_text"]).where("article_text is not null").dropDuplicates(["url"])
    text = F.replace(F.replace("article_text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    markup = F.concat(F.lit("<html><head><title>"), F.coalesce("fetched_title", F.lit("")), F.lit("</title><style>p{}</style></head><body><nav>menu</nav><article><p>"), F.replace(text, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></article><script>1</script></body></html>"))
    return df.select("url", markup.alias("html"))


@query("src_html_extract")
def src_html_extract(spark, base):
    from tessella.sources import web

    return web.extract_pages(_pages(spark, base), "url", "html")


def _stub(url: str) -> str:
    """A stand-in for the network: what comes back depends on the address alone."""
    last = sum(map(ord, url)) % 5
    if last == 0:
        raise TimeoutError(url)
    return "" if last == 1 else "<title>t</title><p>" + "word " * (20 if last == 2 else 200) + "</p>"


@query("src_http_fetch")
def src_http_fetch(spark, base):
    from tessella.sources import web

    return web.fetch_rows(S.load_spread(spark, base, "articles_v3", ["url"]).distinct(), _stub).select("url", "fetch_status", F.length("article_text").alias("chars"))


@query("src_cdx_retry")
def src_cdx_retry(spark, base):
    from tessella.sources import web

    failed = S.load(spark, base, "labeled_articles", ["url", "fetch_status"]).where(C.unresolved(F.col("fetch_status"))).select("url").distinct()
    archive = web.with_retry(_stub, tries=2, first_wait=0.0)
    return web.fetch_rows(failed, _stub, archive).select("url", "fetch_status")


@query("sink_html_json")
def sink_html_json(spark, base):
    """The cube of a report as one JSON document."""
    from tessella.sources import sinks

    by_country = S.load(spark, base, "articles_v3", ["source_country"]).groupBy("source_country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_country")
    return spark.createDataFrame([(sinks.to_json({"by_country": by_country}),)], "report string")


@query("sink_text_report")
def sink_text_report(spark, base):
    from tessella.sources import sinks

    by_status = S.load(spark, base, "labeled_articles", ["fetch_status"]).groupBy("fetch_status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fetch_status")
    return spark.createDataFrame([(line,) for line in sinks.text_table(by_status, {"fetch_status": 24, "n": 10}).split("\n")], "line string")


@query("geo_path")
def geo_path(spark, base):
    """Rings of invented outlines, thinned and projected; small ones are dropped."""
    from tessella.operators.geo import svg_path

    angle = F.transform(F.sequence(F.lit(0), F.lit(119)), lambda i: F.struct((F.cos(i * 0.0523598) * F.col("n_regionkey") + F.col("n_nationkey") * 5).alias("lon"), (F.sin(i * 0.0523598) * F.col("n_regionkey") + 10).alias("lat")))
    return S.load(spark, base, "nation", ["n_nationkey", "n_regionkey"]).select("n_nationkey", svg_path(angle).alias("path"))


@query("sink_csv", "SELECT doc_id, lang, title FROM documents WHERE title IS NOT NULL")
def sink_csv(spark, base):
    """One table written as CSV into the shared folder and read back as it was."""
    from tessella.session import shared_folder
    from tessella.sources import sinks

    folder = shared_folder(spark, "csv")
    sinks.write_csv(S.load(spark, base, "documents", ["doc_id", "lang", "title"]).where("title is not null"), folder)
    return S.read_csv(spark, f"{folder}/*.csv", "doc_id bigint, lang string, title string")


@query("sink_sample_html", "SELECT url, title FROM articles_v3 WHERE title IS NOT NULL AND title <> '' GROUP BY 1, 2 QUALIFY row_number() OVER (ORDER BY md5(url), url, title) <= 20")
def sink_sample_html(spark, base):
    """A page of cards with a sample of twenty articles, and the rows that were read back from it."""
    import html
    import os
    import tempfile

    from tessella.sources import sinks

    # a report on the driver of a stated number of rows
    sample = S.load(spark, base, "articles_v3", ["url", "title"]).where("title is not null and title <> ''").distinct().orderBy(F.md5("url"), "url", "title").limit(20)
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "cards.html")
        sinks.write_cards(sample, path, "url", "title")
        page = open(path, encoding="utf-8").read()
    rows = [r for r in sample.collect() if html.escape(r.url) in page and html.escape(r.title) in page]
    return spark.createDataFrame([tuple(r) for r in rows], "url string, title string")
