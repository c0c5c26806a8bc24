"""Queries of phrases over whole documents, all languages at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import resources as R
from tessella.functions import text as X
from tessella.operators import phrases as P
from tessella.plans.columns import quoted, sql_lower, sql_tokens
from tessella.plans.registry import query
from tessella.sources.tables import load_spread

NODES = ["tribunal", "ledger", "staff", "letter"]

DOCS = f"d AS (SELECT doc_id, lang, source AS outlet, source_country AS country, published, text, {sql_tokens('text')} AS toks FROM documents WHERE lang IN ({quoted(R.STOP_WORDS)}) AND text IS NOT NULL)"
STOPS = "st(lang, word) AS (VALUES " + ", ".join(f"('{c}', '{w}')" for c in R.STOP_WORDS for w in R.stop_words(c)) + ")"
VOCAB = "v AS MATERIALIZED (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(toks) AS word FROM d) GROUP BY 1, 2)"
SPOTS = "t AS MATERIALIZED (SELECT doc_id, lang, outlet, country, unnest(toks) AS word, unnest(range(len(toks))) AS pos FROM d), f AS MATERIALIZED (SELECT t.*, s.word IS NOT NULL AS stop FROM t JOIN v ON t.lang = v.lang AND t.word = v.word AND v.n >= 5 LEFT JOIN st s ON s.lang = t.lang AND s.word = t.word)"
GRAMS = """g AS MATERIALIZED (
SELECT a.doc_id, a.lang, a.outlet, a.country, a.word || ' ' || b.word AS phrase, 2 AS words FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE NOT a.stop AND NOT b.stop
UNION ALL SELECT a.doc_id, a.lang, a.outlet, a.country, a.word || ' ' || b.word || ' ' || c.word, 3 FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN f c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE NOT a.stop AND NOT c.stop
UNION ALL SELECT a.doc_id, a.lang, a.outlet, a.country, a.word || ' ' || b.word || ' ' || c.word || ' ' || e.word, 4 FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN f c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 JOIN f e ON a.doc_id = e.doc_id AND e.pos = a.pos + 3 WHERE NOT a.stop AND NOT e.stop)"""
COUNTS = "c AS MATERIALIZED (SELECT lang, phrase, words, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM g GROUP BY 1, 2, 3)"
HEAD = f"WITH {DOCS}, {STOPS}, {VOCAB}"


def _docs(spark, base):
    df = load_spread(spark, base, "documents", ["doc_id", "lang", "source", "source_country", "published", "text"]).where(F.col("lang").isin(*R.STOP_WORDS) & F.col("text").isNotNull())
    return df.select("doc_id", "lang", F.col("source").alias("outlet"), F.col("source_country").alias("country"), "published", "text")


@query("tx_vocab", f"{HEAD} SELECT lang, word, n FROM v")
def tx_vocab(spark, base):
    return P.vocabulary(P.tokenised(_docs(spark, base)))


@query("fn_stopwords", f"{HEAD} SELECT v.lang, v.word, n FROM v JOIN st ON v.lang = st.lang AND v.word = st.word")
def fn_stopwords(spark, base):
    words = P.vocabulary(P.tokenised(_docs(spark, base)))
    return words.join(F.broadcast(P.stop_word_table(words)), ["lang", "word"], "left_semi")


@query("tx_ngrams", f"{HEAD}, {SPOTS}, {GRAMS}, {COUNTS} SELECT lang, phrase, words, occurrences, documents FROM c WHERE documents >= 3")
def tx_ngrams(spark, base):
    return P.ngram_counts(P.ngrams(P.tokenised(_docs(spark, base)))).where("documents >= 3")


@query("tx_ngram_table", f"""{HEAD}, {SPOTS}, {GRAMS}, {COUNTS}, o AS (SELECT lang, phrase, coalesce(outlet, 'UNKNOWN') AS outlet, count(*) AS n FROM g GROUP BY 1, 2, 3), q AS (SELECT lang, phrase, count(*) AS outlets, arg_min(outlet, (-n, outlet)) AS top_outlet, max(n) / sum(n) AS share FROM o GROUP BY 1, 2), k AS (SELECT lang, phrase, count(DISTINCT coalesce(country, 'UNKNOWN')) AS countries FROM g GROUP BY 1, 2),
m AS (SELECT c.lang, c.phrase, words, occurrences, documents, outlets, countries, top_outlet, share AS top_outlet_share, share > 0.5 AS syndication_flag FROM c JOIN q ON c.lang = q.lang AND c.phrase = q.phrase JOIN k ON c.lang = k.lang AND c.phrase = k.phrase WHERE documents >= 10 QUALIFY row_number() OVER (PARTITION BY c.lang ORDER BY occurrences DESC, c.phrase) <= 400)
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY lang ORDER BY syndication_flag, occurrences DESC, phrase) <= 100""")
def tx_ngram_table(spark, base):
    return P.ngram_table(P.ngrams(P.tokenised(_docs(spark, base))))


COLLOC = f"""t AS MATERIALIZED (SELECT doc_id, lang, unnest(toks) AS word, unnest(range(len(toks))) AS pos FROM d), x AS MATERIALIZED (SELECT a.lang, a.word AS node, b.word AS collocate, count(*) AS f_ab FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - 5 AND a.pos + 5 AND a.pos <> b.pos
WHERE a.word IN ({quoted(NODES)}) AND a.word <> b.word GROUP BY 1, 2, 3), y AS MATERIALIZED (SELECT x.*, v.n AS f_b FROM x JOIN v ON x.lang = v.lang AND x.collocate = v.word AND v.n >= 5 WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.lang = x.lang AND st.word = x.collocate))"""


@query("tx_collocations", f"{HEAD}, {COLLOC} SELECT lang, node, collocate, f_ab FROM y")
def tx_collocations(spark, base):
    return P.collocations(P.tokenised(_docs(spark, base)), NODES)


CELL = "CASE WHEN {0} > 0 THEN {0} * ln({0} * total / ({1} * {2})) ELSE 0.0 END"
LL = "2 * (" + " + ".join(CELL.format(*c) for c in (
    ("CAST(f_ab AS DOUBLE)", "f_a", "f_b"), ("CAST(f_a - f_ab AS DOUBLE)", "f_a", "(total - f_b)"), ("CAST(f_b - f_ab AS DOUBLE)", "(total - f_a)", "f_b"), ("CAST(total - f_a - f_b + f_ab AS DOUBLE)", "(total - f_a)", "(total - f_b)")
)) + ")"


@query("tx_colloc_scores", f"""{HEAD}, {COLLOC}, n AS (SELECT lang, CAST(sum(n) AS DOUBLE) AS total FROM v GROUP BY 1), z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, node ORDER BY f_ab DESC, collocate) <= 400), s AS (SELECT z.lang, node, collocate, f_ab, v.n AS f_a, f_b, 14 + log2(2 * f_ab / (v.n + f_b)) AS log_dice, log2(f_ab * total / (v.n * f_b * 10)) AS pmi, total FROM z JOIN v ON z.lang = v.lang AND z.node = v.word JOIN n ON z.lang = n.lang WHERE f_ab >= 3)
SELECT lang, node, collocate, f_ab, f_a, f_b, log_dice, pmi, CASE WHEN least(f_ab, f_a - f_ab, f_b - f_ab, total - f_a - f_b + f_ab) < 0 THEN 0.0 ELSE {LL} END AS log_likelihood FROM s QUALIFY row_number() OVER (PARTITION BY lang, node ORDER BY round(log_dice, 9) DESC, collocate) <= 40""")
def tx_colloc_scores(spark, base):
    return P.collocation_scores(P.tokenised(_docs(spark, base)), NODES)


@query("tx_kwic", f"""WITH {DOCS}, t AS (SELECT doc_id, lang, toks, unnest(toks) AS node, unnest(range(len(toks))) AS pos FROM d) SELECT lang, node, doc_id, CAST(pos AS INT) AS pos, array_to_string(toks[greatest(pos - 7, 1):pos], ' ') AS left, array_to_string(toks[pos + 2:pos + 9], ' ') AS right FROM t WHERE node IN ({quoted(NODES)}) QUALIFY row_number() OVER (PARTITION BY lang, node ORDER BY doc_id, pos) <= 40""")
def tx_kwic(spark, base):
    return P.kwic(P.tokenised(_docs(spark, base)), NODES)


SENTENCES = f"""r AS (SELECT doc_id, lang, outlet, country, published, trim(unnest(string_split(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)))) AS sentence FROM d), w AS (SELECT *, {sql_tokens('sentence')} AS w FROM r),
k AS MATERIALIZED (SELECT doc_id, lang, outlet, country, published, array_to_string(w, ' ') AS key, sentence, regexp_matches(sentence, '{X.QUOTE_SIGNS}') AS is_quote FROM w WHERE len(w) BETWEEN 6 AND 60 AND length(regexp_replace(substring(sentence, 1, 1200), '[^\\p{{L}}]', '', 'g')) / greatest(length(regexp_replace(substring(sentence, 1, 1200), '\\s', '', 'g')), 1) >= 0.55)"""


@query("fn_sentence_key", f"WITH {DOCS}, {SENTENCES} SELECT doc_id, md5(key) AS key, is_quote, count(*) AS n FROM k GROUP BY 1, 2, 3")
def fn_sentence_key(spark, base):
    rows = P.sentence_rows(_docs(spark, base))
    return rows.groupBy("doc_id", F.md5("key").alias("key"), "is_quote").agg(F.count("*").alias("n"))


@query("tx_repeated_sentences", f"""WITH {DOCS}, {SENTENCES} SELECT lang, arg_min(sentence, (NOT is_quote, sentence)) AS sentence, count(DISTINCT doc_id) AS articles, count(DISTINCT coalesce(outlet, 'UNKNOWN')) AS outlets, count(DISTINCT coalesce(country, 'UNKNOWN')) AS countries, CAST(min(published) AS DATE) AS first_seen, CAST(max(published) AS DATE) AS last_seen,
CAST(CAST(max(published) AS DATE) - CAST(min(published) AS DATE) AS INT) AS days, bool_or(is_quote) AS looks_like_quote, count(DISTINCT coalesce(outlet, 'UNKNOWN')) < 2 AS single_outlet FROM k GROUP BY lang, key HAVING count(DISTINCT doc_id) >= 3""")
def tx_repeated_sentences(spark, base):
    return P.repeated_sentences(_docs(spark, base))


@query("tx_phrase_frames", f"""{HEAD}, {SPOTS}, {GRAMS}, {COUNTS}, b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY occurrences DESC, phrase) <= 40000), h AS (SELECT DISTINCT lang, phrase, occurrences, node FROM (SELECT lang, phrase, occurrences, unnest(string_split(phrase, ' ')) AS node FROM b) WHERE node IN ({quoted(NODES)}))
SELECT lang, phrase, occurrences, node, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, node ORDER BY occurrences DESC, phrase) AS rank FROM h) WHERE rank <= 6""")
def tx_phrase_frames(spark, base):
    return P.phrase_frames(P.ngrams(P.tokenised(_docs(spark, base))), NODES)
