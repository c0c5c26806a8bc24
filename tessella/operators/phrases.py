"""Phrases: vocabulary, n-grams, collocations, concordance lines, repeated sentences.

All languages are handled at once with the language as a group key. Tokens are arrays; positions are made only
where they are needed; frequent words are sent to them, so that tokens move once, to their document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import resources as R
from tessella.functions.stats import log_dice, log_likelihood, pmi
from tessella.functions.text import QUOTE_SIGNS, alpha_share, sentences, tokens
from tessella.session import cut_lineage


def stop_word_table(df: DataFrame) -> DataFrame:
    """``lang, word`` of the function words of each language and of English."""
    rows = [(code, w) for code in R.STOP_WORDS for w in R.stop_words(code)]
    return df.sparkSession.createDataFrame(rows, "lang string, word string")


def is_stop(word: Column, lang: Column) -> Column:
    """Whether a word is in the list of its language, as one lookup."""
    table = F.create_map(*[x for code in R.STOP_WORDS for x in (F.lit(code), F.array(*[F.lit(w) for w in R.stop_words(code)]))])
    return F.coalesce(F.array_contains(F.element_at(table, lang), word), F.lit(False))


def tokenised(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``toks`` and drops the text."""
    return docs.withColumn("toks", tokens(F.col(text))).drop(text)


def vocabulary(docs: DataFrame) -> DataFrame:
    """``lang, word, n``."""
    return docs.select("lang", F.explode("toks").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


#: Frequent words up to this number, some 20 MB, are sent to the tokens; beyond it the tokens of a word are spread over SALTS parts.
MOST_BROADCAST_WORDS, SALTS = 200_000, 32


def _frequent_spots(spots: DataFrame, frequent: DataFrame) -> DataFrame:
    """The tokens whose word is in ``frequent`` (``lang, word, n``); no word is a key that all its tokens move to."""
    words = frequent.select("lang", "word")
    if frequent.count() <= MOST_BROADCAST_WORDS:
        return spots.join(F.broadcast(words), ["lang", "word"], "left_semi")
    salted = spots.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copies = words.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["lang", "word", "__salt"], "left_semi").drop("__salt")


def ngrams(docs: DataFrame, *, longest: int = 4, least: int = 5) -> DataFrame:
    """``doc_id, lang, outlet, country, phrase, words`` for every n-gram of 2 to ``longest`` words whose words are frequent enough and that neither starts nor ends with a function word."""
    frequent = cut_lineage(vocabulary(docs).where(F.col("n") >= least))
    spots = docs.select("doc_id", "lang", F.posexplode("toks").alias("pos", "word"))
    kept = _frequent_spots(spots, frequent).withColumn("stop", is_stop(F.col("word"), F.col("lang")))
    order = Window.partitionBy("doc_id").orderBy("pos")
    for k in range(1, longest):
        kept = kept.withColumn(f"w{k}", F.lead("word", k).over(order)).withColumn(f"p{k}", F.lead("pos", k).over(order)).withColumn(f"s{k}", F.lead("stop", k).over(order))

    def of_length(n: int) -> Column:
        whole = (F.col(f"p{n - 1}") == F.col("pos") + n - 1) & ~F.col(f"s{n - 1}")
        return F.when(whole, F.struct(F.concat_ws(" ", "word", *[f"w{k}" for k in range(1, n)]).alias("phrase"), F.lit(n).alias("words")))

    opened = kept.where(~F.col("stop")).select("doc_id", "lang", F.explode(F.array(*[of_length(n) for n in range(2, longest + 1)])).alias("g"))
    found = opened.where("g is not null").select("doc_id", "lang", "g.phrase", "g.words")
    about = docs.select("doc_id", F.coalesce("outlet", F.lit(R.UNKNOWN)).alias("outlet"), F.coalesce("country", F.lit(R.UNKNOWN)).alias("country"))
    return found.join(about, "doc_id")


def ngram_counts(grams: DataFrame) -> DataFrame:
    """``lang, phrase, words, occurrences, documents``."""
    once = grams.groupBy("lang", "phrase", "words", "doc_id").agg(F.count("*").alias("n"))
    return once.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))


def ngram_table(grams: DataFrame, *, least_documents: int = 10, share: float = 0.5, top: int = 100) -> DataFrame:
    """Per language the phrases in enough documents with their outlets and countries, those not held by one outlet first.

    A pre-cut of four times ``top`` by frequency precedes the final order; ties go by phrase.
    """
    once = grams.groupBy("lang", "phrase", "words", "doc_id", "outlet", "country").agg(F.count("*").alias("n"))
    by_outlet = once.groupBy("lang", "phrase", "words", "outlet").agg(F.sum("n").alias("n"), F.count("*").alias("documents"), F.collect_set("country").alias("countries"))
    joined = by_outlet.groupBy("lang", "phrase", "words").agg(
        F.sum("n").alias("occurrences"), F.sum("documents").alias("documents"), F.count("*").alias("outlets"),
        F.min(F.struct((-F.col("n")).alias("n"), "outlet")).alias("t"), F.size(F.array_distinct(F.flatten(F.collect_list("countries")))).cast("bigint").alias("countries"),
    ).withColumn("all", F.col("occurrences")).where(F.col("documents") >= least_documents)
    made = joined.select(
        "lang", "phrase", "words", "occurrences", "documents", "outlets", "countries", F.col("t.outlet").alias("top_outlet"),
        (-F.col("t.n") / F.col("all")).alias("top_outlet_share"), (-F.col("t.n") / F.col("all") > share).alias("syndication_flag"),
    )
    by_frequency = Window.partitionBy("lang").orderBy(F.desc("occurrences"), "phrase")
    final = Window.partitionBy("lang").orderBy("syndication_flag", F.desc("occurrences"), "phrase")
    return made.withColumn("__a", F.row_number().over(by_frequency)).where(F.col("__a") <= 4 * top).withColumn("__b", F.row_number().over(final)).where(F.col("__b") <= top).drop("__a", "__b")


def _around(docs: DataFrame, nodes: list[str], window: int) -> DataFrame:
    """``doc_id, lang, pos, node, before, after``: each place of a node with its neighbours, read from the array itself."""
    def places(toks: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(1), F.size(toks)), lambda i: F.element_at(toks, i).isin(*nodes))
        return F.transform(hits, lambda i: F.struct(
            (i - 1).alias("pos"), F.element_at(toks, i).alias("node"),
            F.slice(toks, F.greatest(i - window, F.lit(1)), F.least(i - 1, F.lit(window))).alias("before"), F.slice(toks, i + 1, window).alias("after"),
        ))

    return docs.where(F.size("toks") > 0).select("doc_id", "lang", F.explode(places(F.col("toks"))).alias("p")).select("doc_id", "lang", "p.*")


def collocations(docs: DataFrame, nodes: list[str], *, window: int = 5, least: int = 5) -> DataFrame:
    """``lang, node, collocate, f_ab``: frequent words other than function words within ``window`` tokens of a node."""
    frequent = vocabulary(docs).where(F.col("n") >= least).select("lang", F.col("word").alias("collocate"))
    pairs = _around(docs, nodes, window).select("lang", "node", F.explode(F.concat("before", "after")).alias("collocate"))
    kept = pairs.where((F.col("collocate") != F.col("node")) & ~is_stop(F.col("collocate"), F.col("lang")))
    return kept.groupBy("lang", "node", "collocate").agg(F.count("*").alias("f_ab")).join(frequent, ["lang", "collocate"])


def collocation_scores(docs: DataFrame, nodes: list[str], *, window: int = 5, least: int = 5, first: int = 400, top: int = 40) -> DataFrame:
    """Log-Dice, PMI and log-likelihood of collocates; the most frequent per node, then those of highest log-Dice."""
    words = vocabulary(docs)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    pairs = collocations(docs, nodes, window=window, least=least)
    by_count = Window.partitionBy("lang", "node").orderBy(F.desc("f_ab"), "collocate")
    cut = pairs.withColumn("__r", F.row_number().over(by_count)).where((F.col("__r") <= first) & (F.col("f_ab") >= 3)).drop("__r")
    named = words.select("lang", F.col("word").alias("node"), F.col("n").alias("f_a"))
    joined = cut.join(named, ["lang", "node"]).join(words.select("lang", F.col("word").alias("collocate"), F.col("n").alias("f_b")), ["lang", "collocate"]).join(totals, "lang").where("f_b >= 5")
    ab, a, b, n = (F.col(c) for c in ("f_ab", "f_a", "f_b", "total"))
    scored = joined.select("lang", "node", "collocate", "f_ab", "f_a", "f_b", log_dice(ab, a, b).alias("log_dice"), pmi(ab, a, b, n, window).alias("pmi"), log_likelihood(ab, a, b, n).alias("log_likelihood"))
    best = Window.partitionBy("lang", "node").orderBy(F.desc(F.round("log_dice", 9)), "collocate")
    return scored.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= top).drop("__r")


def kwic(docs: DataFrame, nodes: list[str], *, width: int = 8, first: int = 40) -> DataFrame:
    """``lang, node, doc_id, pos, left, right``: the first places of each node in order of document and position."""
    lines = _around(docs, nodes, width)
    order = Window.partitionBy("lang", "node").orderBy("doc_id", "pos")
    taken = lines.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= first)
    return taken.select("lang", "node", "doc_id", "pos", F.array_join("before", " ").alias("left"), F.array_join("after", " ").alias("right"))


def sentence_rows(docs: DataFrame, text: str = "text", *, least: int = 6, most: int = 60, letters: float = 0.55) -> DataFrame:
    """``doc_id, lang, outlet, country, published, key, sentence, is_quote`` of every sentence of fitting length that is mostly letters."""
    parts = docs.select("doc_id", "lang", "outlet", "country", "published", F.explode(sentences(F.col(text))).alias("raw")).withColumn("sentence", F.trim("raw")).drop("raw")
    worded = parts.withColumn("w", tokens(F.col("sentence"))).where(F.size("w").between(least, most) & (alpha_share(F.col("sentence")) >= letters))
    return worded.select("doc_id", "lang", "outlet", "country", "published", F.array_join("w", " ").alias("key"), "sentence", F.col("sentence").rlike(QUOTE_SIGNS).alias("is_quote"))


def repeated_sentences(docs: DataFrame, text: str = "text", *, least_documents: int = 3, least_outlets: int = 2) -> DataFrame:
    """Sentences that several documents share: in how many documents, outlets and countries, when, and one text, a quotation if there is one."""
    rows = sentence_rows(docs, text)
    once = rows.groupBy("lang", "key", "doc_id").agg(
        F.min(F.struct((~F.col("is_quote")).alias("q"), "sentence")).alias("t"), F.first("outlet").alias("outlet"), F.first("country").alias("country"), F.first("published").alias("published"),
    )
    counted = once.groupBy("lang", "key").agg(
        F.count("*").alias("articles"), F.countDistinct(F.coalesce("outlet", F.lit(R.UNKNOWN))).alias("outlets"), F.countDistinct(F.coalesce("country", F.lit(R.UNKNOWN))).alias("countries"),
        F.to_date(F.min("published")).alias("first_seen"), F.to_date(F.max("published")).alias("last_seen"), F.min("t").alias("t"),
    ).where(F.col("articles") >= least_documents)
    return counted.select(
        "lang", F.col("t.sentence").alias("sentence"), "articles", "outlets", "countries", "first_seen", "last_seen",
        F.datediff("last_seen", "first_seen").alias("days"), (~F.col("t.q")).alias("looks_like_quote"), (F.col("outlets") < least_outlets).alias("single_outlet"),
    )


def phrase_frames(grams: DataFrame, nodes: list[str], *, pool: int = 40_000, top: int = 6) -> DataFrame:
    """Per node the most frequent phrases that hold it, among the most frequent phrases of all."""
    counted = ngram_counts(grams)
    by_frequency = Window.partitionBy("lang").orderBy(F.desc("occurrences"), "phrase")
    best = counted.withColumn("__r", F.row_number().over(by_frequency)).where(F.col("__r") <= pool)
    held = best.select("lang", "phrase", "occurrences", F.explode(F.array_intersect(F.split("phrase", " "), F.array(*[F.lit(n) for n in nodes]))).alias("node"))
    order = Window.partitionBy("lang", "node").orderBy(F.desc("occurrences"), "phrase")
    return held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
