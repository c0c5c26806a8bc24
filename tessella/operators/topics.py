"""Topics by language, their names, and a language guess by function words."""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import resources as R
from tessella.functions.text import tokens, tokens3
from tessella.operators.relations import first_by
from tessella.operators.similar import SKETCH_BITS, described_sets, parities_agree, sizes_agree, verified

# Rules that name a topic: language, word that its top words hold, name. The first of equal ones wins.
NAME_RULES = [("en", "tribunal", "Hearings"), ("en", "staff", "Staff matters"), ("en", "letter", "Staff matters"), ("fr", "tribunal", "Audiences"), ("en", "hotel", "DROP  (hotels)")]


#: Scripts that tell a language by themselves, as classes of characters; of Japanese and Chinese, kana tell the former.
SCRIPTS = {"ar": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}", "hi": r"\x{0900}-\x{097F}", "ja": r"\x{3040}-\x{30FF}", "ru": r"\x{0400}-\x{04FF}", "zh": r"\x{4E00}-\x{9FFF}"}
#: Share of the letters from which a script tells the language, and of kana among those of Japanese.
SCRIPT_SHARE, KANA_SHARE = 0.5, 0.1


def stop_word_language(text: Column, first: int = 700) -> Column:
    """The language of the start of a text: by its script, else the one whose function words it holds most; null without any, ties in order of the code."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, first)

    def best(held: Column) -> Column:
        def score(code: str) -> Column:
            return F.struct((-F.size(F.filter(held, lambda w: w.isin(*R.STOP_WORDS[code].split())))).alias("n"), F.lit(code).alias("lang"))

        top = F.array_min(F.array(*[score(code) for code in sorted(R.STOP_WORDS)]))
        return F.when(top["n"] < 0, top["lang"])

    def guessed(start: Column) -> Column:
        letters = F.length(F.regexp_replace(start, r"[^\p{L}]", ""))
        share = {code: F.length(F.regexp_replace(start, f"[^{signs}]", "")) / letters for code, signs in SCRIPTS.items()}
        by_script = F.when(share["ja"] + share["zh"] > SCRIPT_SHARE, F.when(share["ja"] > KANA_SHARE, "ja").otherwise("zh"))
        for code in ("ar", "hi", "ru"):
            by_script = by_script.when(share[code] > SCRIPT_SHARE, code)
        return F.when(letters > 0, F.coalesce(by_script, F.transform(F.array(tokens(start)), best)[0]))

    return F.transform(F.array(head), guessed)[0]


def _vectors(docs: DataFrame, lang: str, text: str, language: str, min_df: int, features: int):
    rows = docs.where(F.col(lang) == language).withColumn("__w", tokens3(F.substring(text, 1, 6000)))
    kept = StopWordsRemover(inputCol="__w", outputCol="__k", stopWords=list(R.stop_words(language))).transform(rows)
    model = CountVectorizer(inputCol="__k", outputCol="__v", minDF=min_df, maxDF=0.55, vocabSize=features).fit(kept)
    return model, model.transform(kept).drop("__w", "__k")


def _languages(docs: DataFrame, lang: str, least: int, most: int) -> list[str]:
    counted = docs.where(F.col(lang).isin(*R.STOP_WORDS)).groupBy(lang).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return [row[0] for row in counted.orderBy(F.desc("n"), lang).limit(most).collect()]


def _fit(vectors: DataFrame, topics: int, iterations: int, seed: int):
    return LDA(featuresCol="__v", k=topics, maxIter=iterations, seed=seed, optimizer="online", learningDecay=0.7, learningOffset=10.0).fit(vectors)


def topics_by_language(
    docs: DataFrame, *, key: str, lang: str, text: str, topics: int = 8, iterations: int = 25, seed: int = 42,
    least_documents: int = 300, most_languages: int = 6, min_df: int = 8, features: int = 8000,
) -> DataFrame:
    """``key, lang, main_topic, weights``: online LDA for each language with enough documents; topics count from 1."""
    parts = []
    for language in _languages(docs, lang, least_documents, most_languages):
        model, vectors = _vectors(docs, lang, text, language, min_df, features)
        if model.vocabulary:
            weights = vector_to_array("topicDistribution")
            made = _fit(vectors, topics, iterations, seed).transform(vectors).select(key, F.lit(language).alias("lang"), weights.alias("weights"))
            parts.append(made.withColumn("main_topic", F.array_position("weights", F.array_max("weights")).cast("int")))
    if not parts:
        kind = docs.schema[key].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"{key} {kind}, lang string, weights array<double>, main_topic int")
    return reduce(DataFrame.unionByName, parts)


def top_words_by_language(docs: DataFrame, *, lang: str, text: str, topics: int = 8, iterations: int = 25, seed: int = 42, least_documents: int = 300, most_languages: int = 6, words: int = 15, min_df: int = 8, features: int = 8000) -> DataFrame:
    """``lang, topic, top_words``: the words of largest weight, joined."""
    rows = []
    for language in _languages(docs, lang, least_documents, most_languages):
        model, vectors = _vectors(docs, lang, text, language, min_df, features)
        if model.vocabulary:
            for topic in _fit(vectors, topics, iterations, seed).describeTopics(words).collect():
                rows.append((language, topic.topic + 1, " ".join(model.vocabulary[i] for i in topic.termIndices)))
    return docs.sparkSession.createDataFrame(rows, "lang string, topic int, top_words string")


def most_frequent_words(titles: DataFrame, words: int = 15) -> DataFrame:
    """``lang, topic, top_words``: of ``lang, topic, words`` the most frequent words, joined; of equal ones the lesser word first."""
    split = titles.select("lang", "topic", F.explode(F.split("words", " ")).alias("word")).where("word <> ''")
    counted = split.groupBy("lang", "topic", "word").agg((-F.count("*")).alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "topic").orderBy("n", "word"))).where(F.col("rank") <= words)
    top = F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"])
    return ranked.groupBy("lang", "topic").agg(F.array_join(top, " ").alias("top_words"))


def suggested_names(words: DataFrame, *, key: str, rules: list[tuple[str, str, str]] = NAME_RULES) -> DataFrame:
    """``key, name``: the name with most rule words in ``words`` of ``key, lang, words``; of equal ones the earlier rule."""
    table = words.sparkSession.createDataFrame([(i, *rule) for i, rule in enumerate(rules)], "rule int, rule_lang string, word string, name string")
    hits = words.join(F.broadcast(table), (F.col("lang") == F.col("rule_lang")) & F.col("words").contains(F.col("word")))
    counted = hits.groupBy(key, "name").agg((-F.count("*")).alias("n"), F.min("rule").alias("rule"))
    return first_by(counted, [key], ["n", "rule"], ["name"])


def name_template(table: DataFrame) -> DataFrame:
    """``lang, topic, top_words`` with a suggested name and an empty one to be filled in."""
    keyed = table.withColumn("id", F.concat_ws(":", "lang", "topic"))
    named = suggested_names(keyed.select("id", "lang", F.col("top_words").alias("words")), key="id")
    return keyed.join(named, "id", "left").select("lang", "topic", "top_words", F.coalesce("name", F.lit("")).alias("suggested_name"), F.lit("").alias("your_name"))


def named_topics(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with ``name``: the given one, else the suggested one, else the number."""
    joined = docs.join(F.broadcast(names), ["lang", "topic"], "left")
    return joined.withColumn("name", F.coalesce("your_name", "suggested", F.concat(F.lit("Topic "), F.col("topic").cast("string"))))


def topic_mix(weighted: DataFrame, group: str, weights: str, topics: int, least: int) -> DataFrame:
    means = [F.avg(F.col(weights)[i]).alias(f"topic_{i + 1}") for i in range(topics)]
    return weighted.groupBy(group).agg(F.count("*").alias("n"), *means).where(F.col("n") >= least)


#: Words of 64 parities that travel to each table: with fewer, more pairs are left for the whole sketch.
FOLDS = 4


def minhash_pairs(units: DataFrame, threshold: float = 0.8, tables: int = 8, seed: int = 42) -> DataFrame:
    """``a, b, similarity`` by MinHash tables: an approximate alternative to the exact similarity join, verified by the sets themselves.

    Sets of similarity ``s`` share the least hash of a table with probability ``s``. Numbers and a folded sketch of each set
    travel to its tables; classes of size and the sketch rule out pairs there that can't be similar enough, without loss.
    """
    factors = [random.Random(f"{seed}:{k}").getrandbits(64) | 1 for k in range(tables)]
    sets = described_sets(units, factors)
    folded = [reduce(Column.bitwiseXOR, [F.get("sketch", F.lit(i)) for i in range(k, SKETCH_BITS // 64, FOLDS)]).alias(f"k{k}") for k in range(FOLDS)]
    # similar sizes lie in one class or in two that follow each other
    size_class = F.floor(F.log("n") / (1e-6 - math.log(max(threshold, 1e-9)))).cast("int")
    rows = sets.select("num", "n", *folded, size_class.alias("c"), F.posexplode("least").alias("t", "h"))

    def side(x: str, df: DataFrame) -> DataFrame:
        return df.select("t", "h", "c", F.col("num").alias(x), *[F.col(c).alias(c + x) for c in ("n", *(f"k{k}" for k in range(FOLDS)))])

    lesser, greater = side("a", rows), side("b", rows.withColumn("c", F.explode(F.array("c", F.col("c") - 1))))
    once = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    agree = parities_agree(reduce(Column.__add__, [F.bit_count(F.col(f"k{k}a").bitwiseXOR(F.col(f"k{k}b"))) for k in range(FOLDS)]), threshold)
    candidates = lesser.join(greater, ["t", "h", "c"]).where(once & sizes_agree(threshold) & agree).select("a", "b")
    return verified(candidates, sets, threshold)
