import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import dedupe as D
from tessella.operators import events as V
from tessella.operators import matching as M
from tessella.operators import relations as O
from tessella.operators import skew as K
from tessella.operators import topics as T


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 140)]
    found = {r.id: r.component for r in O.connected_components(spark.createDataFrame(chain + star + [(7, 7), (500, 500), (None, 3)], "a int, b int")).collect()}
    assert all(found[i] == 1 for i in range(1, 41)) and all(found[i] == 100 for i in range(100, 140)) and found[500] == 500


def test_components_against_brute_force(spark):
    random.seed(3)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    found = {r.id: r.component for r in O.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {x: find(x) for edge in edges for x in edge}
    assert O.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def codebook(spark):
    rows = [(1, "viol", "viol", "regex", "viol", "France", False, "Support"), (2, "我也是", "我也是", "substr", "我也是", "Taiwan", False, "Support"), (3, "generic", "generic", "regex", "generic", "x", False, "Support"),
            (4, "(note)", "(note)", "regex", "(note)", "x", False, "Support"), (5, "abc", "abc", "substr", "abc", "x", True, "Backlash"), (6, "bcd", "bcd", "substr", "bcd", "x", False, "Support"), (7, "ABC", "abc", "substr", "abc", "y", True, "Backlash")]
    return spark.createDataFrame(rows, "kw_id int, kw_match string, kw_match_lower string, match_mode string, keyword string, keyword_country string, is_hashtag boolean, stance_primary string")


def test_matching_semantics(spark):
    docs = spark.createDataFrame([(1, "viol&#xEA;ncia"), (2, "un viol"), (3, "說我也是的人"), (4, "xabcdx"), (5, "generic (note)"), (6, None), (7, "")], "id int, t string")
    terms = M.codebook_terms(codebook(spark))
    found = {(r.id, r.term) for r in M.match_terms(docs, terms, key="id", doc=F.col("t")).collect()}
    assert found == {(2, "viol"), (3, "我也是"), (4, "abc"), (4, "bcd")}
    joined = {(r.id, r.term) for r in M.theta_join(docs.where("id <> 1"), terms, key="id", doc=F.col("t")).collect()}
    assert joined == found


def test_rollup_counts_keywords_once(spark):
    hits = M.attach_codebook(spark.createDataFrame([("u", "abc"), ("u", "bcd"), ("u", "abc")], "url string, term string"), codebook(spark))
    row = M.article_rollup(hits).first()
    assert (row.keywords_matched, row.n_keywords, row.n_support, row.n_backlash, row.has_hashtag_term) == ("abc | bcd", 2, 1, 1, True)


def test_similar_pairs_against_brute_force(spark):
    random.seed(5)
    words = "a b c d e f g h i j k l m".split()
    texts = {}
    for i in range(60):
        base = [random.choice(words) for _ in range(30)] if i % 3 == 0 else texts[i - 1].split()
        base = list(base)
        base[random.randrange(len(base))] = "z"
        texts[i] = " ".join(base)

    def sh(t):
        w = t.split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    want = {(a, b) for a in texts for b in texts if a < b and len(sh(texts[a]) & sh(texts[b])) / len(sh(texts[a]) | sh(texts[b])) >= 0.6}
    got = {(r.a, r.b) for r in D.similar_pairs(spark.createDataFrame(list(texts.items()), "id int, norm string"), 0.6).collect()}
    assert got == want and want


def alike(n=40, length=60):
    """Texts with a common end, some changed from the one before, under ids that fall as rows rise; and their pairs of similarity 0.5."""
    random.seed(8)
    texts, before = {}, []
    for i in range(n):
        before = [f"w{random.randrange(10**6)}" for _ in range(length)] if i % 4 == 0 else before[: -6 * (i % 4)] + [f"v{random.randrange(10**6)}" for _ in range(6 * (i % 4))]
        texts[f"u{n - i:03d}"] = " ".join(before + "the same end of all of these texts".split())
    sets = {u: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for u, t in texts.items() for w in [t.split()]}
    scores = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    return texts, scores


def test_similar_pairs_move_sets_of_near_texts_only(spark):
    texts, scores = alike()
    made = D.similar_pairs(spark.createDataFrame(list(texts.items()), "id string, norm string").repartition(3), 0.5)
    got = {(r.a, r.b): r.similarity for r in made.collect()}
    assert got == {pair: score for pair, score in scores.items() if score >= 0.5} and got
    # what is left to run joins texts that are near: no shingle, no distinct candidates
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 4


def test_minhash_pairs_are_verified_by_the_sets_themselves(spark):
    texts, scores = alike(n=12, length=3000)
    got = {(r.a, r.b): r.similarity for r in T.minhash_pairs(spark.createDataFrame(list(texts.items()), "id string, norm string").repartition(3)).collect()}
    assert got == {pair: score for pair, score in scores.items() if score >= 0.8} and got


def test_threshold_table_is_monotone(spark, tiny):
    rows = {r.threshold: r.unique_bodies for r in D.threshold_table(spark.read.parquet(f"{tiny}/labeled_articles.parquet"), "url", "article_text").collect()}
    assert rows[1.0] >= rows[0.9] >= rows[0.8] > 0


def test_editorial_guard(spark):
    rows = [(1, "a", "News/Reporting", "support", ["x"], "one two three four five six"), (1, "b", "Opinion/Editorial", "backlash", ["x", "bold", "harsh"], "one two three four five six"), (1, "c", None, None, None, "quite another text with its own words here"), (2, "d", None, None, None, None)]
    found = {r.url: r.reasons for r in D.editorial_splits(spark.createDataFrame(rows, "cluster_id int, url string, article_type string, stance string, words array<string>, norm string")).collect()}
    assert "opinion_overlay" in found["b"] and any(r.startswith("stance_differs(backlash_vs_support") for r in found["b"]) and any(r.startswith("added_evaluative") for r in found["b"])
    assert "unique_text" in found["c"] and "d" not in found


def test_editorial_guard_reads_rows_of_one_address_as_its_sql(spark, tmp_path):
    from tessella.plans.corpus import dd_editorial_guard

    text = "one two three four five six"
    rows = [("a", "News/Reporting", "support", ["x"], text), ("b", "Analysis", "support", None, text), ("b", "News/Reporting", "backlash", None, text), ("c", None, "support", None, text), ("d", None, "support", None, text), ("e", None, "support", None, text)]
    spark.createDataFrame(rows, "url string, article_type string, stance string, evaluative_language array<string>, article_text string").write.parquet(f"{tmp_path}/labeled_articles.parquet")
    spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "c"), (1, "e"), (2, "d"), (2, "absent")], "cluster_id long, url string").write.parquet(f"{tmp_path}/dedupe_map.parquet")
    made = dd_editorial_guard(spark, str(tmp_path))
    assert {r.url: r.reasons for r in made.collect()} == {"a": [], "b": ["opinion_overlay", "stance_differs(backlash_vs_support)"], "c": [], "e": []}
    # the driver holds the plan, again at each step of it
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 24


def test_smoothing_and_peak(spark):
    dense = spark.createDataFrame([("e", "c", 9, 0, 1), ("e", "c", 9, 1, 4), ("e", "c", 9, 2, 1)], "event string, country string, articles int, offset int, n int")
    assert [r.mean3 for r in V.smoothed(dense).orderBy("offset").collect()] == [2.5, 2.0, 2.5]
    row = V.summary(dense).first()
    assert (row.peak_day, row.onset_day, row.reliable) == (0, 1, False)


def test_event_join_on_bins(spark):
    events = V.event_table(spark, [("k", "2018-01-10", "A", "l", ["tribunal"], False), ("late", "2019-12-31", None, "l", ["tribunal"], False)])
    days = [("u1", "A", "2018-01-03"), ("u2", "A", "2018-01-02"), ("u3", "B", "2018-02-24"), ("u4", "B", "2018-02-25"), ("u5", "B", None)]
    rows = spark.createDataFrame([(u, c, d, "The TRIBÚNAL sat") for u, c, d in days], "url string, country string, day string, text string").withColumn("day", F.to_date("day"))
    assert {(r.event, r.url, r.offset) for r in V.event_matches(rows, events).collect()} == {("k", "u1", -7), ("k", "u3", 45)}


def skewed(spark, n=4000):
    random.seed(1)
    keys = ["hot" if random.random() < 0.4 else None if random.random() < 0.1 else f"k{random.randrange(60)}" for _ in range(n)]
    return keys, spark.createDataFrame([(k, i % 500, "x") for i, k in enumerate(keys)], "key string, v int, __shard string")


def test_plan_splits_and_packs(spark):
    _, df = skewed(spark)
    plan = K.plan_fragments(K.key_loads(df, F.col("key")), 8)
    assert len(plan.placed["hot"]) >= 3 and max(plan.loads) < 1.6 * plan.total / 8
    parts = K.fragmented(df.drop("__shard"), F.col("key"), F.col("v"), plan)
    rows = parts.groupBy(F.spark_partition_id().alias("p"), "__task").count().collect()
    # each partition is one task of the plan, and none has much more than its share
    assert len(rows) == len({r["p"] for r in rows}) == 8 and all(r["p"] == r["__task"] for r in rows)
    assert max(r["count"] for r in rows) < 1.5 * plan.total / 8
    other = spark.createDataFrame([("hot", 1)], "key string, w int")
    joined, _ = K.balanced_join(df.drop("__shard"), other, key=df["key"], matching_key=other["key"], row=df["v"], tasks=8)
    each = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert len(each) == len(plan.placed["hot"]) and max(each) < 1.5 * sum(each) / len(each)


def test_balanced_join_equals_plain_join(spark):
    keys, df = skewed(spark)
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4), ("absent", 5)], "key string, w int")
    joined, _ = K.balanced_join(df, other, key=df["key"], matching_key=other["key"], row=df["v"], tasks=8)
    want = sum(2 for k in keys if k == "hot") + sum(1 for k in keys if k == "k3")
    assert joined.count() == want
    left, _ = K.balanced_join(df, other, key=df["key"], matching_key=other["key"], row=df["v"], tasks=8, how="left")
    assert left.count() == want + sum(1 for k in keys if k not in ("hot", "k3"))


def test_per_key_distinct_is_exact(spark):
    keys, df = skewed(spark)
    want = defaultdict(set)
    for i, k in enumerate(keys):
        want[k].add(i % 500)
    got = {r["key"]: (r["rows"], r["distinct"]) for r in K.per_key_distinct(df, key=F.col("key"), value="v", tasks=8).collect()}
    assert got == {k: (keys.count(k), len(v)) for k, v in want.items()}


def test_heavy_values_edges(spark):
    rows = [("A ", None)] * 10 + [("a", "x")] * 10 + [(f"o{i}", None) for i in range(180)] + [(None, None)] * 50
    df = spark.createDataFrame(rows, "outlet string, source_country string")
    assert {tuple(r) for r in K.heavy_values(df, ["outlet", "source_country"], least_share=0.08).collect()} == {("outlet", "a")}
    assert {tuple(r) for r in K.heavy_values(df, ["outlet", "source_country"], least_share=0.04).collect()} == {("outlet", "a"), ("source_country", "x")}
    assert K.heavy_values(df.limit(0), ["outlet"], least_share=0.04).count() == 0


def test_upsert_and_samples(spark):
    old = spark.createDataFrame([("a", "FAILED:1"), ("b", "OK")], "url string, s string")
    new = spark.createDataFrame([("a", "OK_WAYBACK"), ("b", "WAYBACK_ERR")], "url string, s string")
    assert {tuple(r) for r in O.upsert(old, new, "url", ["s"], F.col("new_s") != "WAYBACK_ERR").collect()} == {("a", "OK_WAYBACK"), ("b", "OK")}
    rows = spark.range(100)
    assert O.sample_uniform(rows, "id", 10).collect() == O.sample_uniform(rows, "id", 10).collect()


def test_balanced_join_rejects_other_kinds(spark):
    with pytest.raises(ValueError):
        K.balanced_join(spark.range(1), spark.range(1), key=F.col("id"), matching_key=F.col("id"), row=F.col("id"), tasks=2, how="full")


def test_name_template_reads_all_titles(spark, tmp_path):
    from tessella.plans import registry

    rows = [(i, "en", "Staff letter" if i >= 40 else "Hotel") for i in range(0, 160, 8)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, title string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["tx_name_template"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("en", 1, "letter staff hotel", "Staff matters", "")]


@pytest.mark.parametrize("name, operator", [("tx_lda", "topics_by_language"), ("tx_top_words", "top_words_by_language")])
def test_topic_queries_use_the_topics_and_passes_of_the_operator(spark, tiny, monkeypatch, name, operator):
    from tessella.operators import topics
    from tessella.plans import registry

    asked = []
    monkeypatch.setattr(topics, operator, lambda docs, **options: asked.append(options) or docs)
    registry.queries()[name](spark, tiny)
    assert asked and not {"topics", "iterations"} & set(asked[0])


def test_a_codebook_of_several_automata_and_salted_words(spark, monkeypatch):
    from tessella.operators import matching as M
    from tessella.operators import phrases as P

    docs = spark.createDataFrame([(i, "en", "o", "c", f"alpha beta gamma {'delta' if i % 2 else 'beta'} word{i}") for i in range(12)], "doc_id bigint, lang string, outlet string, country string, text string")
    terms = spark.createDataFrame([(w, "regex") for w in ("alpha", "beta", "gamma", "delta", "word1")], "term string, mode string")
    whole = {tuple(r) for r in M.match_terms(docs, terms, key="doc_id", doc=F.col("text")).collect()}
    grams = sorted(map(tuple, P.ngrams(P.tokenised(docs)).collect()))
    monkeypatch.setattr(M, "MOST_TERMS", 2)
    monkeypatch.setattr(P, "MOST_BROADCAST_WORDS", 1)
    assert {tuple(r) for r in M.match_terms(docs, terms, key="doc_id", doc=F.col("text")).collect()} == whole and len(whole) > 40
    assert sorted(map(tuple, P.ngrams(P.tokenised(docs)).collect())) == grams and grams


def test_languages_of_all_ten(spark):
    from tessella.operators.topics import stop_word_language

    texts = {
        "en": "The clerk said that the office was closed", "es": "El tribunal dijo que no se abre para los otros", "fr": "Le conseil a dit que les autres ne sont pas dans la salle", "de": "Der Rat sagte dass die anderen nicht in dem Saal sind",
        "pt": "O conselho disse que os outros não estão na sala", "ru": "Совет передаёт протокол", "ja": "映画祭の理事会は日程を延期した", "zh": "电影节理事会推迟了时间表", "ar": "نشر مجلس المهرجان", "hi": "महोत्सव समिति ने",
    }
    rows = spark.createDataFrame([*texts.items(), ("none", "123"), ("null", None)], "code string, v string").select("code", stop_word_language(F.col("v")).alias("got")).collect()
    assert {r.code: r.got for r in rows} == {**{c: c for c in texts}, "none": None, "null": None}
