from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions.stats import log_likelihood, wilson
from tessella.operators import columns as C
from tessella.operators.repair import fix_mojibake, repaired_text


def one(spark, value, *columns, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(*columns).first()


def test_norm_url(spark):
    assert one(spark, "https://www.a.com/x/?q=1#t", X.norm_url(F.col("v")))[0] == "a.com/x"
    assert one(spark, None, X.norm_url(F.col("v")))[0] is None


def test_norm_title_and_null(spark):
    assert one(spark, " Élan — PARTAGÉ! ", X.norm_title(F.col("v")))[0] == "elan partage"
    assert one(spark, None, X.norm_title(F.col("v")))[0] == ""


def test_rot47_turns_back(spark):
    assert one(spark, "kAmp?5 r2C=D@?", X.rot47(F.col("v")))[0] == "<p>And Carlson"
    assert one(spark, "Any text, 1!", X.rot47(X.rot47(F.col("v"))))[0] == "Any text, 1!"


def test_short_text_gives_words_as_shingles(spark):
    assert sorted(one(spark, "a b c", X.shingles(F.col("v")))[0]) == ["a", "b", "c"]
    assert one(spark, "a b c d e f", X.shingles(F.col("v")))[0] == ["a b c d e", "b c d e f"]


def test_borders_of_terms(spark):
    bounded = X.bounded_contains(F.col("v"), F.lit("viol"))
    assert one(spark, "le viol, dit-il", bounded)[0]
    assert not one(spark, "violência e éviol", bounded)[0]
    assert one(spark, "viol", bounded)[0]
    assert not one(spark, "", bounded)[0]


def test_article_type_precedence(spark):
    assert one(spark, "https://a.b/analysis/opinion/", C.article_type(F.col("v"), F.lit(None).cast("string")))[0] == "Analysis"
    assert one(spark, "https://a.b/x", C.article_type(F.col("v"), F.lit("Opinion: why")))[0] == "Opinion/Editorial"


def test_stance_and_classes(spark):
    assert one(spark, 1, C.article_stance(F.col("v"), F.lit(1)), kind="int")[0] == "Mixed"
    assert one(spark, "#a | b", C.match_class(X.kw_list(F.col("v"))))[0] == "both"
    assert one(spark, None, C.match_class(X.kw_list(F.col("v"))))[0] == "none"


def test_stale_year(spark):
    assert one(spark, "in 2024 it", C.stale(F.col("v")))[0]
    assert not one(spark, "in 12024 it", C.stale(F.col("v")))[0]


def test_wilson(spark):
    low, high = wilson(F.lit(180.0), F.lit(199.0))
    row = one(spark, "x", low, high)
    assert abs(row[0] - 0.86) < 0.01 and abs(row[1] - 0.94) < 0.01
    low, high = wilson(F.lit(0.0), F.lit(0.0))
    assert tuple(one(spark, "x", low, high)) == (0.0, 0.0)


def test_log_likelihood_of_an_impossible_table(spark):
    assert one(spark, "x", log_likelihood(F.lit(5), F.lit(3), F.lit(9), F.lit(100)))[0] == 0.0


def test_mojibake(spark):
    assert one(spark, "prisiÃ³n", fix_mojibake(F.col("v")))[0] == "prisión"
    assert one(spark, "prisión Ã", fix_mojibake(F.col("v")))[0] == "prisión Ã"


def turn(text):
    return "".join(chr(33 + (ord(c) - 33 + 47) % 94) if 33 <= ord(c) <= 126 else c for c in text)


def test_turned_text_is_repaired(spark):
    sentence = "The clerk said that the office, 23 of its staff and a lawyer had agreed on all of it by Friday"
    cases = {
        "A plain lead.\n" + turn(f"<p>{sentence}</p>"): "A plain lead.\n" + sentence,
        turn(f"<p>{sentence}\nOn two lines.</p>") + " Plain again.": f"{sentence}\nOn two lines. Plain again.",
        "Plain words stand here before it " + turn(sentence) + " and here after it": f"Plain words stand here before it {sentence} and here after it",
        turn(f"<p>{sentence}"): f" {sentence}", turn("<p></p>"): "", "kAm": "kAm", "": "", None: None,
        "Nothing to do here.": "Nothing to do here.", "kAm 2345 6789 4567 2345 6789 3456 2345 6789": "kAm 2345 6789 4567 2345 6789 3456 2345 6789",
        "The code E96 is listed beside many plain words of an article that nobody turned": "The code E96 is listed beside many plain words of an article that nobody turned",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", repaired_text(F.col("v")).alias("r")).collect()
    assert {r.v: r.r for r in rows} == cases


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 9)), st.sets(st.integers(0, 9)))
def test_jaccard_is_symmetric(a, b):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    row = spark.createDataFrame([(sorted(a), sorted(b))], "a array<int>, b array<int>").select(X.jaccard(F.col("a"), F.col("b")), X.jaccard(F.col("b"), F.col("a"))).first()
    assert row[0] == row[1] == (len(a & b) / len(a | b) if a and b else 0.0)


def test_accents_against_the_unicode_tables(spark):
    import unicodedata

    words = ["Việt Nam", "ﬁancé", "Ｆｕｌｌ", "Ἀθῆναι", "مُحَمَّد", "क़लम", "がぎぐ", "ﾊﾝｶｸ", "\U0001d400\U0001d41b", "été", "Ǆ", "ñandú", "①②", ""]
    rows = spark.createDataFrame([(w,) for w in words], "v string").select("v", X.strip_accents(F.col("v")).alias("r")).collect()
    assert {r.v: r.r for r in rows} == {w: "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)) for w in words}


def test_entities_against_the_standard_library(spark):
    import html

    texts = ["viol&#xEA;ncia &amp; p&eacute;rdida", "&amp;lt; &lt;b&gt;", "&#39;&#8217;&#x2019;&hellip;", "&nosuch; & && &;", "&#128; &#0; &#x110000; &#xD800;", "a &NotEqualTilde; b", "", "plain", "&&amp;&"]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", X.html_unescape(F.col("v")).alias("r")).collect()
    assert {r.v: r.r for r in rows} == {t: html.unescape(t) for t in texts}
