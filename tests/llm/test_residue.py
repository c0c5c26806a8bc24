import pytest

from tessella.llm import residue as S

PROSE = "The tribunal clerk handed over the minutes of the closed meeting outside the courthouse on Tuesday, according to Vira Denholm of the transit union."
CASES = [
    "404 Not Found: the page /news/a-b could not be found. Reference XYZQWRT.",
    "Please enable JavaScript to view alpha-beta. Ticket QWRTZPL.\n© 2019 Somepost. All rights reserved.",
    "{{title-one}} (QWRTZPL)\n{{body.two}} - three",
    "Dear ${name.one}, your item on ${section_two} ${body-three} will appear here",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Magna aliqua ut enim.",
    "TK TK TK headline TK body TK (QWRTZPL)",
    "お探しのページ /a/b は見つかりませんでした(QWRTZPL)\nこの記事を共有する",
    "Страница /a/b не найдена. Код QWRTZPL.",
    "We use cookies on alpha-beta. Accept all or manage choices. Consent string QWRTZPL",
    "asdf alpha-beta asdf jkl QWRTZPL asdf qwer",
]
NO_CASES = [
    PROSE, PROSE + "\n404 Not Found: the page /news/a could not be found.", "La page affichait « page introuvable », a noté Vira Denholm, et la radio régionale a demandé à lire le compte rendu de la réunion fermée près de Dalen.",
    "The form still read {{name}} when Vira Denholm opened it, and the transit union quietly withdrew the list of unanswered reports near Dalen.", "Share this story", "", "   ", None,
    "Readers were told to enable JavaScript, Vira Denholm complained, and the hotel chain handed over a draft code for touring crews near Dalen.",
]


def found(spark, texts):
    df = spark.createDataFrame([(f"u{i}", t, "x") for i, t in enumerate(texts)], "url string, body string, doc string")
    return {r.url for r in S.residue_documents(df, key="url", text="body").collect()}


def test_cases_and_no_cases(spark):
    assert found(spark, CASES) == {f"u{i}" for i in range(len(CASES))}
    assert found(spark, NO_CASES) == set()


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([("u", CASES[0]), ("u", CASES[0]), (None, CASES[0])], "url string, body string")
    assert [r.url for r in S.residue_documents(df, key="url", text="body").collect()] == ["u"]
    assert S.residue_documents(df.limit(0), key="url", text="body").count() == 0
    assert S.without_residue(df.where("url is not null"), key="url", text="body").count() == 0


def test_templates_are_aligned_at_their_words(spark):
    texts = [f"Kindly note the resource {w} was not found by the router under {w}x." for w in ("anna", "bela", "cora", "dora", "enid")]
    pages = spark.createDataFrame(list(enumerate(texts)), "page bigint, text string")
    made = S.templates(S.described_lines(pages)).collect()
    tokens = [S.line_tokens(t) for t in texts]
    shared = [t if all(x[i] == t for x in tokens) else None for i, t in enumerate(tokens[0])]
    assert made and all(r.template == shared[: len(r.template)] and r.support == 5 for r in made)
    assert shared[4] is None and shared[-1] is None and sum(t is not None for t in shared) == 11


def invented(n):
    """Three templates that no phrase of the lexicon is in, with one record for each number below n."""
    code = [f"{chr(65 + i % 26)}{chr(65 + i // 26 % 26)}{i * 7919 % 100000}" for i in range(n)]
    return (
        [f"Our machines dropped the thing you wanted. Quote {c} when you write to us about it." for c in code],
        [f"Dear FIRST_NAME LAST_NAME, thank you for reading ARTICLE_TITLE by AUTHOR.\nShare this story {c}" for c in code],
        [f"By [Author Name] on [Date]\n____ said on ____ that it was so.\nShare this story {c}" for c in code],
    )


def test_templates_without_any_phrase_of_the_lexicon_are_found(spark):
    pages = [t for template in invented(60) for t in template] + [PROSE]
    assert found(spark, pages) == {f"u{i}" for i in range(180)}


def test_what_the_lexicon_and_the_templates_add(spark):
    """Notices are found by their templates alone; few records of one need the lexicon; without mates and without a phrase nothing is found."""
    many = [c.replace("QWRTZPL", f"Q{i}X{i * 7}").replace("XYZQWRT", f"R{i}Y{i * 3}") for c in CASES[:8] for i in range(60)]
    df = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(many)], "url string, body string")
    alone = S.residue_documents(df, key="url", text="body", lexicon=False).count()
    assert alone >= 0.7 * len(many) and found(spark, many) == {f"u{i}" for i in range(len(many))}
    assert found(spark, [template[0] for template in invented(1)][:1]) == set()


def test_a_very_long_article_with_a_mention(spark):
    assert found(spark, [(PROSE + "\n") * 3000 + "Please enable JavaScript to view x."]) == set()


@pytest.mark.parametrize("line", ["{{a}}", "<%= x %>", "%%NAME%%", "[[title]]", "${x}", "#{y}", "<?php echo $t; ?>", "{headline}"])
def test_placeholder_syntax(line):
    assert S.describe_line(line)["kind"] == "residue"


def test_unfilled_slots_of_lines_without_a_cue(spark):
    """Lines are aligned over all records by their shape; placeholders, defaults and blanks in its slots are residue, values aren't."""
    line = "This article by {} was published in our newspaper of the city"
    filled = [line.format(f"{n} Vorin") + f"\n{n}" for n in ("Anna", "Bela", "Cora", "Dora", "Enid", "Fay")]
    empty = [line.format(x) + "\nShare this story" for x in ("{{author}}", "undefined", "")]
    assert found(spark, filled + empty) == {"u6", "u7", "u8"}
    assert found(spark, [line.format("{{author}}") + f"\nSection {x}" for x in "abc"]) == {"u0", "u1", "u2"}
    assert found(spark, [line.format("undefined")] * 4) == set()


def test_copies_and_shapes_of_articles_that_mention_a_placeholder_are_no_cases(spark):
    mention = "The form still read {{{{name}}}} when {} opened it, and the transit union withdrew the list near Dalen."
    assert found(spark, [mention.format("Vira Denholm")] * 5 + [mention.format(f"{n} Roe") for n in ("Anna", "Bela", "Cora", "Dora")]) == set()


def test_a_long_notice_is_residue_if_its_template_covers_it(spark):
    long = "We use cookies on {} so that our partners and we can measure how pages are read, keep you signed in, remember what you chose on earlier visits and show you offers that fit; you may change this at any time in the settings."
    texts = [long.format(x) for x in ("alpha", "beta", "gamma", "delta")]
    assert S.describe_line(texts[0])["size"] > S.NOTICE_WORDS
    assert found(spark, texts) == {f"u{i}" for i in range(4)}
    assert found(spark, texts[:1]) == set()
    assert found(spark, ["Readers were told to enable JavaScript, Vira Denholm complained, and the hotel chain handed over a draft code for touring crews near Dalen, where the board met on Tuesday."] * 4) == set()
