import numpy as np

from tessella.llm import languages as S

EN = "The tribunal clerk handed over the minutes of the meeting, while the staff waited outside with their lawyers."
FR = "Le conseil du festival a remis le compte rendu de la réunion, tandis que les salariées attendaient dans le quartier du port."
ES = "La junta del festival entregó el acta de la reunión, mientras los empleados esperaban en la antigua sala con otras personas."
DE = "Der Festivalvorstand überreichte das Protokoll der Sitzung, während die Angestellten im Hafenviertel auf den Richter warteten."
PT = "A direção do festival entregou as atas da reunião, enquanto os funcionários esperavam no antigo salão com outras pessoas."
RU = "Совет фестиваля передаёт протокол закрытого собрания в портовом районе."
JA = "映画祭の理事会は公聴会の日程を延期したが、江崎は社員食堂で待っていた。"
ZH = "电影节理事会推迟了听证会的时间表，而顾若宁在员工食堂等候。"
AR = "نشر مجلس المهرجان محضر الاجتماع المغلق في حي الميناء."
HI = "महोत्सव समिति ने बंद बैठक के विवरण को प्रकाशित किया।"
TEXTS = dict(en=EN, es=ES, fr=FR, de=DE, pt=PT, ru=RU, ja=JA, zh=ZH, ar=AR, hi=HI)


def frame(spark, rows):
    return spark.createDataFrame(rows, "url string, body string, title string, language string")


def wrong(spark, rows):
    found = S.document_languages(frame(spark, rows), key="url", text="body", title="title", label="language")
    return {(r.url, r.lang) for r in S.mislabelled(found, key="url").collect()}


def test_every_language_without_much_to_learn_from(spark):
    rows = [(code, text + "\n" + text, None, "xx") for code, text in TEXTS.items()]
    assert wrong(spark, rows) == {(code, code) for code in TEXTS}


def test_labels(spark):
    rows = [("a", EN, None, "en-US"), ("b", EN, None, "English"), ("c", EN, None, "eng"), ("d", EN, None, "fr"), ("e", EN, None, None), ("f", EN, None, " und "), ("g", None, FR, "fr"), ("h", "", FR, "en"), ("i", None, "nan", "en"), ("j", None, None, None), ("k", "123 — 45", None, "en")]
    assert wrong(spark, rows) == {("d", "en"), ("e", "en"), ("f", "en"), ("h", "fr")}


def test_mixed_texts_and_the_quarter(spark):
    rows = [("a", "\n\n".join([EN, EN, EN, FR]), None, "en"), ("b", "\n".join([EN] * 4 + [FR]), None, "en"), ("a", "\n\n".join([EN, EN, EN, FR]), None, "en")]
    assert wrong(spark, rows) == {("a", "en"), ("a", "fr")}


def test_look_alike_letters_stay_latin(spark):
    assert wrong(spark, [("a", EN.replace("a", "а").replace("o", "о"), None, "en")] + [(f"x{i}", EN, None, "en") for i in range(3)]) == set()


def test_segments_cover_a_switch(spark):
    text = EN + " " + RU + " " + EN
    rows = S.language_segments(spark.createDataFrame([("u", text), ("n", None), ("e", "")], "url string, body string"), key="url", text="body").orderBy("start_pos").collect()
    assert [r.lang for r in rows] == ["en", "ru", "en"] and all(0.9 < r.confidence <= 1 for r in rows)
    assert text[rows[1].start_pos : rows[1].end_pos] == RU.rstrip(".")


def test_viterbi_against_exhaustive_search():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = rng.integers(0, 6, 5)
        scores = rng.normal(size=(int(lengths.sum()), 3))
        labels = S.viterbi(scores, lengths, penalty=0.7)
        at = 0
        for n in lengths:
            part, path = scores[at : at + n], labels[at : at + n]

            def value(p):
                return sum(part[i][s] for i, s in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))

            if n:
                every = np.array(np.meshgrid(*[range(3)] * n)).T.reshape(-1, n)
                assert abs(value(list(path)) - max(value(list(p)) for p in every)) < 1e-9
            at += n


def test_empty_and_long(spark):
    empty = frame(spark, [("a", EN, None, "en")]).limit(0)
    assert S.document_languages(empty, key="url", text="body", title="title", label="language").count() == 0
    assert wrong(spark, [("a", (EN + " ") * 3000, None, "de")]) == {("a", "en")}


def test_a_long_run_of_han_is_scored_to_its_end(spark):
    scores = S.WordScores({"the": [3, 0, 0, 0, 0]}, {}, [1] * S.LATIN)
    run = "天地人山水火土木金日月年" + "听证会时间表员工书写东车门问间" * 2
    assert scores.score(run)[S.ZH] > scores.score(run)[S.JA]


def test_a_switch_has_its_price_after_any_number_of_words(spark):
    """Three foreign words inside a text don't make a segment, wherever they stand."""
    three = " Der Festivalvorstand nicht "
    for before in (100, 4090, 4096, 4097, 5000):
        words = (EN.replace(".", "").replace(",", "").split() * (before // 15 + 1))[:before]
        scores = S.WordScores({w.lower(): [20, 0, 0, 0, 0] for w in EN.replace(".", "").replace(",", "").split()} | {"der": [0, 0, 0, 9, 0], "festivalvorstand": [0, 0, 0, 2, 0], "nicht": [0, 0, 0, 9, 0]}, {}, [99] * S.LATIN)
        (_, _, _, labels, _), = S._segments_of([" ".join(words) + three + " ".join(words[:60])], scores)
        assert list(labels) == [0], before


def test_letters_of_other_languages_lower_the_confidence(spark):
    rows = [("ru", RU, None, None), ("uk", "Їхній виступ є її відповіддю", None, None), ("ar", AR, None, None), ("fa", "گزارش پیچیده‌ای که چاپ گشت", None, None)]
    found = S.document_languages(frame(spark, rows), key="url", text="body", title="title", label="language")
    sure = {r.url: r.confidence for r in found.collect()}
    assert sure["ru"] == sure["ar"] == 1.0 and sure["uk"] < 0.6 and sure["fa"] < 0.6


def test_words_are_learned_from_every_row(spark):
    """Words that one row of 12,000 has are known, whichever row it is."""
    words = [chr(0x1E01 + 2 * i) * 4 for i in range(12)]
    rows = [(f"r{i}", EN, None, "en") for i in range(12_000)]
    rows += [(f"s{i}", f"{FR} {w} {w}", None, "fr") for i, w in enumerate(words)] + [(f"w{i}", w, None, "fr") for i, w in enumerate(words)]
    assert wrong(spark, rows) == set()
    counts, _, lines = S.word_counts(frame(spark, rows), "body")
    assert {tuple(r)[1:] for r in counts.where(counts.w.isin(words)).collect()} == {(0, 0, 2, 0, 0)} and lines[0] == 12_000 * len(S._WORD.findall(EN))
