import random
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import lookalikes as L
from tessella.llm import site_lines as S


def brute(rows, least=6):
    count, seen = defaultdict(set), set()
    for url, outlet, text in rows:
        if url is not None and outlet is not None and text is not None:
            for i, line in enumerate(text.split("\n")):
                form = re.sub(r"[0-9]+", "0", re.sub(r"\s+", " ", line.lower()).strip())
                if form:
                    count[outlet.lower().strip(), form].add(url)
                    seen.add((url, i, outlet.lower().strip(), form))
    return {(u, i) for u, i, o, f in seen if len(count[o, f]) >= least}


def test_repeated_lines_against_brute_force(spark):
    random.seed(6)
    lines = ["Share this story", "SHARE this  story ", "Updated 12.3.2018", "Updated 1.12.2019", "", "  ", "The clerk of the tribunal published the list of reports", "x", "٣ items", "4 items", "5 items"]
    rows = [(f"u{i}", random.choice(["A.example", "a.example ", "b", None]), "\n".join(random.choice(lines) for _ in range(5))) for i in range(80)]
    rows += [(None, "b", "x"), ("n", "b", None), ("e", "b", ""), *rows[:5]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "url string, outlet string, body string, src int")
    got = S.repeated_lines(df, key="url", source="outlet", text="body").collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(set(map(tuple, got)))
    near = {tuple(r) for r in S.near_repeated_lines(df, key="url", source="outlet", text="body").collect()}
    assert brute(rows) <= near
    assert S.repeated_lines(df.limit(0), key="url", source="outlet", text="body").count() == 0


def test_near_lines_share_a_cluster_and_texts_are_cleaned(spark):
    rows = [(f"u{i}", "a", f"By {n} for the paper\nBody number {i} of its own kind {'abcdefgh'[i] * 5}") for i, n in enumerate(["Anna", "Bela", "Cora", "Dora", "Enid", "Fay"])]
    df = spark.createDataFrame(rows, "url string, outlet string, body string")
    near = S.near_repeated_lines(df, key="url", source="outlet", text="body")
    assert {tuple(r) for r in near.collect()} >= {(f"u{i}", 0) for i in range(6)}
    clean = {r.url: r.clean_text for r in S.without_lines(df, S.repeated_lines(df, key="url", source="outlet", text="body"), key="url", text="body").collect()}
    assert clean["u0"] == rows[0][2]


def test_hot_line_counts_documents_not_rows(spark):
    df = spark.createDataFrame([("same", "a", "line\nline\nline")] * 20, "url string, outlet string, body string")
    assert S.repeated_lines(df, key="url", source="outlet", text="body").count() == 0


KEYWORDS = [(1, "hush clause"), (2, "HUSH CLAUSE"), (3, "señal común"), (4, "#NoMoreHush"), (5, "ヒソヒソ条約"), (6, "half-told story"), (7, None), (8, "​"), (9, "Türspaltregel")]


def hidden(spark, texts):
    df = spark.createDataFrame([(f"u{i}", t, "k") for i, t in enumerate(texts)], "url string, body string, kw string")
    return {(r.url, r.kw_id) for r in L.hidden_mentions(df, KEYWORDS, key="url", text="body").collect()}


def test_hidden_mentions(spark):
    texts = [
        "a hush clause here", "a ｈｕｓｈ ｃｌａｕｓｅ", "a hu​sh clause", "a hush сlause", "señal común", "#\U0001d40d\U0001d428MoreHush", "ﾋｿﾋｿ条約", "half‑told  story", "senal comun", None, "", "Türspaltregel",
        "＃noмorehush", "hushclause", "half told story", "a HUSH\tCLAUSE",
    ]
    got = hidden(spark, texts)
    assert got == {("u1", 1), ("u1", 2), ("u2", 1), ("u2", 2), ("u3", 1), ("u3", 2), ("u4", 3), ("u5", 4), ("u6", 5), ("u7", 6), ("u11", 9), ("u12", 4), ("u15", 1), ("u15", 2)}


def test_classes_are_transitive_and_represented_by_frequency():
    uf = L.character_classes("eе℮ＥE")
    assert len({uf.find(c) for c in "eеＥE"}) == 1
    table = L.folding_table({ord("е"): 9, ord("e"): 2, ord("Ｅ"): 1})
    assert L.fold("eＥе", table) == "еее"
    classes = L.keyword_classes([(1, "Hush"), (2, "ｈush"), (3, "hush"), (4, "hush")], L.folding_table({ord(c): 5 for c in "hush"}, extra="ｈH"))
    assert list(classes.values()) == [("hush", [1, 2, 3, 4])]


def test_rewriting_is_leftmost_longest():
    table = L.folding_table({ord(c): 5 for c in "abcx dＡｃ"})
    classes = L.keyword_classes([(1, "AB"), (2, "ab cd")], table)
    assert L.rewrite("x Ａb ｃd ab", table, classes, L.automaton(classes)) == "x ab cd AB"


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_folding_twice_changes_nothing_more(text):
    table = L.folding_table({ord(c): 1 for c in text if not 0xD800 <= ord(c) < 0xE000})
    once = L.fold(text, table)
    again = L.folding_table({**{ord(c): 1 for c in text if not 0xD800 <= ord(c) < 0xE000}, **{ord(c): 1 for c in once}})
    assert L.fold(once, again) == L.fold(text, again)


def test_near_lines_against_brute_force(spark):
    """Lines that differ in their first words and in blanks are one component, though the first and the last are less alike; fewer documents than the least are none."""
    draw = random.Random(9)
    stock = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ala", "ero", "imi", "otu", "usa")]
    bases = [draw.sample(stock, 60) for _ in range(12)]
    rows = []
    for g, base in enumerate(bases):
        for d in range(6 if g % 3 else 5):
            rows.append((f"g{g}d{d}", "a", (" " if d % 2 else "\u00a0 ").join(base[3 * d :])))
    df = spark.createDataFrame(rows, "url string, outlet string, body string")

    def shingles(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    sets = {u: shingles(t) for u, _, t in rows}
    group = {u: {u} for u in sets}
    for u in sets:
        for v in sets:
            if len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v]) and group[u] is not group[v]:
                group[u] |= group[v]
                for w in list(group[u]):
                    group[w] = group[u]
    expected = {(u, 0) for u in sets if len(group[u]) >= 6}
    assert {tuple(r) for r in S.near_repeated_lines(df, key="url", source="outlet", text="body").collect()} == expected
    assert expected


def test_near_lines_with_months_and_wide_scripts(spark):
    months = ["enero", "febrero", "marzo", "abril", "mayo", "junio"]
    rows = [(f"m{i}", "a", f"publicado el {i + 1} de {m} por la redacción del diario") for i, m in enumerate(months)]
    wide = "この記事の無断転載を禁じます著作権は当社に帰属します詳しくは利用規約をご覧ください担当は"
    rows += [(f"w{i}", "b", wide + x) for i, x in enumerate("一二三四五六")]
    df = spark.createDataFrame(rows, "url string, outlet string, body string")
    assert {r.url for r in S.near_repeated_lines(df, key="url", source="outlet", text="body").collect()} == {r[0] for r in rows}


def test_texts_are_cleaned_of_near_lines_too(spark):
    rows = [(f"u{i}", "a", f"By {n} for the paper\nShare this story\nBody number {i} of its own kind {'abcdefgh'[i] * 5}") for i, n in enumerate(["Anna", "Bela", "Cora", "Dora", "Enid", "Fay"])]
    rows += [("n", "a", None), ("o", None, "Share this story")]
    df = spark.createDataFrame(rows, "url string, outlet string, body string")
    clean = {r.url: r.clean_text for r in S.without_repeated(df, key="url", source="outlet", text="body").collect()}
    assert clean == {u: t and t.split("\n")[-1] for u, _, t in rows}


def test_representative_is_the_spelling_most_frequent_in_the_texts(spark):
    rows = [("a", "the Hush here"), ("b", "a Hush and a hush"), ("c", None), ("d", "no mention"), ("a", "the Hush here")]
    df = spark.createDataFrame(rows, "url string, body string")
    keywords = [(1, "hush"), (2, "hush"), (3, "Hush")]
    assert {r.keyword for r in L.mention_counts(df, keywords, key="url", text="body").collect()} == {"Hush"}
    got = sorted((r.url, r.rewritten) for r in L.rewritten_texts(df, keywords, key="url", text="body").collect())
    assert [(u, t.count("Hush") if t else t) for u, t in got] == [("a", 1), ("b", 2), ("c", None), ("d", 0)]


def test_marks_in_another_order_and_letters_of_three_scripts(spark):
    keywords = [(1, "Việt lê"), (2, "ГоворимВслух"), (3, "névoa vaga"), (4, "banana nova")]
    texts = ["Vie\u0302\u0323t le\u0302", "Vie\u0323\u0302t le\u0302", "ΓоворимВслух", "né\u03bdoa \u03bdaga", "ba\u039dana \u039dova", "bavava vova"]
    df = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)], "url string, body string")
    got = {(r.url, r.kw_id) for r in L.hidden_mentions(df, keywords, key="url", text="body").collect()}
    assert got == {("u0", 1), ("u1", 1), ("u2", 2), ("u3", 3), ("u4", 4)}


def test_nodes_of_a_large_bucket_are_all_compared(spark):
    """700 nodes share one band: each is like one other, and hardly any like the least of the bucket."""
    draw = random.Random(4)
    rows, pairs = [], 350
    for m in range(2 * pairs):
        own = random.Random(m % pairs).sample(range(1 << 30), 20)
        words = own if m < pairs else own[1:] + [draw.randrange(1 << 30)]
        rows.append((f"d{m}", 0, m, m, m, 20, [-1] + [1000 * m + i for i in range(1, S.BANDS)], 0, words))
    lines = spark.createDataFrame(rows, "doc string, line_no int, k1 bigint, k2 bigint, m bigint, n int, bands array<bigint>, sketch bigint, sh array<int>")
    assert {tuple(r) for r in S.line_clusters(lines).select("m", "component").collect()} == {(m, m % pairs) for m in range(2 * pairs)}


def test_links_of_a_block_connect_what_all_pairs_do():
    draw = random.Random(8)
    for size in (0, 1, 40):
        sets = [set(draw.sample(range(draw.choice([25, 6000])), 20)) for _ in range(size)]
        sets += [set(list(x)[draw.randrange(4) :]) for x in sets]
        a, b = S.block_links(S.pa.array([sorted(x) for x in sets], S.pa.list_(S.pa.int32())), 0.8)

        def joined(links):
            group = list(range(len(sets)))
            for x, y in links:
                group = [group[x] if g == group[y] else g for g in group]
            return {frozenset(i for i, g in enumerate(group) if g == h) for h in group}

        every = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        assert joined(zip(a.tolist(), b.tolist())) == joined(every) and len(a) < max(len(sets), 1)


def test_sketches_rule_out_no_pair_that_is_similar():
    """Sets differ in as many shingles at least as their sketches in bits."""
    draw = random.Random(3)
    for size in (1, 5, 9, 40, 300):
        for _ in range(60):
            one = draw.sample(range(1 << 62), size)
            other = one[size // 10 :] + draw.sample(range(1 << 62), size // 10)
            made = S.np.array(sorted(one) + sorted(other), dtype=S.np.uint64)
            (a, b) = S.signatures(made, S.np.array([0, size]))[1].tolist()
            assert (a ^ b).bit_count() <= len(set(one) ^ set(other))
