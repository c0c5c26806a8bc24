import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import encoding as E
from tessella.llm import packing as P
from tessella.llm import shared_spans as S


def windows(text, n):
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def brute_pairs(texts, n):
    ids = sorted(texts)
    sets = {i: windows(texts[i] or "", n) for i in ids}
    return {(a, b) for a in ids for b in ids if a < b and sets[a] & sets[b]}


def corpus(seed, n=25):
    random.seed(seed)
    letters = "ab é中🎉\n"
    texts = {i: "".join(random.choice(letters) for _ in range(random.randint(0, 160))) for i in range(n)}
    for i in range(5, n, 3):
        source = texts[i - 4]
        start = random.randrange(max(1, len(source)))
        cut = source[start : start + random.randint(15, 60)]
        at = random.randrange(len(texts[i]) + 1)
        texts[i] = texts[i][:at] + cut + texts[i][at:]
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_shares_and_removals_against_brute_force(spark, seed):
    texts = {**corpus(seed), 900: None, 901: "", 902: "x" * 300, 903: "x" * 250}
    df = spark.createDataFrame([(i, t, "q") for i, t in texts.items()] + [(902, "x" * 300, "q"), (None, "x" * 300, "q")], "cluster_id bigint, body string, digest string")
    runs = S.shared_runs(df, key="cluster_id", text="body", min_span=20, gram=9)
    assert {tuple(r) for r in S.sharing_pairs(runs).collect()} == brute_pairs(texts, 20)
    held = {r.cluster_id: (r.chars, r.shared_chars, r.removable_chars) for r in S.shared_share(df, runs, key="cluster_id", text="body", min_span=20).collect()}
    first = {}
    for i in sorted(texts):
        for w in windows(texts[i] or "", 20):
            first.setdefault(w, i)
    seen = {i: windows(t or "", 20) for i, t in texts.items()}
    for i, t in texts.items():
        t = t or ""
        shared, lost = set(), set()
        for p in range(len(t) - 19):
            w = t[p : p + 20]
            if any(w in seen[j] for j in texts if j != i):
                shared.update(range(p, p + 20))
            if first[w] != i:
                lost.update(range(p, p + 20))
        assert held[i] == (len(t), len(shared), len(lost))


def test_large_classes_are_paired_in_parts(spark, monkeypatch):
    random.seed(11)
    passage = "".join(random.choice("abcdefgh") for _ in range(40))
    texts = {i: f"{i:03d}" * 5 + passage + ("tail of some" if i % 3 else "") for i in range(23)}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "cluster_id bigint, body string")
    runs = S.shared_runs(df, key="cluster_id", text="body", min_span=20, gram=9)
    whole = {tuple(r) for r in S.sharing_pairs(runs).collect()}
    monkeypatch.setattr(S, "PART_MEMBERS", 4)
    assert {tuple(r) for r in S.sharing_pairs(runs).collect()} == whole == brute_pairs(texts, 20)
    classes = {}
    for r in S.sharing_classes(runs).collect():
        classes.setdefault(r["class"], (set(), r.members))[0].add(r.id)
    assert all(len(ids) == n for ids, n in classes.values())
    assert {(a, b) for ids, _ in classes.values() for a in ids for b in ids if a < b} == whole


def test_long_texts_are_read_in_segments(spark, monkeypatch):
    random.seed(7)
    base = "".join(random.choice("abcdefghij") for _ in range(5000))
    other = "".join(random.choice("klmnopqrst") for _ in range(3000)) + base[2400:2650] + "zz"
    monkeypatch.setattr(S, "SEGMENT_CHARS", 700)
    mine = set().union(*[set(part[1].tolist()) for part in S.unit_rows([base], 200, 120)])
    others = set().union(*[set(part[1].tolist()) for part in S.unit_rows([other], 200, 120)])
    assert mine & others


def test_empty_table(spark):
    df = spark.createDataFrame([], "cluster_id bigint, body string")
    runs = S.shared_runs(df, key="cluster_id", text="body")
    assert S.sharing_pairs(runs).count() == 0 and S.shared_share(df, runs, key="cluster_id", text="body").count() == 0


def test_hot_group_of_copies(spark):
    chooser = random.Random(1)
    text = "".join(chooser.choice("abcdefgh ") for _ in range(400))
    df = spark.createDataFrame([(i, text) for i in range(40)], "cluster_id bigint, body string")
    runs = S.shared_runs(df, key="cluster_id", text="body")
    assert S.sharing_pairs(runs).count() == 40 * 39 // 2
    lost = S.shared_parts(runs, lost_only=True).collect()
    assert len(lost) == 39 and all((r.start_pos, r.end_pos) == (0, 400) for r in lost)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'strevmld12,.é中ア🎉́ "), st.characters(codec="utf-8")), max_size=120), st.integers(1, 9))
def test_tree_of_ids_equals_plain_encoding(text, leaf):
    enc = E.encoding()
    ids = E.tree_encode(enc, text, leaf)
    assert ids == enc.encode_ordinary(text)
    assert E.tree_decode(enc, ids, 3).decode("utf-8") == text


def test_ids_equal_the_other_library(spark, tiny):
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    df = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").limit(60)
    special = spark.createDataFrame([(-1, "a <|endoftext|> b"), (-2, None), (-3, ""), (-4, "word " * 9000), (-5, "x" * 20000), (-6, "中" * 9000)], "doc_id bigint, text string")
    rows = df.union(special)
    got = {r.key: r.value for r in E.encode_column(rows.withColumnRenamed("doc_id", "key"), "key", "text").collect()}
    for r in rows.collect():
        assert got[r.doc_id] == (other.encode(r.text, add_special_tokens=False).ids if r.text else [])


def check_plan(sizes, capacity, plan):
    mine = plan.sort_values(["doc_id", "piece_no"])
    for doc, size in sizes.items():
        rows = mine[mine.doc_id == doc]
        assert rows.n_tokens.sum() == (size or 0)
        assert list(rows.start_token) == [i * capacity for i in range(len(rows))]
        assert len(rows) == max(1, -(-(size or 0) // capacity))
    assert plan.groupby("container_id").n_tokens.sum().max() <= capacity


def test_containers(spark):
    random.seed(2)
    sizes = {i: random.choice([0, 1, 5, 60, 99, 100, 101, 250, 1000]) for i in range(400)} | {1000: None}
    df = spark.createDataFrame([(i, s, "x") for i, s in sizes.items()], "doc_id bigint, tokens int, size string")
    got = P.container_plan(df, key="doc_id", size="tokens", budgets=[("small", 100), ("large", 700)], shard_items=64).toPandas()
    for name, capacity in (("small", 100), ("large", 700)):
        check_plan(sizes, capacity, got[got.budget_name == name])
    assert P.container_plan(df.limit(0), key="doc_id", size="tokens", budgets=[("small", 100)]).count() == 0
    assert P.container_plan(df, key="doc_id", size="tokens", budgets=[]).count() == 0
    with pytest.raises(ValueError):
        P.container_plan(df, key="doc_id", size="tokens", budgets=[("none", 0)])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_packing_keeps_capacity_and_wastes_little(sizes):
    at = P.pack_items(np.array(sizes, dtype=np.int64), 50)
    filled = pd.Series(sizes, dtype=float).groupby(at).sum() if sizes else pd.Series(dtype=float)
    assert not len(filled) or filled.max() <= 50
    assert not sizes or at.max() + 1 <= max(1, 2 * sum(sizes) / 50 + 1)


def test_unused_room_on_real_sizes(spark, tiny):
    df = E.encode_column(spark.read.parquet(f"{tiny}/../sf0.01/documents.parquet"), "doc_id", "text", only_count=True).withColumnRenamed("key", "doc_id")
    budgets = [("short", 512), ("standard", 2048), ("wide", 8192)]
    usage = {r.budget_name: r.unused_share for r in P.container_usage(P.container_plan(df, key="doc_id", size="value", budgets=budgets), budgets).collect()}
    assert max(usage.values()) < 0.06


def test_budgets_of_one_name_are_packed_apart(spark):
    df = spark.createDataFrame([(i, 30 + i % 50) for i in range(90)], "doc_id bigint, tokens int")
    got = P.container_plan(df, key="doc_id", size="tokens", budgets=[("a", 100), ("a", 120)], shard_items=32).toPandas()
    assert len(got) == 180 and not got.duplicated(["container_id", "doc_id"]).any()
    held = got.groupby("container_id").n_tokens.sum()
    assert held.max() <= 120 and (held > 100).any() and (got.groupby("doc_id").size() == 2).all()
