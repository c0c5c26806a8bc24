import datetime as dt
import random

from pyspark.sql import functions as F

from tessella.llm import survivors as S

SCHEMA = "cluster_id bigint, url string, title string, outlet string, source_country string, published timestamp_ntz, fetch_status string, fetched_at timestamp_ntz"


def day(n):
    return dt.datetime(2019, 1, 1) + dt.timedelta(days=n)


def pick(df, **more):
    fields = more.pop("fields", ["title"])
    chosen = S.surviving_bundles(df, group="cluster_id", member="url", bundles={f: (f,) for f in fields}, **more)
    return {(r.cluster_id, r.bundle): r.url for r in chosen.collect()}


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_order_of_trust(spark):
    df = rows(spark, (1, "a", "t", None, None, None, "FAILED:1", day(9)), (1, "b", "t", None, None, None, "OK", day(1)), (1, "c", "t", None, None, None, "OK_WAYBACK", day(2)), (1, "d", "NaN", None, None, None, "OK", day(8)))
    assert pick(df) == {(1, "title"): "c"}


def test_missing_values_and_ties(spark):
    epoch = dt.datetime(1970, 1, 1)
    df = rows(
        spark, (1, "b", "not_applicable", "o", None, epoch, "OK", None), (1, "a", "not_applicable", "o", "UNKNOWN", None, "OK", None), (1, "a", "not_applicable", "o", "UNKNOWN", None, "OK", None),
        (2, "c", "  ", "o", "-", epoch, "OK", day(1)), (None, "z", "t", None, None, None, "OK", None),
    )
    got = pick(df, fields=["title", "source_country", "published"])
    assert got == {(1, "title"): "a"}


def test_equal_to_brute_force(spark):
    random.seed(4)
    values = []
    for c in range(30):
        for m in range(random.randint(1, 6)):
            values.append((c, f"u{c}-{m}", random.choice(["t", "", None, "null", "x y"]), None, None, None, random.choice(["OK", "FAILED:2", None]), day(random.randint(0, 5))))
    want = {}
    for c in range(30):
        good = [v for v in values if v[0] == c and v[2] in ("t", "x y")]
        if good:
            want[(c, "title")] = min(good, key=lambda v: (v[6] != "OK", -v[7].timestamp(), v[1]))[1]
    assert pick(rows(spark, *values)) == want
    assert pick(rows(spark, *values).limit(0)) == {}


def test_dependency_chooses_consistent_bundles(spark):
    # the corpus states alpha -> France; the most trusted country of cluster 9 belongs to another outlet
    filler = [(i, f"f{i}", None, "alpha", "France", None, "OK", day(0)) for i in range(3)] + [(i, f"g{i}", None, "beta", "Spain", None, "OK", day(0)) for i in range(3, 6)]
    df = rows(spark, *filler, (9, "x", None, "alpha", None, None, "OK", day(9)), (9, "y", None, None, "Spain", None, "OK", day(8)), (9, "z", None, None, "France", None, "FAILED:1", day(1)))
    got = pick(df, fields=["outlet", "source_country"], dependency=("outlet", "source_country"))
    assert got[(9, "outlet")] == "x" and got[(9, "source_country")] == "z"


def test_branches_against_exhaustive_search(spark):
    random.seed(8)
    values = []
    for c in range(25):
        for m in range(random.randint(2, 6)):
            values.append((c, f"u{c}-{m}", None, random.choice(["alpha", "beta", "gamma", None]), random.choice(["France", "Spain", None]), None, random.choice(["OK", "FAILED:1"]), day(random.randint(0, 40))))
    pairs = {}
    for v in values:
        if v[3] and v[4]:
            pairs[(v[3], v[4].lower())] = pairs.get((v[3], v[4].lower()), 0) + 1
    stated = {x: min((y for (a, y) in pairs if a == x), key=lambda y: (-pairs[(x, y)], y)) for x in {a for a, _ in pairs}}

    def trust(v):
        return S.FILLED_WEIGHT + (S.STATUS_WEIGHT if v[6] == "OK" else 0) + int(v[7].replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)

    got = pick(rows(spark, *values), fields=["outlet", "source_country"], dependency=("outlet", "source_country"))
    by_url = {v[1]: v for v in values}
    for c in range(25):
        members = [v for v in values if v[0] == c]
        best = 0
        for a in members:
            if a[3]:
                partners = [b for b in members if b[4] and (a[3] not in stated or stated[a[3]] == b[4].lower())]
                best = max(best, trust(a) + max(map(trust, partners), default=0))
        if any(v[3] for v in members):
            total = trust(by_url[got[(c, "outlet")]]) + (trust(by_url[got[(c, "source_country")]]) if (c, "source_country") in got else 0)
            assert total == best


def test_members_with_clashing_columns(spark):
    mapped = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (None, "d"), (3, None)], "cluster_id bigint, url string")
    articles = rows(spark, (7, "a", "t", None, None, None, "OK", day(1)), (8, "b", "u", None, None, None, "OK", day(2))).withColumn("cluster_id", F.lit(5).cast("bigint")).withColumn("one", F.lit(1))
    members = S.cluster_members(mapped, articles, ["title"])
    assert pick(members) == {(1, "title"): "b"}


def test_two_dependencies_against_exhaustive_search(spark):
    """A chain outlet -> source_country -> title: every choice of members is tried."""
    random.seed(18)
    values = []
    for c in range(20):
        for m in range(random.randint(2, 4)):
            values.append((c, f"u{c}-{m}", random.choice(["s", "t", None]), random.choice(["alpha", "beta", None]), random.choice(["France", "Spain", None]), None, random.choice(["OK", "FAILED:1"]), day(random.randint(0, 40))))
    rules = [("outlet", 3, "source_country", 4), ("source_country", 4, "title", 2)]
    stated = {}
    for _, i, _, j in rules:
        counts = {}
        for v in values:
            if v[i] and v[j]:
                counts[v[i], v[j].lower()] = counts.get((v[i], v[j].lower()), 0) + 1
        stated[i] = {x: min((y for a, y in counts if a == x), key=lambda y: (-counts[x, y], y)) for x, _ in counts}

    def trust(v):
        return S.FILLED_WEIGHT + (S.STATUS_WEIGHT if v[6] == "OK" else 0) + int(v[7].replace(tzinfo=dt.timezone.utc).timestamp() * 1e6) if v else 0

    def kept(choice):
        return all(not choice[i] or not choice[j] or stated[i].get(choice[i][i]) in (None, choice[j][j].lower()) for _, i, _, j in rules)

    got = pick(rows(spark, *values), fields=["outlet", "source_country", "title"], dependencies=[r[::2] for r in rules])
    by_url = {v[1]: v for v in values}
    for c in range(20):
        members = [v for v in values if v[0] == c]
        options = {i: [v for v in members if v[i]] for i in (3, 4, 2)}
        best = max(
            trust(a) + trust(b) + trust(d) for a in options[3] or [None] for b in [*options[4], None] for d in [*options[2], None] if kept({3: a, 4: b, 2: d})
        )
        mine = {i: by_url.get(got.get((c, f))) for i, f in ((3, "outlet"), (4, "source_country"), (2, "title"))}
        assert kept(mine) and sum(map(trust, mine.values())) == best


def test_a_bundle_comes_from_one_row(spark):
    """Two rows of one url don't mix: a record's bundle is one of them."""
    df = rows(spark, (1, "u", "pageB", "A-place", None, None, "OK", day(1)), (1, "u", "pageA", "Z-place", None, None, "OK", day(1)), (1, "v", None, None, "France", None, "OK", day(1)))
    bundles = {"page": ("title", "outlet"), "origin": ("source_country",)}
    record = S.surviving_records(S.surviving_bundles(df, group="cluster_id", member="url", bundles=bundles, carry=True), bundles, group="cluster_id", member="url").first()
    assert (record.title, record.outlet) in {("pageB", "A-place"), ("pageA", "Z-place")} and record.source_country == "France" and record.page_from == "u"


def test_a_hot_group_is_branched(spark):
    """One group holds nearly all rows."""
    values = [(1, f"u{i}", None, f"o{i % 50}", None, None, "OK", day(i % 40)) for i in range(400)] + [(1, f"w{i}", None, None, f"c{i % 30}", None, "OK", day(i % 40)) for i in range(400)]
    values += [(2, f"s{i}", None, f"o{i}", f"c{i + 25}", None, "FAILED:1", day(0)) for i in range(5)]
    got = pick(rows(spark, *values), fields=["outlet", "source_country"], dependency=("outlet", "source_country"))
    assert {k[0] for k in got} == {1, 2} and len(got) == 4
