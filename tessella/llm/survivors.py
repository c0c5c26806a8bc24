"""Problem 1: one surviving record for each group of duplicates, bundle by bundle.

A bundle is a set of fields that depend on each other and survive together from one row
of one member. A row can give a bundle if at least one of its fields is filled; more filled
fields, a trusted status, and a later time win, in that order, and the smaller member
key among what is equal. Functional dependencies ``determinant -> dependent`` link bundles: where both survive,
the dependent's value must be the one that the corpus states most often for the determinant's; a dependent bundle may stay empty for that.
The choice is by branch and bound over the sum of trust:

* root: every bundle takes its best row. That sum bounds all choices from above, so groups whose root keeps all dependencies are
  done, and without dependencies all are;
* the others branch, one linked bundle after the other: each value of a determinant is a branch, a stated partner is looked up by its value.
  Of branches that ask the same of the bundles to come only the best stays, and those whose sum with the best of all
  bundles to come doesn't reach the incumbent (the best determinants alone, which every group can have) are cut.

Everything is an aggregation with map-side combine or a join on (group, value) after it; what is joined on the group alone is salted, so a
group that holds a third of all rows is never collected anywhere.

Missing values: null, blank, a word or sign that only stands for a missing value, the
first instant of 1970. A group whose members have no filled value of a bundle has no
row for it. Repeated rows and ties don't change the result; an empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import cut_lineage

# Words and signs that only stand for a missing value, in lower case.
MISSING_WORDS = (
    "nan", "null", "none", "nil", "na", "n/a", "n.a.", "n.a", "#n/a", "<na>", "nat", "unknown", "undefined", "und", "missing", "empty", "blank",
    "not available", "not_available", "notavailable", "no data", "no value", "not set", "unset", "unspecified", "tbd", "tba", "void", "(null)", "[null]",
    "(none)", "<null>", "<none>", "(unknown)", "(blank)", "(empty)", "-", "--", "---", "–", "—", "?", "??", "???", ".", "..", "...", "…", "/", "*", "_", "x",
)
#: Status values of a trusted fetch.
TRUSTED_STATUS = ("OK", "OK_WAYBACK")
#: Weights in microseconds: a trusted status outweighs any time, a filled field any status.
STATUS_WEIGHT = 2**53
FILLED_WEIGHT = 2**55
NO_TIME = -(2**52)
FOUND_FIELDS = ("title", "published", "source_country", "fetched_title", "stance", "evidence")


def filled(column: str | Column, kind: str) -> Column:
    """Whether a value says something; see the module's text."""
    c = F.col(column) if isinstance(column, str) else column
    if kind == "string":
        word = F.lower(F.regexp_replace(c, r"^[\s\p{Z}\x{85}\x{200B}\x{FEFF}]+|[\s\p{Z}\x{85}\x{200B}\x{FEFF}]+$", ""))
        return c.isNotNull() & (word != "") & ~word.isin(*MISSING_WORDS)
    if kind.startswith("timestamp"):
        return c.isNotNull() & (c != F.lit("1970-01-01 00:00:00").cast(kind))
    if kind == "date":
        return c.isNotNull() & (c != F.lit("1970-01-01").cast("date"))
    return c.isNotNull()


def _micros(column: str) -> Column:
    """Microseconds of a timestamp with or without zone; null first."""
    return F.coalesce(F.unix_micros(F.col(column).cast("timestamp")), F.lit(NO_TIME).cast("bigint"))


def _candidates(members: DataFrame, group: str, member: str, bundles: Mapping[str, Sequence[str]], status: str, fetched_at: str) -> DataFrame:
    kinds = dict(members.dtypes)
    trust = F.when(F.col(status).isin(*TRUSTED_STATUS), F.lit(STATUS_WEIGHT)).otherwise(F.lit(0).cast("bigint")) + _micros(fetched_at)
    out = members.withColumn("__trust", trust)
    for name, fields in bundles.items():
        count = sum((F.when(filled(f"`{f}`", kinds[f]), 1).otherwise(0) for f in fields), F.lit(0))
        out = out.withColumn(f"__n_{name}", count)
    return out


#: Into so many parts the rows of a group are cut where they meet the one row of their group.
SALTS = 16


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` joined with the one row that ``groups`` has of each ``g``; the rows of a large group are spread over SALTS parts."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "g"]), F.lit(SALTS)).cast("int"))
    copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["g", "__salt"]).drop("__salt")


def surviving_bundles(
    members: DataFrame, *, group: str, member: str, bundles: Mapping[str, Sequence[str]], status: str = "fetch_status",
    fetched_at: str = "fetched_at", dependency: tuple[str, str] | None = None, dependencies: Sequence[tuple[str, str]] = (), carry: bool = False,
) -> DataFrame:
    """``group, bundle, member, trust`` of the row that gives each bundle; with ``carry`` also ``row``, its fields of all bundles.

    ``dependencies`` are pairs of a determinant and a dependent field of two different bundles, determinants first; ``dependency`` is one more.
    """
    rules = [*([dependency] if dependency else []), *dependencies]
    home = {f: b for b, fields in bundles.items() for f in fields}
    if any(home[x] == home[y] for x, y in rules):
        raise ValueError("a dependency links two different bundles")
    linked = list(dict.fromkeys(home[f] for rule in rules for f in rule))
    if any(linked.index(home[x]) > linked.index(home[y]) for x, y in rules):
        raise ValueError("dependencies have to be in the order of their bundles")
    kinds = dict(members.dtypes)
    names = {b: i for i, b in enumerate(bundles)}
    scored = _candidates(members, group, member, bundles, status, fetched_at).where(F.col(group).isNotNull())

    def value(field: str) -> Column:
        return F.when(filled(f"`{field}`", kinds[field]), F.lower(F.trim(F.col(f"`{field}`").cast("string"))))

    own = {b: list(dict.fromkeys(f for rule in rules for f in rule if home[f] == b)) for b in bundles}
    held = [F.struct(*[F.col(f"`{f}`").alias(f) for f in dict.fromkeys(home)]).alias("row")] if carry else []
    packed = scored.select(F.col(group).alias("g"), *[
        F.when(F.col(f"__n_{b}") > 0, F.struct(
            (-F.col(f"__n_{b}") * F.lit(FILLED_WEIGHT) - F.col("__trust")).alias("t"), (-F.col("__trust")).alias("trust"), F.col(f"`{member}`").alias("m"), *held, *[value(f).alias(f"v_{f}") for f in own[b]]
        )).alias(f"b{i}") for b, i in names.items()
    ])
    root = packed.groupBy("g").agg(*[F.min(f"b{i}").alias(f"b{i}") for i in names.values()])
    if rules:
        packed = cut_lineage(packed)
        stated = {
            rule: scored.select(value(rule[0]).alias("x"), value(rule[1]).alias("y")).where("x is not null and y is not null").groupBy("x", "y").count()
            .groupBy("x").agg(F.min(F.struct((-F.col("count")).alias("c"), "y")).alias("s")).select("x", F.col("s.y").alias("y")) for rule in rules
        }
        root = _checked(cut_lineage(root), rules, names, home, stated)
        settled = root.where("kept").drop("kept")
        root = settled.unionByName(_branched(packed, cut_lineage(root.where(~F.col("kept")).drop("kept")), rules, linked, names, home, stated))
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("bundle"), *[F.col(f"b{i}.{c}").alias(c) for c in ("m", "trust", *(["row"] if carry else []))]) for b, i in names.items()]))
    made = root.select("g", rows.alias("x")).where("x.m is not null")
    return made.select(F.col("g").alias(group), "x.bundle", F.col("x.m").alias(member), (-F.col("x.trust")).alias("trust"), *(["x.row"] if carry else []))


def _checked(root: DataFrame, rules, names, home, stated) -> DataFrame:
    """Adds ``kept``: whether the best rows of all bundles keep every dependency."""
    kept = F.lit(True)
    for n, rule in enumerate(rules):
        x, y = (F.col(f"b{names[home[f]]}.v_{f}") for f in rule)
        table = stated[rule].select(F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
        root = root.join(table, x == F.col(f"x{n}"), "left")
        partner = F.col(f"b{names[home[rule[1]]]}")
        kept = kept & (F.col(f"y{n}").isNull() | partner.isNull() | F.coalesce(y == F.col(f"y{n}"), F.lit(False)))
    return root.select("g", *[f"b{i}" for i in names.values()], kept.alias("kept"))


def _branched(packed: DataFrame, groups: DataFrame, rules, linked, names, home, stated) -> DataFrame:
    """The groups whose root breaks a dependency, with the best consistent choice; bundles without dependencies keep their best row."""
    columns = [f"b{i}" for i in names.values()]
    gain = lambda b: F.coalesce(-F.col(f"b{names[b]}.t"), F.lit(0))
    bests = groups.select("g", *[F.greatest(gain(b), F.lit(0)).alias(f"top{names[b]}") for b in linked])
    # what depends on nothing can always have its best row, with all that depends on it empty
    incumbent = sum((F.col(f"top{names[b]}") for b in linked if all(home[y] != b for _, y in rules)), F.lit(0).cast("bigint"))
    frontier = bests.select("g", F.lit(0).cast("bigint").alias("sum"), *[F.lit(None).cast(groups.schema[f"b{names[b]}"].dataType).alias(f"b{names[b]}") for b in linked], *[F.lit(None).cast("string").alias(f"q{n}") for n in range(len(rules))])
    some = groups.select("g")
    for level, b in enumerate(linked):
        c = f"b{names[b]}"
        asked = [n for n, rule in enumerate(rules) if home[rule[1]] == b]
        asks = [n for n, rule in enumerate(rules) if home[rule[0]] == b]
        rows = packed.select("g", c).where(f"{c} is not null").join(some, "g", "left_semi")
        fields = [rules[n][0] for n in asks] + [rules[n][1] for n in asked]
        # one candidate for each combination of values that a dependency speaks of
        each = rows.groupBy("g", *[F.col(f"{c}.v_{f}").alias(f"w{k}") for k, f in enumerate(fields)]).agg(F.min(c).alias("cand"))
        for k, n in enumerate(asks):
            table = stated[rules[n]].select(F.col("x").alias(f"w{k}"), F.col("y").alias(f"want{n}"))
            each = each.join(table, f"w{k}", "left")
        wants = [f"want{n}" for n in asks]
        values = [F.col(f"w{len(asks) + k}").alias(f"is{n}") for k, n in enumerate(asked)]
        each = each.select("g", "cand", *wants, *values)
        # a candidate is found by what is asked of it, or by nothing if nothing is: then by its own demands alone
        keys = [f"is{n}" for n in asked]
        for n in asked:
            free = each.groupBy("g", *wants, *[k for k in keys if k != f"is{n}"]).agg(F.min("cand").alias("cand")).withColumn(f"is{n}", F.lit(None).cast("string"))
            each = each.where(f"is{n} is not null").unionByName(free)
        state = [f"q{n}" for n in range(len(rules))]
        if asked:
            found = frontier.join(each.withColumnRenamed("g", "g_"), (F.col("g") == F.col("g_")) & _all(F.col(f"q{n}").eqNullSafe(F.col(f"is{n}")) for n in asked), "left").drop("g_", *keys)
        else:
            found = _with_group(each, frontier)
        grown = found.where("cand is not null").withColumn(c, F.col("cand")).withColumn("sum", F.col("sum") - F.col("cand.t"))
        for n in asks:
            grown = grown.withColumn(f"q{n}", F.col(f"want{n}"))
        # a bundle may stay empty for a dependency, or if its group has no value of it
        empty = frontier if asked else frontier.join(each.select("g").distinct(), "g", "left_anti")
        grown = grown.select(frontier.columns).unionByName(empty)
        rest = sum((F.col(f"top{names[o]}") for o in linked[level + 1 :]), F.lit(0).cast("bigint"))
        bound = bests.select("g", (incumbent - rest).alias("floor"))
        pending = [q for q, rule in zip(state, rules) if linked.index(home[rule[1]]) > level]
        packed_row = F.struct((-F.col("sum")).alias("s"), *[F.col(f"b{names[o]}") for o in linked])
        merged = grown.groupBy("g", *pending).agg(F.min(packed_row).alias("p"))
        open_ = _with_group(merged, bound).where(-F.col("p.s") >= F.col("floor")).drop("floor")
        frontier = cut_lineage(open_.select("g", (-F.col("p.s")).alias("sum"), *[F.col(f"p.b{names[o]}").alias(f"b{names[o]}") for o in linked], *[F.col(q) if q in pending else F.lit(None).cast("string").alias(q) for q in state]))
    # nothing is pending any more: one row for each group
    chosen = frontier.select("g", *[f"b{names[b]}" for b in linked])
    return groups.drop(*[f"b{names[b]}" for b in linked]).join(chosen, "g").select("g", *columns)


def _all(conditions) -> Column:
    return functools.reduce(lambda x, y: x & y, conditions)


def cluster_members(dedupe_map: DataFrame, articles: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows of the members of every cluster with two or more distinct urls; flags are not used."""
    mapped = dedupe_map.where("url is not null and cluster_id is not null").groupBy("cluster_id", "url").agg(F.lit(1).alias("one"))
    several = mapped.groupBy("cluster_id").agg(F.count("*").alias("urls")).where("urls >= 2").select("cluster_id")
    slim = articles.select("url", "fetch_status", "fetched_at", *[f for f in fields if f not in ("url", "fetch_status", "fetched_at")])
    return mapped.drop("one").join(several, "cluster_id", "left_semi").join(slim, "url")


def surviving_records(choice: DataFrame, bundles: Mapping[str, Sequence[str]], *, group: str, member: str) -> DataFrame:
    """One built record for each group of a choice with ``carry``: every bundle's fields from the row that gives it."""
    picks = [F.max(F.when(F.col("bundle") == b, F.struct(F.col(f"row.{f}").alias("x")))).getField("x").alias(f) for b, fields in bundles.items() for f in fields]
    sources = [F.max(F.when(F.col("bundle") == b, F.col(member))).alias(f"{b}_from") for b in bundles]
    return choice.groupBy(group).agg(*picks, *sources)
