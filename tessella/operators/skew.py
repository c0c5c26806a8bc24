"""A few keys that hold most records: per-key results without a few tasks running far longer.

Fragment and replicate by estimated load. Loads are counted per key with map-side combine. The heavy keys, those above a
part of a task's fair share, are few by definition (their number is bounded by the number of tasks over that part), so they and nothing
else are planned on the driver: keys above a fair share are split into shards in proportion to their load, and shards and the other heavy
keys are bin-packed into tasks, largest first into the least loaded. All remaining keys are spread by hash. Rows of a split
key go to one of its shards by a hash of their own; the matching side is replicated to the shards of split keys only.

Placement is by task number: both sides are partitioned by it directly, so the plan says which task gets which rows, and
joins and partial results run inside a task without another shuffle.

A null key has a load and rows of its own and matches nothing, as in any join. Columns keep their names; what this module adds
starts with ``__``.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import cut_lineage

#: A key is heavy above this part of a task's fair share, and split above the whole of it.
HEAVY_PART = 1 / 8


@dataclass(frozen=True)
class FragmentPlan:
    """The tasks of each heavy key's shards, and the load that each task was given."""

    tasks: int
    total: int
    placed: dict[str | None, tuple[int, ...]]
    loads: tuple[float, ...]

    def split_keys(self) -> dict[str | None, int]:
        return {key: len(at) for key, at in self.placed.items() if len(at) > 1}


def key_loads(df: DataFrame, key: Column) -> DataFrame:
    """``key, load`` of every key, null included."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("load"))


def plan_fragments(loads: DataFrame, tasks: int, heavy_part: float = HEAVY_PART) -> FragmentPlan:
    """Bin-pack the heavy keys of ``key, load`` to tasks; the driver sees at most ``tasks / heavy_part`` of them."""
    total = loads.agg(F.sum("load")).first()[0] or 0
    fair = max(1.0, total / tasks)
    heavy = loads.where(F.col("load") > fair * heavy_part).collect()
    pieces = []
    for row in heavy:
        shards = min(tasks, -(-row.load // int(fair)))
        pieces += [(row.load / shards, row.key, i) for i in range(shards)]
    bins = [(0.0, t) for t in range(tasks)]
    given, placed = [0.0] * tasks, {row.key: [] for row in heavy}
    # largest first into the least loaded task
    for load, key, _ in sorted(pieces, key=lambda p: (-p[0], p[1] is None, p[1] or "", p[2])):
        filled, task = heapq.heappop(bins)
        placed[key].append(task)
        given[task] = filled + load
        heapq.heappush(bins, (given[task], task))
    rest = (total - sum(r.load for r in heavy)) / tasks
    return FragmentPlan(tasks, int(total), {k: tuple(v) for k, v in placed.items()}, tuple(g + rest for g in given))


def _plan_table(spark: SparkSession, plan: FragmentPlan, names: str) -> DataFrame:
    return spark.createDataFrame([(key, list(at)) for key, at in plan.placed.items()], names)


def _spread_task(key: str, plan: FragmentPlan) -> Column:
    """Task of a key that the plan doesn't name."""
    return F.pmod(F.xxhash64(key), F.lit(plan.tasks)).cast("int")


def _by_task(df: DataFrame, plan: FragmentPlan) -> DataFrame:
    """Partition number ``__task`` gets exactly the rows of that task."""
    return df.repartitionById(plan.tasks, F.col("__task"))


def fragmented(df: DataFrame, key: Column, row: Column, plan: FragmentPlan) -> DataFrame:
    """Adds ``__key, __shard, __task`` and partitions by the task. ``row`` tells rows of a split key apart: what has to stay together is equal in it."""
    placed = F.broadcast(_plan_table(df.sparkSession, plan, "__planned string, __at array<int>"))
    joined = df.withColumn("__key", key.cast("string")).join(placed, F.col("__key").eqNullSafe(F.col("__planned")), "left").drop("__planned")
    shard = F.when(F.size("__at") > 1, F.pmod(F.xxhash64(row), F.size("__at")).cast("int")).otherwise(0)
    task = F.when(F.col("__at").isNotNull(), F.get("__at", F.col("__shard"))).otherwise(_spread_task("__key", plan))
    return _by_task(joined.withColumn("__shard", shard).withColumn("__task", task.cast("int")).drop("__at"), plan)


def replicated(matching: DataFrame, key: Column, plan: FragmentPlan) -> DataFrame:
    """The matching side with ``__match_key, __match_shard, __task``, partitioned by the task: one copy for each shard of a split key, else one."""
    table = _plan_table(matching.sparkSession, plan, "__split_key string, __at array<int>").where("__split_key is not null")
    with_key = matching.withColumn("__match_key", key.cast("string"))
    joined = with_key.join(F.broadcast(table), F.col("__match_key") == F.col("__split_key"), "left")
    at = F.coalesce("__at", F.array(_spread_task("__match_key", plan)))
    columns = [F.col(f"`{c}`") for c in with_key.columns]
    return _by_task(joined.select(*columns, F.posexplode(at).alias("__match_shard", "__task")), plan)


def balanced_join(df: DataFrame, matching: DataFrame, *, key: Column, matching_key: Column, row: Column, tasks: int, how: str = "inner") -> tuple[DataFrame, FragmentPlan]:
    """Join on a skewed key; ``how`` is inner or left. Also returns the plan, for per-key results by (key, shard)."""
    if how not in ("inner", "left"):
        raise ValueError("an inner or a left join")
    plan = plan_fragments(key_loads(df, key.cast("string")), tasks)
    left, right = fragmented(df, key, row, plan), replicated(matching, matching_key, plan).withColumnRenamed("__task", "__match_task")
    same = (F.col("__task") == F.col("__match_task")) & (F.col("__key") == F.col("__match_key")) & (F.col("__shard") == F.col("__match_shard"))
    return left.join(right, same, how).drop("__match_key", "__match_shard", "__match_task"), plan


def per_key_distinct(df: DataFrame, *, key: Column, value: str, tasks: int) -> DataFrame:
    """``key, rows, distinct`` of every key. Shards are cut by the value, so their distinct counts add up exactly.

    Equal rows are counted before they move; the heavy keys are planned by these counts.
    """
    once = df.groupBy(key.cast("string").alias("__k"), F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    plan = plan_fragments(key_loads(df, key.cast("string")), tasks)
    parts = fragmented(once, F.col("__k"), F.col("__v"), plan)
    by_shard = parts.groupBy("__task", "__key", "__shard").agg(F.sum("__n").alias("rows"), F.count("__v").alias("distinct"))
    return by_shard.groupBy(F.col("__key").alias("key")).agg(F.sum("rows").alias("rows"), F.sum("distinct").alias("distinct"))


def heavy_values(df: DataFrame, columns: list[str], *, least_share: float) -> DataFrame:
    """``key_field, key_value`` of the trimmed lower-case values that hold at least this share of all rows of ``df``.

    One scan for all columns: each row gives one key per column, and one more that counts rows; counting is combined before the shuffle.
    As many tasks are planned as make the share a fair one, so the keys that the plan places are few, at most the number
    of columns over the share and the heavy part, and the answer is among them.
    """
    pairs = F.explode(F.array(F.struct(F.lit(None).cast("string").alias("f"), F.lit(None).cast("string").alias("v")), *[F.struct(F.lit(c).alias("f"), F.lower(F.trim(F.col(c))).alias("v")) for c in columns]))
    counted = df.select(pairs.alias("p")).where("p.f is null or p.v is not null").groupBy("p.f", "p.v").agg(F.count("*").alias("load"))
    loads = cut_lineage(counted.select(F.to_json(F.struct("f", "v"), {"ignoreNullFields": "false"}).alias("key"), "f", "v", "load"))
    total = (loads.where("f is null").agg(F.sum("load")).first()[0] or 0)
    keyed = loads.where("f is not null")
    plan = plan_fragments(keyed, max(1, int(1 / least_share)))
    placed = F.broadcast(_plan_table(df.sparkSession, plan, "key string, __at array<int>").select("key"))
    large = keyed.join(placed, "key").where((F.col("load") >= least_share * total) & (F.lit(total) > 0))
    return large.select(F.col("f").alias("key_field"), F.col("v").alias("key_value"))
