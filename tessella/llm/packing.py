"""Problem 9: items of varying length in containers of fixed capacity.

Sizes are numbers of tokens. An item larger than the capacity is cut into full
containers and one rest; every other item stays whole. The estimated cost of an item
is linear plus quadratic in its tokens, as attention is. Items are taken in descending
order and each goes to the container of lowest cost so far that still has room, so
that containers fill evenly in tokens and in cost; if it would close some containers, leaving no
room in them, it goes to the one of lowest cost of these. Without that preference evenly filled containers
all keep a little room that nothing fits into.

At scale the items are dealt by hash into shards of a bounded number of items, each
packed by itself; every shard sees the same mix of sizes, so the only price of
sharding is the partly filled containers at each shard's end. A shard first gets as
many containers as its tokens need at least; only when an item fits nowhere does it
open another.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one shard on average; bounds the memory and the time of a packing task.
SHARD_ITEMS = 8192
#: Cost of an item of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Part of the capacity up to which the room that an item would leave counts as none.
CLOSING_SLACK = 1 / 1024


def pack_items(sizes: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """Container of each item. No size may exceed ``capacity``; empty items go to container 0.

    Equal sizes are taken in the order given, and equal costs in the order of containers,
    so that the result is determined by the input.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    if len(sizes) and (sizes.max() > capacity or sizes.min() < 0):
        raise ValueError("a size is negative or exceeds the capacity")
    out = np.zeros(len(sizes), dtype=np.int64)
    opened = int(-(-int(sizes.sum()) // capacity)) if len(sizes) else 0
    slack = int(capacity * CLOSING_SLACK)
    room = np.full(max(opened, 1) * 2 + 16, capacity, dtype=np.int64)
    cost = np.zeros(len(room))
    for item in np.argsort(-sizes, kind="stable"):
        size = int(sizes[item])
        if size == 0:
            break  # descending: only empty items are left
        left = room[:opened] - size
        fits = np.flatnonzero(left >= 0)
        if len(fits):
            closing = fits[left[fits] <= slack]
            choice = closing if len(closing) else fits
            at = int(choice[np.argmin(cost[choice])])
        else:
            if opened == len(room):
                room = np.concatenate([room, np.full(opened, capacity, dtype=np.int64)])
                cost = np.concatenate([cost, np.zeros(opened)])
            at, opened = opened, opened + 1
        out[item] = at
        room[at] -= size
        cost[at] += linear * size + quadratic * size * size
    return out


def container_plan(
    items: DataFrame, *, key: str, size: str, budgets: Sequence[tuple[str, int]], shard_items: int = SHARD_ITEMS,
    item_count: int | None = None,
) -> DataFrame:
    """Where each item lies: ``budget_name, container_id, key, piece_no, start_token, n_tokens``.

    ``budgets`` are (name, capacity) pairs, a handful. A null or negative size counts as 0; an
    empty item has one piece of 0 tokens. Every key occurs for every budget. ``container_id``
    is unique within a budget: the shard in the upper half, the container in the lower one.
    ``item_count`` saves the count over ``items`` when the caller has it.
    """
    if not budgets:
        return items.sparkSession.createDataFrame(
            [], f"budget_name string, container_id bigint, {key} {items.schema[key].dataType.simpleString()}, piece_no int, start_token int, n_tokens int"
        )
    if any(capacity <= 0 for _, capacity in budgets):
        raise ValueError("capacities must be positive")
    count = items.count() if item_count is None else item_count
    shards = max(1, -(-count // shard_items))
    kind = items.schema[key].dataType.simpleString()
    options = F.array(*[F.struct(F.lit(n).alias("budget_name"), F.lit(int(c)).alias("capacity"), F.lit(sum(m == n for m, _ in budgets[:i])).alias("nth")) for i, (n, c) in enumerate(budgets)])
    tokens = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("int")
    spread = (
        items.select(F.col(key).alias("item"), tokens.alias("size"))
        .withColumn("shard", F.pmod(F.xxhash64("item", F.lit(9)), F.lit(shards)).cast("int"))
        .select("item", "size", "shard", F.explode(options).alias("o"))
        # budgets of one name and different capacities have containers of their own
        .select("item", "size", (F.col("shard") + F.lit(shards) * F.col("o.nth")).alias("shard"), "o.budget_name", "o.capacity")
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        capacity = int(pdf["capacity"].iloc[0])
        size_of = pdf["size"].to_numpy(np.int64)
        full = np.where(size_of > capacity, size_of // capacity, 0)
        rest = size_of - full * capacity
        keep = (rest > 0) | (full == 0)
        at = np.full(len(pdf), -1, dtype=np.int64)
        at[keep] = pack_items(rest[keep], capacity)
        first_free = int(at.max()) + 1 if keep.any() else 0
        whole = np.repeat(np.arange(len(pdf)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        row = np.concatenate([np.flatnonzero(keep), whole])
        container = np.concatenate([at[keep], first_free + np.arange(len(whole))])
        piece_no = np.concatenate([full[keep], piece])
        n = np.concatenate([rest[keep], np.full(len(whole), capacity)])
        return pd.DataFrame({
            "budget_name": pdf["budget_name"].to_numpy()[row],
            "container_id": (int(pdf["shard"].iloc[0]) << 32) + container,
            key: pdf["item"].to_numpy()[row],
            "piece_no": piece_no.astype(np.int32),
            "start_token": (piece_no * capacity).astype(np.int32),
            "n_tokens": n.astype(np.int32),
        })

    return spread.groupBy("budget_name", "capacity", "shard").applyInPandas(
        pack, f"budget_name string, container_id bigint, `{key}` {kind}, piece_no int, start_token int, n_tokens int"
    )


def container_usage(plan: DataFrame, budgets: Sequence[tuple[str, int]]) -> DataFrame:
    """Per budget: containers, tokens and the share of room left unused."""
    capacity = F.create_map(*[x for n, c in budgets for x in (F.lit(n), F.lit(int(c)))])
    return (
        plan.groupBy("budget_name").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
        .withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * capacity[F.col("budget_name")]))
    )
