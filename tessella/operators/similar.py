"""What similarity joins share: numbered sets of shingles with sketches, prefixes, min-hashes, and the exact test of candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import shingle_hashes
from tessella.session import write_stage

#: Bits of a sketch: the parities of a set's members by ten bits of their hash.
SKETCH_BITS = 1024
#: Counts of shingles by the low bits of their hash: 8 MB for each Python worker, whatever the input.
COUNT_BUCKETS = 1 << 20
_ROWS = 1000


def _lists(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the members of their sets one after the other, and the size of each set."""
    for first in range(0, batch.num_rows, _ROWS):
        part = batch.slice(first, _ROWS)
        sets = part.column("sh")
        yield part, sets.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)


def _array(values: np.ndarray, width: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width, dtype=np.int32)), pa.array(values.reshape(-1)))


def _described(factors: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the size, the sketch and the least hash under each factor to ``num, id, norm, sh``, whose sets aren't kept."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, members, sizes in _lists(batch):
                hashes, owner = members.astype(np.uint64), np.repeat(np.arange(len(sizes)), sizes)
                bits = np.bincount(owner * SKETCH_BITS + (hashes >> np.uint64(54)).astype(np.int64), minlength=len(sizes) * SKETCH_BITS) & 1
                sketch = np.packbits(bits.astype(np.uint8)).view(np.int64)
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                least = np.empty((len(sizes), len(factors)), np.int64)
                for k, factor in enumerate(factors):
                    mixed = (hashes ^ (hashes >> np.uint64(31))) * factor
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * (factor | np.uint64(5))
                    least[:, k] = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), starts).astype(np.int64)
                columns = [part.column(c) for c in ("num", "id", "norm")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes.astype(np.int32)), _array(sketch, SKETCH_BITS // 64), _array(least, len(factors)) if len(factors) else pa.array([[]] * len(sizes), pa.list_(pa.int64()))], ["num", "id", "norm", "n", "sketch", "least"])

    return made


def described_sets(units: DataFrame, factors: Sequence[int] = ()) -> DataFrame:
    """``num, id, norm, n, sketch, least`` of ``id, norm``: numbers instead of ids and sketches instead of sets travel; written once."""
    rows = units.where("norm is not null").select(F.monotonically_increasing_id().alias("num"), "id", "norm", shingle_hashes(F.col("norm")).alias("sh"))
    kind = units.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(_described(np.array(factors, np.uint64)), f"num bigint, id {kind}, norm string, n int, sketch array<bigint>, least array<bigint>")
    return write_stage(made, "sets")


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """``num, n, place, s``: the first ``n - ceil(threshold * n) + 1`` shingles of each set, rare ones first.

    Any order of shingles that is the same for all sets loses no pair. This one goes by how many shingles share the low bits of
    the hash, then by the hash: common shingles come last. ``s`` is half of the hash, so some equal ones differ.
    """
    rows = sets.select("num", shingle_hashes(F.col("norm")).alias("sh"))
    counted = rows.select(F.explode("sh").alias("s")).groupBy(F.col("s").bitwiseAND(COUNT_BUCKETS - 1).alias("bucket")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(COUNT_BUCKETS, np.int64)
    counts[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, members, sizes in _lists(batch):
                owner, size = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes, sizes)
                order = np.lexsort((members, shared.value[members & (COUNT_BUCKETS - 1)], owner))
                place = np.arange(len(members)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                first = place < size - np.ceil(size * threshold - 1e-9) + 1
                num = part.column("num").to_numpy()
                columns = (num[owner[first]], size[first].astype(np.int32), place[first].astype(np.int32), (members[order][first] >> 32).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["num", "n", "place", "s"])

    return rows.mapInArrow(made, "num bigint, n int, place int, s int")


def sizes_agree(threshold: float) -> Column:
    return F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9


def parities_agree(differ: Column, threshold: float) -> Column:
    """Whether parities differ in no more bits than sets ``threshold`` alike can differ in members: no such pair is lost."""
    return differ <= (1 - threshold) / (1 + threshold) * (F.col("na") + F.col("nb")) + 1e-9


def sketches_agree(a: Column, b: Column, threshold: float) -> Column:
    return parities_agree(F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x), threshold)


def verified(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` of candidates ``a, b`` (numbers) that are at least so similar, by their ids, the lesser one first."""

    def side(x: str, *columns: Column) -> DataFrame:
        return sets.select(F.col("num").alias(x), *columns)

    left, right = (side(x, F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}")) for x in "ab")
    near = write_stage(candidates.distinct().join(left, "a").join(right, "b").where(sketches_agree(F.col("ka"), F.col("kb"), threshold)).select("a", "b"), "near")
    # texts travel for sets with a near one only
    named = near.select(F.col("a").alias("num")).union(near.select(F.col("b").alias("num"))).distinct()
    texts = write_stage(sets.select("num", "id", "norm").join(named, "num", "left_semi"), "texts")
    full = near
    for x in "ab":
        full = full.join(texts.select(F.col("num").alias(x), F.col("id").alias(f"id{x}"), F.col("norm").alias(f"norm{x}")), x)
    compared = full.select("ida", "idb", shingle_hashes(F.col("norma")).alias("ha"), shingle_hashes(F.col("normb")).alias("hb"))
    # bound once: written out, it would be evaluated at each mention
    both = F.transform(F.array(F.size(F.array_intersect("ha", "hb"))), lambda x: x / (F.size("ha") + F.size("hb") - x))[0]
    return compared.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b"), both.alias("similarity")).where(F.col("similarity") >= threshold)
