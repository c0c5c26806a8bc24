"""Problem 7: long exact spans shared between records.

Units of text are hashed, digests are grouped globally, the earliest ranked record keeps
a shared unit and all others lose it, with original offsets retained. Lines or paragraphs
as units would miss a run that starts or ends inside a line, so the units are cut
by content: of each window of ``min_span`` signs the ``gram``-sign unit with the smallest
hash is kept (winnowing). Two texts that share any run of ``min_span`` signs share
the units of that run, so nothing is lost. Text is compared exactly as stored; normalisation is
the identity.

1. Units whose digest occurs in two records mark candidate places.
2. Around these places only, digests of 128 bits of every run of exactly ``min_span`` signs are
   grouped. A run whose group has two records is shared.
3. Groups with the same members are represented by one digest (members are compared by
   count, least, greatest and sum of hashes, never collected): ``sharing_classes`` gives one row per member. Distinct pairs are
   made of these classes, large ones in parts; shares and removals need none.

Null and short texts share nothing. A record whose key is repeated counts once: the least text stands for it.
Rows with a null key are left out. Long texts are read in overlapping segments, so memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.batches import sliced
from tessella.session import cut_lineage

MIN_SPAN = 200
GRAM = 120
#: Code points hashed at once by a Python worker.
SEGMENT_CHARS = 1 << 18
#: Repeated digests and candidate places up to this size are broadcast; beyond it the joins shuffle. A row takes so many bytes in the table that is joined with.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 80
#: Members of a group of which all are paired in one place; larger groups are cut into parts of this size, and each pair of parts is one place.
PART_MEMBERS = 256

# Odd multipliers of the rolling hashes and of the mixing steps.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    kept = _POWERS.get(base)
    if kept is None or len(kept[0]) < n:
        size = max(n, SEGMENT_CHARS + 1024)
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        kept = _POWERS[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return kept


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def rolling_hashes(codes: np.ndarray, length: int, base: int = _BASES[0]) -> np.ndarray:
    """Hash of every run of ``length`` signs, by prefix sums modulo 2**64."""
    n = len(codes)
    if n < length:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(base, n + 1)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return _mixed((sums[length:] - sums[:-length]) * down[: n - length + 1])


def _window_reduce(values: np.ndarray, width: int, ufunc) -> np.ndarray:
    """``ufunc`` over every window of ``width`` values, in linear time."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, values[-1], dtype=values.dtype)]).reshape(-1, width)
    forward = ufunc.accumulate(padded, axis=1).ravel()
    backward = ufunc.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(backward[:n], forward[width - 1 : width - 1 + n])


def winnow(hashes: np.ndarray, width: int, owner: np.ndarray | None = None) -> np.ndarray:
    """Positions that are the least of some window of ``width`` hashes.

    ``owner`` numbers the record of each hash; windows across two records don't count.
    """
    if len(hashes) < width:
        return np.empty(0, dtype=np.int64)
    least = _window_reduce(hashes, width, np.minimum)
    if owner is not None:
        least[owner[: len(least)] != owner[width - 1 :]] = 0
    edge = np.zeros(width - 1, dtype=np.uint64)
    greatest = _window_reduce(np.concatenate([edge, least, edge]), width, np.maximum)
    return np.flatnonzero((greatest == hashes) & (hashes > 0))


def _segments(texts: list[str | None], min_span: int) -> Iterator[list[tuple[int, int, str]]]:
    """Groups of (row, offset, segment) with a bounded number of signs; segments overlap by ``min_span - 1``."""
    group: list[tuple[int, int, str]] = []
    size = 0
    for row, text in enumerate(texts):
        if text is None or len(text) < min_span:
            continue
        for start in range(0, len(text) - min_span + 1, SEGMENT_CHARS):
            piece = text[start : start + SEGMENT_CHARS + min_span - 1]
            if size and size + len(piece) > SEGMENT_CHARS:
                yield group
                group, size = [], 0
            group.append((row, start, piece))
            size += len(piece)
    if group:
        yield group


def _units(group: list[tuple[int, int, str]], min_span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays (row, position, digest) of the units of a group of segments."""
    codes = code_points("".join(piece for _, _, piece in group))
    lengths = np.array([len(piece) for _, _, piece in group])
    begins = np.cumsum(lengths) - lengths
    hashes = rolling_hashes(codes, gram)
    owner = np.repeat(np.arange(len(group)), lengths)
    crossing = owner[: len(hashes)] != owner[gram - 1 : gram - 1 + len(hashes)]
    hashes[crossing] = np.uint64(0xFFFFFFFFFFFFFFFF)
    # the windows of a record end where its last unit starts: units across two records never count
    label = np.where(crossing, len(group) + np.arange(len(hashes)), owner[: len(hashes)])
    at = winnow(hashes, min_span - gram + 1, label)
    at = at[~crossing[at]]
    rows = np.array([row for row, _, _ in group])[owner[at]]
    offsets = np.array([start for _, start, _ in group]) - begins
    return rows, at + offsets[owner[at]], hashes[at]


def unit_rows(texts: list[str | None], min_span: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays (row, digest) of the units of each text, a digest once per text and group of segments."""
    for group in _segments(texts, min_span):
        rows, _, digests = _units(group, min_span, gram)
        _, first = np.unique(np.stack([rows.astype(np.uint64), digests]), axis=1, return_index=True)
        yield rows[first], digests[first].view(np.int64)


def _unit_mapper(min_span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for rows, digests in unit_rows(batch.column(1).to_pylist(), min_span, gram):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(digests, pa.int64())], names=["id", "digest"])

    return run


def run_starts(text: str, wanted: np.ndarray, min_span: int, gram: int) -> np.ndarray:
    """Starts of the runs of ``min_span`` signs that hold a unit with one of the wanted digests."""
    count = len(text) - min_span + 1
    if count <= 0:
        return np.empty(0, dtype=np.int64)
    change = np.zeros(count + 1, dtype=np.int32)
    for group in _segments([text], min_span):
        _, positions, digests = _units(group, min_span, gram)
        at = positions[np.isin(digests.view(np.int64), wanted)]
        np.add.at(change, np.maximum(at - (min_span - gram), 0), 1)
        np.add.at(change, np.minimum(at + 1, count), -1)
    return np.flatnonzero(np.cumsum(change[:-1]) > 0)


def _run_mapper(min_span: int, gram: int):
    """Digests of the runs of ``min_span`` signs that hold one of the given units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[list[np.ndarray]] = [[], [], [], []]
            waiting = 0
            for row, (text, wanted) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                starts = run_starts(text, np.asarray(wanted, dtype=np.int64), min_span, gram)
                # hash only the stretches around the places, in pieces of bounded length
                for part in np.split(starts, np.flatnonzero(np.diff(starts) > min_span) + 1):
                    for part in np.array_split(part, max(1, len(part) // SEGMENT_CHARS)):
                        if not len(part):
                            continue
                        codes = code_points(text[part[0] : part[-1] + min_span])
                        chosen = [rolling_hashes(codes, min_span, base)[part - part[0]] for base in _BASES]
                        for column, values in zip(out, (np.full(len(part), row), part, *chosen)):
                            column.append(values)
                        waiting += len(part)
                        if waiting > SEGMENT_CHARS:
                            yield _run_batch(batch, out)
                            out, waiting = [[], [], [], []], 0
            if waiting:
                yield _run_batch(batch, out)

    return run


def _run_batch(batch: pa.RecordBatch, out: list[list[np.ndarray]]) -> pa.RecordBatch:
    rows, starts, one, two = (np.concatenate(x) for x in out)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(rows)), pa.array(starts, pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
        names=["id", "start", "d1", "d2"],
    )


def _slim(records: DataFrame, key: str, text: str) -> DataFrame:
    return records.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")


def shared_runs(records: DataFrame, *, key: str, text: str, min_span: int = MIN_SPAN, gram: int = GRAM) -> DataFrame:
    """``id, start, d1, d2`` of every run of ``min_span`` signs that is a candidate; written to the shared folder.

    Every run that occurs in two records is among them.
    """
    if not 0 < gram <= min_span:
        raise ValueError("a unit is at least one sign and at most the span")
    slim = _slim(records, key, text)
    kind = slim.schema["id"].dataType.simpleString()
    units = slim.mapInArrow(_unit_mapper(min_span, gram), f"id {kind}, digest bigint")
    # what is shared is little as a rule: then it travels to the units and to the texts, else they are shuffled to it
    repeated = cut_lineage(units.groupBy("digest").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("digest"))
    repeated = F.broadcast(repeated) if repeated.count() * ROW_BYTES <= BROADCAST_BYTES else repeated
    places = cut_lineage(units.join(repeated, "digest").groupBy("id").agg(F.sort_array(F.collect_set("digest")).alias("places")))
    size = places.agg(F.sum(F.size("places") * 8 + ROW_BYTES)).first()[0] or 0
    few = F.broadcast(places) if size <= BROADCAST_BYTES else places
    chosen = slim.join(few, "id").groupBy("id").agg(F.min(F.struct("text", "places")).alias("x")).select("id", "x.text", "x.places")
    return cut_lineage(chosen.mapInArrow(_run_mapper(min_span, gram), f"id {kind}, start int, d1 bigint, d2 bigint"))


def _groups(runs: DataFrame) -> DataFrame:
    """Runs in two or more records: their first owner and what tells their members apart."""
    return (
        runs.groupBy("d1", "d2")
        .agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"))
        .where("owner <> last")
    )


def sharing_classes(runs: DataFrame) -> DataFrame:
    """``class, id, members``: the groups of records that share a run, each set of members once, and how many they are.

    Linear in the records, however many share a run; a pair shares a run exactly if some class holds both.
    """
    groups = _groups(runs)
    one_each = groups.groupBy("owner", "last", "n", "sum").agg(F.min(F.struct("d1", "d2")).alias("d")).select("d.d1", "d.d2")
    members = runs.select("d1", "d2", "id").join(one_each, ["d1", "d2"]).distinct()
    sizes = members.groupBy("d1", "d2").agg(F.count("*").alias("members"))
    return members.join(sizes, ["d1", "d2"]).select(F.xxhash64("d1", "d2").alias("class"), "id", "members")


def sharing_pairs(runs: DataFrame) -> DataFrame:
    """Pairs ``id_a < id_b`` of records that share a run.

    A large class is cut into parts by a hash of the member. Its rows are sent to each pair of parts that holds theirs, so no task pairs
    more than two parts, whatever the class holds; the pairs themselves are the result that is asked for.
    """
    classes = cut_lineage(sharing_classes(runs))
    parts = F.ceil(F.col("members") / PART_MEMBERS).cast("int")
    cut = classes.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    left = cut.select("class", F.col("id").alias("id_a"), F.col("part").alias("pa"), F.explode(others).alias("pb"))
    right = cut.select("class", F.col("id").alias("id_b"), F.explode(others).alias("pa"), F.col("part").alias("pb"))
    return left.join(right, ["class", "pa", "pb"]).where("id_a < id_b").select("id_a", "id_b").distinct()


def shared_parts(runs: DataFrame, min_span: int = MIN_SPAN, *, lost_only: bool = False) -> DataFrame:
    """Merged stretches ``id, start_pos, end_pos`` that occur elsewhere; with ``lost_only`` those an earlier record keeps."""
    found = runs.join(_groups(runs).select("d1", "d2", "owner"), ["d1", "d2"])
    starts = (found.where("owner <> id") if lost_only else found).select("id", "start").distinct()
    by_start = Window.partitionBy("id").orderBy("start")
    opened = (F.col("start") - F.lag("start").over(by_start) > min_span).cast("int")
    islands = starts.withColumn("new", F.coalesce(opened, F.lit(1))).withColumn("island", F.sum("new").over(by_start))
    return islands.groupBy("id", "island").agg(F.min("start").alias("start_pos"), (F.max("start") + min_span).cast("int").alias("end_pos")).drop("island")


def shared_share(records: DataFrame, runs: DataFrame, *, key: str, text: str, min_span: int = MIN_SPAN) -> DataFrame:
    """Per record: its length, how many of its signs occur in a shared run, and how many an earlier record keeps."""
    def total(parts: DataFrame, name: str) -> DataFrame:
        return parts.groupBy("id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias(name))

    lengths = records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.length(F.min(text)).alias("chars"))
    joined = lengths.join(total(shared_parts(runs, min_span), "shared"), "id", "left").join(total(shared_parts(runs, min_span, lost_only=True), "lost"), "id", "left")
    chars, shared, lost = F.coalesce("chars", F.lit(0)), F.coalesce("shared", F.lit(0)), F.coalesce("lost", F.lit(0))
    return joined.select(
        F.col("id").alias(key), chars.alias("chars"), shared.cast("bigint").alias("shared_chars"), lost.cast("bigint").alias("removable_chars"),
        F.when(chars > 0, shared / chars).otherwise(0.0).alias("shared_share"),
    )
