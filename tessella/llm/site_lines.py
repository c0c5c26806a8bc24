"""Problem 5: lines that one source repeats in document after document.

Numbers, dates and names are masked in every line; lines of one source with the same masked form are one node. Nodes are clustered by
locality-sensitive hashing: BANDS bands of BAND_ROWS min-hashes each over shingles of five words. Nodes that share a band, and whose sizes and sketches
don't rule it out, are compared by their shingles; a sketch has a bit for each of 64 kinds of shingles, set if their number is odd, so that sets differ in as many shingles at least as their sketches in bits; those of at least ``similarity`` are linked, links are joined to
components, and components whose lines occur in at least ``min_documents`` distinct documents are the repeated ones.
``near_repeated_lines`` gives their lines. ``repeated_lines`` takes from the same components the lines whose
own form (equal but for case, white space and digits) occurs in that many documents: the exact test comes last.

Nodes of one shingle (lines of up to five words) are alike only if they are equal, so they need no bands. Within a bucket of any size
all pairs are compared: in one of up to PAIR_BUCKET nodes pair by pair, sketches first; larger ones are cut into parts of BLOCK nodes, any two parts are a block,
and a block gives links that connect what is alike in it, fewer than it has nodes. The time for a large bucket grows with the square of its nodes.

Plan: one scan of the texts gives a few numbers for each line, which are written once; texts are never shuffled, and counts are combined before they move,
so a source or a line that holds a third of all rows costs no task more than others.

Null texts and null sources have no lines; blank lines never count; repeated rows count once, as documents are told
apart by their key. Columns not named are ignored. Names can't be told from words in scripts without capitals and aren't masked there;
each sign of a script without blanks is a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.batches import sliced
from tessella.operators.relations import connected_components
from tessella.session import cut_lineage, write_stage

MIN_DOCUMENTS = 6
SIMILARITY = 0.8
SHINGLE_WORDS = 5
#: Nodes of similarity 0.8 share one of six bands of three min-hashes with probability 0.987.
BANDS, BAND_ROWS = 6, 3
#: Nodes of a bucket up to which pairs are rows; larger buckets are compared in blocks of two parts.
PAIR_BUCKET = 64
#: Nodes of a part, and shingles that are counted at once in a block.
BLOCK, BLOCK_SHINGLES = 512, 4096
#: Nodes to be compared up to this number are broadcast to their shingles, under 16 MB in all; beyond it the join shuffles.
BROADCAST_NODES = 1 << 18
# Names of months in languages that write them without a capital.
MONTHS = (
    "enero febrero marzo abril mayo junio julio agosto septiembre setiembre octubre noviembre diciembre "
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre "
    "janeiro fevereiro março maio junho julho setembro outubro novembro dezembro "
    "января февраля марта апреля мая июня июля августа сентября октября ноября декабря "
    "يناير فبراير مارس أبريل مايو يونيو يوليو أغسطس سبتمبر أكتوبر نوفمبر ديسمبر जनवरी फ़रवरी फरवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर अक्टूबर नवंबर दिसंबर"
).split()

_MONTHS = frozenset(MONTHS)
_CORE = re.compile(r"[^\W_]+(?:[^\w\s]+[^\W_]+)*")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")
_DIGITS = re.compile("[0-9]+")
# Odd multipliers of the min-hashes and of the shingle hash.
_DRAW = np.random.default_rng(5)
_ODD = _DRAW.integers(1 << 62, dtype=np.uint64, size=BANDS * BAND_ROWS) * np.uint64(2) + np.uint64(1)
_PLUS = _DRAW.integers(1 << 62, dtype=np.uint64, size=BANDS * BAND_ROWS)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def line_form(line: str) -> str:
    """The form in which two lines are the same: lower case, single blanks, trimmed, digit runs as one sign."""
    return _DIGITS.sub("0", " ".join(line.lower().split()))


def masked_word(word: str) -> str:
    """A name (capitalised word), a number, a date or a month as one sign with the marks around it, else the word in lower case."""
    core = _CORE.search(word)
    if core is None:
        return word
    inner = core.group()
    masked = "#" if inner[0].isupper() or inner[0].isdigit() or inner.lower() in _MONTHS else inner.lower()
    return word[: core.start()] + masked + word[core.end() :].lower()


class _Hashes(dict):
    """A number for the look-alike form of each word, kept while it is wanted."""

    MOST_KEPT = 400_000

    def __missing__(self, word: str) -> int:
        self[word] = made = crc32(masked_word(word).encode("utf-8", "replace"))
        return made


def masked_numbers(line: str, known: _Hashes) -> list[int]:
    """The look-alike form of a line: numbers of its words, without names, numbers and dates; signs of scripts without blanks are words."""
    return [known[w] for w in (_WIDE.sub(r" \g<0> ", line) if _WIDE.search(line) else line).split()]


def shingles(lines: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the five-word shingles of several lines, line after line, and where each line starts; a shorter line is one shingle."""
    lengths = np.array([len(x) for x in lines], dtype=np.int64)
    words = np.fromiter((w for x in lines for w in x), dtype=np.uint64, count=int(lengths.sum()))
    words = np.concatenate([words, np.zeros(SHINGLE_WORDS, dtype=np.uint64)])
    owner = np.repeat(np.arange(len(lines)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(owner))  # words from here to the end of the line
    made = np.zeros(len(owner), dtype=np.uint64)
    for i in range(SHINGLE_WORDS):
        made = np.where(left > i, (made ^ words[i : i + len(owner)]) * _STEP, made)
        made ^= made >> np.uint64(29)
    whole = (left >= SHINGLE_WORDS) | (left == np.repeat(lengths, lengths))
    made, owner = made[whole], owner[whole]
    order = np.lexsort((made, owner))
    made, owner = made[order], owner[order]
    first = np.ones(len(made), dtype=bool)
    first[1:] = (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])
    made, owner = made[first], owner[first]
    return made, np.searchsorted(owner, np.arange(len(lines)))


def signatures(made: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band values and sketches of the shingle sets that begin at ``starts``."""
    least = np.empty((len(starts), BANDS * BAND_ROWS), dtype=np.uint64)
    for i in range(BANDS * BAND_ROWS):
        mixed = made * _ODD[i] + _PLUS[i]
        least[:, i] = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), starts)
    bands = np.zeros((len(starts), BANDS), dtype=np.uint64)
    for j in range(BAND_ROWS):
        bands = (bands ^ least[:, j::BAND_ROWS]) * _STEP
        bands ^= bands >> np.uint64(31)
    return bands, np.bitwise_xor.reduceat(np.uint64(1) << ((made >> np.uint64(32)) & np.uint64(63)), starts)


def _digest(data: bytes) -> tuple[int, int]:
    digest = blake2b(data, digest_size=16).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


_SCHEMA = "doc {kind}, line_no int, k1 bigint, k2 bigint, m bigint, n int, bands array<bigint>, sketch bigint, sh array<int>"


def _line_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of each non-blank line; what belongs to its node comes with the node's first line in a batch."""
    hashes = _Hashes()
    for batch in sliced(batches):
        if len(hashes) > hashes.MOST_KEPT:
            hashes.clear()
        rows, numbers, k1, k2, ms, told, sets, origins = [], [], [], [], [], [], [], []
        known: dict[tuple[str, str], tuple[int, int, int, list[int]]] = {}
        nodes: set[int] = set()
        for row, (src, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            source = src.encode("utf-8", "replace") + b"\n"
            own = _digest(source)[0]
            for number, line in enumerate(text.split("\n")):
                if not line or line.isspace():
                    continue
                made = known.get((src, line))
                if made is None:
                    words = masked_numbers(line, hashes)
                    made = known[src, line] = (*_digest(source + line_form(line).encode("utf-8", "replace")), _digest(source + np.array(words, dtype=np.uint32).tobytes())[0], words)
                a, b, m, words = made
                rows.append(row)
                numbers.append(number)
                k1.append(a)
                k2.append(b)
                ms.append(m)
                new = m not in nodes and len(words) > SHINGLE_WORDS
                told.append(len(sets) if new else None)
                if new:
                    nodes.add(m)
                    sets.append(words)
                    origins.append(own)
        if not rows:
            continue
        taken, which = pa.array(rows), pa.array(told, pa.int32())
        if sets:
            made, starts = shingles(sets)
            bands, sketch = signatures(made, starts)
            # bands are those of a source: lines of two sources share none
            bands = (bands ^ np.array(origins, dtype=np.int64).view(np.uint64)[:, None]) * _STEP + np.arange(BANDS, dtype=np.uint64)
            ends = np.append(starts[1:], len(made))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(made)), pa.int32()), pa.array((made >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            band_lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.view(np.int64).ravel()))
            node = [pa.array((ends - starts).astype(np.int32)), band_lists, pa.array(sketch.view(np.int64)), lists]
        else:
            node = [pa.array([], t) for t in (pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(taken), pa.array(numbers, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(ms, pa.int64()), *[x.take(which) for x in node]],
            names=["doc", "line_no", "k1", "k2", "m", "n", "bands", "sketch", "sh"],
        )


def described_lines(documents: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """One row of numbers for each non-blank line: document, place, form, node, and with its first line in a batch what belongs to the node."""
    slim = documents.where(F.col(key).isNotNull() & F.col(source).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.lower(F.trim(F.col(source))).alias("src"), F.col(text).alias("text"))
    return slim.mapInArrow(_line_mapper, _SCHEMA.format(kind=documents.schema[key].dataType.simpleString()))


def _may_be_similar(similarity: float) -> Column:
    """What nodes of at least ``similarity`` fulfil: sets of sizes n and n_ that are so similar differ in (n + n_) * (1 - similarity) / (1 + similarity) shingles at most."""
    differing = F.bit_count(F.col("sketch").bitwiseXOR(F.col("sketch_")))
    return (differing * (1 + similarity) <= (F.col("n") + F.col("n_")) * (1 - similarity) + 1e-6) & (F.least("n", "n_") >= similarity * F.greatest("n", "n_") - 1e-6)


def _buckets(lines: DataFrame) -> DataFrame:
    """Nodes of each bucket that holds several, with their number ``k`` and place ``r`` in it."""
    nodes = lines.where("bands is not null")
    # a node comes once for each batch that has it, and once is enough
    held = nodes.select("m", "n", "sketch", F.explode("bands").alias("bucket")).repartition("bucket").groupBy("bucket", "m").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    bucket = Window.partitionBy("bucket")
    held = held.withColumn("r", F.row_number().over(bucket.orderBy("m"))).withColumn("k", F.count("*").over(bucket)).where("k > 1")
    return write_stage(held, "site-line-buckets")


def _candidates(held: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a < b`` of nodes that share a bucket of up to PAIR_BUCKET and may be similar by their sketches and sizes."""
    few = held.where(F.col("k") <= PAIR_BUCKET).select("bucket", "m", "n", "sketch").repartition("bucket")
    other = few.select("bucket", F.col("m").alias("m_"), F.col("n").alias("n_"), F.col("sketch").alias("sketch_"))
    return few.join(other, "bucket").where((F.col("m") < F.col("m_")) & _may_be_similar(similarity)).select(F.col("m").alias("a"), F.col("m_").alias("b")).distinct()


def block_links(sets: pa.ListArray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places ``a, b`` of sets of at least ``similarity`` that connect all that such pairs connect: a forest over all pairs."""
    sizes = np.diff(sets.offsets.to_numpy())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, column, times = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = times > 1  # others are in no common part
    owner, column = owner[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    common = np.zeros((len(sizes), len(sizes)), dtype=np.float64)
    for start in range(0, int(shared.sum()), BLOCK_SHINGLES):
        here = (column >= start) & (column < start + BLOCK_SHINGLES)
        held = np.zeros((len(sizes), BLOCK_SHINGLES), dtype=np.float32)
        held[owner[here], column[here] - start] = 1
        common += held @ held.T
    alike = common >= similarity * (sizes[:, None] + sizes[None, :] - common)
    free = np.ones(len(sizes), dtype=bool)
    a, b = [], []
    for seed in range(len(sizes)):
        waiting = [seed] if free[seed] else []
        free[seed] = False
        while waiting:
            at = waiting.pop()
            new = np.flatnonzero(alike[at] & free)
            free[new] = False
            a.append(np.full(len(new), at))
            b.append(new)
            waiting += new.tolist()
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def _large_links(large: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` of the nodes of buckets of more than PAIR_BUCKET: each two nodes of a bucket meet in a block."""
    last = F.floor((F.col("k") - 1) / BLOCK)
    placed = large.select("bucket", "m", F.floor((F.col("r") - 1) / BLOCK).alias("g"), last.alias("last"))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("last")), lambda h: (h != F.col("g")) | (F.col("last") == 0))
    blocks = placed.select("bucket", "m", "g", F.explode(others).alias("h")).select("bucket", F.least("g", "h").alias("low"), F.greatest("g", "h").alias("high"), "m")

    def run(block: pa.Table) -> pa.Table:
        nodes = block.column("m").to_numpy()
        lists = block.column("sh").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else pa.concat_arrays([lists])
        offsets = lists.offsets.to_numpy()
        a, b = block_links(pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), lists.flatten()), similarity)
        return pa.table({"a": pa.array(nodes[a], pa.int64()), "b": pa.array(nodes[b], pa.int64())})

    return blocks.join(sets, "m").groupBy("bucket", "low", "high").applyInArrow(run, "a bigint, b bigint")


def _sent(nodes: DataFrame) -> DataFrame:
    """``nodes``, broadcast if they are few."""
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes


def line_clusters(lines: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """``m, component``: the nodes that are linked to others, with the least node of their component."""
    # lines of one form can differ in their look-alike form, as that goes by capitals: those are linked
    several = cut_lineage(lines.groupBy("k1", "k2").agg(F.min("m").alias("a"), F.max("m").alias("b")).where("a <> b").select("k1", "k2", "a"))
    alike = lines.select("k1", "k2", "m").join(_sent(several), ["k1", "k2"]).where("a <> m").select("a", F.col("m").alias("b")).distinct()
    held = _buckets(lines)
    large = held.where(F.col("k") > PAIR_BUCKET)
    pairs = cut_lineage(_candidates(held, similarity))
    wanted = cut_lineage(pairs.select(F.col("a").alias("m")).union(pairs.select(F.col("b").alias("m"))).union(large.select("m")).distinct())
    sets = cut_lineage(lines.where("sh is not null").select("m", "sh").join(_sent(wanted), "m", "left_semi").dropDuplicates(["m"]))
    common = F.size(F.array_intersect("sh", "sh_"))
    full = pairs.join(sets.withColumnRenamed("m", "a"), "a").join(sets.select(F.col("m").alias("b"), F.col("sh").alias("sh_")), "b")
    links = full.where(common >= similarity * (F.size("sh") + F.size("sh_") - common)).select("a", "b")
    return connected_components(links.union(_large_links(large, sets, similarity)).union(alike)).withColumnRenamed("id", "m")


def clustered_lines(documents: DataFrame, *, key: str, source: str, text: str, min_documents: int = MIN_DOCUMENTS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The lines, and the nodes ``m`` of all components that occur in at least ``min_documents`` documents."""
    lines = write_stage(described_lines(documents, key, source, text), "site-lines")
    clusters = line_clusters(lines, similarity=similarity)
    # documents are counted by a hash of their key; the keys themselves travel only with the lines that are found
    placed = lines.select("m", F.xxhash64("doc").alias("d")).join(clusters, "m", "left").select("d", F.coalesce("component", "m").alias("component"))
    counted = cut_lineage(placed.distinct().groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents).select("component"))
    # a node that is linked to no other is its own component, and so is the least node of each component
    return lines, cut_lineage(clusters.join(counted, "component", "left_semi").select("m").union(counted.select(F.col("component").alias("m"))).distinct())


def near_repeated_lines(
    documents: DataFrame, *, key: str, source: str, text: str, min_documents: int = MIN_DOCUMENTS, similarity: float = SIMILARITY
) -> DataFrame:
    """``key, line_no`` of each line of a component of near lines that occurs in at least ``min_documents`` documents of its source."""
    lines, nodes = clustered_lines(documents, key=key, source=source, text=text, min_documents=min_documents, similarity=similarity)
    return lines.select("doc", "line_no", "m").join(nodes, "m", "left_semi").select(F.col("doc").alias(key), "line_no").distinct()


def repeated_lines(documents: DataFrame, *, key: str, source: str, text: str, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``key, line_no`` of the lines of these components whose own form occurs in at least ``min_documents`` documents of its source."""
    lines, nodes = clustered_lines(documents, key=key, source=source, text=text, min_documents=min_documents)
    # all nodes of a form are in one component, so lines are found by their forms alone
    found = lines.select("k1", "k2", "m", F.xxhash64("doc").alias("d")).join(nodes, "m", "left_semi").select("k1", "k2", "d").distinct()
    heavy = cut_lineage(found.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents).select("k1", "k2"))
    return lines.select("doc", "line_no", "k1", "k2").join(heavy, ["k1", "k2"], "left_semi").select(F.col("doc").alias(key), "line_no").distinct()


def without_lines(documents: DataFrame, removed: DataFrame, *, key: str, text: str) -> DataFrame:
    """``key`` and the text without the lines of ``removed``; the order of the others and all blank lines stay."""
    gone = removed.groupBy(key).agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    joined = documents.select(key, text).join(gone, key, "left")
    return joined.select(key, F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias("clean_text"))


def without_repeated(documents: DataFrame, *, key: str, source: str, text: str, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``key`` and the text without the lines that are repeated, equal or near, in ``min_documents`` documents of a source: equal lines are near ones."""
    removed = near_repeated_lines(documents, key=key, source=source, text=text, min_documents=min_documents)
    return without_lines(documents, removed, key=key, text=text)
