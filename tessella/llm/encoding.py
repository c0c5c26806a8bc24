"""Problem 8: the whole corpus as ids of a public vocabulary.

Encoding is a monoid: a text is the concatenation of its halves, and the ids of the
whole follow from the ids of both halves and of a small window around the seam. Long
texts are encoded as a balanced tree of leaves whose neighbours are joined this way.

Why a join is exact. The splitting pattern of the vocabulary reads from left to
right and looks at no character before the current one, so what follows a boundary
between two pieces depends only on the text after it. A place where a letter is
followed by a non-letter, a digit by a non-digit, or any visible sign by white space
always is such a boundary, whatever surrounds it, since no alternative of the pattern
goes across it. Between the last certain boundary of the left half and the first one of the
right half the seam is encoded anew; outside, the ids are those of the halves. The
window doubles until both boundaries are inside.

Null and empty texts have an empty list of ids. Strings that look like special tokens
are ordinary text.
"""

from __future__ import annotations

import ast
import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.batches import sliced

#: Folder of the vocabulary files; every function takes another one.
DEFAULT_FOLDER = "/opt/tokenizers"
DEFAULT_TOKENIZER = "byte_bpe_50k"
#: Code points encoded in one piece; longer texts become a tree.
LEAF_CHARS = 8192
FIRST_WINDOW = 64


def _splitting_pattern(folder: str) -> str:
    """The pattern stated beside the vocabulary files."""
    with open(os.path.join(folder, "__init__.py"), encoding="utf-8") as source:
        for statement in ast.parse(source.read()).body:
            if isinstance(statement, ast.Assign) and getattr(statement.targets[0], "id", "") == "PATTERN":
                return ast.literal_eval(statement.value)
    raise ValueError(f"{folder} states no splitting pattern")


@lru_cache(maxsize=4)
def encoding(tokenizer: str = DEFAULT_TOKENIZER, folder: str = DEFAULT_FOLDER):
    """The byte-level vocabulary, loaded once in each Python process."""
    import tiktoken

    with open(os.path.join(folder, f"{tokenizer}.tiktoken"), "rb") as ranks_file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks_file if line.strip())}
    return tiktoken.Encoding(tokenizer, pat_str=_splitting_pattern(folder), mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _certain_boundary():
    import regex

    return regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=\S)(?=\s)")


def _last_boundary(text: str, window: int) -> int:
    """Index of the last certain boundary strictly inside the last ``window`` signs, or 0 at the text's start, or -1."""
    start = max(0, len(text) - window)
    found = -1
    for match in _certain_boundary().finditer(text, max(start, 1), len(text)):
        if match.start() < len(text):
            found = match.start()
    if found > 0:
        return found
    return 0 if start == 0 else -1


def _first_boundary(text: str, window: int) -> int:
    """Index of the first certain boundary inside the first ``window`` signs, the text's length at its end, or -1."""
    for match in _certain_boundary().finditer(text, 1, min(len(text), window + 1)):
        if match.start() < min(len(text), window):
            return match.start()
    return len(text) if window >= len(text) else -1


def join_ids(enc, left: str, left_ids: list[int], right: str, right_ids: list[int], window: int = FIRST_WINDOW) -> list[int]:
    """Ids of ``left + right`` from the ids of both."""
    if not left or not right:
        return left_ids + right_ids
    while True:
        begin, end = _last_boundary(left, window), _first_boundary(right, window)
        if begin >= 0 and end >= 0:
            break
        window *= 2
    tail, head = left[begin:], right[:end]
    drop_left, drop_right = len(enc.encode_ordinary(tail)), len(enc.encode_ordinary(head))
    return left_ids[: len(left_ids) - drop_left] + enc.encode_ordinary(tail + head) + right_ids[drop_right:]


def tree_encode(enc, text: str, leaf: int = LEAF_CHARS) -> list[int]:
    """Ids of ``text`` by halving down to leaves and joining upwards."""
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    middle = len(text) // 2
    left, right = text[:middle], text[middle:]
    return join_ids(enc, left, tree_encode(enc, left, leaf), right, tree_encode(enc, right, leaf))


def tree_decode(enc, ids: list[int], leaf: int = LEAF_CHARS) -> bytes:
    """Bytes of ``ids``: decoding is plain concatenation up the tree."""
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    middle = len(ids) // 2
    return tree_decode(enc, ids[:middle], leaf) + tree_decode(enc, ids[middle:], leaf)


def _mapper(tokenizer: str, folder: str, leaf: int, only_count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer, folder)
        for batch in sliced(batches):
            ids = [tree_encode(enc, t, leaf) if t else [] for t in batch.column(1).to_pylist()]
            made = pa.array([len(x) for x in ids], pa.int32()) if only_count else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["key", "value"])

    return run


def encode_column(
    df: DataFrame, key: str | Column, text: str | Column, *, tokenizer: str = DEFAULT_TOKENIZER,
    folder: str = DEFAULT_FOLDER, leaf: int = LEAF_CHARS, only_count: bool = False,
) -> DataFrame:
    """Columns ``key`` and ``value``: the ids of ``text`` or, with ``only_count``, their number.

    Works on each Arrow batch by itself: no shuffle, and lost executors only repeat their own batches.
    A null key is kept; a null or empty text has no ids. Other columns of ``df`` never reach Python.
    """
    slim = df.select((F.col(key) if isinstance(key, str) else key).alias("key"), (F.col(text) if isinstance(text, str) else text).alias("value"))
    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(_mapper(tokenizer, folder, leaf, only_count), f"key {kind}, value {'int' if only_count else 'array<int>'}")
