"""Problem 6: one form for text that looks the same but differs in its characters.

Classes of code points that look alike are built by union-find over the pairs of a
small stated table, the compatibility and case mappings of Unicode, blanks, and hyphens. The
representative of a class is its most frequent member in the corpus. Signs without width
vanish; a sign that Unicode writes as several (a ligature, a letter with its accent) becomes the
representatives of its parts, so that composed and combining accents agree. Keywords whose
forms agree are one class of strings, again represented by the most frequent spelling.
Mentions are found, and rewritten greedily from left to right and longest first, by
one Aho-Corasick automaton over all keyword classes.

A null or empty text has no mentions; a null keyword, or one without any visible sign, is in
no text. Repeated rows count once in ``hidden_mentions``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.batches import sliced

# Letters of other scripts that look like the Latin letter before them.
LOOK_ALIKES = {
    "a": "аɑαА", "b": "ВвƄЬΒ", "c": "сСϲⅽᴄ", "d": "ԁժ", "e": "еЕҽ", "f": "ғϝ", "g": "ɡց", "h": "һНҺհΗ", "i": "іІıɩΙ",
    "j": "јЈϳ", "k": "КкκΚ", "l": "ӏⅼ", "m": "МмΜ", "n": "ոΝ", "o": "оОοΟօ", "p": "рРρΡ", "q": "ԛգ", "r": "г", "s": "ѕЅꜱ",
    "t": "ТтΤ", "u": "սυ", "v": "ѵᴠν", "w": "ԝѡ", "x": "хХΧ×", "y": "уУΥү", "z": "ΖᴢƵ",
}
# Capitals that look like a letter which their own small form doesn't look like; they are not joined with it.
CAPITALS_ONLY = frozenset("ΝΗΥΓΛΒ")
# Greek capitals that look like Cyrillic ones.
CAPITAL_PAIRS = [("Г", "Γ"), ("П", "Π"), ("Л", "Λ"), ("Ф", "Φ")]
# Pairs that look alike within Arabic, Devanagari and punctuation.
OTHER_PAIRS = [
    ("ي", "ی"), ("ك", "ک"), ("ه", "ہ"), ("ه", "ھ"), ("'", "’"), ("'", "‘"), ("'", "ʼ"), ("'", "′"), ("'", "＇"), ("'", "`"), ("'", "´"), ("#", "＃"), ("#", "﹟"), ("#", "♯"), ("_", "＿"),
]
# Signs without width that have no common category, and the stretch sign of Arabic.
NO_WIDTH = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x2065, 0x3164, 0xFFA0, 0x0640, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
VISIBLE_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
HYPHENS = {0x2212, 0x2043, 0x02D7, 0x30A0, 0xFE63, 0xFF0D}
_BLANKS = re.compile(" {2,}")
#: Two or more marks with a class of their own in one run.
_MARKS = re.compile("[\u0300-\u036F\u0483-\u0487\u064B-\u065F\u0670\u06D6-\u06ED\u093C\u094D\u1AB0-\u1AFF\u1DC0-\u1DFF\u20D0-\u20FF\u3099\u309A]{2,}")


class UnionFind:
    """Transitive classes over any hashable members."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        root = x
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, x, y) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> dict:
        out = defaultdict(set)
        for x in list(self.parent):
            out[self.find(x)].add(x)
        return out


def _kind(c: str) -> str:
    """Blank, hyphen, nothing to see, or an ordinary sign. Line feeds stay what they are."""
    category, code = unicodedata.category(c), ord(c)
    if category == "Zs" or c == "\t":
        return "blank"
    if category == "Pd" or code in HYPHENS:
        return "hyphen"
    if (category == "Cf" and code not in VISIBLE_FORMAT) or code in NO_WIDTH:
        return "none"
    return "sign"


def character_classes(characters: Iterable[str]) -> UnionFind:
    """Look-alike classes of the given characters and of what they are mapped to."""
    uf = UnionFind()
    for letter, others in LOOK_ALIKES.items():
        for other in others:
            uf.union(letter, other)
    for a, b in OTHER_PAIRS + CAPITAL_PAIRS:
        uf.union(a, b)
    # small capitals, named after their letter
    for code in [*range(0x1D00, 0x1D23), *range(0x0262, 0x02A0), 0xA730, 0xA731]:
        name = unicodedata.name(chr(code), "")
        if re.fullmatch(r"LATIN LETTER SMALL CAPITAL [A-Z]", name):
            uf.union(chr(code), name[-1].lower())
    waiting, seen = list(dict.fromkeys([*characters, *list(uf.parent)])), set()
    while waiting:
        c = waiting.pop()
        if c in seen:
            continue
        seen.add(c)
        uf.find(c)
        kind = _kind(c)
        if kind == "blank":
            uf.union(c, " ")
        elif kind == "hyphen":
            uf.union(c, "-")
        elif kind == "sign":
            for other in (unicodedata.normalize("NFKD", c), c.casefold(), c.lower(), c.upper()):
                if c != other and (c in CAPITALS_ONLY or other in CAPITALS_ONLY):
                    continue
                if len(other) == 1:
                    uf.union(c, other)
                    waiting.append(other)
                elif other:
                    waiting.extend(other)
    return uf


def folding_table(counts: Mapping[int, int], extra: str = "") -> dict[int, str]:
    """What each code point becomes: the representative of its class, nothing, or several representatives.

    ``counts`` gives the frequency of code points in the corpus; ties go to lower case, then to the smaller one.
    """
    characters = [chr(c) for c in sorted(counts) if not 0xD800 <= c < 0xE000] + sorted(set(extra))
    uf = character_classes(characters)
    best = {root: min(members, key=lambda m: (-counts.get(ord(m), 0), m != m.casefold(), ord(m))) for root, members in uf.classes().items()}

    def folded(c: str, depth: int = 0) -> str:
        if _kind(c) == "none":
            return ""
        parts = unicodedata.normalize("NFKD", c)
        if len(parts) == 1:
            case = c.casefold()
            parts = case if len(case) > 1 else c
        if len(parts) > 1 and depth < 4:
            return "".join(folded(p, depth + 1) for p in parts)
        return best[uf.find(c)] if c in uf.parent else c

    table: dict[int, str] = {}
    for c in {*characters, *uf.parent}:
        to = folded(c)
        if to != c:
            table[ord(c)] = to
    return table


def fold(text: str, table: Mapping[int, str]) -> str:
    """The one form of ``text``; runs of blanks become one, and marks on one letter stand in the order of their classes."""
    out = text.translate(table)
    if _MARKS.search(out):
        out = _MARKS.sub(lambda m: "".join(sorted(m.group(), key=unicodedata.combining)), out)
    return _BLANKS.sub(" ", out) if "  " in out else out


def keyword_classes(keywords: Iterable[tuple[object, str]], table: Mapping[int, str], spelled: Mapping[str, int] | None = None) -> dict[str, tuple[str, list]]:
    """Form -> (representative spelling, ids). ``spelled`` counts spellings; else each keyword row counts one."""
    spelled = spelled or {}
    uf, rows = UnionFind(), defaultdict(list)
    for identity, keyword in keywords:
        if keyword is None or not (form := fold(keyword, table).strip()):
            continue
        uf.union("f" + form, "k" + keyword)
        rows[keyword].append(identity)
    out = {}
    for members in uf.classes().values():
        form = next(m[1:] for m in members if m[0] == "f")
        spellings = [m[1:] for m in members if m[0] == "k"]
        best = min(spellings, key=lambda k: (-spelled.get(k, 0), -len(rows[k]), k))
        out[form] = (best, sorted((i for k in spellings for i in rows[k]), key=lambda i: (i is None, i)))
    return out


def automaton(forms: Iterable[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for form in forms:
        made.add_word(form, form)
    if len(made):
        made.make_automaton()
    return made


def greedy_mentions(folded: str, made) -> list[tuple[int, int, str]]:
    """Leftmost-longest mentions (start, end, form) without overlap."""
    hits = [(end - len(form) + 1, -len(form), form) for end, form in made.iter(folded)] if len(made) else []
    out, free = [], 0
    for start, negative, form in sorted(hits):
        if start >= free:
            out.append((start, start - negative, form))
            free = start - negative
    return out


def rewrite(text: str, table: Mapping[int, str], classes: Mapping[str, tuple[str, list]], made) -> str:
    """The folded text with every mention in the representative spelling of its keyword class."""
    folded = fold(text, table)
    out, at = [], 0
    for start, end, form in greedy_mentions(folded, made):
        out += [folded[at:start], classes[form][0]]
        at = end
    return "".join(out) + folded[at:]


def code_point_counts(df: DataFrame, *columns: str) -> dict[int, int]:
    """How often each code point occurs; at most as many numbers as Unicode has code points reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = defaultdict(int)
        for batch in sliced(batches):
            for column in batch.columns:
                for start in range(0, len(column), 256):
                    texts = "".join(t for t in column.slice(start, 256).to_pylist() if t)
                    codes = np.frombuffer(texts.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                    counts = np.bincount(codes)
                    for code in np.flatnonzero(counts):
                        total[int(code)] += int(counts[code])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["code", "n"])

    counted = df.select(*columns).mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return {row.code: row.n for row in counted.collect()}


def _hidden_mapper(table: dict[int, str], classes: dict[str, tuple[str, list]], lowered: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(classes)
        for batch in sliced(batches):
            rows, ids = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if not text or not len(made):
                    continue
                found = {form for _, form in made.iter(fold(text, table))}
                if found:
                    low = text.lower()
                    for form in found:
                        for identity in classes[form][1]:
                            if lowered[identity] not in low:
                                rows.append(row)
                                ids.append(identity)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(ids, pa.int32())], names=["key", "kw"])

    return run


def hidden_mentions(documents: DataFrame, keywords: Iterable[tuple[int, str]], *, key: str, text: str) -> DataFrame:
    """``key, kw_id`` of the keywords that a reader sees in ``text`` but a lower-case comparison misses.

    ``keywords`` is the codebook, a table of bounded size that is held on the driver.
    """
    keywords = [(i, k) for i, k in keywords if i is not None and k is not None]
    table = folding_table(code_point_counts(documents, text), extra="".join(k for _, k in keywords))
    classes = keyword_classes(keywords, table)
    kind = documents.schema[key].dataType.simpleString()
    slim = documents.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull())
    found = slim.mapInArrow(_hidden_mapper(table, classes, {i: k.lower() for i, k in keywords}), f"key {kind}, kw int")
    return found.distinct().select(F.col("key").alias(key), F.col("kw").alias("kw_id"))


def spelling_counts(documents: DataFrame, spellings: Iterable[str], *, key: str, text: str) -> dict[str, int]:
    """How often each spelling stands in the texts as it is stored, leftmost-longest; repeated rows count once."""
    spellings = sorted({x for x in spellings if x})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, total = automaton(spellings), defaultdict(int)
        for batch in sliced(batches):
            for value in batch.column(0).to_pylist():
                for _, _, spelling in greedy_mentions(value, made):
                    total[spelling] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["spelling", "n"])

    rows = documents.where(F.col(text).isNotNull() & F.col(key).isNotNull()).groupBy(key, F.xxhash64(text)).agg(F.min(text).alias("text")).select("text")
    return {r.spelling: r.n for r in rows.mapInArrow(run, "spelling string, n bigint").groupBy("spelling").agg(F.sum("n").alias("n")).collect()}


def rewritten_texts(documents: DataFrame, keywords: Iterable[tuple[int, str]], *, key: str, text: str) -> DataFrame:
    """``key, rewritten``: each whole text folded, its mentions in the spelling of their class that is most frequent in the texts."""
    keywords = [(i, k) for i, k in keywords if i is not None and k is not None]
    table = folding_table(code_point_counts(documents, text), extra="".join(k for _, k in keywords))
    classes = keyword_classes(keywords, table, spelling_counts(documents, [k for _, k in keywords], key=key, text=text))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(classes)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rewrite(v, table, classes, made) if v else v for v in batch.column(1).to_pylist()], pa.string())], names=["key", "rewritten"])

    slim = documents.select(key, text).where(F.col(key).isNotNull())
    return slim.mapInArrow(run, f"key {kind}, rewritten string").distinct().withColumnRenamed("key", key)


def mention_counts(documents: DataFrame, keywords: Iterable[tuple[int, str]], *, key: str, text: str) -> DataFrame:
    """``key, keyword, mentions``: greedy mentions under the representative spelling of each keyword class."""
    keywords = [(i, k) for i, k in keywords if i is not None and k is not None]
    table = folding_table(code_point_counts(documents, text), extra="".join(k for _, k in keywords))
    classes = keyword_classes(keywords, table, spelling_counts(documents, [k for _, k in keywords], key=key, text=text))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(classes)
        for batch in sliced(batches):
            rows, names, counts = [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                if not value or not len(made):
                    continue
                found: dict[str, int] = defaultdict(int)
                for _, _, form in greedy_mentions(fold(value, table), made):
                    found[classes[form][0]] += 1
                rows += [row] * len(found)
                names += found
                counts += found.values()
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(names), pa.array(counts, pa.int32())], names=["key", "kw", "n"])

    slim = documents.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull())
    counted = slim.mapInArrow(run, f"key {kind}, kw string, n int")
    return counted.groupBy("key", "kw").agg(F.max("n").alias("mentions")).select(F.col("key").alias(key), F.col("kw").alias("keyword"), "mentions")
