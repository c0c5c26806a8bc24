"""Problem 4: a language with a confidence for each document and each segment of it.

The script of a word narrows its candidates: Cyrillic, Arabic, Devanagari and kana
leave one language, Han characters two, Latin letters five. Within a script, words have scores,
log-ratios of their frequencies in each language, learned from all texts
themselves: function words that only one language has state the language of a line,
and all words of the line are counted for it; unknown words fall back on their trigrams. Scores lie in
a file that executors fetch and read by pages, so the vocabulary has no bound. Viterbi
with a penalty for switching then labels every word of a text, so that names and quoted words don't
break a segment while a passage in another language does.

Texts are labelled as a whole, however long. Cyrillic and Arabic letters that Russian and Arabic don't have lower the confidence.

A line is written in the language that most of its letters are labelled with. A document's
languages are those of at least a quarter of its non-blank lines. A text that is null or blank leaves the
title to decide. Texts without words have no language. Repeated rows give one result.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.batches import sliced
from tessella.session import write_stage

LANGUAGES = ("en", "es", "fr", "de", "pt", "ru", "ja", "zh", "ar", "hi")
LATIN = 5
RU, JA, ZH, AR, HI = range(5, 10)
#: Price of a change of language, and of a word in a script that the language doesn't use.
SWITCH_PENALTY, FOREIGN_SCRIPT = 6.0, -2.5
CLIP = 3.0
LINE_SHARE = 0.25

# Function words that only one of the five languages in Latin script uses.
FUNCTION_WORDS = {
    "en": "the of and to that was for on with by at from which were an said this have has been their they would about who will more not are he she his her while",
    "es": "el los las del y una con al su más lo fue según mientras pero sus ha sobre también entre hasta cuando muy sin ya este desde después había dijo esta en por",
    "fr": "le les des du et dans pour sur au aux est avec par une qui ce ont selon près été elle il à ses cette sans plus mais ou leur l d qu tandis dit",
    "de": "der die das und den dem des ein eine einer einen einem von zu mit im nicht auf für am vor ist wie sagte nahe bei sich auch nach oder aus war wurde über werden",
    "pt": "o os do da dos das em um uma no na nos nas ao não foi pelo pela mais com disse segundo enquanto perto são à seu sua também até depois é ou",
}
# Other names of the ten languages; longer codes are cut at their first mark.
LANGUAGE_NAMES = {
    "en": "en eng english", "es": "es spa spanish castilian", "fr": "fr fra fre french", "de": "de deu ger german", "pt": "pt por portuguese",
    "ru": "ru rus russian", "ja": "ja jpn japanese jp", "zh": "zh zho chi cmn chinese mandarin", "ar": "ar ara arb arabic", "hi": "hi hin hindi",
}
NAMED = {name: code for code, names in LANGUAGE_NAMES.items() for name in names.split()}
# Words that stand for a missing title.
NO_TITLE = frozenset("nan null none n/a na - -- unknown undefined und nil missing".split()) | {"not available", "no title", ""}
# Cyrillic and Greek letters taken for the Latin ones that they look like, inside Latin words only.
_INSIDE_LATIN = str.maketrans("аеорсухіјѕԁһкмтвнАВЕКМНОРСТУХІЈЅοαινρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhkmtbhABEKMHOPCTYXIJSoaivpABEZHIKMNOPTYX")

# Letters that Cyrillic and Arabic script have for other languages than Russian and Arabic.
_OTHER_LETTERS = re.compile(r"[\u0400\u0402-\u040F\u0450\u0452-\u052F\u0671-\u06D3\u06D5\u06EE\u06EF\u06FA-\u06FF\u0750-\u077F]")
_MIXED = re.compile("[Ͱ-ӿ]")
_WORD = re.compile(r"[A-Za-zÀ-ɏḀ-ỿͰ-ӿ̀-ͯ]+|[぀-ヿｦ-ﾟ]+|[㐀-鿿々]+|[ऀ-ॿ]+|[؀-ۿݐ-ݿﭐ-﷿ﹰ-ﻼ]+")
_ASCII_WORD = re.compile("[A-Za-z]+")
_LETTER_WORD = re.compile(r"[A-Za-zÀ-ɏḀ-ỿͰ-ӿ̀-ͯ]+")
_OTHER_SCRIPTS = re.compile(r"[぀-ヿｦ-ﾟ㐀-鿿々ऀ-ॿ؀-ۿݐ-ݿﭐ-﷿ﹰ-ﻼ]")
_LATIN_LETTER = re.compile("[A-Za-zÀ-ɏ]")
_SPREAD = re.compile(r"[Ａ-Ｚａ-ｚ\U0001D400-\U0001D7FF­​-‍⁠﻿]")


def named_language(label: str | None) -> str | None:
    """The code that a label names: codes, longer codes and English names do, anything else doesn't."""
    if label is None:
        return None
    return NAMED.get(re.split(r"[-_ (]", label.strip().lower(), maxsplit=1)[0])


def _readable(text: str) -> str:
    """Letters of another width or style as plain ones, signs without width gone; most texts have neither."""
    if _SPREAD.search(text):
        import unicodedata

        text = re.sub(r"[­​-‍⁠﻿]", "", text)
        if _SPREAD.search(text):
            text = unicodedata.normalize("NFKC", text)
    return text


def _words(line: str) -> list[str]:
    """The words of a line, those of ``_WORD``; one class of letters is enough for most lines."""
    if line.isascii():
        return _ASCII_WORD.findall(line)
    return _WORD.findall(line) if _OTHER_SCRIPTS.search(line) else _LETTER_WORD.findall(line)


def _stated_language(words: list[str], owner: dict[str, str]) -> str | None:
    """The language whose own function words a line uses, clearly more than any other's."""
    votes = Counter(filter(None, map(owner.get, words)))
    if not votes:
        return None
    (best, n), *rest = votes.most_common(2)
    return best if n >= 2 and n >= 3 * (rest[0][1] if rest else 0) else None


def _owners() -> dict[str, str]:
    seen = Counter(w for words in FUNCTION_WORDS.values() for w in set(words.split()))
    return {w: code for code, words in FUNCTION_WORDS.items() for w in words.split() if seen[w] == 1}


def _trigrams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def _ratios(table: np.ndarray, totals: np.ndarray, weight: float) -> np.ndarray:
    """Clipped log-ratios of each row's rate in a language to its mean rate."""
    rate = table / totals
    share = (rate + 1e-9) / (rate.mean(1, keepdims=True) + 1e-9)
    trust = 1 - np.exp(-table.sum(1, keepdims=True) / 4)
    return np.clip(np.log(share + 0.02) * trust * weight, -CLIP, CLIP)


class WordScores:
    """Scores of words for each language; words are looked up once and kept by number."""

    MOST_KEPT = 400_000

    def __init__(self, counts: dict[str, list[int]], grams: dict[str, list[int]], lines: list[int]) -> None:
        words_in, grams_in = (np.array(list(x.values()), dtype=float).reshape(-1, LATIN) for x in (counts, grams))
        self.known = dict(zip(counts, _ratios(words_in, np.array(lines, dtype=float) + 1.0, 1.0).tolist()))
        self.grams = dict(zip(grams, _ratios(grams_in, np.maximum(grams_in.sum(0), 1.0), 0.25).tolist()))
        self.clear()

    @classmethod
    def stored(cls, known: _ScoreTable, grams: _ScoreTable) -> WordScores:
        made = cls.__new__(cls)
        made.known, made.grams = known, grams
        made.clear()
        return made

    def clear(self) -> None:
        self.number = _Numbers(self)
        #: Of words whose scores aren't in the arrays yet: scores, whether a word has letters that its only candidate doesn't use, length.
        self.new: list[tuple[list[float], bool, int]] = []
        self.rows = np.zeros((1024, len(LANGUAGES)), dtype=np.float64)
        self.strange = np.zeros(1024)
        self.lengths = np.zeros(1024)
        self.held = 0

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, strangeness and lengths of all words by their number."""
        if self.new:
            before, self.held = self.held, self.held + len(self.new)
            if self.held > len(self.rows):
                for name in ("rows", "strange", "lengths"):
                    old = getattr(self, name)
                    made = np.zeros((2 * self.held, *old.shape[1:]))
                    made[:before] = old[:before]
                    setattr(self, name, made)
            for array, values in zip((self.rows, self.strange, self.lengths), zip(*self.new)):
                array[before : self.held] = values
            self.new = []
        return self.rows, self.strange, self.lengths

    def score(self, word: str) -> list[float]:
        out = [FOREIGN_SCRIPT] * len(LANGUAGES)
        first = word[0]
        if "一" <= first <= "鿿" or "㐀" <= first <= "䶿" or first == "々":
            signs = [_han_scores(c) for c in word]
            ja, zh = -0.1 + sum(s[0] for s in signs), sum(s[1] for s in signs)
            out[JA], out[ZH] = max(-CLIP, min(CLIP, ja)), max(-CLIP, min(CLIP, zh))
        elif "぀" <= first <= "ヿ" or "ｦ" <= first <= "ﾟ":
            out[JA], out[ZH] = min(1.0 + 0.5 * len(word), CLIP), -CLIP
        elif "ऀ" <= first <= "ॿ":
            out[HI] = 1.0
        elif "؀" <= first <= "ݿ" or first >= "ﭐ":
            out[AR] = 1.0
        else:
            latin = cyrillic = 0
            if not word.isascii() and _MIXED.search(word):
                latin = sum(not "Ͱ" <= c <= "ӿ" for c in word)
                cyrillic = sum("Ѐ" <= c <= "ӿ" for c in word)
                word = word if cyrillic > 2 * latin else word.translate(_INSIDE_LATIN)
            if cyrillic > 2 * latin:
                out[RU] = 1.0
            else:
                plain = word.lower()
                known = self.known.get(plain)
                if known is not None:
                    out[:LATIN] = known
                else:
                    parts = [x for g in _trigrams(plain) if (x := self.grams.get(g)) is not None]
                    out[:LATIN] = [sum(x) / len(parts) for x in zip(*parts)] if parts else [0.0] * LATIN
        return out

    def numbers(self, words: list[str]) -> list[int]:
        return list(map(self.number.__getitem__, words))

    def add(self, word: str) -> int:
        row = self.score(word)
        self.new.append((row, max(row[RU], row[AR]) > 0 and _OTHER_LETTERS.search(word) is not None, len(word)))
        return self.held + len(self.new) - 1


class _Numbers(dict):
    """The numbers of words; a new word is scored when it is first asked for."""

    def __init__(self, scores: WordScores) -> None:
        super().__init__()
        self.scores = scores

    def __missing__(self, word: str) -> int:
        self[word] = made = self.scores.add(word)
        return made


@lru_cache(maxsize=1 << 17)
def _han_scores(c: str) -> tuple[float, float]:
    """What a Han character says for Japanese and for Chinese: something only if one of them alone writes it."""
    japanese, simplified = _encodable(c, "shift_jis"), _encodable(c, "gb2312")
    if japanese and not simplified:
        return 1.0, -0.5
    return (-1.5, 1.0) if not japanese and (simplified or _encodable(c, "big5")) else (0.0, 0.0)


def _encodable(c: str, codec: str) -> bool:
    try:
        c.encode(codec)
        return True
    except UnicodeEncodeError:
        return False


def _counting_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the lines that state their language, counted for it; what is counted is passed on whenever it is many words."""
    owner = _owners()
    counts = [Counter() for _ in range(LATIN)]

    def counted() -> pa.RecordBatch:
        words = [w for c in counts for w in c]
        numbers = [n for c in counts for n in c.values()]
        at = np.repeat(np.arange(LATIN, dtype=np.int32), [len(c) for c in counts])
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(at), pa.array(numbers, pa.int64())], names=["w", "c", "n"])

    for batch in sliced(batches):
        for value in batch.column(0).to_pylist():
            for line in _readable(value).split("\n"):
                if not _LATIN_LETTER.search(line):
                    continue
                # the form of a last sigma goes by the whole word, so such lines are lowered word by word
                words = _words(line.lower()) if "Σ" not in line else [w.lower() for w in _WORD.findall(line)]
                stated = _stated_language(words, owner)
                if stated:
                    counts[LANGUAGES.index(stated)].update(words)
        if sum(map(len, counts)) > WordScores.MOST_KEPT:
            yield counted()
    yield counted()


def _by_language(at: str, n: str) -> list[Column]:
    return [F.sum(F.when(F.col(at) == i, F.col(n)).otherwise(F.lit(0).cast("bigint"))).alias(f"n{i}") for i in range(LATIN)]


_COUNTS = [f"n{i}" for i in range(LATIN)]


def _totals(counts: DataFrame) -> np.ndarray:
    return np.array([x or 0 for x in counts.agg(*[F.sum(n) for n in _COUNTS]).first()], dtype=float)


def word_counts(documents: DataFrame, text: str) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """``w, n0..n4`` of words and of trigrams, counted by language over the lines of all rows, and the words counted for each language.

    Words counted once are left out.
    """
    spark = documents.sparkSession
    counted = documents.select(F.col(text).alias("text")).where("text is not null").mapInArrow(_counting_mapper, "w string, c int, n bigint")
    seen = write_stage(counted.groupBy("w").agg(*_by_language("c", "n")), "language-words")
    # what is known without any text
    listed = spark.createDataFrame([(w, LANGUAGES.index(code), 3) for code, words in FUNCTION_WORDS.items() for w in words.split()], "w string, c int, n bigint")
    both = seen.union(listed.groupBy("w").agg(*_by_language("c", "n"))).groupBy("w").agg(*[F.sum(n).alias(n) for n in _COUNTS])
    words = both.where(" + ".join(_COUNTS) + " > 1")
    trigrams = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring(F.concat(F.lit("^"), F.col("w"), F.lit("$")), i, F.lit(3)))
    grams = words.select(F.explode(trigrams).alias("w"), *[F.least(n, F.lit(50)).alias(n) for n in _COUNTS]).groupBy("w").agg(*[F.sum(n).alias(n) for n in _COUNTS])
    return words, write_stage(grams, "language-trigrams"), _totals(seen)


def _hashed(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


class _ScoreTable:
    """Scores by the hash of their word, read from a file as they are asked for: only its pages that are in use take memory."""

    MOST_KEPT = 200_000

    def __init__(self, path: str) -> None:
        n = os.path.getsize(path) // (8 + 4 * LATIN)
        self.keys = np.memmap(path, dtype="<i8", mode="r", shape=(n,)).view(np.ndarray) if n else np.zeros(0, dtype=np.int64)
        self.scores = np.memmap(path, dtype="<f4", mode="r", offset=8 * n, shape=(n, LATIN)).view(np.ndarray) if n else None
        self.kept: dict[str, list[float] | None] = {}

    def get(self, word: str) -> list[float] | None:
        if word in self.kept:
            return self.kept[word]
        if len(self.kept) >= self.MOST_KEPT:
            self.kept.clear()
        hashed = _hashed(word)
        at = int(self.keys.searchsorted(hashed))
        self.kept[word] = found = self.scores[at].tolist() if at < len(self.keys) and self.keys[at] == hashed else None
        return found


def _score_file(counts: DataFrame, totals: np.ndarray, weight: float) -> str:
    """The scores of a table of counts as a file that every executor fetches; its name. The driver holds one partition at a time."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).astype(float)
            made = _ratios(table, totals, weight).astype("<f4")
            keys = pa.array([_hashed(w) for w in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, pa.array([row.tobytes() for row in made], pa.binary())], names=["h", "s"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = batch.column(0).to_numpy().astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([keys], pa.binary()), pa.array([b"".join(batch.column(1).to_pylist())], pa.binary())], names=["h", "s"])

    packed = counts.mapInArrow(score, "h bigint, s binary").orderBy("h").mapInArrow(pack, "h binary, s binary")
    folder = tempfile.mkdtemp(prefix="tessella-")
    path = os.path.join(folder, f"language-scores-{uuid.uuid4().hex}")
    with open(path, "wb") as keys, tempfile.TemporaryFile(dir=folder) as scores:
        for row in packed.toLocalIterator():
            keys.write(row.h)
            scores.write(row.s)
        scores.seek(0)
        shutil.copyfileobj(scores, keys)
    counts.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def learn_scores(documents: DataFrame, text: str) -> tuple[str, str]:
    """Names of the files with the scores of words and of trigrams, learned from the lines of all rows."""
    words, grams, totals = word_counts(documents, text)
    return _score_file(words, totals + 1.0, 1.0), _score_file(grams, np.maximum(_totals(grams), 1.0), 0.25)


@lru_cache(maxsize=1)
def learned_scores(learned: tuple[str, str]) -> WordScores:
    """The scores of ``learn_scores`` on an executor; a worker keeps those that it used last for its next tasks."""
    return WordScores.stored(*[_ScoreTable(SparkFiles.get(name)) for name in learned])


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best label of each word. ``scores`` has the words of all stretches one after the other, ``lengths`` their numbers."""
    begins = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    begins, sizes = begins[order], lengths[order]
    n, states = scores.shape
    labels = np.zeros(n, dtype=np.int8)
    if not n:
        return labels
    stay = np.ones((n, states), dtype=bool)
    source = np.zeros(n, dtype=np.int8)
    active = int((sizes > 0).sum())
    best = scores[begins[:active]].copy()
    final = np.zeros(len(sizes), dtype=np.int8)
    for t in range(1, int(sizes[0]) + 1):
        still = int(np.searchsorted(-sizes, -t, side="left"))  # stretches with more than t words
        if still < active:
            final[still:active] = best[still:active].argmax(1)
            best = best[:still]
            active = still
        if not active:
            break
        at = begins[:active] + t
        top = best.argmax(1)
        switched = best[np.arange(active), top] - penalty
        kept = best >= switched[:, None]
        stay[at] = kept
        source[at] = top
        best = np.where(kept, best, switched[:, None]) + scores[at]
    now = final.copy()
    for t in range(int(sizes[0]) - 1, -1, -1):
        active = int(np.searchsorted(-sizes, -t, side="left"))
        at = begins[:active] + t
        labels[at] = now[:active]
        if t:
            now[:active] = np.where(stay[at, now[:active]], now[:active], source[at])
    return labels


def _label_batch(texts: list[str | None], scores: WordScores) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of texts: rows, non-blank lines, letters by line's row and language, and the share of letters in words that their language can't write."""
    if len(scores.number) > scores.MOST_KEPT:
        scores.clear()
    ids: list[int] = []
    line_words: list[int] = []
    row_of_line: list[int] = []
    stretches: list[int] = []
    rows: list[int] = []
    nonblank: list[int] = []

    def finish():
        lengths = np.array(stretches, dtype=np.int64)
        numbers = np.array(ids, dtype=np.int64)
        table, strangeness, sizes = (x[numbers] for x in scores.arrays())
        labels = viterbi(table.astype(np.float32), lengths)
        line_of = np.repeat(np.arange(len(line_words)), line_words)
        shape = (max(len(row_of_line), 1), len(LANGUAGES))
        letters = np.bincount(line_of * shape[1] + labels, weights=sizes, minlength=shape[0] * shape[1]).reshape(shape)
        strange = np.bincount(line_of, weights=sizes * strangeness, minlength=shape[0])
        return rows, nonblank, np.array(row_of_line, dtype=np.int64), letters, strange / np.maximum(letters.sum(1), 1)

    for row, text in enumerate(texts):
        if not text or not text.strip():
            continue
        count, before = 0, len(ids)
        for line in _readable(text).split("\n"):
            if not line.strip():
                continue
            count += 1
            words = _words(line)
            if words:
                ids += scores.numbers(words)
                line_words.append(len(words))
                row_of_line.append(row)
        if len(ids) > before:
            stretches.append(len(ids) - before)
        rows.append(row)
        nonblank.append(count)
        if len(ids) > 250_000:
            yield finish()
            ids, line_words, row_of_line, stretches, rows, nonblank = [], [], [], [], [], []
    if rows:
        yield finish()


def _document_mapper(learned):
    """``learned``: the files of ``learn_scores``; each executor fetches them once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = learned_scores(learned)
        for batch in sliced(batches):
            texts, titles = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            used = [t if t and t.strip() else (n if n and n.strip().lower() not in NO_TITLE else None) for t, n in zip(texts, titles)]
            out_rows, langs, shares, sure = [], [], [], []
            for rows, nonblank, row_of_line, letters, strange in _label_batch(used, scores):
                best = letters.argmax(1)
                margin = letters.max(1) / np.maximum(letters.sum(1), 1) * (1 - strange)
                found: dict[int, Counter] = defaultdict(Counter)
                confidence: dict[tuple[int, int], float] = defaultdict(float)
                for row, label, m in zip(row_of_line.tolist(), best.tolist(), margin.tolist()):
                    found[row][label] += 1
                    confidence[row, label] += m
                for row, count in zip(rows, nonblank):
                    for label, n in found[row].items():
                        out_rows.append(row)
                        langs.append(LANGUAGES[label])
                        shares.append(n / count)
                        sure.append(confidence[row, label] / n)
            if out_rows:
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(out_rows)), batch.column(3).take(pa.array(out_rows)), pa.array(langs),
                    pa.array(shares, pa.float64()), pa.array(sure, pa.float64()),
                ], names=["key", "label", "lang", "share", "confidence"])

    return run


def document_languages(documents: DataFrame, *, key: str, text: str, title: str, label: str) -> DataFrame:
    """``key, label, lang, share, confidence``: each language of a document, the share of its lines and how sure it is."""
    learned = learn_scores(documents, text)
    kind = documents.schema[key].dataType.simpleString()
    slim = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(title).alias("title"), F.col(label).alias("label")).where("key is not null")
    return slim.mapInArrow(_document_mapper(learned), f"key {kind}, label string, lang string, share double, confidence double").withColumnRenamed("key", key)


def _named_expression(label: str):
    """SQL form of ``named_language``."""
    pairs = [x for name, code in NAMED.items() for x in (F.lit(name), F.lit(code))]
    head = F.regexp_extract(F.lower(F.trim(F.col(label))), r"^([^-_ (]*)", 1)
    return F.element_at(F.create_map(*pairs), head)


def mislabelled(languages: DataFrame, *, key: str) -> DataFrame:
    """``key, lang`` of documents with two languages, or whose label names none or not theirs."""
    large = languages.where(F.col("share") >= LINE_SHARE).withColumn("named", _named_expression("label"))
    # all rows of a document come from one batch; repeated rows are equal
    by_document = large.groupBy(key).agg(F.collect_set("lang").alias("langs"), F.max("named").alias("named"))
    wrong = (F.size("langs") >= 2) | F.col("named").isNull() | ~F.array_contains("langs", F.col("named"))
    return by_document.where(wrong).select(key, F.explode("langs").alias("lang"))


def _segments_of(texts: list[str | None], scores: WordScores) -> Iterator[tuple[np.ndarray, ...]]:
    """For groups of texts: arrays of row, start, end, label and confidence of each stretch in one language."""
    words: list[str] = []
    row_of: list[int] = []
    begins: list[int] = []
    ends: list[int] = []
    stretches: list[int] = []

    def finish() -> tuple[np.ndarray, ...]:
        numbers = np.array(scores.numbers(words), dtype=np.int64)
        table, odd, _ = (x[numbers] for x in scores.arrays())
        labels = viterbi(table, np.array(stretches, dtype=np.int64))
        rows = np.array(row_of)
        first = np.concatenate([[0], np.flatnonzero((np.diff(labels) != 0) | (np.diff(rows) != 0)) + 1])
        last = np.concatenate([first[1:], [len(labels)]]) - 1
        sums = np.add.reduceat(table, first, axis=0)
        own = sums[np.arange(len(first)), labels[first]][:, None]
        sure = (1 - np.add.reduceat(odd, first) / (last - first + 1)) / np.exp(np.clip(sums - own, -60, 60)).sum(1)
        return rows[first], np.array(begins)[first], np.array(ends)[last], labels[first], sure

    if len(scores.number) > scores.MOST_KEPT:
        scores.clear()
    for row, text in enumerate(texts):
        spots = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)] if text else []
        if not spots:
            continue
        for held, values in zip((words, begins, ends), zip(*spots)):
            held.extend(values)
        row_of += [row] * len(spots)
        stretches.append(len(spots))
        if len(words) > 250_000:
            yield finish()
            for held in (words, row_of, begins, ends, stretches):
                held.clear()
    if words:
        yield finish()


def _segment_mapper(learned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = learned_scores(learned)
        names = pa.array(LANGUAGES)
        for batch in sliced(batches):
            for rows, begins, ends, labels, sure in _segments_of(batch.column(1).to_pylist(), scores):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows)), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), names.take(pa.array(labels)), pa.array(sure, pa.float64())
                ], names=["key", "start_pos", "end_pos", "lang", "confidence"])

    return run


def language_segments(documents: DataFrame, *, key: str, text: str) -> DataFrame:
    """``key, start_pos, end_pos, lang, confidence``: stretches of words in one language, offsets in code points."""
    learned = learn_scores(documents, text)
    kind = documents.schema[key].dataType.simpleString()
    slim = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    made = slim.mapInArrow(_segment_mapper(learned), f"key {kind}, start_pos int, end_pos int, lang string, confidence double")
    return made.withColumnRenamed("key", key)
