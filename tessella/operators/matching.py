"""Documents against a codebook of terms."""

from __future__ import annotations

import html
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.batches import sliced
from tessella.functions.text import bounded_contains
from tessella.operators.columns import is_term

#: Terms of one automaton; a larger codebook is cut by a hash of the term, and the documents are read once for each part.
MOST_TERMS = 500_000
#: Broadcast limit of the join forms, in rows of the codebook.
MOST_BROADCAST_ROWS = 100_000


def codebook_terms(codebook: DataFrame) -> DataFrame:
    """Distinct ``term, mode`` of the rows that are terms; of two modes the greater one counts."""
    rows = codebook.where("kw_match_lower is not null and kw_match is not null").where(is_term(F.col("kw_match"), F.col("kw_match_lower")))
    return rows.groupBy(F.col("kw_match_lower").alias("term")).agg(F.max("match_mode").alias("mode"))


def _wordlike(c: str) -> bool:
    return c == "_" or c.isalnum()


def find_terms(text: str, automaton, modes: dict[str, str]) -> set[str]:
    """All terms that occur in a lower-case text; bounded ones only where no letter, digit or underscore touches them."""
    found = set()
    for end, term in automaton.iter(text):
        if term in found:
            continue
        start = end - len(term) + 1
        if modes[term] == "substr" or not ((start and _wordlike(text[start - 1])) or (end + 1 < len(text) and _wordlike(text[end + 1]))):
            found.add(term)
    return found


def match_terms(documents: DataFrame, terms: DataFrame, *, key: str, doc: Column, unescape: bool = True) -> DataFrame:
    """``key, term`` for every term in ``doc``, overlapping ones included.

    One automaton holds all terms, so a document is read once whatever their number. A null document has no
    terms. Repeated keys give repeated rows.
    """
    parts = -(-terms.count() // MOST_TERMS)
    if parts > 1:
        # twice as many parts as needed, so that none is too large by chance
        each = [terms.where(F.pmod(F.xxhash64("term"), F.lit(2 * parts)) == i) for i in range(2 * parts)]
        return reduce(DataFrame.unionByName, [match_terms(documents, part, key=key, doc=doc, unescape=unescape) for part in each])
    modes = {row.term: row.mode for row in terms.collect() if row.term}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in modes:
            automaton.add_word(term, term)
        if modes:
            automaton.make_automaton()
        for batch in sliced(batches):
            at, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if text and modes:
                    plain = html.unescape(text) if unescape and "&" in text else text
                    for term in sorted(find_terms(plain.lower(), automaton, modes)):
                        at.append(row)
                        found.append(term)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(found)], names=["key", "term"])

    kind = documents.schema[key].dataType.simpleString()
    slim = documents.select(F.col(key).alias("key"), doc.alias("doc")).where("doc is not null")
    return slim.mapInArrow(run, f"key {kind}, term string").withColumnRenamed("key", key)


def theta_join(documents: DataFrame, terms: DataFrame, *, key: str, doc: Column) -> DataFrame:
    """The same result as a join on containment: the terms are broadcast after a check of their number, the documents are never moved.

    Plain containment is tested first; borders are looked at only for pairs that pass.
    """
    if terms.limit(MOST_BROADCAST_ROWS + 1).count() > MOST_BROADCAST_ROWS:
        return match_terms(documents, terms, key=key, doc=doc, unescape=False)
    pairs = documents.select(key, F.lower(doc).alias("__doc")).join(F.broadcast(terms), F.col("__doc").contains(F.col("term")))
    return pairs.where((F.col("mode") == "substr") | bounded_contains(F.col("__doc"), F.col("term"))).select(key, "term")


def attach_codebook(hits: DataFrame, codebook: DataFrame) -> DataFrame:
    """Each hit with every codebook row of its term."""
    rows = codebook.where(is_term(F.col("kw_match"), F.col("kw_match_lower"))).select(
        F.col("kw_match_lower").alias("term"), "keyword", "keyword_country", "is_hashtag", "stance_primary"
    )
    return hits.join(rows, "term", "left")


def article_rollup(hits: DataFrame, *, key: str = "url") -> DataFrame:
    """One row per article: its sorted distinct keywords, their stances, counts and whether any is a hashtag.

    A keyword with two stances has the greater one. Keywords are counted once.
    """
    per_keyword = hits.where("keyword is not null").groupBy(key, "keyword").agg(F.max("stance_primary").alias("stance"), F.max("is_hashtag").alias("tag"))
    pair = F.struct("keyword", "stance")
    rolled = per_keyword.groupBy(key).agg(
        F.array_sort(F.collect_list(pair)).alias("pairs"), F.count("*").cast("int").alias("n_keywords"),
        F.count_if(F.col("stance") == "Support").cast("int").alias("n_support"), F.count_if(F.col("stance") == "Backlash").cast("int").alias("n_backlash"),
        F.coalesce(F.max("tag"), F.lit(False)).alias("has_hashtag_term"),
    )
    return rolled.select(
        key, F.array_join(F.transform("pairs", lambda p: p["keyword"]), " | ").alias("keywords_matched"),
        F.array_join(F.transform("pairs", lambda p: F.concat(p["keyword"], F.lit(" ["), F.coalesce(p["stance"], F.lit("")), F.lit("]"))), " | ").alias("keyword_stances"),
        "n_keywords", "n_support", "n_backlash", "has_hashtag_term",
    )
