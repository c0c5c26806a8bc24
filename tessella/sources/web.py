"""Pages: main text from HTML, statuses of fetches, and hooks for fetching and labelling."""

from __future__ import annotations

import html
import json
import time
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.batches import sliced

# Elements that hold no text of an article, and those that end a line.
_SILENT = {"script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "button", "table", "svg", "iframe", "figure"}
_BLOCKS = {"p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "br", "pre", "tr"}
#: Shorter texts count as too short; longer ones are cut.
LEAST_TEXT, MOST_TEXT = 400, 8000


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self.silent, self.in_title = [], [], 0, False

    def handle_starttag(self, tag, attrs):
        self.silent += tag in _SILENT
        self.in_title = self.in_title or tag == "title"
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in _SILENT and self.silent:
            self.silent -= 1
        if tag == "title":
            self.in_title = False
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.silent:
            self.parts.append(data)


def page_text(page: str) -> tuple[str | None, str | None]:
    """Title and main text of a page; None for what there isn't."""
    reader = _Reader()
    reader.feed(page)
    reader.close()
    lines = (" ".join(line.split()) for line in "".join(reader.parts).split("\n"))
    text, title = "\n".join(line for line in lines if line), " ".join("".join(reader.title).split())
    return title or None, text or None


def extract_pages(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """``key, fetched_title, article_text`` from a column of HTML; a null page gives nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [page_text(p) if p else (None, None) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string())], names=["key", "fetched_title", "article_text"])

    kind = pages.schema[key].dataType.simpleString()
    made = pages.select(F.col(key).alias("key"), F.col(markup).alias("m")).mapInArrow(run, f"key {kind}, fetched_title string, article_text string")
    return made.withColumnRenamed("key", key)


Fetch = Callable[[str], str]


def classify(fetch: Fetch, archive: Fetch | None, url: str) -> tuple[str, str | None, str | None]:
    """Status, title and text of one address: direct, else from an archive, else the reason why not."""
    reason = "FAILED"
    for source, ok in ((fetch, "OK"), (archive, "OK_WAYBACK")):
        if source is None:
            continue
        try:
            title, text = page_text(source(url))
        except Exception as error:  # any failure of a fetch is a status
            reason = f"{'FAILED' if ok == 'OK' else 'WAYBACK_ERR'}:{getattr(error, 'code', None) or type(error).__name__}"
            continue
        if not text:
            reason = "NO_TEXT"
        elif len(text) < LEAST_TEXT:
            return "TOO_SHORT", title, text
        else:
            return ok, title, text[:MOST_TEXT]
    return reason, None, None


def fetch_rows(urls: DataFrame, fetch: Fetch, archive: Fetch | None = None, *, key: str = "url") -> DataFrame:
    """``key, fetch_status, fetched_title, article_text`` with injectable fetchers; no network of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [classify(fetch, archive, u) if u else ("NO_TEXT", None, None) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([m[i] for m in made], pa.string()) for i in range(3)]], names=[key, "fetch_status", "fetched_title", "article_text"])

    return urls.select(key).mapInArrow(run, f"{key} string, fetch_status string, fetched_title string, article_text string")


def with_retry(fetch: Fetch, tries: int = 4, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Fetch:
    """A fetcher that waits twice as long after each failure."""

    def run(url: str) -> str:
        for attempt in range(tries):
            try:
                return fetch(url)
            except Exception:
                if attempt + 1 == tries:
                    raise
                sleep(first_wait * 2**attempt)
        raise AssertionError

    return run


# Fields of a label in the order in which they are asked for.
LABEL_FIELDS = "is_about_movement boolean, primary_focus string, stance string, stance_confidence string, evidence string"


def stub_label(text: str) -> str:
    """A stand-in for a labelling model: a valid answer made from the text alone."""
    return json.dumps({
        "is_about_movement": "#" in text, "primary_focus": "other", "stance": "not_applicable", "stance_confidence": "low", "evidence": html.unescape(text[:80]),
    })


def label_rows(df: DataFrame, key: str, text: str, labeller: Callable[[str], str] = stub_label, fields: str = LABEL_FIELDS) -> DataFrame:
    """``key``, the label's fields and ``llm_error``: answers are checked against the schema, failures become rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            answers, errors = [], []
            for value in batch.column(1).to_pylist():
                try:
                    answers.append(labeller(value) if value else None)
                    errors.append(None if value else "no text")
                except Exception as error:
                    answers.append(None)
                    errors.append(f"{type(error).__name__}: {error}"[:200])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["key", "answer", "llm_error"])

    kind = df.schema[key].dataType.simpleString()
    asked = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, answer string, llm_error string")
    parsed = asked.withColumn("a", F.from_json("answer", fields, {"mode": "PERMISSIVE"}))
    broken = F.when(F.col("answer").isNotNull() & F.col("a.stance").isNull(), F.lit("answer does not fit the schema"))
    return parsed.select(F.col("key").alias(key), "a.*", F.coalesce("llm_error", broken).alias("llm_error"))
