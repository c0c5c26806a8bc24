"""Writing results: Parquet for what grows, CSV, JSON, HTML and text reports for small tables."""

from __future__ import annotations

import html
import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A report holds no more rows than this; a larger table belongs in Parquet.
MOST_REPORT_ROWS = 100_000


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Lists joined and structures as JSON, for formats without nested values."""
    out = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        c = F.col(f"`{field.name}`")
        if kind == "array" and field.dataType.elementType.typeName() == "string":
            c = F.array_join(c, " | ")
        elif kind in ("array", "struct", "map"):
            c = F.to_json(c)
        out.append(c.alias(field.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", one_file: bool = False) -> None:
    """CSV with quoted line breaks; ``one_file`` is for reports, since it gathers all rows in one task."""
    made = flat(df)
    writer = (made.coalesce(1) if one_file else made).write.mode(mode).option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def rows_of(df: DataFrame, limit: int = MOST_REPORT_ROWS) -> list[dict]:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    return [r.asDict(recursive=True) for r in rows]


def to_json(tables: Mapping[str, DataFrame]) -> str:
    """Small tables as one JSON object; what JSON doesn't know becomes text."""
    return json.dumps({name: rows_of(df) for name, df in tables.items()}, ensure_ascii=False, default=str, separators=(",", ":"))


PAGE = "<!doctype html><meta charset=utf-8><title>{title}</title><pre id=out></pre><script>const data={data};document.getElementById('out').textContent=JSON.stringify(data,null,1)</script>"


def write_html(tables: Mapping[str, DataFrame], path: str, title: str = "Report", template: str = PAGE) -> None:
    data = to_json(tables).replace("</", "<\\/")
    Path(path).write_text(template.replace("{title}", html.escape(title)).replace("{data}", data), encoding="utf-8")


def write_cards(df: DataFrame, path: str, title: str, body: str, limit: int = 200) -> None:
    """A sample as escaped cards."""
    cards = [f"<article><h2>{html.escape(str(r[title] or ''))}</h2><p>{html.escape(str(r[body] or ''))}</p></article>" for r in rows_of(df.limit(limit), limit)]
    Path(path).write_text("<!doctype html><meta charset=utf-8>" + "\n".join(cards), encoding="utf-8")


def text_table(df: DataFrame, widths: Mapping[str, int]) -> str:
    """Fixed-width lines with a head; longer values are cut."""
    def line(values: Mapping[str, object]) -> str:
        return "  ".join(str("" if values[c] is None else values[c])[:w].ljust(w) for c, w in widths.items()).rstrip()

    return "\n".join([line({c: c for c in widths}), "  ".join("-" * w for w in widths.values()), *[line(r) for r in rows_of(df.select(*widths))]])
