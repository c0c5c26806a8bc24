"""Derived columns and predicates over article tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import resources as R


def usable(status: Column, text: Column) -> Column:
    return status.isin(*R.USABLE_STATUS) & text.isNotNull()


def stale(text: Column) -> Column:
    """A late year, bounded by anything but letters, digits and underscores, near the start of the text."""
    head = F.substring(text, 1, R.STALE_PREFIX)
    return F.coalesce(head.rlike(f"(?:^|[^\\p{{L}}\\p{{N}}_]){R.STALE_YEARS}(?:[^\\p{{L}}\\p{{N}}_]|$)"), F.lit(False))


def unreadable(text: Column) -> Column:
    """Share of signs of a broken encoding above the limit; empty texts are unreadable."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, R.UNREADABLE_PREFIX)
    broken = F.length(head) - F.length(F.translate(head, R.MOJIBAKE_SIGNS, ""))
    return F.when(F.length(head) == 0, F.lit(True)).otherwise(broken / F.length(head) > R.MOJIBAKE_SHARE)


def junk(text: Column, phrases: Sequence[str] = R.JUNK_PHRASES) -> Column:
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, R.JUNK_PREFIX))
    found = F.lit(False)
    for phrase in phrases:
        found = found | head.contains(phrase)
    return found


def is_term(term: Column, term_lower: Column) -> Column:
    """A codebook row that is a term and no note: not one of the note words, not in parentheses."""
    return ~F.trim(term_lower).isin(*R.CODEBOOK_NOTES) & ~term.rlike(r"^\(.*\)$")


def known_country(country: Column) -> Column:
    return F.coalesce(country, F.lit(R.UNKNOWN))


def article_stance(n_support: Column, n_backlash: Column) -> Column:
    return (
        F.when((n_support > 0) & (n_backlash > 0), "Mixed").when(n_backlash > 0, "Backlash").when(n_support > 0, "Support").otherwise("Other")
    )


def _segments(words: Sequence[str]) -> str:
    return "(?i)/(" + "|".join(re.escape(w).replace("\\%", "%") for w in words) + r")(/|$|\?)"


ANALYSIS_PATTERN, OPINION_PATTERN = _segments(R.ANALYSIS_SEGMENTS), _segments(R.OPINION_SEGMENTS)
TITLE_PATTERNS = ("(?iu)" + R.TITLE_PREFIX, "(?iu)" + R.TITLE_INLINE)


def article_type(url: Column, title: Column) -> Column:
    """Analysis before opinion before news, by path segments and title marks; a null title has no marks."""
    t = F.coalesce(title, F.lit(""))
    opinion = url.rlike(OPINION_PATTERN) | t.rlike(TITLE_PATTERNS[0]) | t.rlike(TITLE_PATTERNS[1])
    return F.when(url.rlike(ANALYSIS_PATTERN), "Analysis").when(opinion, "Opinion/Editorial").otherwise("News/Reporting")


def match_class(keywords: Column) -> Column:
    """Which kinds of keywords an array holds: with #, without, both, none."""
    tagged = F.exists(keywords, lambda k: k.startswith("#"))
    plain = F.exists(keywords, lambda k: ~k.startswith("#"))
    return F.when(tagged & plain, "both").when(tagged, "hashtag_only").when(plain, "generic_only").otherwise("none")


def fetch_outcomes(status: Column) -> dict[str, Column]:
    """Independent conditions; a status may meet none or two."""
    return {
        "downloaded": status.isin(*R.USABLE_STATUS), "gone": status.isin(*R.GONE_STATUS), "blocked": status.isin(*R.BLOCKED_STATUS),
        "network": status.rlike(R.NETWORK_PATTERN), "no_text": status.isin(*R.NO_TEXT_STATUS),
    }


def unresolved(status: Column) -> Column:
    found = F.lit(False)
    for prefix in R.UNRESOLVED_PREFIXES:
        found = found | status.startswith(prefix)
    return found


def diagnosis(status: Column, chars: Column, enough: int = 400) -> Column:
    """What a failed fetch came to, by how its text was got and how much there is."""
    thin = F.coalesce(chars, F.lit(0)) < enough
    return (
        F.when(status == "OK", F.when(thin, "SHORT_browser").otherwise("RECOVERED_browser"))
        .when(status == "OK_WAYBACK", F.when(thin, "WAYBACK_THIN").otherwise("RECOVERED_wayback"))
        .when(status.isin(*R.NO_TEXT_STATUS), "NO_TEXT_browser").otherwise("DEAD_no_archive")
    )


def error_class(message: Column) -> Column:
    low = F.lower(message)
    return F.when(low.contains("429"), "429").when(low.contains("403"), "403").when(low.contains("timeout"), "timeout").otherwise("other")


def mapped(column: Column, table: Mapping[str, str]) -> Column:
    """Look up a small table given as code; null for anything else."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), column)


def language_group(country: Column) -> Column:
    return mapped(country, R.COUNTRY_GROUP)


def stance_map(joined: Column) -> Column:
    """``kw [stance] | ...`` as an array of distinct (keyword, stance); parts of another form are left out."""
    parts = F.filter(F.transform(F.split(joined, "\\Q | \\E"), F.trim), lambda p: p.rlike(r"^.* \[.+\]$"))
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(.*) \[(.+)\]$", 1).alias("keyword"), F.regexp_extract(p, r"^(.*) \[(.+)\]$", 2).alias("stance")))
    return F.coalesce(F.array_distinct(pairs), F.array().cast("array<struct<keyword:string,stance:string>>"))


def map_position(longitude: Column, latitude: Column, width: int = 960, height: int = 440) -> tuple[Column, Column]:
    """Equirectangular position in whole pixels."""
    return F.rint((longitude + 180) / 360 * width).cast("int"), F.rint((90 - latitude) / 180 * height).cast("int")
