"""Problem 10: sentence units of every document, in SQL expressions only.

Dots and other terminators that end nothing (decimals, addresses, initials,
abbreviations, list marks, anything between paired quotation marks or brackets) are
replaced one for one by private-use signs, so that offsets stay true. What terminators are left is
marked by script-specific rules, the text is split at the marks, and the units are
given as offsets into the original text, which restores the masked signs.

Null, empty and blank texts have no units. A unit without a letter or digit is left out.
Private-use signs of the text itself are taken as ordinary signs.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Private-use signs used as placeholders.
OPEN, CLOSE = "\ue001", "\ue002"
APOSTROPHE, SHUT = "\ue007", "\ue008"
OUTER = ("\ue009", "\ue00a")
BRACKETS = (("\ue003", "\ue004"), ("\ue005", "\ue006"))
MASKED = "\ue010"
MARK = "\ue0ff"
RESERVED = OPEN + CLOSE + APOSTROPHE + SHUT + "".join(OUTER) + "".join(a + z for a, z in BRACKETS) + MASKED + MARK

# White space.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))

# Abbreviations. The dot of a title never ends a sentence; the dot of a reference
# word doesn't before a number; other abbreviations end one only where a new one follows.
TITLES = (
    "Mr Mrs Ms Mx Dr Prof Gen Col Capt Lt Sgt Maj Cmdr Rev Hon Sen Rep Gov Pres St Ste Mt Ft "
    "Sr Sra Srta Dra Drs Dña Dn Lic Ing Arq Mme Mmes Mlle Mgr MM Me Pr Hr Fr Frl Dipl Mag "
    "av bzw vgl ca evtl ggf inkl Sog sog vs cf viz approx ret dept Hg "
    "ул им просп пер пл проф акад доц гл ред см напр тов "
    "डॉ प्रो श्री सुश्री कु पं स्व"
).split()
REFERENCES = (
    "Str str No Nos no nos Nr Nrn núm num n nº N p pp pg pág págs pag S s Abs Art art arts Art Kap Bd Ziff Fig fig Abb Tab "
    "vol vols Vol ch chap sec Sec cap ed Ed lib t T Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec "
    "ene abr ago dic janv févr avr juil déc jan fev mai out dez Jän Okt Dez д стр рис кв корп ст п г №"
).split()
GERMAN_ORDINAL_LEADS = "am Am der Der die Die das Das dem Dem den Den des Des im Im vom Vom zum Zum zur Zur beim Beim ab Ab bis Bis seit Seit".split()
COMPANY_TAILS = "Ltd Inc KG Corp Co LLC AG SA Lda".split()

_LINE_ENDS = "\\n\\r\\u000B\\u000C\\u001C-\\u001E\\u0085\\u2028\\u2029"
_BLANK = "[\\s\\u0085\\u001C-\\u001F\\p{Z}]"
_QUOTES = [("„", "“”", "„“”"), ("“", "”", "“”"), ("«", "»", "«»"), ("»", "«", "«»"), ("「", "」", "「」"), ("『", "』", "『』"), ("《", "》", "《》"), ("〈", "〉", "〈〉"), ('"', '"', '"'), ("＂", "＂", "＂")]
_BRACKETS = [("(", ")"), ("（", "）"), ("[", "]"), ("【", "】"), ("〔", "〕"), ("{", "}")]
#: What a pair can begin with. Patterns look at a few ranges first, which skips plain text fast, then at these signs.
_QUOTE_OPENS = "[" + "".join(dict.fromkeys(a for a, _, _ in _QUOTES)) + "‘]"
_BRACKET_OPENS = "[" + "".join("\\" + a for a, _ in _BRACKETS) + "]"
_STRONG = "!?。！？।॥؟｡۔‼⁇⁈⁉"
_OPENERS = "[\ue001\ue003\ue005(（\\[【〔{“„«\"'‘「『¿¡—–\\-]"


def _words(words: list[str]) -> str:
    return "|".join(sorted(dict.fromkeys(words), key=lambda w: (-len(w), w)))


def _mask_pairs(opened: str = OPEN, closed: str = CLOSE, *, nested: bool = False) -> tuple[str, str]:
    """Innermost paired quotation marks on one line become ``opened`` and ``closed``, German pairs before English ones.

    Apostrophes between letters are APOSTROPHE by then. Marks that open and close alike can't be nested.
    """
    # after a word or the end of a sentence, » closes
    lead = {"»": f"(?<![\\p{{L}}\\p{{N}}.!?…{CLOSE}])"}
    parts = [f"{lead.get(a, '')}{a}([^{inner}{_LINE_ENDS}]*)[{z}]" for a, z, inner in _QUOTES if not (nested and a == z)]
    parts.append(f"(?<![\\p{{L}}\\p{{N}}])‘([^‘’{_LINE_ENDS}]*+)’(?!\\p{{L}})")
    return f"(?=[\"«»\\u2018-\\uff02])(?={_QUOTE_OPENS})(?:" + "|".join(parts) + ")", opened + "".join(f"${i + 1}" for i in range(len(parts))) + closed


def _mask_brackets(level: int) -> tuple[str, str]:
    """Innermost bracket pairs on one line become BRACKETS[level]."""
    signs = "".join("\\" + x for pair in _BRACKETS for x in pair)
    plain = f"[^{signs}{_LINE_ENDS}]*+"
    parts = [f"\\{a}({plain})\\{z}" for a, z in _BRACKETS]
    opened, closed = BRACKETS[level]
    return f"(?=[(\\[{{\\u3010-\\uff08])(?={_BRACKET_OPENS})(?:" + "|".join(parts) + ")", opened + "".join(f"${i + 1}" for i in range(len(parts))) + closed


def _silence(text: Column, opened: str, closed: str, kept_last: str) -> Column:
    """Mask the terminators between ``opened`` and ``closed``; of the sign before ``closed``, those in ``kept_last`` stay."""
    terminators = ".…" + _STRONG
    last = "".join(x for x in terminators if x not in kept_last)

    def segment(x: Column) -> Column:
        n = F.length(x)
        inside = F.concat(
            F.translate(F.substring(x, F.lit(1), n - 2), terminators, MASKED * len(terminators)),
            F.translate(F.substring(x, n - 1, F.lit(2)), last, MASKED * len(last)),
        )
        return F.when(x.startswith(opened) & x.endswith(closed) & (n > 2), inside).otherwise(x)

    def whole(t: Column) -> Column:
        pieces = F.split(t, f"(?={opened})|(?<={closed})")
        return F.when(t.contains(closed), F.array_join(F.transform(pieces, segment), "")).otherwise(t)

    # the lambda binds the text once: written out, the expression would be evaluated at each mention
    return F.transform(F.array(text), whole)[0]


def _silence_outer(text: Column) -> Column:
    """Mask the terminators in the pairs around other pairs, and make their marks OPEN and CLOSE; a last dot stays."""
    terminators = ".…" + _STRONG + OPEN + CLOSE

    def segment(x: Column) -> Column:
        tail = F.regexp_extract(x, f"\\.?{CLOSE}*{OUTER[1]}$", 0)
        head = F.substring(x, F.lit(1), F.length(x) - F.length(tail))
        inside = F.concat(F.translate(head, terminators, MASKED * len(terminators)), F.translate(tail, CLOSE, SHUT))
        return F.when(x.startswith(OUTER[0]) & x.endswith(OUTER[1]), inside).otherwise(x)

    pieces = F.split(text, f"(?={OUTER[0]})|(?<={OUTER[1]})")
    return F.translate(F.array_join(F.transform(pieces, segment), ""), "".join(OUTER), OPEN + CLOSE)


def _nested(text: Column, opening: str, closing: str, step: Callable[[Column], Column]) -> Column:
    """``step`` as often as pairs can still lie around others, of whatever depth; most texts have none left."""

    def count(t: Column, signs: str) -> Column:
        return F.length(t) - F.length(F.translate(t, signs, ""))

    def whole(t: Column) -> Column:
        left = F.least(count(t, opening), count(t, closing))
        stepped = F.aggregate(F.sequence(F.lit(1), F.greatest(left, F.lit(1))), t, lambda a, _: step(a))
        # signs are counted only where some pair can be left
        some = functools.reduce(operator.or_, [t.contains(x) for x in opening])
        return F.when(some, F.when(left > 0, stepped).otherwise(t)).otherwise(t)

    return F.transform(F.array(text), whole)[0]


def _silent_dots() -> str:
    """Dots that end nothing by themselves. Each alternative starts at the dot, so plain text is skipped fast."""
    before = "(?<![\\p{L}\\p{M}\\p{N}])"
    cases = [
        # decimals, times, dates, versions
        "(?<=\\d\\.)(?=\\d)",
        # addresses: nothing but a lower-case letter or digit follows at once
        "(?=[\\p{Ll}\\d/@_])(?<=[\\p{L}\\p{N}_\\-]\\.)",
        # initials, one letter standing alone: U.V.O., J. R., J.-C., Arabic titles of one letter
        "(?<=" + before + "[\\p{Lu}\\p{Lo}]\\.)(?!$)(?<![ぁ-ヿ㐀-鿿]\\.)",
        "(?<=[\\p{Lu}]\\.-?\\p{Lu}\\.)",
        # one lower-case letter and another part: p. ej., z. B., т. е.
        "(?<=" + before + "\\p{Ll}\\.)(?=[\\s\\u00a0]?(?:\\p{Lu}\\.|\\p{Ll}))",
        "(?<=" + before + f"(?:{_words(TITLES)})\\.)(?=[\\s\\u00a0]*[\\p{{L}}\\p{{N}}{OPEN}])",
        "(?<=" + before + f"(?:{_words(REFERENCES)})\\.)(?=[\\s\\u00a0]*\\d)",
        "(?<=" + before + f"(?:Co|Bros|Cie)\\.)(?=[\\s\\u00a0]*(?:{_words(COMPANY_TAILS)})\\b)",
        "(?<=" + before + "EE\\.)(?=[\\s\\u00a0]?UU)",
        # German ordinals after an article or preposition
        "(?<=" + before + f"(?:{_words(GERMAN_ORDINAL_LEADS)})[\\s\\u00a0]\\d{{1,2}}\\.)(?=[\\s\\u00a0])",
        # list marks at the start of a line
        f"(?<=(?:^|[{_LINE_ENDS}])[ \\t]{{0,8}}(?:\\d{{1,3}}|\\p{{L}}|[ivxIVX]{{1,5}})\\.)(?=[\\s\\u00a0])",
    ]
    return "\\.(?:" + "|".join(cases) + ")"


def _ends() -> str:
    """Where a unit ends: line breaks, and terminators with their closing marks where a new sentence can follow."""
    shut = "\ue004\ue006"
    line = f"[{_LINE_ENDS}]+"
    new_after_blank = f"(?={_BLANK}+{_OPENERS}*{_BLANK}*(?!{_OPENERS})[^\\p{{Ll}}{_LINE_ENDS}\\s])"
    cased_after_blank = f"(?={_BLANK}+{_OPENERS}*{_BLANK}*[\\p{{Lu}}\\p{{Lt}}])"
    new_at_once = f"(?={_OPENERS}*(?:\\p{{Lu}}[\\p{{Ll}}\\p{{M}} ’{APOSTROPHE}']|\\p{{Lo}}{{2}}|[¿¡]))"
    # a closing quotation mark ends a unit only after a dot and before a capital: else a report may follow
    dot = f"(?<!\\.)\\.(?![.…])(?:{SHUT}*{CLOSE}{cased_after_blank}|[{shut})）\\]】〕}}]*(?:{new_after_blank}|{new_at_once}))"
    strong = f"(?:[{_STRONG}][{_STRONG}.…]*)[{shut})）\\]】〕}}”’\"»」』]*(?:(?<![!?][{shut})\\]}}”’\"»」』]{{0,3}})|{new_after_blank}|{new_at_once})"
    dots = f"(?:\\.{{2,}}|\\.*…[….]*)(?:[{shut})\\]}}]*(?:{cased_after_blank}|(?={_OPENERS}*\\p{{Lu}}\\p{{Ll}})))"
    return f"(?=[\\n-\\r\\u001C-\\u001E\\u0085!.?\\u0600-\\uffff])(?=[{_LINE_ENDS}.…{_STRONG}])({line}|{strong}|{dots}|{dot})"


def marked_text(text: Column) -> Column:
    """The text with placeholders and a MARK after each end of a unit; MARK is the only sign added."""
    pairs, pairs_to = _mask_pairs()
    clean = F.when(text.rlike(f"[{RESERVED}]"), F.translate(text, RESERVED, "�" * len(RESERVED))).otherwise(text)
    masked = F.regexp_replace(clean, "’(?<=\\p{L}’)(?=\\p{L})", APOSTROPHE)
    masked = F.regexp_replace(masked, pairs, pairs_to)
    masked = _silence(masked, OPEN, CLOSE, ".")
    directed = [q for q in _QUOTES if q[0] != q[1]]
    outer, outer_to = _mask_pairs(*OUTER, nested=True)
    masked = _nested(
        masked, "".join(dict.fromkeys(a for a, _, _ in directed)) + "‘", "".join(dict.fromkeys("".join(z for _, z, _ in directed))) + "’",
        lambda t: _silence_outer(F.regexp_replace(t, outer, outer_to)),
    )
    masked = F.regexp_replace(masked, *_mask_brackets(0))
    masked = _silence(masked, *BRACKETS[0], "." + _STRONG)
    masked = _nested(
        masked, "".join(a for a, _ in _BRACKETS), "".join(z for _, z in _BRACKETS),
        lambda t: F.translate(_silence(F.regexp_replace(t, *_mask_brackets(1)), *BRACKETS[1], "." + _STRONG), "".join(BRACKETS[1]), "".join(BRACKETS[0])),
    )
    masked = F.regexp_replace(masked, _silent_dots(), MASKED)
    return F.regexp_replace(masked, _ends(), "$1" + MARK)


def sentence_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, start_pos, end_pos`` of every unit, offsets in code points, end exclusive, without white space at the ends.

    Repeated rows give their units once; two texts of one key give the units of both. The only shuffle carries a few
    numbers for each unit, and texts never leave the scan's tasks.
    """
    pieces = (
        df.where(F.col(text).isNotNull())
        .select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.posexplode(F.split(marked_text(F.col(text)), MARK)).alias("i", "piece"))
        .withColumn("len", F.length("piece"))
        .withColumn("lead", F.col("len") - F.length(F.ltrim("piece", F.lit(WHITE_SPACE))))
        .withColumn("body", F.length(F.trim("piece", F.lit(WHITE_SPACE))))
        .withColumn("kept", F.col("piece").rlike("[\\p{L}\\p{N}]"))
        .select("key", "h", "i", "len", "lead", "body", "kept")
        # one shuffle serves what follows: repeated rows once, offsets, distinct units
        .repartition("key")
        .dropDuplicates(["key", "h", "i"])
    )
    before = Window.partitionBy("key", "h").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return (
        pieces.withColumn("offset", F.coalesce(F.sum("len").over(before), F.lit(0)))
        .where("kept")
        .select(
            F.col("key").alias(key),
            (F.col("offset") + F.col("lead")).cast("int").alias("start_pos"),
            (F.col("offset") + F.col("lead") + F.col("body")).cast("int").alias("end_pos"),
        )
        .distinct()
    )
