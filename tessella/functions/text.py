"""Text functions as Column expressions: everything here stays inside the JVM."""

from __future__ import annotations

import unicodedata
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folded(code: int) -> str:
    """The compatibility decomposition of a code point without its combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))


#: All code points but surrogates, private ones, and syllables of Hangul, which decompose one to one.
_CODES = [*range(0xA0, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)]


def _folding_pairs() -> tuple[str, str]:
    """Signs whose decomposition is one plain sign with marks or in another style, and that sign; blanks become blanks."""
    pairs = [(chr(code), plain) for code in _CODES if len(plain := _folded(code)) == 1 and plain != chr(code)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _mark_class() -> str:
    """A character class of all combining marks."""
    runs: list[list[int]] = []
    for code in (c for c in _CODES if unicodedata.combining(chr(c))):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in runs) + "]"


ACCENTED, PLAIN = _folding_pairs()
MARKS = _mark_class()
#: Ligatures and digraphs of Latin letters, with the letters that they stand for.
LIGATURES = [(chr(c), _folded(c)) for c in [*range(0x132, 0x14A), *range(0x1C4, 0x1F4), *range(0xFB00, 0xFB07)] if len(_folded(c)) > 1]
_LIGATURE = "[" + "".join(a for a, _ in LIGATURES) + "]"
#: The same classes for Java, which tries ranges one by one: one test that other signs fail goes before them. A mark that Java doesn't know yet is unassigned there.
_JAVA_MARKS, _JAVA_LIGATURE = f"[\\p{{M}}\\p{{Cn}}&&{MARKS}]", f"[\\x{{0132}}-\\x{{FB06}}&&{_LIGATURE}]"


def strip_accents(text: Column) -> Column:
    """Signs without their marks and in their plain style, Latin ligatures as letters. Null stays null."""
    plain = F.translate(F.regexp_replace(text, _JAVA_MARKS, ""), ACCENTED, PLAIN)

    def parted(x: Column) -> Column:
        whole = x
        for sign, letters in LIGATURES:
            whole = F.replace(whole, F.lit(sign), F.lit(letters))
        return F.when(x.rlike(_JAVA_LIGATURE), whole).otherwise(x)

    return F.transform(F.array(plain), parted)[0]


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def norm_url(url: Column) -> Column:
    """The address without scheme, www., query, fragment and trailing slashes, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "^www\\.", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, "[?#][\\s\\S]*$", ""), "/+$", ""))


def norm_title(title: Column) -> Column:
    """Title as a comparable key: no accents, lower case, signs to blanks, squeezed; null counts as empty."""
    plain = F.lower(strip_accents(F.coalesce(title, F.lit(""))))
    return squeeze(F.regexp_replace(plain, "[^\\p{L}\\p{N}_\\s]", " "))


def norm_body(text: Column) -> Column:
    """Like ``norm_title`` with addresses removed after lower-casing."""
    plain = F.lower(strip_accents(F.coalesce(text, F.lit(""))))
    return squeeze(F.regexp_replace(F.regexp_replace(plain, "https?://\\S+", " "), "[^\\p{L}\\p{N}_\\s]", " "))


def norm_event(text: Column) -> Column:
    """Lower case without accents; signs but # become blanks, nothing is squeezed."""
    return F.regexp_replace(F.lower(strip_accents(F.coalesce(text, F.lit("")))), "[^\\p{L}\\p{N}_\\s#]", " ")


ENTITY = "&#?[0-9A-Za-z]{1,8};"
#: Names of all entities that end in a semicolon, and what they stand for.
NAMED_ENTITIES = {name[:-1]: sign for name, sign in html5.items() if name.endswith(";")}
#: Signs that numeric entities of the control range stand for in practice.
CONTROL_ENTITIES = {n: bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
#: Entities, stretches without any, and single ampersands, in their order.
ENTITY_PIECES = "(&(?:#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,7}|[A-Za-z][A-Za-z0-9]*);|[^&]+|&)"


def html_unescape(text: Column) -> Column:
    """Named and numeric entities as the signs they stand for, in one pass; what is none stays. Null stays null."""
    def numbered(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^&#[xX]?([0-9A-Fa-f]+);$", 1)
        code = F.when(piece.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")

        def sign(n: Column) -> Column:
            wrong = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
            controls = F.create_map(*[F.lit(x) for n, c in CONTROL_ENTITIES.items() for x in (n, c)])
            made = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
            return F.when(wrong, F.lit("�")).when(n.between(0x80, 0x9F), F.coalesce(F.element_at(controls, n.cast("int")), made)).otherwise(made)

        return F.transform(F.array(code), sign)[0]

    names = F.create_map(*[F.lit(x) for pair in NAMED_ENTITIES.items() for x in pair])

    def piece(x: Column) -> Column:
        named = F.element_at(names, F.regexp_extract(x, "^&([A-Za-z][A-Za-z0-9]*);$", 1))
        return F.when(~x.startswith("&"), x).when(x.startswith("&#"), numbered(x)).otherwise(F.coalesce(named, x))

    whole = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(ENTITY_PIECES), 1), piece), "")
    return F.when(text.contains("&"), whole).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters with at least two of them."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([\\p{L}\\p{Nl}\\p{No}]+)"), 1)
    return F.filter(words, lambda w: F.length(w) >= 2)


def tokens3(text: Column) -> Column:
    """Runs of three or more letters that touch neither digit nor underscore."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([\\p{L}\\p{N}_]+)"), 1)
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike("[\\p{Nd}_]"))


def shingles(norm: Column, size: int = 5) -> Column:
    """Distinct word shingles of a normalised text; a shorter one gives its words."""

    def made(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
        return F.array_distinct(F.when(F.size(words) >= size, runs).otherwise(words))

    # the lambda binds the words once
    return F.transform(F.array(F.split(norm, " ")), made)[0]


def shingle_hashes(norm: Column, size: int = 5) -> Column:
    """Hashes of the distinct shingles of ``shingles``, made without the strings."""

    def made(hashes: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
        return F.array_distinct(F.when(F.size(hashes) >= size, runs).otherwise(hashes))

    # words are hashed once, then their hashes
    return F.transform(F.array(F.transform(F.split(norm, " "), lambda w: F.xxhash64(w))), made)[0]


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 0 if one is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))


def sentences(text: Column) -> Column:
    """Pieces after a full stop, exclamation or question mark or ellipsis and white space."""
    return F.split(text, "(?<=[.!?…])\\s+")


QUOTE_SIGNS = "[\"“”„«»‘’「」『』]"


def alpha_share(text: Column, first: int = 1200) -> Column:
    """Share of letters among what isn't white space in the first signs; 0 if there is nothing."""
    head = F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, first), "\\s", "")
    return F.when(F.length(head) > 0, F.length(F.regexp_replace(head, "[^\\p{L}]", "")) / F.length(head)).otherwise(F.lit(0.0))


_ROT47_FROM = "".join(map(chr, range(33, 127)))
_ROT47_TO = _ROT47_FROM[47:] + _ROT47_FROM[:47]


def rot47(text: Column) -> Column:
    """The visible ASCII signs turned by 47; its own inverse."""
    return F.translate(text, _ROT47_FROM, _ROT47_TO)


def kw_list(joined: Column, by: str = " | ") -> Column:
    """A joined list as an array of trimmed parts; null gives an empty one."""
    parts = F.transform(F.split(joined, "\\Q" + by + "\\E"), F.trim)
    return F.coalesce(parts, F.array().cast("array<string>"))


def json_list(text: Column) -> Column:
    """A JSON list as a set of lower-case trimmed words; anything else gives an empty one."""
    parsed = F.from_json(text, "array<string>")
    return F.coalesce(F.array_distinct(F.transform(F.filter(parsed, lambda x: x.isNotNull()), lambda x: F.lower(F.trim(x)))), F.array().cast("array<string>"))


def boundary_pattern(term: Column) -> Column:
    """Pattern for a term that no letter, digit or underscore touches."""
    escaped = F.regexp_replace(term, "([\\\\.\\[\\]{}()*+?^$|#\\-])", "\\\\$1")
    return F.concat(F.lit("(?:^|[^\\p{L}\\p{N}_])"), escaped, F.lit("(?:[^\\p{L}\\p{N}_]|$)"))


def bounded_contains(text: Column, term: Column) -> Column:
    """Whether ``term`` occurs in ``text`` with no letter, digit or underscore at either side, without a pattern for each pair.

    Both sides of every occurrence are looked at: the text is split at the term.
    """
    wordlike = "[\\p{L}\\p{N}_]"

    def found(parts: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(parts) - 1)
        free = F.exists(places, lambda i: ~F.element_at(parts, i).rlike(wordlike + "$") & ~F.element_at(parts, i + 1).rlike("^" + wordlike))
        return F.when(F.size(parts) > 1, free).otherwise(F.lit(False))

    quoted = F.concat(F.lit("\\Q"), term, F.lit("\\E"))
    return F.transform(F.array(F.split(text, quoted, -1)), found)[0]
