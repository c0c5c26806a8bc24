"""Repair of broken bodies, as column expressions: text turned by 47, and UTF-8 read in a one-byte encoding.

Turned text is found in two ways. Between the turned marks of a paragraph everything is turned back. Elsewhere words vote: a word
gains if it has more letters when turned, and it is turned where the words around it gain much together. Words that are
letters already stay at the edge of such a stretch; numbers have no vote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import rot47

# What "<p>", "</p>", "the " and "and " look like when turned.
OPENED, CLOSED = "kAm", "k^Am"
HINT = r"kAm|k\^Am|E96 |2\?5 "
#: Words on each side that vote with a word, the gain in letters for each sign that they need together, and how many of them have to gain.
AROUND, LEAST_GAIN, LEAST_VOTES = 4, 0.20, 3


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def _voted(line: Column) -> Column:
    """A line with the words turned back whose surroundings gain by it."""
    def described(word: Column) -> Column:
        gain = F.when(word.rlike(r"^[\d.,:/%()+-]*$"), F.lit(0)).otherwise(_letters(rot47(word)) - _letters(word))
        return F.struct(word.alias("w"), gain.alias("gain"), F.length(word).alias("size"))

    def decided(words: Column) -> Column:
        def word(x: Column, i: Column) -> Column:
            def won(near: Column) -> Column:
                total = F.aggregate(near, F.struct(F.lit(0).alias("gain"), F.lit(0).alias("size"), F.lit(0).alias("votes")), lambda a, y: F.struct(
                    (a["gain"] + y["gain"]).alias("gain"), (a["size"] + y["size"]).alias("size"), (a["votes"] + (y["gain"] > 0).cast("int")).alias("votes")
                ))
                return F.transform(F.array(total), lambda t: (t["gain"] > LEAST_GAIN * t["size"]) & (t["votes"] >= LEAST_VOTES))[0]

            # the words before and after have one vote each, so that the edges of a stretch are found
            turned = won(F.slice(words, F.greatest(i + 1 - AROUND, F.lit(1)), F.least(i, F.lit(AROUND)) + 1)) | won(F.slice(words, i + 1, AROUND + 1))
            before, after = F.get(words, i - 1)["gain"], F.get(words, i + 1)["gain"]
            inside = (x["gain"] >= 0) | (F.coalesce(before, F.lit(1)) > 0) & (F.coalesce(after, F.lit(1)) > 0)
            return F.when(turned & inside, rot47(x["w"])).otherwise(x["w"])

        return F.transform(words, word)

    words = F.transform(F.split(line, " "), described)
    made = F.array_join(F.transform(F.array(words), decided)[0], " ")
    return F.transform(F.array(made), lambda x: F.when(x == line, x).otherwise(_plain(x)))[0]


def _plain(text: Column) -> Column:
    """Without the tags that turning brought back."""
    return F.regexp_replace(text, "</?[A-Za-z][^<>]*>", " ")


def _voted_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), _voted), "\n")


def repaired_text(text: Column) -> Column:
    """The text with what was turned turned back; null stays null, a text without a hint stays as it is."""
    def piece(part: Column, i: Column) -> Column:
        end = F.instr(part, F.lit(CLOSED))
        paragraph = F.concat(_plain(rot47(F.substring(part, F.lit(1), end - 1))), _voted_lines(F.substring(part, end + len(CLOSED), F.length(part))))
        return F.when(i == 0, _voted_lines(part)).when(end > 0, paragraph).otherwise(_voted_lines(F.concat(F.lit(OPENED), part)))

    whole = F.array_join(F.transform(F.split(text, OPENED), piece), "")
    return F.when(text.rlike(HINT), whole).otherwise(text)


def repaired(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, repaired, changed``. Null texts stay null and are unchanged."""
    made = df.select(F.col(key), F.col(text).alias("__text"), repaired_text(F.col(text)).alias("repaired"))
    return made.select(key, "repaired", F.coalesce(F.col("repaired") != F.col("__text"), F.lit(False)).alias("changed"))


#: Signs that Windows-1252 has where Latin-1 has control codes, and those codes.
_HIGH = [(bytes([b]).decode("cp1252"), chr(b)) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]


def fix_mojibake(text: Column) -> Column:
    """UTF-8 once read as Windows-1252, read right: where the marks of it occur and the bytes are valid, else unchanged."""
    marked = text.rlike("Ã|Â|ð|ï¼|â€")

    def read(narrow: Column) -> Column:
        # every sign has to be one byte, and the bytes valid UTF-8
        return F.when(narrow.rlike("^[\\x{0}-\\x{FF}]*$"), F.try_validate_utf8(F.encode(narrow, "ISO-8859-1").cast("string")))

    narrow = F.translate(text, "".join(a for a, _ in _HIGH), "".join(b for _, b in _HIGH))
    return F.when(marked, F.coalesce(F.transform(F.array(narrow), read)[0], text)).otherwise(text)
