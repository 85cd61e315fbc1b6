"""Rule-based text operators as column expressions.

Rules are parameters: the same functions take any lexicon. A first matching rule wins, which is
a CASE expression; lists of hits keep the order of the lexicon.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def unnegated(keyword: str, negators: tuple[str, ...], fillers: str = "") -> str:
    """Pattern of a keyword that no negator precedes, fillers and blanks between them allowed,
    within the six characters in front of it."""
    gap = f"[{re.escape(fillers)}\\s]" if fillers else "\\s"
    looks = "".join(f"(?<!{re.escape(n)}{gap}{{0,{6 - len(n)}}})" for n in sorted(negators, key=len, reverse=True) if len(n) <= 6)
    return f"(?U){looks}{re.escape(keyword)}"


def signal_words(text: Column, keywords: tuple[str, ...], negators: tuple[str, ...], fillers: str = "") -> Column:
    """Keywords that occur without a negation in front, in lexicon order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(unnegated(k, negators, fillers)), F.lit(k)) for k in keywords]))


def first_match(rules: tuple[tuple[str, Column], ...], default: str) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules], F.lit(default))


def short(text: Column, pattern: str, most: int) -> Column:
    """Whether a stripped text of 1 to `most` characters has the pattern."""
    t = strip(F.coalesce(text, F.lit("")))
    return F.length(t).between(1, most) & t.rlike(pattern)


def categories(text: Column, lexicon: dict[str, tuple[str, ...]]) -> Column:
    """Names of the categories of which any keyword occurs, in lexicon order."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")
    return F.array_compact(F.array(*[F.when(low.rlike("|".join(map(re.escape, words))), F.lit(name)) for name, words in lexicon.items()]))


def clean_lines(text: Column) -> Column:
    """No zero-width marks; lines stripped; three or more line ends are two, runs of blanks one."""
    t = F.regexp_replace(text, "[\\uFEFF\\u200B\\u200C\\u200D]", "")
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.array_join(F.transform(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t"))), "\n")
    return F.btrim(F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), "[ \t]+", " "), F.lit(BLANKS))


def shingles(text: Column, width: int) -> Column:
    """Distinct character n-grams; a shorter text is its only one; none without text.

    The text is split into characters once, as a lambda's argument, so a gram costs its own width
    and not the way to its place.
    """
    n = F.length(text)
    places = F.sequence(F.lit(1), n - width + 1)
    grams = F.transform(F.array(F.split(text, "")), lambda c: F.transform(places, lambda i: F.array_join(F.slice(c, i, width), "")))[0]
    return F.when(n >= width, F.array_distinct(grams)).when(n > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


# fixed values: what the two normal forms keep
def normal_key(text: Column) -> Column:
    """Letters and digits of the lower-cased text."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def key_latin_han(text: Column) -> Column:
    """Digits, a-z and Han characters of the lower-cased text."""
    return F.regexp_replace(F.lower(text), "[^0-9a-z\u4e00-\u9fff]", "")


def without_punctuation(text: Column, marks: str = ".,;:!?") -> Column:
    return F.translate(text, marks, "")


def without_titles(text: Column) -> Column:
    """No blanks, and no titles in angle quotes."""
    return F.regexp_replace(F.regexp_replace(text, "《[^》]*》", ""), "[ \t\r\n]+", "")


def md5_long(text: Column) -> Column:
    """The first eight bytes of the MD5 digest as a little-endian unsigned number, in decimal."""
    digest = F.md5(text)
    return F.conv(F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in range(7, -1, -1)]), 16, 10)


def masked(text: Column, surnames: tuple[str, ...] = (), titles: tuple[str, ...] = ()) -> Column:
    """Names (a surname, one to three letters, a title) and runs of six digits or more become
    placeholders."""
    if surnames:
        text = F.regexp_replace(text, f"({'|'.join(surnames)})[\\p{{L}}]{{1,3}}({'|'.join(titles)})", "<name>")
    return F.regexp_replace(text, "[0-9]{6,}", "<number>")
