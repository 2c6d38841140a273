"""Text expressions. All of them are built-in Spark functions and stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gabble import catalog

# The characters Python's strip() removes.
_WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_SECONDS_PER_DAY = 86400


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often the body or a lambda reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def filled(text: Column) -> Column:
    """Null text becomes the empty string."""
    return F.coalesce(text.cast("string"), F.lit(""))


def default(value: Column, fallback) -> Column:
    """The value, or the fallback where it is missing."""
    return F.coalesce(value, F.lit(fallback))


def fold(text: Column) -> Column:
    """Lower case with the six accented letters of the name lists mapped to plain ones.

    Pure ASCII text has none of them and skips the character-wise mapping.
    """
    mapped = F.translate(F.lower(text), catalog.FOLD_FROM, catalog.FOLD_TO)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(mapped)


def contains_any(text: Column, variants: Column) -> Column:
    """True where the text contains any of the variants as a substring; null is false.

    Prepare both sides alike, with :func:`fold` for accent-insensitive or ``lower`` for
    case-insensitive matching.
    """
    hit = bind(text, lambda t: F.exists(variants, lambda v: t.contains(v)))
    return F.coalesce(hit, F.lit(False))


def mentions(text: Column, name: Column) -> Column:
    """True where the text contains the name, ignoring case; null is false."""
    return F.coalesce(F.lower(text).contains(F.lower(name)), F.lit(False))


def strip(text: Column) -> Column:
    """Remove white space of any kind, no-break space included, from both ends."""
    return F.btrim(text, F.lit(_WHITE_SPACE))


def strip_footer(text: Column, marker: str = catalog.FOOTER_MARKER,
                 pattern: str = catalog.FOOTER_PATTERN) -> Column:
    """Remove a mass-deletion footer, then surrounding white space.

    The pattern only runs on texts with the marker, a literal every match contains.
    """
    cut = F.regexp_replace(text, f"(?d){pattern}", "")
    return strip(F.when(text.contains(marker), cut).otherwise(text))


def strip_control(text: Column) -> Column:
    """Remove control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(text, catalog.CONTROL_PATTERN, "")


def truncate(text: Column, n: int | None) -> Column:
    """First ``n`` characters; ``None`` keeps the whole text."""
    return text if n is None else F.substring(text, 1, n)


def is_deleted_text(text: Column, phrases: Iterable[str] = catalog.DELETED_PHRASES,
                    whole: Iterable[str] = catalog.DELETED_WHOLE) -> Column:
    """Case-insensitive search for a deletion marker; null text is no match.

    Phrases count anywhere, the patterns only as the whole text (a final line end may follow).
    """
    anchored = text.rlike("(?idU)^(?:" + "|".join(f"{p}$" for p in whole) + ")")
    anywhere = [F.lower(text).contains(p.lower()) for p in phrases]
    return F.coalesce(reduce(Column.__or__, anywhere, anchored), F.lit(False))


def is_live_body(text: Column, markers: Iterable[str] = catalog.DELETED_BODIES) -> Column:
    """True for text that is neither missing nor empty nor exactly a deletion marker."""
    return F.coalesce((text != "") & ~text.isin(*markers), F.lit(False))


def member(value: Column, names: Iterable[str]) -> Column:
    """Exact, case-sensitive set membership where null is not a member."""
    return F.coalesce(value.isin(*names), F.lit(False))


def absolute_url(permalink: Column, prefix: str = catalog.URL_PREFIX) -> Column:
    """Permalink with the site's prefix; a missing permalink counts as empty."""
    return F.concat(F.lit(prefix), default(permalink, ""))


def epoch_seconds(value: Column) -> Column:
    """Integer epoch seconds; missing or unreadable values become 0."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def utc_date(seconds: Column) -> Column:
    """``yyyy-MM-dd`` in UTC whatever the session's time zone is."""
    days = F.floor(epoch_seconds(seconds) / _SECONDS_PER_DAY).cast("int")
    return F.date_add(F.to_date(F.lit("1970-01-01")), days).cast("string")


def word_pattern(words: Iterable[str]) -> str:
    """Regular expression for any of the words, bounded by non-letters on both sides.

    Looking at the first two letters before anything else skips most positions of a text.
    """
    words = list(words)

    def letters(at: int) -> str:
        return "[" + "".join(sorted({rf"\Q{w[at]}\E" for w in words})) + "]"

    start = letters(0) + (letters(1) if all(len(w) > 1 for w in words) else "")
    body = "|".join(rf"\Q{w}\E" for w in words)
    letter = r"[\p{L}\p{N}_]"
    return f"(?={start})(?<!{letter})(?:{body})(?!{letter})"


def has_word(text: Column, words: Iterable[str]) -> Column:
    """True where the lower-case text contains any of the (lower-case) words."""
    return F.lower(text).rlike(word_pattern(words))


def count_words(text: Column, words: Iterable[str]) -> Column:
    """How often words of the list occur in the lower-case text."""
    return F.regexp_count(F.lower(text), F.lit(word_pattern(words))).cast("bigint")
