"""Text helpers whose results agree with Python's ``str`` methods and ``re`` on native scripts."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() removes and str.splitlines() breaks at.
SPACE = r"\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE_CHARS = (
    "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}"

# Native digits, each set in the order 0 to 9.
DEVANAGARI_DIGITS = "०१२३४५६७८९"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
URDU_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
WESTERN_DIGITS = "0123456789"

# The same characters as ranges, which a regex compares faster than single characters; line breaks other than the line feed.
DIGIT_RANGES = {digits: f"{digits[0]}-{digits[-1]}" for digits in (DEVANAGARI_DIGITS, ARABIC_DIGITS, URDU_DIGITS)}
OTHER_LINE_BREAK = r"\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}-\x{2029}"

WORD = r"\p{L}\p{N}_"
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_blank(value: Column) -> Column:
    """True for null and the empty string only; blank spaces count as present."""
    return F.coalesce(value, F.lit("")) == ""


def strip(value: Column) -> Column:
    """Both ends freed of everything Python's ``str.strip`` removes; a plain character-set trim, no regex."""
    return F.btrim(value, F.lit(SPACE_CHARS))


def unify_lines(value: Column) -> Column:
    """Line breaks of any kind as one line feed; a text that has line feeds only is left as it is."""
    other = value.rlike(f"[{OTHER_LINE_BREAK}]")
    return F.when(other, F.regexp_replace(value, rf"\r\n|[{LINE_BREAK}]", "\n")).otherwise(value)


def split_lines(value: Column) -> Column:
    return F.split(value, rf"\r\n|[{LINE_BREAK}]")


def to_western(value: Column) -> Column:
    return F.translate(value, DEVANAGARI_DIGITS + ARABIC_DIGITS + URDU_DIGITS, WESTERN_DIGITS * 3)


def western_or_null(value: Column) -> Column:
    """Value with native digits made Western; null when it holds none of the three digit sets."""
    return F.when(value.rlike(f"[{''.join(DIGIT_RANGES.values())}]"), to_western(value))


def extraction_digits(value: Column) -> Column:
    """Digits made Western before patterns are tried: Devanagari and Urdu sets only."""
    western = F.translate(value, DEVANAGARI_DIGITS + URDU_DIGITS, WESTERN_DIGITS * 2)
    return F.when(value.rlike(f"[{DIGIT_RANGES[DEVANAGARI_DIGITS]}{DIGIT_RANGES[URDU_DIGITS]}]"), western).otherwise(value)


def fold_matra(value: Column) -> Column:
    """Short-i vowel sign written as long-ii, so both spellings of a label meet."""
    return F.replace(value, F.lit("ि"), F.lit("ी"))


def identity_key(value: Column) -> Column:
    """Form in which two identifiers count as equal: no outer blanks, no case."""
    # Upper first folds letters such as ß; the empty text keeps the optimizer from dropping that step.
    return F.lower(F.concat(F.upper(strip(value)), F.lit("")))


def count_chars(value: Column, char_class: str) -> Column:
    """How many characters of ``value`` fall in a regex character class."""
    return F.length(value) - F.length(F.regexp_replace(value, f"[{char_class}]+", ""))


def count_literal(value: Column, literal: str) -> Column:
    """Non-overlapping occurrences of ``literal``, as ``str.count`` gives."""
    return (F.length(value) - F.length(F.replace(value, F.lit(literal), F.lit("")))) / F.lit(len(literal))


def _entity_udf():
    def unescape(values: pd.Series) -> pd.Series:
        return values.map(html.unescape, na_action="ignore")

    return F.pandas_udf(unescape, T.StringType())


def strip_markup(value: Column) -> Column:
    """Plain text of a marked-up page.

    Entities are resolved first, so an escaped tag disappears like a real one. Only texts that hold an
    ampersand are sent to Python; the rest stays in the JVM.
    """
    plain = F.coalesce(_entity_udf()(F.when(F.contains(value, F.lit("&")), value)), value)
    spaced = F.regexp_replace(F.regexp_replace(plain, "<[^>]+>", " "), r"[ \t]+", " ")
    return strip(F.regexp_replace(spaced, rf"[{SPACE}]*[{LINE_BREAK}][{SPACE}]*", "\n"))


def word_confidence(confidences: Column, text: Column) -> Column:
    """Document confidence from per-word confidences (-1 marks no word); 0.5 when there are none to read but text is."""
    kept = F.filter(confidences, lambda c: c != -1)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, c: acc + c.cast("double"))
    mean = F.when(F.size(kept) > 0, total / F.size(kept) / 100).otherwise(0.0)
    fallback = F.when(strip(F.coalesce(text, F.lit(""))) != "", 0.5).otherwise(0.0)
    return F.when(confidences.isNull(), fallback).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)))
