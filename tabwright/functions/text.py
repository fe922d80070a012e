"""Text expressions: trimming, numeric text, boolean text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------------
# Cell texts a delimited file uses for "missing".
NULL_TOKENS = ["", "NA", "N/A", "null", "NULL", "None", "nan", "NaN"]
# Words a numeric-looking column uses for "missing" (compared in lower case).
MISSING_WORDS = ["na", "n/a", "null", "none", "nan", "unknown", "undefined", "-", "--"]
# Words reported as dirt in a mostly numeric text column (compared in lower case).
DIRTY_WORDS = ["unknown", "n/a", "none", "null", "?", "-"]
# Signs and unit words removed from numeric text.
NUMERIC_SIGNS = ",$€£%"
UNIT_WORDS = r"(?i)\b(?:year|years|yr|yrs|annual|salary|usd|eur|gbp)\b"
NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
WHOLE_NUMBER = r"^[+-]?[0-9]+$"
# Texts accepted as an integer or float literal: digits may be grouped by underscores.
INT_LITERAL = r"^[+-]?[0-9]+(?:_[0-9]+)*$"
FLOAT_LITERAL = (
    r"(?i)^[+-]?(?:(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)"
    r"(?:e[+-]?[0-9]+(?:_[0-9]+)*)?|inf|infinity|nan)$"
)
TRUE_WORDS = ["true", "1", "yes", "t", "y"]
FALSE_WORDS = ["false", "0", "no", "f", "n"]
# ----------------------------------------------------------------------------------

# Fixed value: the characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_all(c: Column) -> Column:
    """Strip every kind of white space at both ends, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(trim_all(c), r"(?U)\s+", " ")


def null_tokens_to_null(c: Column) -> Column:
    return F.when(~c.isin(NULL_TOKENS), c)


def _bare_number(c: Column, pattern: str) -> Column:
    """The text without signs and unit words if it is a number, else empty. Words that stand for
    "missing" are no numbers. Each step is evaluated once per cell."""
    bare = trim_all(F.regexp_replace(F.translate(trim_all(c), NUMERIC_SIGNS, ""), UNIT_WORDS, ""))
    return F.regexp_extract(bare, pattern, 0)


def clean_numeric_text(c: Column) -> Column:
    """Numeric text without signs and unit words, or null when no number remains."""
    return F.nullif(_bare_number(c, NUMBER), F.lit(""))


def text_to_long(c: Column) -> Column:
    return _bare_number(c, WHOLE_NUMBER).try_cast("bigint")


def text_to_double(c: Column) -> Column:
    return _bare_number(c, NUMBER).try_cast("double")


def text_to_boolean(c: Column) -> Column:
    word = F.lower(trim_all(c))
    return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))


def looks_like_float(c: Column) -> Column:
    """True when the text, without ``$ , %`` and outer white space, is a float literal."""
    return trim_all(F.translate(c, "$,%", "")).rlike(FLOAT_LITERAL)


def parses_as(c: Column, expected: str) -> Column:
    """True when the text, without ``$ ,``, is an integer or float literal."""
    bare = trim_all(F.translate(c, "$,", ""))
    return bare.rlike(INT_LITERAL if expected == "integer" else FLOAT_LITERAL)


def looks_like_date(c: Column) -> Column:
    """Three parts separated by ``-`` or ``/``."""
    return F.length(c) - F.length(F.translate(c, "-/", "")) == 2


def parse_boolean_word(value: object) -> bool | None:
    """The driver-side twin of ``text_to_boolean`` for parameters."""
    word = str(value).strip().lower()
    if word in TRUE_WORDS:
        return True
    return False if word in FALSE_WORDS else None
