"""Text patterns as SQL conditions: numbers in text, e-mail addresses and readable dates."""

from __future__ import annotations

from .sqltext import pattern, text

# The formats a text must have to count as a number, an address or a date.
NUMBER_STARTS = "\t\n\v\f\r +-.0123456789IiNn"
NUMBER_CHARACTERS = r"\A[\s0-9+\-._eEinfatyINFATY]+\z"
DIGIT_SEPARATOR = r"(?<=\d)_(?=\d)"
NUMBER = r"\A\s*\+?-?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*\z"
EMAIL = r"\A[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\z"
ZONE_NAME = r" [A-Za-z0-9_/+\-:]*"
DATE = (
    r"\A\s*-?(\d{1,6})([-/ \\])(\d{1,2})\2(\d{1,2})( \([Bb][Cc]\))?"
    r"(\s*|[ T]\s*(0*([01]?\d|2[0-3]):([0-5]?\d(:([0-5]?\d(\.\d*)?)?)?)?|0*24:(00?(:(00?(\.0*)?)?)?)?)"
    rf"(Z|[+-]\d{{2}}(\d{{2}}|(:\d{{2}}(:\d{{2}})?)?(:{ZONE_NAME})?)|{ZONE_NAME})?\s*)\z"
)
YEAR_PADDING = r"\A0+(?=\d{4,}-)"
DATE_WORDS = ("epoch", "inf", "infinity", "-inf", "-infinity")
EMAIL_NAME_PART = "email"
DATE_NAME_PART = "date"


def reads_as_number(value: str) -> str:
    """Whether a text casts to double; null for null.

    The first character decides for most texts without a regular expression, and the character test
    stops at the first foreign character, so long prose never reaches the separator removal.
    """
    starts = ", ".join(str(ord(character)) for character in NUMBER_STARTS)
    digits = f"regexp_replace({value}, {pattern(DIGIT_SEPARATOR)}, '')"
    return (
        f"(ascii({value}) IN ({starts}) AND {value} RLIKE {pattern(NUMBER_CHARACTERS)} "
        f"AND {digits} RLIKE {pattern(NUMBER)})"
    )


def is_email(value: str) -> str:
    return f"({value} RLIKE {pattern(EMAIL)})"


def reads_as_date(value: str) -> str:
    """Whether a text casts to a date or a timestamp; null for null."""
    # Year, month and day with separators Spark reads; the year gets at least four digits.
    padded = f"regexp_replace({value}, {pattern(DATE)}, '000$1-$3-$4')"
    calendar_day = f"regexp_replace({padded}, {pattern(YEAR_PADDING)}, '')"
    # 1 BC is the year 0, so leap days are those of the year before; calendars repeat after 400 years.
    year = f"try_cast(regexp_replace({value}, {pattern(DATE)}, '$1') AS INT)"
    day = f"regexp_replace({value}, {pattern(DATE)}, '$3-$4')"
    before = f"CASE WHEN {year} > 0 AND NOT startswith(ltrim({value}), '-') THEN concat(4000 + ({year} - 1) % 400, '-', {day}) END"
    calendar_day = f"CASE WHEN contains(lower({value}), ' (bc)') THEN {before} ELSE {calendar_day} END"
    words = ", ".join(text(word) for word in DATE_WORDS)
    return (
        f"(CASE WHEN {value} RLIKE {pattern(DATE)} THEN try_cast({calendar_day} AS DATE) IS NOT NULL WHEN {value} IS NOT NULL THEN false END "
        f"OR lower(trim({value})) IN ({words}))"
    )
