"""Text functions: the same semantics as Columns (for Catalyst) and as plain Python (for kernels).

Word classes are ASCII, white space is the set of JavaScript's ``\\s``; both are spelled out, since the
classes of Java, Python and RE2 differ.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space class, what is trimmed at the ends beyond it, the connectives.
WS = r"\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
ENDS = WS + r"\x1C-\x1F\x{85}"
CONNECTIVES = ("a", "an", "the", "and", "or", "nor", "of", "to", "in", "on", "at", "by", "for", "as", "if", "is")

# Patterns that decide tokens; Java's and RE2's regular expressions read them alike.
TOKEN = rf"[0-9][0-9,.\-/:]*[0-9]|[A-Za-z0-9_]+|[^A-Za-z0-9_{WS}]|[{WS}]+"
WORD = r"[A-Za-z0-9_]+"
BLANK = rf"^[{WS}]+$"
RUN = rf"[{WS}]+"
TRIM = rf"^[{ENDS}]+|[{ENDS}]+$"
# Fixed value: a page number is a number or a well-formed roman numeral between dashes, after "page", before "of" or "/" and another.
_TENS, _UNITS = "(?:xc|xl|l?x{0,3})", "(?:ix|iv|v?i{0,3})"
_NUMERAL = f"(?:#|m{{1,3}}(?:cm|cd|d?c{{0,3}}){_TENS}{_UNITS}|(?:cm|cd|dc{{0,3}}|c{{1,3}}){_TENS}{_UNITS}|(?:xc|xl|lx{{0,3}}|x{{1,3}}){_UNITS}|ix|iv|vi{{0,3}}|i{{1,3}})"
PAGE_SHAPE = f"^(?:page ?)?[-–— ]*{_NUMERAL}[-–— ]*(?:(?:of|/) ?{_NUMERAL})?$"
#: A run of digits, of which a signature keeps that it is there.
DIGITS = r"\p{Nd}+"


def _python(pattern: str) -> re.Pattern:
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern))


_TOKEN, _WORD, _BLANK, _RUN, _TRIM = map(_python, (TOKEN, WORD, BLANK, RUN, TRIM))


def norm(text: Column, ignore_case: bool = False) -> Column:
    """White space runs as one space, none at the ends; lower case on request."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), RUN, " "), TRIM, "")
    return F.lower(out) if ignore_case else out


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def words_only(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def content_tokens(text: Column) -> Column:
    return F.filter(tokenize(text), lambda t: ~t.rlike(BLANK))


def categorize(old: Column, new: Column) -> Column:
    """punctuation where both have the same words but are not equal, else content."""
    same = F.array_join(words_only(old), " ") == F.array_join(words_only(new), " ")
    return F.when(same & (old != new), F.lit("punctuation")).otherwise(F.lit("content"))


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def sentinel(kind: Column, number: Column) -> Column:
    """What stands in a text for a reference to a note: kind and number between two private characters."""
    return F.concat(F.lit("\ue000"), kind, F.lit(":"), number.cast("string"), F.lit("\ue001"))


def signature(text: Column, normalized: bool = False) -> Column:
    """What repeated lines are told by: each number as #, lower case; a bare page number is #.

    ``normalized`` says that the text went through ``norm`` already.
    """
    out = F.lower(F.regexp_replace(text if normalized else norm(text), DIGITS, "#"))
    return F.regexp_replace(out, PAGE_SHAPE, "#")


def half(x: Column) -> Column:
    """To the nearest half, ties to even."""
    return F.bround(x * 2) / 2


# Roman numerals.
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman(n: Column) -> Column:
    """Lower-case roman numeral; empty below 1."""
    out, rest = F.lit(""), n
    for value, letters in ROMAN:
        out = F.concat(out, F.repeat(F.lit(letters), F.floor(rest / value).cast("int")))
        rest = F.pmod(rest, F.lit(value))
    return F.when(n > 0, out).otherwise(F.lit(""))


def letters(n: Column) -> Column:
    """List letters: a to z, then aa, ab and on (base 26 without a zero); empty below 1."""
    digit = lambda k: F.chr(97 + F.pmod(k - 1, F.lit(26)))
    up = lambda k: F.floor((k - 1) / 26)
    out, rest = digit(n), up(n)
    for _ in range(4):
        out, rest = F.when(rest > 0, F.concat(digit(rest), out)).otherwise(out), F.when(rest > 0, up(rest)).otherwise(F.lit(0))
    return F.when(n > 0, out).otherwise(F.lit(""))


def page_letters(n: Column) -> Column:
    """Page letters: a to z, then aa, bb and on; decimal below 1."""
    return F.when(n > 0, F.repeat(F.chr(97 + F.pmod(n - 1, F.lit(26))), (F.floor((n - 1) / 26) + 1).cast("int"))).otherwise(n.cast("string"))


# The same on Python strings.


def py_norm(text: str | None, ignore_case: bool = False) -> str:
    out = _TRIM.sub("", _RUN.sub(" ", text or ""))
    return out.lower() if ignore_case else out


def py_tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text or "")


def py_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def py_content(text: str | None) -> list[str]:
    return [t for t in py_tokens(text) if not _BLANK.match(t)]


def py_is_blank(token: str) -> bool:
    return bool(_BLANK.match(token))


def py_categorize(old: str, new: str) -> str:
    return "punctuation" if old != new and py_words(old) == py_words(new) else "content"


def py_ranges(numbers: Sequence[int], dash: str = "-") -> str:
    """Sorted distinct numbers as "1-3, 5, 7-8"."""
    out: list[list[int]] = []
    for n in sorted(set(numbers)):
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return ", ".join(str(a) if a == b else f"{a}{dash}{b}" for a, b in out)
