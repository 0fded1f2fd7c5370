"""String columns: normalised text, identifiers, keywords, URLs.

All patterns are Java patterns; ``(?iu)`` folds case beyond ASCII and ``(?U)``
makes ``\\s \\w \\d \\b`` Unicode-aware.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and their base letter, position by position.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
_BASE = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"
assert len(_MARKED) == len(_BASE)


@cache
def _compatible() -> tuple[str, str, dict[str, str]]:
    """Compatibility forms by Unicode's own rule: (signs, their single base signs, signs of several base signs).

    Hangul syllables stay whole.
    """
    single, several = {}, {}
    for point in range(0x80, 0xFFFF):
        sign = chr(point)
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF or sign in _MARKED:
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", sign.lower()) if not unicodedata.combining(c))
        if base != sign and len(base) == 1:
            single[sign] = base
        elif base != sign and base:
            several[sign] = base
    return "".join(single), "".join(single.values()), several


def fold_compatible(col: Column) -> Column:
    """Ligatures, wide letters, fractions, numbers in circles and the like as their plain signs."""
    marked, bases, several = _compatible()
    table = F.str_to_map(F.lit("\u0001".join(f"{a}\u0002{b}" for a, b in several.items())), F.lit("\u0001"), F.lit("\u0002"))
    text = F.translate(col, marked, bases)
    signs = "".join(several)
    runs = F.regexp_extract_all(text, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
    spelled = F.array_join(F.transform(runs, lambda r: F.coalesce(F.element_at(table, r), r)), "")
    return F.when(F.translate(text, signs, "") != text, spelled).otherwise(text)


def title_words(col: Column) -> Column:
    """A capital at the start of every run of letters, small letters behind it."""
    runs = F.regexp_extract_all(col, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))), ""
    )


_BLANKS = " \t\n\r\x0b\x0c\xa0"


def strip(col: Column) -> Column:
    """Cut blanks of every kind at both ends (``trim`` cuts spaces only)."""
    return F.btrim(col, F.lit(_BLANKS))


def norm_text(col: Column) -> Column:
    """Comparison form of a text: lower case, no accents, no punctuation."""
    text = F.lower(F.coalesce(col.cast("string"), F.lit("")))
    folded = F.regexp_replace(fold_compatible(F.translate(text, _MARKED, _BASE)), r"\p{M}+", "")
    text = F.when(F.octet_length(text) == F.length(text), text).otherwise(folded)  # ASCII has nothing to fold
    text = F.replace(text, F.lit("&"), F.lit(" och "))
    text = F.regexp_replace(text, r"(?U)[^\w\s]+|[/_|(),;:+\-]+", " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def norm_id(col: Column) -> Column:
    """Registration and chassis numbers: ASCII letters and digits, upper case."""
    return F.upper(F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), "[^A-Za-z0-9]", ""))


def norm_variant(col: Column, rewrites: Iterable[tuple[str, str]]) -> Column:
    text = norm_text(col)
    for old, new in rewrites:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def loose_text(col: Column) -> Column:
    """Lower case with ``_`` and ``-`` read as spaces; keeps all other signs."""
    text = F.lower(F.coalesce(col.cast("string"), F.lit("")))
    for sign in "_-":
        text = F.replace(text, F.lit(sign), F.lit(" "))
    return text


def contains_any(text: Column, keywords: Iterable[str]) -> Column:
    """One regular expression for a whole keyword list, so text is read once."""
    words = sorted(set(keywords))
    return text.rlike(any_of_pattern(words)) if words else F.lit(False)


def any_of_pattern(words: Iterable[str]) -> str:
    """Alternation with shared prefixes factored out, so most positions fail on one character."""
    groups: dict[str, list[str]] = {}
    for word in words:
        groups.setdefault(word[:1], []).append(word[1:])
    if "" in groups:
        return ""
    parts = []
    for head, tails in groups.items():
        rest = any_of_pattern(tails) if len(tails) > 1 else _quote(tails[0])
        parts.append(_quote(head) + rest)
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def _quote(word: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", word)


def quote_pattern(word: str) -> str:
    """Literal text as a pattern that Java and RE2 read alike."""
    return _quote(word)


def first_keyword_value(text: Column, table: Iterable[tuple[str, int]], default: int = 0) -> Column:
    """Value of the first keyword (table order) that occurs in ``text``."""
    expr = None
    for word, value in table:
        hit = F.contains(text, F.lit(word))
        expr = F.when(hit, F.lit(value)) if expr is None else expr.when(hit, F.lit(value))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def clean_url(col: Column) -> Column:
    """Trimmed, without fragment and trailing slashes; empty becomes null."""
    text = strip(col)
    cut = F.rtrim(F.substring_index(text, "#", 1), F.lit("/"))
    return F.when(F.length(text) > 0, cut)


def blank_to_null(col: Column) -> Column:
    return F.when(F.length(col) > 0, col)


def digits(col: Column) -> Column:
    """All digits as a number; 0 when there are none or the number passes 64 bits.

    Only what fits is cast: a failing cast costs many times a good one.
    """
    found = F.ltrim(F.regexp_replace(col, r"\D+", ""), F.lit("0"))
    size = F.length(found)
    fits = size.between(1, 18) | ((size == 19) & (found <= str(2**63 - 1)))
    return F.coalesce(F.when(fits, found).try_cast("bigint"), F.lit(0).cast("bigint"))


def folded_letters(col: Column) -> Column:
    """Small letters as ``(?iu)`` reads them: four signs beyond ASCII stand for one of its letters."""
    return F.lower(F.translate(col, "\u0130\u0131\u017f\u212a", "iisk"))


def body_type(col: Column) -> Column:
    """First body word of a page in fixed order of preference.

    The patterns, which are dear, run only where their first word occurs at all.
    """
    text = F.regexp_replace(col, r"(?U)\s+", " ")
    plain = folded_letters(col)
    has = lambda word, rest="": F.contains(plain, F.lit(word)) & text.rlike(rf"(?iU)\b{word}{rest}\b")
    return (
        F.when(has("touring"), "Touring")
        .when(has("cross", r"\s*country"), "Cross Country")
        .when(has("kombi"), "Kombi")
        .when(has("sedan"), "Sedan")
        .when(has("suv"), "SUV")
    )


def join_model_tokens(col: Column, numbers: Iterable[str] = ("530", "330"), letter: str = "e") -> Column:
    """``"530 e"`` → ``"530e"`` for the given model numbers."""
    alternatives = "|".join(numbers)
    return F.regexp_replace(col, rf"(?iU)\b({alternatives})\s+{letter}\b", f"$1{letter}")


def gearbox(col: Column) -> Column:
    return F.when(F.contains(F.lower(col), F.lit("aut")), "Automat").otherwise(strip(col))


# Swedish registration numbers: three letters, then three digits or two digits and a letter.
_REG_BODY = r"([A-ZÅÄÖ]{3})[\s-]?(\d{3}|\d{2}[A-Z])"
REG_PATTERN = rf"(?iu)(?<![A-ZÅÄÖ0-9]){_REG_BODY}(?![A-ZÅÄÖ0-9])"


def valid_regno(col: Column) -> Column:
    """Cleaned registration number, or null when it is not one."""
    kept = F.upper(F.regexp_replace(col, "[^A-Za-zÅÄÖåäö0-9]", ""))
    return F.when(kept.rlike(r"^[A-ZÅÄÖ]{3}([0-9]{3}|[0-9]{2}[A-Z])$"), kept)


def find_regno(col: Column) -> Column:
    """First registration number standing free in a text."""
    return valid_regno(F.regexp_extract(col, REG_PATTERN, 0))  # which cuts the sign between the parts


def spaced_thousands(col: Column) -> Column:
    """12345 → ``12 345``."""
    return F.translate(F.format_number(col, 0), ",", " ")
