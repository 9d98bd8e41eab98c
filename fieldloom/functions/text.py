"""Scalar functions on text, as column expressions that stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rule(change: Callable[[str], str]) -> tuple[str, str, dict[str, str]]:
    """What a change of single characters does to every code point: those that become one other character and what each
    becomes, and those that become several or none. Hangul syllables, which follow a rule of their own, are left out."""
    one, several = {}, {}
    for code in (*range(0x80, 0xAC00), *range(0xE000, 0x110000)) if change("A") == "A" else (*range(0x41, 0xAC00), *range(0xE000, 0x110000)):
        c = chr(code)
        if (out := change(c)) != c:
            (one if len(out) == 1 else several)[c] = out
    return "".join(one), "".join(one.values()), several


def _bare(c: str) -> str:
    return "".join(p for p in unicodedata.normalize("NFD", c) if unicodedata.category(p) != "Mn")


_COMPOSED, _BASE, _PARTS = _rule(_bare)
_PARTS = {c: out for c, out in _PARTS.items() if out}  # what vanishes is a mark
_CAPITAL, _SMALL, _FOLDS = _rule(str.casefold)
#: Marks; one letter was taken for a mark by older versions of Unicode.
_MARKS = r"[\p{Mn}&&[^\u1734]]"
_BEYOND_ASCII = r"[^\x00-\x7F]"
#: The first syllable, and the numbers of vowels and of final consonants, by which syllables are composed of letters.
_SYLLABLE, _VOWELS, _FINALS = 0xAC00, 21, 28
#: White space of any kind.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that separate a label from its value, and glyphs that are read for one another.
SEPARATORS = ":;,.·|¦!-—–_"
CONFUSED, FOLDED = "ODQILSZB", "00011528"
ORDINALS = ("n", "no", "nro", "n0")


def _spelled(s: Column, table: dict[str, str]) -> Column:
    """Characters of a table replaced by the several that they become; only texts that have one are taken apart."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    each = F.transform(F.split(s, ""), lambda c: F.coalesce(F.try_element_at(known, c), c))
    return F.when(s.rlike("[" + "".join(table) + "]"), F.array_join(each, "")).otherwise(s)


def _letters(s: Column) -> Column:
    """Hangul syllables as their two or three letters, by arithmetic on code points."""
    first, vowel, final = (F.array(*(F.lit(chr(at + k) if at + k >= least else "") for k in range(n))) for at, n, least in ((0x1100, 19, 0), (0x1161, _VOWELS, 0), (0x11A7, _FINALS, 0x11A8)))

    def apart(c: Column) -> Column:
        k = F.ascii(c) - _SYLLABLE
        parts = F.get(first, F.floor(k / (_VOWELS * _FINALS)).cast("int")), F.get(vowel, F.floor(k / _FINALS).cast("int") % _VOWELS), F.get(final, k % _FINALS)
        return F.when(c.rlike("^[\uac00-\ud7a3]"), F.concat(*parts)).otherwise(c)

    return F.when(s.rlike("[\uac00-\ud7a3]"), F.array_join(F.transform(F.split(s, ""), apart), "")).otherwise(s)


def strip_accents(s: Column) -> Column:
    """Decomposed letters without their marks; º, ° and ß are not folded. ASCII has neither, so it stays as it is."""
    bare = F.regexp_replace(F.translate(_letters(_spelled(s, _PARTS)), _COMPOSED, _BASE), f"{_MARKS}+", "")
    return F.when(s.rlike(_BEYOND_ASCII), bare).otherwise(s)


def case_fold(s: Column) -> Column:
    """A text by which texts are compared whatever their case: small letters, and ß as ss, ligatures as their letters."""
    return F.when(s.rlike(_BEYOND_ASCII), F.translate(_spelled(s, _FOLDS), _CAPITAL, _SMALL)).otherwise(F.lower(s))


def trim_spaces(s: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(s, F.lit(WHITE))


def collapse_spaces(s: Column) -> Column:
    return F.regexp_replace(trim_spaces(s), r"(?U)\s+", " ")


def normalize_plate(s: Column) -> Column:
    return F.upper(F.regexp_replace(strip_accents(s), "[^A-Za-z0-9]", ""))


def plate_confusables(s: Column) -> Column:
    """For comparison only: glyphs that are read for one another become one."""
    return F.translate(normalize_plate(s), CONFUSED, FOLDED)


def _label(c: str) -> str:
    return re.sub("[^a-z0-9]", "", _bare(c).lower())


#: Characters up to this code point become one letter, or none, each by itself.
_LATIN = [chr(code) for code in range(0x250) if not chr(code).isascii() or not chr(code).isalnum()]
_LETTERS, _NOTHING = [c for c in _LATIN if _label(c)], [c for c in _LATIN if not _label(c)]


def label_token(s: Column) -> Column:
    """The small letters and digits of a text, without accents."""
    short = F.lower(F.translate(s, "".join(_LETTERS + _NOTHING), "".join(map(_label, _LETTERS))))
    # A text of other characters too, which stay in it, is taken by the rules of all characters.
    return F.when(F.octet_length(short) == F.length(short), short).otherwise(F.regexp_replace(F.lower(strip_accents(s)), "[^a-z0-9]", ""))


def is_ordinal_marker(s: Column) -> Column:
    return label_token(s).isin(*ORDINALS)


def strip_leading_separator(s: Column) -> Column:
    return trim_spaces(F.ltrim(s, F.lit(WHITE + SEPARATORS)))


def decimal_text(s: Column) -> Column:
    """The number a text holds, as written (without a plus or leading zeros), or null. One comma alone is a point."""
    t = F.replace(strip_leading_separator(s), F.lit(" "), F.lit(""))
    t = F.when(t.rlike(r"^[^,.]*,[^,.]*\z"), F.replace(t, F.lit(","), F.lit("."))).otherwise(t)
    plain = F.regexp_replace(F.regexp_replace(t, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    return F.when(s.rlike(r"^(0|[1-9][0-9]*)(\.[0-9]+)?\z"), s).when(t.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?\z"), plain)


def parse_decimal(s: Column) -> Column:
    return decimal_text(s).try_cast("decimal(38,18)")


def int_text(s: Column) -> Column:
    """The whole number a text holds, or null; a decimal is not cut off."""
    t = F.replace(strip_leading_separator(s), F.lit(" "), F.lit(""))
    return F.when(s.rlike(r"^(0|[1-9][0-9]*)\z"), s).when(t.rlike(r"^[+-]?[0-9]+\z"), F.regexp_replace(F.regexp_replace(t, r"^\+", ""), r"^(-?)0+(?=\d)", "$1"))


def parse_int(s: Column) -> Column:
    return int_text(s).try_cast("decimal(38,0)")


def distinct_characters(s: Column) -> Column:
    return F.size(F.array_remove(F.array_distinct(F.split(F.lower(s), "")), ""))


def looks_masked(s: Column, confidence: Column) -> Column:
    """Whether a text is a redaction: a run of mask glyphs, or few different letters and no digit. A confidence of 30 or
    less admits more different letters."""
    packed = F.regexp_replace(s, r"(?U)\s+", "")
    word = F.regexp_replace(s, "[^A-Za-z0-9]", "")
    n, kinds = F.length(word), distinct_characters(word)
    # The most kinds of letters it may have; what cannot be a redaction is not counted at all.
    most = F.when(F.coalesce(confidence <= 30.0, F.lit(False)), F.greatest(F.lit(3), F.floor(n / 2))).when(n >= 6, 3).otherwise(0)
    cut = F.when((n < 4) | (most == 0), False).otherwise(kinds <= most)
    # What has a digit is neither.
    return F.when(s.rlike("[0-9]"), False).otherwise(F.coalesce(packed.rlike(r"^[#*░-▓]{3,}\z") | cut, F.lit(False)))


def number_json(value: Column) -> Column:
    """A number as JSON: whole values without a fraction."""
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("double").cast("string"))


def drive_id(s: Column) -> Column:
    """The file id in a link or on its own, or null."""
    t = F.regexp_replace(trim_spaces(s), "^[\"']+|[\"']+\\z", "")
    linked = F.coalesce(*(F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (r"/d/([A-Za-z0-9_-]{10,})", r"[?&]id=([A-Za-z0-9_-]{10,})")))
    return F.coalesce(linked, F.when(t.rlike(r"^[A-Za-z0-9_-]{10,}\z"), t))


def file_stem(s: Column) -> Column:
    """A path without the extension of its last part; leading dots of that part begin none."""
    return F.regexp_replace(s, r"([^/.][^/]*)\.[^/.]*\z", "$1")


def redact(entries: Column, names: list[str]) -> Column:
    """A map with the values of the given keys, in either case, hidden."""
    return F.transform_values(entries, lambda k, v: F.when(F.lower(k).isin(*names), F.lit("[REDACTED]")).otherwise(v))


def missing_codes(wanted: Column, available: Column) -> Column:
    """Of codes joined by plus signs, those that are not available, in order."""
    return F.filter(F.split(wanted, "[+]"), lambda c: ~F.array_contains(available, c))


def same_members(a: Column, b: Column) -> Column:
    """Whether two arrays have the same members, however often."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
