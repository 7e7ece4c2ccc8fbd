"""One consistent form for text that looks the same.

Compatibility normalisation in composed form, full case folding, mapped
spaces, removal of default-ignorable characters, and look-alike letters put
back into the script of their word; computed once per distinct value of a
batch. The same pass names what it found (:data:`KINDS`).
"""

from __future__ import annotations

import functools
import re
import unicodedata as ud

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("compatibility", "decomposed", "invisible", "space", "look_alike")

# Code points of the property Default_Ignorable_Code_Point (Unicode), as ranges.
IGNORABLE = "\u00ad\u034f\u061c\u115f-\u1160\u17b4-\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
# Letters of one script and the Latin letters they look like.
CYRILLIC, CYRILLIC_AS = "асеорхуіјѕһԁԛԝАВСЕНІЈКМОРЅТХУ", "aceopxyijshdqwABCEHIJKMOPSTXY"
GREEK, GREEK_AS = "αοιυνρκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aoiuvpkABEZHIKMNOPTYX"
LATIN_ODD, LATIN_ODD_AS = "ıɡɑ", "iga"
# Cyrillic letters that Latin or Greek letters look like.
AS_CYRILLIC = {**dict(zip("aceopxyijsABCEHIJKMOPSTXY", "асеорхуіјѕАВСЕНІЈКМОРЅТХУ")), **dict(zip("αοιυρκΑΒΕΗΙΚΜΟΡΤΥΧ", "аоіуркАВЕНІКМОРТУХ"))}
AS_LATIN = {**dict(zip(CYRILLIC, CYRILLIC_AS)), **dict(zip(GREEK, GREEK_AS)), **dict(zip(LATIN_ODD, LATIN_ODD_AS))}
_MARKS = "\u0300-\u036f"
_LATIN = "A-Za-zªºÀ-ÖØ-öø-ʸḀ-ỿ"
_GREEK = "Ͱ-ͳͶ-ͷͻ-ͽͿ-Ͽἀ-\u1fff"
_CYRILLIC = "Ѐ-ԯ"
_TURKISH = re.compile("[ğşĞŞİ]")
_SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: Superscripts and fractions in everyday use, ordinal signs, and other signs that stand for themselves.
_PLAIN = "ªº¹²³¼½¾"


def _ranges(chars: list[int]) -> str:
    out, start, last = [], None, None
    for c in [*chars, None]:
        if start is not None and c != last + 1 if c is not None else start is not None:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(last))}")
            start = None
        if c is not None and start is None:
            start = c
        last = c
    return "".join(out)


@functools.cache
def _patterns() -> dict[str, re.Pattern]:
    """The patterns; built once a process from the Unicode data."""
    compat = []
    for c in (*range(0x80, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)):
        ch = chr(c)
        if ud.category(ch)[0] in "LN" and ch not in _PLAIN and ud.normalize("NFKC", ch) != ch and not re.match(f"[{IGNORABLE}]", ch):
            compat.append(c)
    compat_class = _ranges(compat)
    mixed = f"[{_LATIN}][{_MARKS}]*[{_GREEK}{_CYRILLIC}]|[{_GREEK}][{_MARKS}]*[{_LATIN}{_CYRILLIC}]|[{_CYRILLIC}][{_MARKS}]*[{_LATIN}{_GREEK}]"
    # marks of other scripts, and the vowels and finals of Hangul that join the letter before
    more = "\u0483-\u0487\u0591-\u05bd\u064b-\u065f\u0900-ः\u093c\u1161-\u1175\u11a8-\u11c2\u3099\u309a"
    return {
        # characters above the basic plane are a test of their own: they would slow down every set they are in
        "any": re.compile(f"[{_ranges([c for c in compat if c < 0x10000])}{_MARKS}{more}{IGNORABLE.split(chr(0x1BCA0))[0]}{_SPACES}ıɡɑ]"),
        "above": re.compile("[\U00010000-\U0010ffff]"),
        "latin": re.compile(f"[{_LATIN}]"),
        "other": re.compile(f"[{_GREEK}{_CYRILLIC}]"),
        "greek": re.compile(f"[{_GREEK}]"),
        "compatibility": re.compile(f"[{compat_class}]"),
        "marks": re.compile(f"[{_MARKS}{more}]"),
        "ignorable": re.compile(f"[{IGNORABLE}]"),
        "space": re.compile(f"[{_SPACES}]"),
        "mixed": re.compile(mixed),
        "word": re.compile(f"[{_LATIN}{_GREEK}{_CYRILLIC}](?:[{_LATIN}{_GREEK}{_CYRILLIC}{_MARKS}])*"),
    }


def _mixed(text: str) -> bool:
    """Whether letters of two scripts stand side by side. Marks between them are found elsewhere."""
    p = _patterns()
    if p["greek"].search(text) and p["mixed"].search(text):
        return True
    latin, mixed = p["latin"].search, p["mixed"].search
    for word in text.split():
        if not word.isascii() and latin(word) and mixed(word):
            return True
    return False


def _joins(ch: str) -> bool:
    """Whether the character is part of an emoji sequence."""
    return ud.category(ch) in ("So", "Sk", "Sm") or ch in "\u200d\ufe0f\u20e3" or ch in "0123456789#*" or 0x1F000 <= ord(ch) < 0x20000


def _needs_joiner(ch: str) -> bool:
    """Whether the letter is of a script whose words are written with joiners."""
    return 0x0600 <= ord(ch) < 0x0E00 or 0x1000 <= ord(ch) < 0x1100 or 0x1780 <= ord(ch) < 0x18B0 or 0xFB50 <= ord(ch) < 0xFF00


def _invisible(text: str) -> bool:
    """Whether a default-ignorable character stands in the text outside emoji sequences and words that need it."""
    for m in _patterns()["ignorable"].finditer(text):
        ch, before, after = m[0], text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if ch == "\ufe0f" and before and _joins(before):
            continue
        if ch == "\ufe0e" and before and _joins(before):
            continue
        if ch == "\u200d" and before and after and ord(before) > 0x7F and ord(after) > 0x7F and _joins(before) and _joins(after):
            continue
        if ch in "\u200c\u200d" and before and after and _needs_joiner(before) and _needs_joiner(after):
            continue
        if 0xE0020 <= ord(ch) <= 0xE007F and before and (_joins(before) or 0xE0020 <= ord(before) <= 0xE007F):
            continue
        return True
    return False


def _script(ch: str) -> str:
    c = ord(ch)
    if 0x0400 <= c <= 0x052F:
        return "c"
    if 0x0370 <= c <= 0x03FF or 0x1F00 <= c <= 0x1FFF:
        return "g"
    return "l"


def _word_home(letters: str) -> str:
    """The script a word belongs to: that of the letters which don't look like another script's, else of most letters."""
    own = {"l": 0, "c": 0, "g": 0}
    for ch in letters:
        s = _script(ch)
        sure = s == "c" and ch not in AS_LATIN or s == "l" and ch not in AS_CYRILLIC or s == "g" and ch not in AS_LATIN and ch not in AS_CYRILLIC
        own[s] += 1000 if sure else 1
    return max(own, key=lambda s: (own[s], s == "l", s == "c"))


def _settle(text: str, turkish: bool) -> tuple[str, bool]:
    """The text with look-alike letters put into the script of their word, and whether there were any."""
    found = False

    def word(m: re.Match) -> str:
        nonlocal found
        w = m[0]
        scripts = {_script(ch) for ch in w if not "\u0300" <= ch <= "\u036f"}
        odd = not turkish and any(ch in LATIN_ODD for ch in w)
        if len(scripts) == 1 and not odd:
            return w
        home = _word_home([ch for ch in w if not "\u0300" <= ch <= "\u036f"])
        if home == "c":
            out = "".join(AS_CYRILLIC.get(ch, ch) if _script(ch) != "c" else ch for ch in w)
        elif home == "l":
            out = "".join(AS_LATIN.get(ch, ch) if _script(ch) != "l" or ch in LATIN_ODD and not turkish else ch for ch in w)
        else:
            out = w
        found |= out != w
        return out

    return _patterns()["word"].sub(word, text), found


def analyse(text: str) -> tuple[str, tuple[str, ...]]:
    """The canonical form of a text and the kinds of odd characters in it."""
    if text.isascii():
        return text.lower(), ()
    p = _patterns()
    if not p["any"].search(text) and not p["above"].search(text) and not (p["other"].search(text) and _mixed(text)):
        out = text.casefold()
        return (out if ud.is_normalized("NFKC", out) else ud.normalize("NFKC", ud.normalize("NFKC", text).casefold())), ()
    kinds = []
    if p["compatibility"].search(text):
        kinds.append("compatibility")
    if p["marks"].search(text) and not ud.is_normalized("NFC", text):
        kinds.append("decomposed")
    if _invisible(text):
        kinds.append("invisible")
    if p["space"].search(text):
        kinds.append("space")
    plain = ud.normalize("NFKC", p["space"].sub(" ", p["ignorable"].sub("", text)))
    plain, found = _settle(plain, bool(_TURKISH.search(plain)))
    if found:
        kinds.append("look_alike")
    return ud.normalize("NFKC", plain.casefold()), tuple(kinds)


def canonical_form(text: str) -> str:
    return analyse(text)[0]


RESULT = T.StructType([T.StructField("form", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


def canonical(text: Column) -> Column:
    """``form`` (the canonical form) and ``kinds`` (what odd characters were in the text) of a string column.

    Null gives null; the empty text is its own form; lone surrogates can't
    occur in Spark strings. Equal texts of a batch are computed once.
    """

    @F.pandas_udf(RESULT)
    def of(s: pd.Series) -> pd.DataFrame:
        codes, values = pd.factorize(s, use_na_sentinel=True)
        forms, kinds = zip(*[analyse(v) for v in values]) if len(values) else ((), ())
        forms, kinds = [*forms, None], [*map(list, kinds), None]
        return pd.DataFrame({"form": [forms[c] for c in codes], "kinds": [kinds[c] for c in codes]})

    return of(text)


def odd_records(df: DataFrame, table: str, key: str, text: str) -> DataFrame:
    """``table_name``, ``record_key``, ``form`` and ``kinds`` of the records whose text holds odd characters.

    Texts of ASCII alone are in canonical form but for case and aren't sent
    to Python. Null texts and null keys with odd texts: the former are no
    records of the result, the latter have a null key.
    """
    own = df.select(F.col(key).cast("string").alias("record_key"), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]"))
    own = own.withColumn("c", canonical(F.col("text"))).where(F.size("c.kinds") > 0)
    return own.select(F.lit(table).alias("table_name"), "record_key", F.col("c.form").alias("form"), F.col("c.kinds").alias("kinds"))
