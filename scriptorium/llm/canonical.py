"""One consistent form for visually identical text (problem 5).

Quick-check properties decide first: a text of tabs, line feeds and printable ASCII is canonical and never leaves the
JVM. In other texts only unstable segments are touched: a character of an unstable class together with the combining
marks around it, or a run of letters that mixes Latin with look-alikes of another alphabet. Each segment is normalised
with its boundary context (the base letter before a mark) and spliced back; stable text is copied as it is.

Null stays null, an empty text stays empty; the form is a fixed point. Text wholly in another script, superscripts,
dashes, quotation marks and other symbols stay as they are.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters of other alphabets that look like a Latin letter.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p",
    "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϳ": "j", "ϲ": "c",
    "Ս": "U", "Տ": "S", "Օ": "O", "Լ": "L", "հ": "h", "ո": "n", "ս": "u", "օ": "o", "ց": "g", "զ": "q",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R",
    "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y",
    "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
_LOOKS = frozenset(LOOK_ALIKES)
#: Hyphens with a plain form.
HYPHENS = {"‐": "-", "‑": "-", "﹣": "-", "－": "-"}
#: Invisible characters outside the format category.
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x180E), *range(0xFE00, 0xFE10)]
#: JVM quick check: texts without such a character are canonical.
MAY_BE_UNSTABLE = r"[^\x09\x0A\x20-\x7E]"


@lru_cache(maxsize=1)
def _single() -> dict[int, str]:
    """Unstable single characters and their canonical strings, derived from Unicode properties."""
    table: dict[int, str] = {}
    for code in range(sys.maxunicode + 1):
        if code < 0x80 and code not in (0x7F,) and code >= 0x20 or 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        category = unicodedata.category(char)
        if category == "Cn":
            continue
        if category == "Zs":
            table[code] = " "
        elif category in ("Zl", "Zp") or code in (0x0D, 0x85):
            table[code] = "\n"
        elif category == "Cc" and code not in (0x09, 0x0A):
            table[code] = " " if code in (0x0B, 0x0C) else ""
        elif category == "Cf":
            table[code] = ""
        else:
            kind = unicodedata.decomposition(char)
            if kind.startswith(("<font>", "<wide>", "<narrow>")) or (kind and 0xFB00 <= code <= 0xFB4F):
                table[code] = unicodedata.normalize("NFKC", char)
            elif not unicodedata.is_normalized("NFC", char):
                table[code] = unicodedata.normalize("NFC", char)
    for code in INVISIBLE:
        table[code] = ""
    table.update({ord(k): v for k, v in HYPHENS.items()})
    table.pop(0x20, None)
    return table


@lru_cache(maxsize=1)
def _singles() -> frozenset[str]:
    """The unstable single characters; a text without them needs no search for segments."""
    return frozenset(map(chr, _single()))


@lru_cache(maxsize=1)
def _joining() -> set[int]:
    """Characters that may change with what stands before them: reordered marks and second parts of compositions.

    The quick check answers "maybe" for them: a segment of them has the character before it as its boundary context.
    """
    found = {c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))}
    for code in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", chr(code)) == chr(code):
            found.add(int(parts[1], 16))
    # Medial and final letters of Hangul syllables, which compose by rule and not by table.
    return found | set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))


@lru_cache(maxsize=1)
def _patterns():
    import regex

    singles = "".join(regex.escape(chr(c)) for c in sorted(_single()))
    look = "".join(LOOK_ALIKES)
    joins = "".join(regex.escape(chr(c)) for c in sorted(_joining()))
    return (
        regex.compile(r"\r\n|[" + singles + "]+"),
        regex.compile(rf"[^{joins}]?[{joins}]+"),
        regex.compile(rf"(?=\p{{L}}*[{look}])(?=\p{{L}}*\p{{Latin}})(?<!\p{{L}})\p{{L}}+"),
    )


def canonical(text: str | None) -> str | None:
    """The consistent form of one text."""
    if not text or text.isascii() and text.isprintable():
        return text
    unstable, composed, letters = _patterns()
    out, singles = text, _singles()
    if not singles.isdisjoint(text):
        table = _single()
        out = unstable.sub(lambda m: "\n" if m[0] == "\r\n" else m[0].translate(table), text)
    if not out.isascii():
        if not unicodedata.is_normalized("NFC", out):
            out = composed.sub(lambda m: unicodedata.normalize("NFC", m[0]), out)
        if not _LOOKS.isdisjoint(out):
            out = letters.sub(lambda m: "".join(LOOK_ALIKES.get(c, c) for c in m[0]), out)
    return out


def _canonical_series(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def _canonical_udf(text: Column) -> Column:
    return F.pandas_udf(_canonical_series, StringType())(text)


def canonical_column(text: Column) -> Column:
    """The consistent form of a string column; plain ASCII never passes through Python."""
    return F.when(text.rlike(MAY_BE_UNSTABLE), _canonical_udf(text)).otherwise(text)


def canonicalise(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """`df` with the consistent form of column `text` as column `out` and whether it was altered as `<out>_altered`.

    Rows that pass the quick check are not sent to Python: they take a second branch. Null: null and not altered.
    """
    plain = F.col(text).isNull() | ~F.col(text).rlike(MAY_BE_UNSTABLE)
    stable = df.filter(plain).withColumn(out, F.col(text)).withColumn(f"{out}_altered", F.lit(False))
    rest = df.filter(~plain).withColumn(out, _canonical_udf(F.col(text)))
    return stable.unionByName(rest.withColumn(f"{out}_altered", ~F.col(out).eqNullSafe(F.col(text))))


def altered(df: DataFrame, text: str) -> DataFrame:
    """Rows of `df` whose `text` differs from its consistent form, with that form as `canonical`."""
    rest = df.filter(F.col(text).rlike(MAY_BE_UNSTABLE)).withColumn("canonical", _canonical_udf(F.col(text)))
    return rest.filter(F.col("canonical") != F.col(text))
