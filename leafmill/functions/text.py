"""Small text columns used everywhere."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: fixed value: every character Python's str.isspace() takes, as a Java character class
_BLANKS = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLANK = "[" + "".join(f"\\u{c:04x}" for c in _BLANKS) + "]"


def strip_blanks(c: Column) -> Column:
    """Without outer blanks of any kind (Spark's trim takes U+0020 only)."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def _udf(name: str):
    """Normalisation form of a whole batch; texts that are ASCII pass untouched."""
    @F.pandas_udf(StringType())
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(name, t))

    return form


def nfc(c: Column) -> Column:
    """Canonical composition; Spark has no built-in for it. Null stays null."""
    return _udf("NFC")(c)


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def normal_lines(c: Column) -> Column:
    """Unix line ends, no trailing blanks, runs of blank lines as one, none at the ends, footers `· n ·` bare."""
    c = F.regexp_replace(unix_lines(c), f"(?m){BLANK.replace(chr(92) + 'u000a', '')}+$", "")
    c = F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), "^\n+|\n+$", "")
    return F.regexp_replace(c, "(?mU)^[ \t]+([·.]\\s*\\d+\\s*[·.])$", "$1")


def plain_text(c: Column) -> Column:
    """Without heading and list marks, trimmed."""
    c = F.regexp_replace(unix_lines(c), "(?m)^\\s{0,3}#{1,6}\\s+", "")
    return strip_blanks(F.regexp_replace(c, "(?m)^\\s*[-*+]\\s+", ""))


def compact(c: Column) -> Column:
    """All blanks dropped."""
    return F.regexp_replace(c, BLANK, "")


def canonical(c: Column) -> Column:
    """Composed form without blanks: equal canonical texts lost and won no character."""
    return compact(nfc(c))


def visible_length(c: Column) -> Column:
    return F.length(compact(c)).cast("long")


def anchor_form(c: Column, composed: bool = False) -> Column:
    """Composed form with single blanks, to count one text over many pages."""
    return strip_blanks(F.regexp_replace(c if composed else nfc(c), f"{BLANK}+", " "))


# fixed values: what a line is that is nothing but a page number
PAGE_LIKE = r"(?iU)^[ \t]*(?:[·.]\s*\d{1,4}\s*[·.]|[-–—]\s*\d{1,4}\s*[-–—]|\d{1,4}|PAGE\s*\d{1,4}|第\s*\d{1,4}\s*页|页\s*\d{1,4})[ \t]*$"
# fixed values: tokens that hint at a broken text layer; control characters that do
_SUSPICIOUS = r"(?<!\w)(?:[A-Z]{2,}[a-z]|[A-Za-z]*\d+[A-Za-z]+|[A-Za-z]+\?[A-Za-z]*)(?!\w)"
_CONTROL = "[\\u0000-\\u0008\\u000b\\u000c\\u000e-\\u001f]"
# fixed values: script ranges
IPA = "[\\u0250-\\u02ff\\u0300-\\u036f\\u1d00-\\u1dbf]"
HAN = "[\\u3400-\\u9fff]"
SYMBOL = "[\\u2190-\\u22ff\\u25a0-\\u25ff]"


def is_page_like(c: Column) -> Column:
    return F.coalesce(strip_blanks(c).rlike(PAGE_LIKE), F.lit(False))


def garble_ratio(c: Column) -> Column:
    """Share of suspicious characters, 1 at most; a character may count twice. Empty and null texts: 0."""
    bad = F.regexp_count(c, F.lit("[?\\ufffd]")) + F.regexp_count(c, F.lit(_CONTROL)) + F.regexp_count(c, F.lit(r"[\p{Co}\p{Cs}\p{Cn}]"))
    tokens = F.length(F.array_join(F.regexp_extract_all(c, F.lit("(?U)" + _SUSPICIOUS), F.lit(0)), ""))
    n = visible_length(c)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(F.least(F.lit(1.0), (bad + tokens) / n))


def corruption(c: Column) -> dict[str, Column]:
    """Counts of what a damaged text shows."""
    inside = F.array_join(F.regexp_extract_all(c, F.lit(r"【[^】]*】|\[[^\]]*\]"), F.lit(0)), "")
    return {
        "replacement_count": F.regexp_count(c, F.lit("\\ufffd")).cast("long"),
        "question_mark_count": F.regexp_count(c, F.lit(r"\?")).cast("long"),
        "han_in_transcription": F.regexp_count(inside, F.lit(HAN)).cast("long"),
        "control_count": F.regexp_count(c, F.lit(_CONTROL)).cast("long"),
    }


def ipa_signature(c: Column) -> Column:
    """The IPA characters of a text, sorted: equal signatures hold the same ones."""
    return F.array_sort(F.regexp_extract_all(c, F.lit(IPA), F.lit(0)))


# fixed values: device names that may be no file name
_RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10))]


def safe_stem(c: Column) -> Column:
    """A file's stem that is a legal folder name everywhere; `book` where nothing is left."""
    name = F.regexp_replace(c, "(?s)^.*/", "")
    stem = F.when(name.rlike(r"(?s)^.+\."), F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", "")).otherwise(name)
    stem = F.regexp_replace(strip_blanks(F.regexp_replace(stem, r'[<>:"/\\|?*\x00-\x1f]', "_")), r"\.+$", "")
    stem = F.when(F.upper(stem).isin(_RESERVED), F.concat(stem, F.lit("_book"))).otherwise(stem)
    return F.when(F.coalesce(stem, F.lit("")) == "", "book").otherwise(stem)


def page_spec(c: Column) -> Column:
    """`0-2,7` as [0, 1, 2, 7]: sorted distinct pages; a reversed range is an error."""
    def one(p: Column) -> Column:
        low, high = (F.try_element_at(F.split(p, "-"), F.lit(k)).try_cast("int") for k in (1, -1))
        bad = F.raise_error(F.concat(F.lit("reversed page range: "), p)).cast("array<int>")
        return F.when(low > high, bad).otherwise(F.sequence(low, high))

    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, one))))


def clamp_page(page: Column, n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(page, n))


def masked_key(c: Column) -> Column:
    """What may be shown of a secret: `sk-****` and its length."""
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.concat(F.lit("sk-**** ("), F.length(c), F.lit(")")))


def first_count(*counts: Column) -> Column:
    """The first count that is neither null nor 0, else 0."""
    return F.coalesce(*(F.nullif(c, F.lit(0)) for c in counts), F.lit(0))


def cjk_punctuation(c: Column) -> Column:
    """Full-width punctuation next to an ideograph; the replacements are no ideographs, so the order is free."""
    for mark, wide in zip(",.;:()", "，。；：（）"):
        c = F.regexp_replace(c, f"(?<={HAN})\\{mark}|\\{mark}(?={HAN})", wide)
    return c


def sizes(before: Column, after: Column) -> dict[str, Column]:
    """Characters of a text before and after cleaning."""
    return {"chars_in": F.length(before).cast("long"), "chars_out": F.length(after).cast("long")}


def protected_tokens(c: Column) -> Column:
    """struct(code_math, footers): code, then formulas, each in order of place, and the footer lines without outer blanks."""
    from leafmill.functions.pages import CODE, FOOTER, FORMULA

    every = lambda p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    return F.struct(F.concat(every(CODE), every(FORMULA)).alias("code_math"), F.transform(every("(?U)" + FOOTER), strip_blanks).alias("footers"))


def keeps_invariants(before: Column, after: Column) -> Column:
    """Whether a rewritten text has the protected tokens and the phonetic signs of the text before it."""
    return protected_tokens(before).eqNullSafe(protected_tokens(after)) & ipa_signature(before).eqNullSafe(ipa_signature(after))
