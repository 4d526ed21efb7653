"""One consistent form for texts that look the same but differ in their characters.

`visible_form` keeps every difference a reader can see (letters, case, diacritics, length marks, raised digits) and drops
the rest. It is compatibility normalisation in composed form, restricted to compatibility mappings that keep the glyph
(width, radicals, ligatures, no-break forms): the mappings of raised, lowered, circled and font variants change what is
seen. `search_form` is the full form (NFKC, full case folding) for comparisons where such differences do not count.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafmill.runtime import materialize

# fixed values: letters of other scripts drawn like a Latin (or IPA) letter, and signs drawn alike
_CYRILLIC = dict(zip("аеорсухѕіјһәԁԛԝѡӏАВЕКМНОРСТУХЅІЈԌԚԜҮѵѴ", "aeopcyxsijhədqwwlABEKMHOPCTYXSIJGQWYvV"))
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαεγνριϳϲϹͿ", "ABEZHIKMNOPTYXoɑɛɣvpɩjcCJ"))
_LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
_CHEROKEE = dict(zip("ᎪᎬᎳᎻᏞᏟᏢᏚᎢᏃᏦᎷᏴᎠᏀᎫᏙᏒ", "AEWHLCPSTZKMBDGJVR"))
_LATIN = {"ɡ": "g", "ǝ": "ə", "ı̇": "i", "ƨ": "ƨ"}
_ARMENIAN = {"օ": "o", "ս": "u", "ց": "g", "հ": "h", "ո": "n", "ք": "p"}
_SIGNS = {"⍺": "ɑ", "‐": "-", "‑": "-", "−": "-", "⁃": "-", "꞉": ":", "∶": ":", "׃": ":", "ꞌ": "'", "‚": ",", "⁄": "/", "∕": "/", "․": ".", "ǃ": "!", "∗": "*", "∣": "|", "ǀ": "|", "﹘": "-"}
LOOKALIKES = {k: v for part in (_CYRILLIC, _GREEK, _LATIN, _ARMENIAN, _LISU, _CHEROKEE, _SIGNS) for k, v in part.items() if len(k) == 1 and k != v}

# fixed values: compatibility mappings that keep what is seen
_KEEPS_GLYPH = ("<wide>", "<narrow>", "<noBreak>", "<compat>")
# fixed values: compat mappings that do change it (spacing accents, dots, double signs kept as they are drawn)
_DRAWN = set("…‥″‴⁗‶‷¨¯´¸˘˙˚˛˜˝")
# fixed values: default-ignorable code points outside the category Cf
_IGNORABLE = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF)]
# fixed values: category Cf that is drawn (signs around numbers, interlinear marks)
_CF_DRAWN = [(0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD)]


def _within(c: int, spans: list[tuple[int, int]]) -> bool:
    return any(a <= c <= b for a, b in spans)


def ignorable(ch: str) -> bool:
    c = ord(ch)
    return _within(c, _IGNORABLE) or (unicodedata.category(ch) == "Cf" and not _within(c, _CF_DRAWN))


def _seen(ch: str) -> str:
    if ignorable(ch):
        return ""
    if unicodedata.category(ch) == "Zs" or ch == "\t":
        return " "
    kind = unicodedata.decomposition(ch).split(" ")[0]
    if ch not in _DRAWN and ch not in LOOKALIKES and kind in _KEEPS_GLYPH:
        out = unicodedata.normalize("NFKC", ch)
        return "".join(LOOKALIKES.get(x, x) for x in out)
    return LOOKALIKES.get(ch, ch)


@lru_cache(1)
def visible_map() -> dict[int, str]:
    """str.translate table over all of Unicode, built once a worker from the rules above."""
    table = {}
    # outside these blocks stand ideographs, Hangul syllables, surrogates, private use and unassigned code points
    blocks = [range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xD7B0, 0xD800), range(0xF900, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE1000)]
    for c in chain.from_iterable(blocks):
        ch = chr(c)
        to = _seen(ch)
        if to != ch:
            table[c] = to
    return table | {9: " ", 11: "\n", 12: "\n", 0x85: "\n", 0x2028: "\n", 0x2029: "\n"}


def visible(text: str) -> str:
    """Texts with equal `visible` look the same: composed form, plain widths, one kind of blank, nothing invisible.

    Line ends become `\\n`; how many blanks stand together, and case, diacritics and raised forms stay.
    """
    if text.isascii():
        return text.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ").replace("\x0b", "\n").replace("\x0c", "\n")
    text = unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n"))
    # marks go over look-alikes too: decompose, map the base letters, compose again
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(visible_map()))


def search(text: str) -> str:
    """For comparisons without regard to case and form: `visible`, then NFKC and full case folding, closed under both."""
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", visible(text)).casefold())


def _each_distinct(f):
    """`f` once for each distinct value of a batch."""

    def run(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s)  # null: code -1
        out = pd.Series([f(v) for v in values] + [None], dtype=object)
        return out.iloc[codes].reset_index(drop=True)

    return run


@F.pandas_udf(StringType())
def visible_form(s: pd.Series) -> pd.Series:
    return _each_distinct(visible)(s)


@F.pandas_udf(StringType())
def search_form(s: pd.Series) -> pd.Series:
    return _each_distinct(search)(s)


def form_key(text: Column) -> Column:
    """128 bits of a text's form, to group by without moving the text."""
    return F.struct(F.xxhash64(text).alias("h1"), F.hash(text, F.lit(7)).alias("h2"), F.length(text).alias("n"))


def forms(df: DataFrame, row_id: str, text: str, form=visible_form) -> DataFrame:
    """(__id, spelling, form) of the rows whose text and id are not null, materialised: keys of the text and of its form.

    Each distinct text is brought to its form once: copies are put together by their key before, in each map task first.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(row_id).isNotNull()).select(F.col(row_id).alias("__id"), form_key(F.col(text)).alias("spelling"), F.col(text).alias("__text"))
    once = rows.groupBy("spelling").agg(F.min("__text").alias("__text")).select("spelling", form("__text").alias("__form"))
    once = once.select("spelling", form_key(F.col("__form")).alias("form"))
    return materialize(rows.select("__id", "spelling").join(once, "spelling").select("__id", "spelling", "form"), "forms")


def same_look_pairs(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts look the same but are not the same code points.

    Null and empty texts look like nothing and give no pair, nor do rows without an id. Exact copies are no pair of each other, but each of them
    is of every other variant. The groups are those of `variant_classes`; only classes with two spellings or more are
    expanded, over the distinct spellings first, so exact copies never meet each other.
    """
    rows = forms(df.where(F.length(text) > 0), row_id, text)
    spelled = rows.select("form", "spelling").distinct()
    several = spelled.groupBy("form").agg(F.count("*").alias("k")).where("k > 1").select("form")
    members = materialize(rows.join(several, "form", "left_semi").select("form", "spelling", "__id"), "members")
    a = members.select("form", F.col("spelling").alias("sa")).distinct()
    # every ordered pair of different spellings of one form, then their rows
    kinds = a.join(a.select("form", F.col("sa").alias("sb")), "form").where("sa < sb")
    left = members.select("form", F.col("spelling").alias("sa"), F.col("__id").alias("ia"))
    right = members.select("form", F.col("spelling").alias("sb"), F.col("__id").alias("ib"))
    return kinds.join(left, ["form", "sa"]).join(right, ["form", "sb"]).select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))


def variant_classes(df: DataFrame, row_id: str, text: str, form=visible_form) -> DataFrame:
    """(row_id, class_id, spellings): each row's class of texts of one form, named by its smallest row id.

    form: `visible_form` (what looks the same) or `search_form` (what is the same but for case and form). Rows with a null text
    or id are left out; empty texts form one class.
    """
    rows = forms(df, row_id, text, form)
    spelled = rows.groupBy("form", "spelling").agg(F.min("__id").alias("low"))
    classes = spelled.groupBy("form").agg(F.min("low").alias("class_id"), F.count("*").alias("spellings"))
    return rows.join(classes, "form").select(F.col("__id").alias(row_id), "class_id", "spellings")
