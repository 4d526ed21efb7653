"""Noise of scanned pages: running lines, page numbers, words split by line breaks, misread words; and its repair.

Lines come from page texts (one row per page) or from a table of lines; both become one table of *lines* that holds what
later steps need: words, pairs of ideographs (each as one string, which is cheaper to bring from Python than lists), the pieces at a line break, and the text of edge lines only. Words are
counted over all lines of all tables given together. The anagram hash of a word is the sum of its characters' hashes; two
words that differ by one or two neighbouring characters read as another, or as two, have equal hashes once those are taken
away. So the differences of the whole alphabet are one equi-join of rare words with frequent ones, and which of them are
confusions of this scan is learned from the corpus: how many long words each explains. Ideographs are learned from the
company they keep: a misread one is rare and stands only where one other, frequent one stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.lookalike import visible
from leafmill.runtime import materialize

# fixed values: letters, digits and signs of like shapes; either side may be read for the other
LOOKS = [
    ("a", "o"), ("b", "h"), ("c", "e"), ("c", "o"), ("cl", "d"), ("d", "cl"), ("e", "o"), ("f", "t"), ("g", "q"), ("h", "li"), ("i", "j"), ("i", "l"), ("i", "t"), ("ii", "n"),
    ("ii", "u"), ("in", "m"), ("l", "t"), ("lc", "k"), ("m", "nn"), ("m", "rn"), ("n", "ri"), ("n", "u"), ("ni", "m"), ("u", "v"), ("v", "y"), ("vv", "w"),
    ("0", "o"), ("1", "i"), ("1", "l"), ("1", "t"), ("2", "z"), ("3", "e"), ("4", "a"), ("5", "s"), ("6", "b"), ("7", "t"), ("8", "b"), ("8", "s"), ("9", "g"), ("9", "q"), ("!", "i"), ("!", "l"),
]
#: signs printed for a character that was lost
LOST = "�■□"
#: a variant is frequent if it is seen so many times, and so many times as often as the rare word
LEAST, TIMES = 3, 4
#: letters of words from which confusions are learned: two long words are seldom neighbours by chance
LONG = 6
#: a confusion is learned if it explains so many long words, and so many times as many as the average one
LEARNED, LIFT = 3, 3
#: bits a correction needs, what each word beside it adds if it is known beside the variant, and takes if it is not
ENOUGH, BESIDE, ALONE = 6.5, 3.0, 1.0
#: an ideograph may be a misread one if it is so many times rarer, so much of it is explained, and its company differs so little
RARER, EXPLAINED, APART = 20, 0.75, 0.4
#: by definition a running head is no longer
LONGEST_HEAD = 200
#: pages of a book on which a head must stand to be a running one: written like the catalogue's titles, or in any way but a sentence
HEAD_PAGES, ANY_HEAD_PAGES = 2, 4
#: share of its book's pages that a head written in any way must have
HEAD_SHARE = 0.1
#: share of a page's height, above and below, that is margin
MARGIN = 0.08
#: rows that may be broadcast into joins: words of at most some 60 bytes
BROADCAST_WORDS = 200_000

_HYPHENS = "-‐‑\xad¬"
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!" + LOST)
_GOES_ON = re.compile(rf"\s*([A-Za-z0-9!{LOST}]+)")
_RUNS = re.compile(rf"(?:[\w{LOST}]|!(?=[a-z]))+")
_WORD = re.compile(rf"[A-Za-z0-9!{LOST}]+")
_LIKE_WORD = re.compile("[A-Za-z]{2}|^[a-z][0-9!]$|^[0-9!][a-z]$")
_COMPOUND = re.compile(r"(?<![\w-])[A-Za-z]+-[A-Za-z]+(?![\w-])")
_BRACKETS = re.compile(r"\[[^\[\]\s]*\]|\*\S+")
_HAN = "㐀-鿿"
_HAN_RUN = re.compile(rf"[{_HAN}{LOST}]{{2,}}")
_ANY_LOST = re.compile(f"[{LOST}]")
_FUNCTION_WORDS = frozenset("a an the and or of in on at by to for from with as".split())
_FUNCTION_HAN = re.compile("([的与和及之])")
_SENTENCE = re.compile(r"[。！？；，.!?;,:=<>{}|\\$#*`\[\]]")
_ROMAN = re.compile(r"(?i)^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
_NUMBER_SHELL = re.compile(r"^[\W_]*(?:第|page\b|p\b|pg\b|folio\b|no\b|页)?[\W_]*([0-9A-Za-z〇零一二三四五六七八九十百千]+?)[\W_]*(?:页|頁)?[\W_]*$", re.I)
_HEAD_NUMBER = re.compile(r"^\s*[\W_]*([0-9OlIS]+|[ivxlc]+)[\W_]*\s+(?=\S)|\s[\W_]*([0-9OlIS]+|[ivxlc]+)[\W_]*$", re.I)
_DIGITS = str.maketrans("OolISs", "001155")


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


LINE = (
    "table_name string, rec_id long, line_no int, book_id string, pno int, edge string, text string, words string, terms string, lost boolean, "
    "mark string, a string, b string, next_rec long, next_no int"
)


def number_of(text: str) -> int | None:
    """The number that is all a text says: digits (misread ones too), Roman or Chinese numerals."""
    if re.fullmatch(r"[0-9OolIS]*[0-9][0-9OolIS]*|[lOI]{2,4}", text):
        return int(text.translate(_DIGITS))
    if text and _ROMAN.match(text):
        value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
        n = [value[c] for c in text.lower()]
        return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0]))
    if text and all(c in "〇零一二三四五六七八九十百千" for c in text):
        if not set(text) & set("十百千"):
            return int("".join(str("〇一二三四五六七八九".index(c.replace("零", "〇"))) for c in text))
        total, digit = 0, 0
        for c in text:
            if c in "十百千":
                total += max(digit, 1) * {"十": 10, "百": 100, "千": 1000}[c]
                digit = 0
            else:
                digit = "〇一二三四五六七八九".index(c.replace("零", "〇"))
        return total + digit
    return None


def is_page_number(text: str, page: int) -> bool:
    m = _NUMBER_SHELL.match(text) if len(text) <= LONGEST_HEAD else None
    return bool(m) and page in (number_of(m[1]), number_of(m[1].replace("l", "1").replace("I", "1")))


def title_key(text: str) -> str:
    """A title without page number, ornaments, blanks and case, to compare running lines by."""
    if len(text) > LONGEST_HEAD:
        return ""
    m = _HEAD_NUMBER.search(text)
    text = text[: m.start()] + " " + text[m.end() :] if m else text
    return "".join(c for c in text if c.isalnum() or c in LOST).lower()


def title_shape(text: str) -> str:
    """What kind of title a text is: its function words, X for each other word; '' if it is written like a sentence."""
    if len(text) > LONGEST_HEAD:
        return ""
    m = _HEAD_NUMBER.search(text)
    text = (text[: m.start()] + " " + text[m.end() :] if m else text).strip().strip("·•~—–- ")
    if _SENTENCE.search(text):
        return ""
    if re.search(f"[{_HAN}]", text):
        return "".join(p if _FUNCTION_HAN.fullmatch(p) else "X" for p in _FUNCTION_HAN.split(re.sub(r"\s", "", text)) if p)
    words = text.split()
    if any(w.lower() not in _FUNCTION_WORDS and not (w[0].isupper() or w[0] in LOST or w[0].isdigit()) for w in words):
        return ""
    return " ".join(w.lower() if w.lower() in _FUNCTION_WORDS else "X" for w in words)


def words_of(text: str) -> list[str]:
    """Latin words, lower case, without transcriptions; a word may hold digits and lost signs but is no number."""
    return [w.lower() for w in _RUNS.findall(_BRACKETS.sub(" ", text)) if _WORD.fullmatch(w) and _LIKE_WORD.search(w)]


def terms_of(text: str) -> list[str]:
    """Pairs of neighbouring ideographs, and hyphenated words."""
    out = [r[i : i + 2] for r in _HAN_RUN.findall(text) for i in range(len(r) - 1)]
    return out + [m.lower() for m in _COMPOUND.findall(text)] if "-" in text else out


def whole_words(text: str, mark: str | None, half: str | None) -> list[str]:
    """The words of a line but for the halves of words that go on in the next line or came from the one before."""
    words = words_of(text)
    words = words[1:] if half and words[:1] == [half] else words
    return words[:-1] if mark else words


def break_mark(text: str) -> str | None:
    """The hyphen that ends a line behind a letter."""
    t = text.rstrip()
    return t[-1] if len(t) > 1 and t[-1] in _HYPHENS and t[-2] in _LETTERS else None


def last_piece(text: str) -> str:
    """The letters before the hyphen that ends a line, lower case."""
    t = text.rstrip().rstrip(_HYPHENS)
    i = len(t)
    while i and t[i - 1] in _LETTERS:
        i -= 1
    return t[i:].lower()


def first_piece(text: str) -> str | None:
    """The letters a line goes on with, unless it starts with a capital."""
    m = _GOES_ON.match(text)
    return m[1].lower() if m and not m[1][:1].isupper() else None


def is_lost(text: str, last: bool) -> bool:
    """Whether a character was lost; the last one of a page is not counted, as the page may be cut there."""
    if not _ANY_LOST.search(text):
        return False
    body = text.rstrip(" \t…") if last else text
    return bool(_ANY_LOST.search(body[:-1] if last and body[-1:] in LOST else body))


def _side(k: int, n: int) -> str:
    """t1, t2 for the first two lines of n, b1, b2 for the last two, else ''."""
    return "t1" if k == 0 else "b1" if k == n - 1 else "t2" if k == 1 else "b2" if k == n - 2 else ""


#: rows of Python results yielded at once
_SLICE = 5000


def _page_lines(table: str):
    names = [c.strip().split(" ")[0] for c in LINE.split(", ")]

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"next_rec": "Int64", "next_no": "Int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rec, book, pno, text in zip(batch["rec_id"], batch["book_id"], batch["pno"], batch["text"]):
                raw = text.split("\n")
                # look-alikes are mapped once for the page; where that changes the number of lines, line by line
                whole = visible(text).split("\n")
                seen = [x.strip() for x in (whole if len(whole) == len(raw) else map(visible, raw))]
                full, open_ = [i for i, x in enumerate(seen) if x], False
                for k, i in enumerate(full):
                    s, last = seen[i], k == len(full) - 1
                    edge = _side(k, len(full))
                    mark = break_mark(raw[i])
                    after = i + 1 if mark and not last and full[k + 1] == i + 1 else None
                    goes_on = after is not None
                    row = (table, rec, i + 1, book, pno, edge, s if edge else None, " ".join(whole_words(s, mark, open_ and first_piece(s))), " ".join(terms_of(s)), is_lost(s, last))
                    open_ = goes_on
                    rows.append((*row, mark, last_piece(s) if goes_on else None, first_piece(seen[after]) if goes_on else None, rec if goes_on else None, after + 1 if goes_on else None))
                if len(rows) >= _SLICE:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    return run


def lines_of_pages(df: DataFrame, table: str, rec: str, text: str) -> DataFrame:
    """Lines of page texts. df: rec, text, book_id, pno. Null and blank texts and rows without an id have none; blank lines are counted, not kept."""
    few = df.where(F.col(text).isNotNull() & F.col(rec).isNotNull()).select(F.col(rec).alias("rec_id"), "book_id", F.coalesce("pno", F.lit(-1)).alias("pno"), F.col(text).alias("text"))
    return few.mapInPandas(_page_lines(table), LINE)


def lines_of_table(df: DataFrame, table: str, rec: str, text: str, page: list[str], order: list[str], top: str = "y0", height: float = 1000.0) -> DataFrame:
    """Lines of a table that has one row each, ordered within their page by `order`; line_no is 0.

    Only what begins in the upper or lower margin can be a running line or a page number; a title that opens the body is
    a heading. Where a line has no place, it must be the first or last of its page.
    """

    @F.pandas_udf("text string, words string, rest string, terms string, lost boolean, lost_last boolean, mark string, a string, head string")
    def seen(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            t, mark = visible(x).strip(), break_mark(x)
            head = first_piece(t)
            words = whole_words(t, mark, None)
            rest = words[1:] if head and words[:1] == [head] else words
            rows.append((t, " ".join(words), " ".join(rest), " ".join(terms_of(t)), is_lost(t, False), is_lost(t, True), mark, last_piece(t) if mark else None, head))
        return pd.DataFrame(rows, columns=["text", "words", "rest", "terms", "lost", "lost_last", "mark", "a", "head"])

    w = Window.partitionBy(*page).orderBy(*order, rec)
    rows = df.where(F.col(text).isNotNull() & F.col(rec).isNotNull()).select(*dict.fromkeys([rec, *page, *order, "book_id", "pno", top]), seen(F.col(text)).alias("s")).where("s.text != ''")
    before, after = F.lag(rec).over(w).isNull(), F.lead(rec).over(w).isNull()
    edge = F.when(F.col(top) < MARGIN * height, "t1").when(F.col(top) > (1 - MARGIN) * height, "b1").when(F.col(top).isNull() & before, "t1").when(F.col(top).isNull() & after, "b1").otherwise("")
    goes_on = F.col("s.mark").isNotNull() & ~after
    rows = rows.select(
        F.lit(table).alias("table_name"), F.col(rec).alias("rec_id"), F.lit(0).alias("line_no"), "book_id", F.coalesce("pno", F.lit(-1)).alias("pno"), edge.alias("edge"), F.col("s.text").alias("text"),
        F.when(F.lag("s.mark").over(w).isNotNull(), F.col("s.rest")).otherwise(F.col("s.words")).alias("words"), F.col("s.terms").alias("terms"), F.when(after, F.col("s.lost_last")).otherwise(F.col("s.lost")).alias("lost"),
        F.col("s.mark").alias("mark"), F.when(goes_on, F.col("s.a")).alias("a"), F.when(goes_on, F.lead("s.head").over(w)).alias("b"), F.when(goes_on, F.lead(rec).over(w)).alias("next_rec"), F.when(goes_on, F.lit(0)).alias("next_no"),
    )
    return rows.withColumn("text", F.when(F.col("edge") != "", F.col("text")))


@F.pandas_udf(T.StructType([T.StructField("key", T.StringType()), T.StructField("shape", T.StringType()), T.StructField("loose", T.BooleanType()), T.StructField("paged", T.BooleanType()), T.StructField("numbered", T.BooleanType())]))
def _title(s: pd.Series, page: pd.Series) -> pd.DataFrame:
    rows = []
    for t, p in zip(s, page):
        t = visible(t).strip() if t else ""
        m = _HEAD_NUMBER.search(t) if len(t) <= LONGEST_HEAD else None
        rows.append((title_key(t), title_shape(t), title_shape(re.sub("[,:，：、]", "", t)) != "", bool(m) and is_page_number(m[1] or m[2], int(p)), is_page_number(t, int(p))))
    return pd.DataFrame(rows, columns=["key", "shape", "loose", "paged", "numbered"])


def _halves(reach: int) -> Column:
    """The first and the last half of a key; with `reach`, cut as those of keys up to so much shorter or longer are."""
    sizes = ", ".join(f"cast((length(key) + {d}) / 2 as int)" for d in range(-reach, reach + 1))
    return F.expr(f"flatten(transform(array_distinct(array({sizes})), n -> array(struct('left' as h, left(key, n) as part), struct('right' as h, right(key, n) as part))))")


def edge_defects(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """(table_name, rec_id, line_no, defect): running lines and page numbers at the edges of pages.

    titles: book_id, title. A running line has for key the title of its book, or a key that stands at the outer edges of several
    pages of its book: HEAD_PAGES where it is written like the titles of the catalogue, else, if it is no sentence or markup,
    ANY_HEAD_PAGES and HEAD_SHARE of the book's; or a key within two characters of one of these that shares its first or second half. A line written like a title that stands once is one
    only if it bears its page's number or its book has running lines on other pages at this edge; a heading of a book
    without any stays. Null titles are none, null books have none.
    """
    edges = lines.where("edge != ''").select("table_name", "rec_id", "line_no", "book_id", "pno", "edge", _title("text", F.col("pno") + 1).alias("t"))
    edges = materialize(edges.select("table_name", "rec_id", "line_no", "book_id", "pno", "edge", "t.*"), "edges")
    known = titles.where("title is not null").select("book_id", _title("title", F.lit(-1)).alias("t")).select("book_id", F.col("t.key").alias("key"), F.col("t.shape").alias("shape"))
    rest = edges.where("not numbered and length(key) > 2")
    # longer shapes than one word tell titles from labels and headings
    shapes = known.where("length(shape) > 1").select("shape").distinct()
    outer = rest.where("edge in ('t1', 'b1')").join(shapes.withColumn("shaped", F.lit(True)), "shape", "left")
    per_key = outer.where("length(key) > 5").groupBy("book_id", "key").agg(F.count_distinct("pno").alias("pages"), F.coalesce(F.bool_or("shaped"), F.lit(False)).alias("shaped"), F.bool_or("loose").alias("loose"))
    of = edges.groupBy("book_id").agg(F.count_distinct("pno").alias("of"))
    repeated = per_key.join(of, "book_id").where(f"if(shaped, pages >= {HEAD_PAGES}, loose and pages >= greatest({ANY_HEAD_PAGES}, {HEAD_SHARE} * of))").select("book_id", "key")
    keys = materialize(repeated.union(known.where("length(key) > 5").select("book_id", "key")).distinct(), "heads")
    a = keys.select("book_id", F.col("key").alias("of"), F.explode(_halves(0)).alias("half"))
    own = rest.select("book_id", "key").distinct().join(keys, ["book_id", "key"], "left_anti")
    b = own.select("book_id", "key", F.explode(_halves(2)).alias("half"))
    near = b.join(a, ["book_id", "half"]).where("levenshtein(key, of, 2) between 0 and 2").select("book_id", "key").distinct()
    all_keys = materialize(keys.union(near).union(known.select("book_id", "key")).distinct(), "heads")
    row = ["table_name", "rec_id", "line_no", "edge"]
    running = rest.join(all_keys, ["book_id", "key"], "left_semi")
    slots = running.where("edge in ('t1', 'b1')").groupBy("book_id", "edge").agg(F.count_distinct("pno").alias("slot_pages")).where(f"slot_pages >= {HEAD_PAGES}")
    alone = outer.where("shaped").join(all_keys, ["book_id", "key"], "left_anti").join(slots, ["book_id", "edge"], "left").where("paged or slot_pages is not null")
    found = running.select(*row, F.lit("running").alias("defect")).union(alone.select(*row, F.lit("running"))).union(edges.where("numbered").select(*row, F.lit("pagenum")))
    # the second line of a page counts only below one that does
    first = found.where("edge in ('t1', 'b1')")
    under = first.select("table_name", "rec_id", F.replace("edge", F.lit("1"), F.lit("2")).alias("edge")).distinct()
    inner = found.where("edge in ('t2', 'b2')").join(under, ["table_name", "rec_id", "edge"], "left_semi").select(*found.columns)
    return first.union(inner).drop("edge")


def char_hash(c) -> Column:
    return F.xxhash64(c).bitwiseAND(F.lit((1 << 40) - 1))


def anagram_hash(word) -> Column:
    """The sum of the characters' hashes (40 bits each, so that sums never overflow)."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda s, c: s + char_hash(c))


def _without(words: DataFrame) -> DataFrame:
    """Each word less each character, and less each two neighbours: (word, n, at, cut, h), h the anagram hash of what is left."""
    one = "transform(sequence(1, length(word)), i -> struct(i as at, substring(word, i, 1) as cut))"
    two = "transform(sequence(1, length(word) - 1), i -> struct(i as at, substring(word, i, 2) as cut))"
    cuts = words.select("word", "n", anagram_hash(F.col("word")).alias("all"), F.explode(F.expr(f"concat({one}, if(length(word) > 1, {two}, array()))")).alias("x"))
    return cuts.select("word", "n", "x.at", "x.cut", (F.col("all") - anagram_hash(F.col("x.cut"))).alias("h"))


_SIGN_IN = "[a-z][0-9!]|[0-9!][a-z]|[�■□]"


def candidates(words: DataFrame) -> DataFrame:
    """(word, variant, n, variant_n, wrong, right): every rare word with every frequent one that another reading of one place gives.

    words: word, n (0 for words never counted). A reading takes one character for another, or for two, or two for one; none is
    merely dropped or added, as that is how words are inflected. A digit or lost sign inside a word is a stronger sign than its
    rarity: such a word needs a variant that is seen more often.
    """
    latin = words.where("word rlike '^[a-z0-9!�■□-]+$' and length(word) > 1")
    rare = _without(latin).withColumnRenamed("cut", "wrong")
    frequent = _without(latin.where("n >= 1 and not word rlike '[0-9!�■□]'")).select(F.col("word").alias("variant"), F.col("n").alias("variant_n"), F.col("cut").alias("right"), "h")
    both = rare.join(frequent, "h").where("word != variant and length(wrong) + length(right) < 4")
    both = both.where(f"variant_n >= greatest({LEAST}, {TIMES} * n) or (word rlike '{_SIGN_IN}' and variant_n > n)")
    # equal hashes are anagrams: the reading must also lead there at its place
    both = both.where("concat(left(word, at - 1), right, substring(word, at + length(wrong))) = variant")
    plain = "not contains(wrong, right) and not contains(right, wrong) and not contains(wrong, '-') and not contains(right, '-') and left(wrong, 1) != left(right, 1) and right(wrong, 1) != right(right, 1)"
    return both.where(plain).select("word", "variant", "n", "variant_n", "wrong", "right").distinct()


def learned(found: DataFrame) -> DataFrame:
    """(wrong, right, bits): what each confusion is worth, by the long words it explains (each by its most frequent variant).

    At most one row for each confusion of the alphabet of words.
    """
    w = Window.partitionBy("word").orderBy(F.desc("variant_n"), F.length("wrong"), "variant", "wrong")
    long = found.where(f"length(word) >= {LONG} and length(variant) >= {LONG}").withColumn("r", F.row_number().over(w)).where("r = 1")
    support = long.groupBy("wrong", "right").agg(F.count("*").alias("k"))
    mean = F.avg("k").over(Window.partitionBy(F.lit(0)))
    return support.withColumn("mean", mean).where(f"k >= {LEARNED} and k >= {LIFT} * mean").select("wrong", "right", (1.5 * F.log2(F.col("k") / F.col("mean") + 1)).alias("bits"))


def _looks() -> Column:
    both = sorted({*LOOKS, *((b, a) for a, b in LOOKS)})
    return F.concat_ws(" ", "wrong", "right").isin([f"{a} {b}" for a, b in both])


def corrections(words: DataFrame) -> DataFrame:
    """(word, variant, n, variant_n, wrong, right, bits): the best variant of each rare word, if it can be enough with the words beside it.

    A reading that is neither learned nor one of like shapes is none. bits: how much more frequent the variant is (4 at most), how long the word is, what its confusion is worth, learned or by
    shape; a digit or sign inside counts twice a shape. Rank: bits, then the more frequent, then the alphabet.
    """
    found = materialize(candidates(words), "candidates")
    worth = F.broadcast(learned(found))
    n = F.length("word")
    shape = F.when(_looks() & F.col("wrong").rlike("[0-9!]"), 4.0).when(F.col("wrong").rlike("[�■□]") & (F.length("right") == 1), 5.0).when(_looks(), 2.5).otherwise(0.0)
    bits = F.least(F.lit(4.0), F.log2(F.col("variant_n") / (F.col("n") + 1))) + F.when(n < 5, 2.0 * (n - 5)).otherwise(F.least(n, F.lit(9)) - 5.0) + shape + F.coalesce("bits", F.lit(0.0))
    scored = found.join(worth, ["wrong", "right"], "left").where((shape > 0) | F.col("bits").isNotNull()).withColumn("score", bits).where(F.col("score") >= ENOUGH - 2 * BESIDE)
    w = Window.partitionBy("word").orderBy(F.desc("score"), F.desc("variant_n"), "variant", "wrong")
    best = scored.withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.select("word", "variant", "n", "variant_n", "wrong", "right", F.col("score").alias("bits"))


def ideographs(pairs: DataFrame) -> DataFrame:
    """(wrong, right, apart, sure): ideographs that stand only in the company of one other that is RARER times as frequent.

    pairs: word (two ideographs), n. The company of an ideograph are its neighbours on either side, with how often they stand
    there; what one stands beside, and how differently often (relative entropy, less what so few sightings differ by chance),
    tells whether it is the other one misread. `sure` is false where a second one fits as well. Only pairs that can cover
    EXPLAINED of an ideograph's sightings are compared: such a partner shares one of the rarest neighbours that make up the rest.
    """
    both = pairs.where(f"word rlike '^[{_HAN}]{{2}}$'")
    side = F.explode(F.array(F.struct(F.expr("left(word, 1)").alias("c"), F.concat(F.lit(">"), F.expr("right(word, 1)")).alias("by")), F.struct(F.expr("right(word, 1)").alias("c"), F.concat(F.lit("<"), F.expr("left(word, 1)")).alias("by"))))
    near = both.select(side.alias("x"), "n").select("x.c", "x.by", "n")
    near = near.join(near.groupBy("c").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")), "c").join(near.groupBy("by").agg(F.count("*").alias("wide")), "by")
    near = materialize(near, "company")
    w = Window.partitionBy("c").orderBy("wide", "by").rowsBetween(Window.unboundedPreceding, -1)
    some = near.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") <= (1 - EXPLAINED) * F.col("all"))
    right = near.select(F.col("c").alias("right"), "by", F.col("n").alias("right_n"), F.col("all").alias("right_all"))
    pair = some.where(f"kinds > 1").join(right, "by").where(f"right != c and right_all >= {RARER} * all").select("c", "right", "right_all").distinct()
    whole = pair.join(near.select("c", "by", "n", "all", "kinds"), "c").join(right.drop("right_all"), ["right", "by"], "left")
    p, q = F.col("n") / F.col("all"), F.coalesce("right_n", F.lit(0.02)) / F.col("right_all")
    explained = F.sum(F.when(F.col("right_n") >= F.greatest(F.lit(LEAST), TIMES * F.col("n")), F.col("n")).otherwise(0)) / F.first("all")
    score = whole.groupBy("c", "right").agg((F.sum(p * F.log(p / q)) - F.first("kinds") / (2.0 * F.first("all"))).alias("apart"), explained.alias("explained"), F.first("right_all").alias("right_all"), F.first("all").alias("all"))
    w = Window.partitionBy("c").orderBy("apart", F.desc("right_all"), "right")
    # few sightings differ more by chance
    best = score.where(f"explained >= {EXPLAINED} and apart <= {APART} + 1.5 / sqrt(all)").withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("apart").over(w))
    return best.where("r = 1").select(F.col("c").alias("wrong"), "right", "apart", F.coalesce(F.col("next") > 2 * F.greatest("apart", F.lit(0.05)), F.lit(True)).alias("sure"))


def pair_corrections(pairs: DataFrame, read: DataFrame) -> DataFrame:
    """(word, variant, sure): pairs with a misread ideograph that are frequent once it is read right. read: from `ideographs`."""
    places = pairs.select("word", "n", F.explode(F.array(F.struct(F.lit(1).alias("at"), F.expr("left(word, 1)").alias("wrong")), F.struct(F.lit(2).alias("at"), F.expr("right(word, 1)").alias("wrong")))).alias("x")).select("word", "n", "x.*")
    other = places.join(_bounded(read), "wrong").withColumn("variant", F.expr("if(at = 1, concat(right, right(word, 1)), concat(left(word, 1), right))"))
    found = other.join(pairs.select(F.col("word").alias("variant"), F.col("n").alias("variant_n")), "variant").where(f"variant_n >= greatest({LEAST}, {TIMES} * n)")
    w = Window.partitionBy("word").orderBy(F.desc("variant_n"), "variant")
    return found.withColumn("r", F.row_number().over(w)).where("r = 1").select("word", "variant", "sure")


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_WORDS else df


def _list(c: str) -> Column:
    """The words of a line, which travel as one string; null for none."""
    return F.when(F.col(c) != "", F.split(c, " "))


def _context(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (word, variant, bits, before, after) with bits for the words beside each, which the whole corpus was asked for."""
    l, r = F.concat_ws(" ", "before", "variant"), F.concat_ws(" ", "variant", "after")
    rows = rows.withColumn("l", F.when(F.col("before").isNotNull(), l)).withColumn("r", F.when(F.col("after").isNotNull(), r))
    asked = rows.select(F.explode(F.array("l", "r")).alias("two")).where("two is not null").distinct()
    twos = lines.select(_list("words").alias("words")).where("size(words) > 1").select(F.explode(F.expr("transform(sequence(2, size(words)), i -> concat_ws(' ', get(words, i - 2), get(words, i - 1)))")).alias("two"))
    seen = twos.join(_bounded(materialize(asked, "asked")), "two", "left_semi").groupBy("two").count().where("count > 1").select("two")
    seen = _bounded(materialize(seen, "beside"))
    for c in ("l", "r"):
        rows = rows.join(seen.select(F.col("two").alias(c), F.lit(BESIDE).alias(f"{c}_bits")), c, "left")
    side = lambda c: F.when(F.col(c).isNull(), 0.0).otherwise(F.coalesce(f"{c}_bits", F.lit(-ALONE)))
    return rows.withColumn("bits", F.col("bits") + side("l") + side("r"))


def word_defects(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(defects, corrections). lines: body lines only, of all tables. defects: table_name, rec_id, line_no, defect, word, variant.

    A word is split (`hyphen`) if a line ends in a hyphen of any kind and the next line of the page goes on in lower
    case, unless the two parts are a compound: its hyphenated form is known and the joined one is not better known;
    where neither is, two known parts are a compound. Soft hyphens always split. Words are known as they are or corrected.
    A misread letter of a split word belongs to the line it stands in. A word that needs the words beside it is judged place by
    place. A lost sign is always a misread character, but for the last one of a page. An ideograph that could be two
    others is named, but not replaced.
    """
    key = ["table_name", "rec_id", "line_no"]
    counts = materialize(lines.select(F.explode(F.split(F.concat_ws(" ", F.nullif("words", F.lit("")), F.nullif("terms", F.lit(""))), " ")).alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n")), "counts")
    splits = lines.where("b is not null and a != ''").select(*key, "next_rec", "next_no", "mark", "a", "b", F.concat("a", "b").alias("joined"), F.concat_ws("-", "a", "b").alias("compound"))
    splits = materialize(splits, "splits")
    parts = ("joined", "compound", "a", "b")
    more = splits.select(F.explode(F.array(*parts)).alias("word")).distinct().join(counts, "word", "left_anti").select("word", F.lit(0).cast("long").alias("n"))
    fixes = materialize(corrections(counts.union(more)), "fixes")
    pairs = counts.where(f"word rlike '^[{_HAN}]{{2}}$'")
    han = materialize(pair_corrections(pairs, materialize(ideographs(pairs), "ideographs")), "han")
    alone = fixes.where(F.col("bits") >= ENOUGH)
    known = counts.select("word", "n").join(splits.select(F.explode(F.array(*parts)).alias("word")).distinct(), "word", "left_semi")
    known = known.union(alone.join(splits.select(F.explode(F.array(*parts)).alias("word")).distinct(), "word", "left_semi").select("word", F.col("variant_n").alias("n")))
    known = _bounded(materialize(known.groupBy("word").agg(F.max("n").alias("n")), "known"))
    for c in parts:
        splits = splits.join(known.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    splits = splits.fillna(0, [f"n_{c}" for c in parts])
    is_split = F.expr("mark in ('­', '¬') or case when n_joined = 0 and n_compound = 0 then n_a = 0 or n_b = 0 else n_joined >= n_compound end")
    splits = materialize(splits.withColumn("split", is_split), "splits")
    hyphens = splits.where("split")

    null = F.lit(None).cast("string")
    table = _bounded(fixes.select("word", "variant", "bits"))
    around = F.expr("transform(words, (w, i) -> struct(w as word, get(words, i - 1) as before, get(words, i + 1) as after))")
    here = lines.select(*key, "lost", _list("words").alias("words")).select(*key, "lost", F.explode(around).alias("x")).select(*key, "lost", "x.*").join(table, "word").where(f"lost or not word rlike '[{LOST}]'").drop("lost")
    here = materialize(here, "here")
    needy = here.where((F.col("bits") < ENOUGH) | (F.col("bits") - 2 * ALONE < ENOUGH))
    sure = here.where(F.col("bits") - 2 * ALONE >= ENOUGH).select(*key, "word", "variant")
    judged = _context(lines, needy).where(F.col("bits") >= ENOUGH).select(*key, "word", "variant")
    signs = lines.select(*key, F.explode(_list("terms")).alias("word")).join(_bounded(han), "word").select(*key, "word", F.when(F.col("sure"), F.col("variant")).alias("variant"))
    lost = lines.where("lost").select(*key, F.lit(LOST[0]).alias("word"), null.alias("variant"))
    single = _bounded(alone.select("word", "variant"))
    joined = hyphens.join(single, hyphens.joined == single.word).withColumn("at", F.expr("size(filter(sequence(1, least(length(joined), length(variant))), i -> left(joined, i) = left(variant, i))) + 1"))
    in_split = [joined.where("at <= length(a)").select(*key, "word", "variant"), joined.where("at > length(a)").select("table_name", F.col("next_rec").alias("rec_id"), F.col("next_no").alias("line_no"), "word", "variant")]
    apart = splits.where("not split").select("table_name", F.explode(F.array(F.struct("rec_id", "line_no", F.col("a").alias("word")), F.struct(F.col("next_rec").alias("rec_id"), F.col("next_no").alias("line_no"), F.col("b").alias("word")))).alias("x"))
    halves = apart.select("table_name", "x.*").join(single, "word").select(*key, "word", "variant")
    misread = reduce(DataFrame.union, [lost, sure, judged, signs, halves, *in_split]).distinct()
    defects = hyphens.select(*key, F.lit("hyphen").alias("defect"), F.col("joined").alias("word"), null.alias("variant"))
    return defects.union(misread.select(*key, F.lit("misread"), "word", "variant")), fixes


def noisy_lines(parts: list[DataFrame], titles: DataFrame) -> DataFrame:
    """(table_name, rec_id, line_no, defect, word, variant) over the lines of all tables. No lines: no row."""
    lines = materialize(reduce(DataFrame.union, parts), "lines")
    edges = materialize(edge_defects(lines, titles), "running")
    key = ["table_name", "rec_id", "line_no"]
    body = lines.drop("text", "edge", "book_id", "pno").join(edges, key, "left_anti")
    gone = edges.select(F.col("table_name"), F.col("rec_id").alias("next_rec"), F.col("line_no").alias("next_no")).withColumn("gone", F.lit(True))
    broken = body.where("b is not null").join(gone, ["table_name", "next_rec", "next_no"], "left").withColumn("b", F.expr("if(gone, null, b)"))
    body = body.where("b is null").union(broken.select(*body.columns))
    defects, _ = word_defects(materialize(body, "body"))
    null = F.lit(None).cast("string")
    return edges.select(*key, "defect", null.alias("word"), null.alias("variant")).union(defects)


def _repaired(text: str, defects) -> str:
    drop = {d["line_no"] for d in defects if d["defect"] in ("running", "pagenum")}
    joins = {d["line_no"] for d in defects if d["defect"] == "hyphen"}
    fixes: dict[int, list] = {}
    for d in defects:
        if d["defect"] == "misread" and d["variant"]:
            fixes.setdefault(d["line_no"], []).append((d["word"], d["variant"]))
    out, open_, held = [], None, []
    for i, raw in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), 1):
        line = raw.rstrip()
        if i in drop:
            continue
        if not line.strip():
            open_ = None
            out.append("")
        elif open_ == "split":
            out[-1] += line.lstrip()
            open_ = "text"
        elif open_ == "text" and not re.match(r"\s*([#>|`~$\\{<=*-]|\d+[.)]\s)", line):
            out[-1] += line.lstrip() if re.search(rf"[{_HAN}，。；：、？！）”]$", out[-1]) or out[-1].endswith("-") else " " + line.lstrip()
        else:
            out.append(line)
            open_ = "text" if not re.match(r"\s*([#|`~$\\{<=]|[-*]\s)", line) else None
        for wrong, right in [*held, *fixes.get(i, [])]:  # in the paragraph, as a split word is whole only there
            whole = rf"(?<![\w{LOST}]){re.escape(wrong)}(?![\w{LOST}])" if wrong.isascii() else re.escape(wrong)
            out[-1] = re.sub(whole, lambda m, r=right: r if m[0].islower() or not m[0].isascii() else r.upper() if m[0].isupper() and len(m[0]) > 1 else r.capitalize(), out[-1], flags=re.I)
        held = fixes.get(i, []) if i in joins else []  # again once the word is whole
        if i in joins and out:
            out[-1] = re.sub(rf"[{_HYPHENS}]\s*$", "", out[-1])
            open_ = "split"
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def repaired_pages(df: DataFrame, table: str, rec: str, text: str, defects: DataFrame, page: list[str] = ()) -> DataFrame:
    """(rec, page, clean, n_defects): page texts without their noisy lines, words rejoined and corrected, in paragraphs.

    Null texts stay null. Lost characters without a known variant stay as they are printed.
    """
    per_page = defects.where(F.col("table_name") == table).groupBy(F.col("rec_id").alias(rec)).agg(F.collect_list(F.struct("line_no", "defect", "word", "variant")).alias("d"))

    @F.pandas_udf("string")
    def repair(s: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _repaired(t, [] if x is None else list(x)) for t, x in zip(s, d)], dtype=object)

    both = df.select(rec, *page, text).join(per_page, rec, "left")
    return both.select(rec, *page, repair(text, "d").alias("clean"), F.coalesce(F.size("d"), F.lit(0)).alias("n_defects"))


#: a line that ends so far from the right edge of its column (shares of its width) ends its paragraph: after a full stop, and at any rate
SHORT, SHORTER = 0.02, 0.15
_STOP = re.compile(r"[.!?。！？…][)\]”’\"'）」』]*$")


def _page_of_lines(lines) -> str:
    """The clean paragraphs of a page's lines, each with its own defects."""
    kinds = [{d["defect"] for d in x["d"]} if x["d"] is not None else set() for x in lines]
    body = [(x, k) for x, k in zip(lines, kinds) if not k & {"running", "pagenum"} and visible(x["text"]).strip()]
    edge: dict = {}
    for x, _ in body:
        if x["x0"] is not None and x["x1"] is not None and x["cell_row"] is None:
            a, z = edge.get(x["column_no"], (x["x0"], x["x1"]))
            edge[x["column_no"]] = min(a, x["x0"]), max(z, x["x1"])
    out, defects, last, split = [], [], None, False
    for x, k in body:
        if last is not None and not split and _parted(last, x, edge):
            out.append("")
        out.append(re.sub(r"[\r\n]+", " ", x["text"]))
        defects.extend({"line_no": len(out), "defect": d["defect"], "word": d["word"], "variant": d["variant"]} for d in (x["d"] if x["d"] is not None else ()))
        last, split = x, "hyphen" in k
    return _repaired("\n".join(out), defects)


def _parted(a, b, edge: dict) -> bool:
    """Whether a paragraph ends between two neighbouring lines, by their places. Lines without places run on."""
    if a["cell_row"] is not None or b["cell_row"] is not None:
        return True
    if None not in (a["y0"], a["y1"], b["y0"]) and a["column_no"] == b["column_no"] and b["y0"] - a["y1"] > a["y1"] - a["y0"]:
        return True
    left, right = edge.get(a["column_no"], (0.0, 0.0))
    if a["x1"] is None or right <= left:
        return False
    short = (right - a["x1"]) / (right - left)
    return short > SHORTER or (short > SHORT and bool(_STOP.search(a["text"].rstrip())))


def repaired_lines(df: DataFrame, table: str, rec: str, text: str, page: list[str], order: list[str], defects: DataFrame) -> DataFrame:
    """(rec, page, clean, n_defects): the lines of each page in `order`, repaired like `repaired_pages`; rec is the smallest of the page.

    Cells, gaps and short lines end paragraphs. Lines without a text or id are left out, as in `lines_of_table`.
    """
    per_line = defects.where(F.col("table_name") == table).groupBy(F.col("rec_id").alias(rec)).agg(F.collect_list(F.struct("defect", "word", "variant")).alias("d"))
    few = df.where(F.col(text).isNotNull() & F.col(rec).isNotNull()).select(*dict.fromkeys([rec, *page, *order, "x0", "x1", "y0", "y1", "column_no", "cell_row"]), F.col(text).alias("__text"))
    line = F.struct(*order, rec, F.col("__text").alias("text"), "x0", "x1", "y0", "y1", "column_no", "cell_row", "d")
    # sorted by place alone: the id makes it unique, so the rest is never compared
    pages = few.join(per_line, rec, "left").groupBy(*page).agg(F.min(rec).alias(rec), F.sort_array(F.collect_list(line)).alias("g"), F.sum(F.coalesce(F.size("d"), F.lit(0))).cast("int").alias("n_defects"))

    @F.pandas_udf("string")
    def repair(s: pd.Series) -> pd.Series:
        return pd.Series([_page_of_lines(g) for g in s], dtype=object)

    return pages.select(rec, *page, repair("g").alias("clean"), "n_defects")
