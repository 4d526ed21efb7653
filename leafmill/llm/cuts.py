"""Texts that lost their end.

First asked is the trie of the corpus vocabulary: a last word that is no known word but a proper prefix of known ones, and
last tokens that go on everywhere else and end no paragraph. Length evidence goes with it: a short last paragraph that the
corpus nearly always carries on, and a message that reports more tokens than the text that arrived has. What shows without a
trie supports it: a sign of the cut after the last word, an open construct (bracket, formula, table, environment), prose
without a stop. The tries are tables of (prefix, count), built and asked by joins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.lookalike import visible
from leafmill.llm.noise import _HAN, is_page_number, title_shape
from leafmill.runtime import materialize

#: more tokens than the text accounts for: the token noise of whole texts stays well below
EXCESS = 0.15
#: a last word is cut if at most this share of the words that begin with it end there
WORD_SHARE = 0.02
#: a short last paragraph is whole if at least this share of the paragraphs that begin with it end there
LABEL_SHARE = 0.3
#: longest paragraph that may be a label, in characters
LABEL = 40
#: rounds of fitting tokens to characters, without the rows beyond EXCESS after the first
FITS = 4
BROADCAST = 200_000

# fixed values: what a cut leaves behind the last word
_SIGN = re.compile(r"(?:…|\.{3}|⋯|�|\[(?:\.{3}|…|cut|truncated)\]|<\.{3}>)\s*$")
_STOP = re.compile(r"""[。！？.!?]["'”’）)\]】》*_~]*(?:\}\}|</[a-zA-Z0-9]+>|\*\*|\\\\)*\s*$""")
_WORD = re.compile(r"[A-Za-z]+")
_CLOSERS = re.compile(r"(?i)</(?:table|tr|ul|ol|dl|h[1-6]|p|div|pre|blockquote|b|i|em|strong|span|sup|sub|a|caption)\s*>\s*$|<(?:br|hr)\s*/?>\s*$|-->\s*$")
_TOKENS = ("han", "latin", "other", "breaks")
_TOKEN = re.compile(rf"[A-Za-z]+|\d+|[{_HAN}]|[^\s\w]|[^\W]")
#: last tokens tell of a cut if they go on so often elsewhere, and end a paragraph in at most such a share
GOES_ON, ENDS = 3, 0.05


def _open_end(text: str) -> bool:
    """Something that began is not closed at the end."""
    if len(re.findall(r"(?m)^[ \t]*```", text)) % 2 or text.count("$$") % 2 or len(re.findall(r"\\begin\{", text)) > len(re.findall(r"\\end\{", text)):
        return True
    if text.count("\\[") > text.count("\\]") and re.search(r"\\\[[^\]]*$", text):
        return True
    if text.rfind("{|") > text.rfind("|}") and re.search(r"(?m)^\{\|", text):
        return True
    if text.rfind("{{") > text.rfind("}}") or text.rfind("[[") > text.rfind("]]"):
        return True
    last = text.rsplit("\n\n", 1)[-1]
    if any(last.count(a) > last.count(b) for a, b in ("()", "[]")) or last.count("“") > last.count("”"):
        return True
    if last.count("**") % 2 or re.search(r"<[^<>\n]*$", last) and re.search(r"</?[a-zA-Z]+[^<>\n]*$", last):
        return True
    return False


def _table_end(lines: list[str]) -> str:
    """`closed` or `open`: whether the table that ends a text ends with a full row."""
    rows = []
    for x in reversed(lines):
        if not x.startswith("|"):
            break
        rows.append(x)
    if not lines[-1].endswith("|") or len(lines[-1]) < 2:
        return "open"
    return "closed" if rows[0].count("|") == rows[-1].count("|") and (len(rows) > 2 or rows[-1] == rows[0] and len(rows) != 1) else "open"


def _last_word(text: str) -> str:
    """The Latin word a text ends with, lower case."""
    return _WORD.findall(text.rsplit("\n", 1)[-1])[-1].lower() if text[-1:].isascii() and text[-1:].isalpha() else ""


def tokens_of(text: str) -> list[str]:
    """Words, numbers (all alike), ideographs and signs of a paragraph, behind a mark of its beginning."""
    return ["^", *("9" if t[0].isdigit() else t.lower() for t in _TOKEN.findall(text))]


def ending(text: str, page: int) -> tuple[str, str, str]:
    """(state, last word, label) of a text. state: empty, sign, open, stop, closed, label or prose."""
    return _ending(visible(text), page)


def _ending(text: str, page: int) -> tuple[str, str, str]:
    """`ending` of a text in its visible form."""
    t = text.rstrip()
    if not t:
        return "empty", "", ""
    lines = [x.strip() for x in t.split("\n")]
    last, before = lines[-1], next((x for x in reversed(lines[:-1]) if x), "")
    alone = len(lines) == 1 or not lines[-2]
    sign = _SIGN.search(t)
    if sign:
        return "sign", _last_word(t[: sign.start()].rstrip()), ""
    if is_page_number(last, page + 1) or re.fullmatch(r"(?i)[·—–\-\[(]\s*[0-9OlI]+\s*[·—–\-\])]|(?:page|p\.)\s*[0-9OlI]+|第\s*[0-9OlI]+\s*页|页\s*[0-9OlI]+", last):
        return "closed", "", ""
    shape = title_shape(last)
    if (alone or _STOP.search(before)) and shape.count("X") >= 3:
        return "closed", "", ""
    word = _last_word(last)
    if _open_end(t):
        return "open", word, ""
    if _STOP.search(t):
        return "stop", "", ""
    if last.startswith("|") and not last.startswith(("|}", "|-")) and "||" not in last:
        return _table_end(lines), "", ""
    if re.match(r"(?i)</?t[dhr]|.*</t[dhr]>$|.*<t[dhr][^>]*>", last) and not re.search(r"(?i)</(tr|table|tbody)>$", last):
        return "open", word, ""
    if re.search(r"(?i)<li\b", last) and not re.search(r"(?i)</[uo]l>$", last):
        return "open", word, ""
    if re.fullmatch(r"={3,}|-{3,}|\|\}|\$\$|`{3,}|\\\]", last) or last.endswith(("$$", "\\]", "}}", "]]", "|}")) or _CLOSERS.search(last):
        return "closed", "", ""
    if re.fullmatch(r"\[[^\[\]]*\]|/[^/\s]+/", last) or re.fullmatch(r"\\end\{[^}]*\}|\\[a-z]+\*?\{[^{}]*\}", last):
        return "closed", "", ""
    if re.search(r"[;,:、]$", last) or (not alone and not re.match(r"[#=<\\>*-]", last) and not _STOP.search(before)):
        return "prose", word, ""
    label = re.sub(r"^(?:#{1,6}\s+|={1,6}\s*|<h[1-6][^>]*>|\\[a-z]+\{|\*\*|__)", "", last)
    marked = label != last
    if marked and re.match(r"(={1,6}|<h[1-6]|\\[a-z]+\{|\*\*|__)", last) and not re.search(r"(={1,6}|</h[1-6]>|\}|\*\*|__)$", last):
        return "open", word, ""
    label = re.sub(r"(?:\s*={1,6}|</h[1-6]>|\}|\*\*|__)$", "", label).strip()
    if len(label) > LABEL or re.search(r"[,;:。！？]", label):
        return "prose", word, ""
    return "label", word, re.sub(r"\d+", "9", label)


def _first_lines(text: str) -> list[str]:
    out = []
    for para in re.split(r"\n[ \t]*\n", text):
        x = para.strip().split("\n", 1)[0].strip()
        x = re.sub(r"^(?:#{1,6}\s+|={1,6}\s*|<h[1-6][^>]*>|\\section\{|\*\*|__)", "", x)
        x = re.sub(r"(?:\s*={1,6}|</h[1-6]>|\}|\*\*|__)$", "", x).strip()
        if x:
            out.append(re.sub(r"\d+", "9", x)[: LABEL + 2])
    return out


READ = "kind string, key string, n long, stops long, rec long, state string, word string, label string, last string, han long, latin long, other long, breaks long"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over the texts: a row (kind `end`) for the end of each, and the vocabulary of the batch, counted.

    Words (inside lines only, as those at the ends of lines may be parts), beginnings of paragraphs, and pairs of tokens: how
    often they go on (n) and end a paragraph (stops). The last paragraph of a text is no evidence of how paragraphs end.
    """
    han = re.compile(f"[{_HAN}，。；：、！？（）“”]")
    names = [c.strip().split(" ")[0] for c in READ.split(", ")]
    for b in batches:
        words, paras, goes, stops, rows = Counter(), Counter(), Counter(), Counter(), []
        for rec, page, text in zip(b["rec"], b["page"], b["text"]):
            v = visible(text)
            n_han, n_latin, n_breaks = len(han.findall(v)), len(re.findall("[ -~]", v)), v.count("\n")
            for line in v.split("\n"):
                words.update(w.lower() for w in _WORD.findall(line)[1:-1])
            paras.update(_first_lines(v))
            end = _SIGN.sub("", v.rstrip()).rstrip()
            parts = [t for p in re.split(r"\n[ \t]*\n", end) if len(t := tokens_of(p)) > 1]
            for t in parts:
                goes.update(zip(t[:-2], t[1:-1]))
            stops.update((t[-2], t[-1]) for t in parts[:-1])
            state, word, label = _ending(v, int(page))
            last = " ".join(parts[-1][-2:]) if parts and state in ("sign", "open", "prose", "label") else ""
            rows.append(("end", None, None, None, rec, state, word, label, last, n_han, n_latin, len(v) - n_han - n_latin - n_breaks, n_breaks))
        blank = (None,) * 9
        rows += [("word", w, n, 0, *blank) for w, n in words.items()] + [("para", w, n, 0, *blank) for w, n in paras.items()]
        rows += [("last", " ".join(k), goes[k], stops[k], *blank) for k in goes.keys() | stops.keys()]
        for i in range(0, len(rows), 20_000):
            yield pd.DataFrame(rows[i : i + 20_000], columns=names).astype({c: "Int64" for c in ("n", "stops", "rec", *_TOKENS)})


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST else df


def prefix_counts(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, ends, goes_on): how often the asked keys end as whole entries, and how often entries go on beyond them.

    vocabulary: key, n. Each entry is a path of the trie; its nodes (prefixes) of the asked lengths are looked up.
    """
    # few: the distinct lengths of words
    lengths = [r[0] for r in asked.select(F.length("key")).distinct().collect()]
    if not lengths:
        return asked.select("key", F.lit(0).cast("long").alias("ends"), F.lit(0).cast("long").alias("goes_on"))
    nodes = vocabulary.withColumn("len", F.explode(F.filter(F.array(*map(F.lit, sorted(lengths))), lambda n: n <= F.length("key"))))
    nodes = nodes.select(F.expr("left(key, len)").alias("node"), (F.col("len") == F.length("key")).alias("whole"), "n")
    hit = nodes.join(_bounded(asked.select(F.col("key").alias("node")).distinct()), "node")
    return hit.groupBy(F.col("node").alias("key")).agg(F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)).alias("ends"), F.sum(F.when(~F.col("whole"), F.col("n")).otherwise(0)).alias("goes_on"))


def token_rates(rows: DataFrame) -> np.ndarray:
    """Tokens per character of each class, least squares over all rows, refitted without those beyond EXCESS."""
    rates = None
    for _ in range(FITS):
        use = rows
        if rates is not None:
            expected = sum(F.col(c) * float(r) for c, r in zip(_TOKENS, rates))
            use = rows.where((F.col("tokens") <= expected * (1 + EXCESS)) & (F.col("tokens") >= expected * (1 - EXCESS)))
        # weighted by 1 / n, as the noise grows with the text
        w = 1.0 / F.greatest(F.lit(1), F.col("han") + F.col("latin"))
        cols = [*_TOKENS, "tokens"]
        sums = use.agg(*(F.sum(F.col(a) * F.col(b) * w).alias(f"{a}_{b}") for a in _TOKENS for b in cols)).first()
        a = np.array([[sums[f"{x}_{y}"] or 0.0 for y in _TOKENS] for x in _TOKENS])
        y = np.array([sums[f"{x}_tokens"] or 0.0 for x in _TOKENS])
        rates = np.linalg.lstsq(a, y, rcond=None)[0]
    return rates


def cut_texts(df: DataFrame, rec: str, text: str, page: str, tokens: DataFrame | None = None) -> DataFrame:
    """(rec, state, cut, evidence): one row per text that is not null and has an id; cut is true where the text lost its end.

    evidence: the first that holds of `word` (an unknown prefix of known words), `tokens_go_on`, `label` (a short paragraph the
    corpus carries on), `sign`, `open`, `prose`, `token_count`; null where the text is whole.
    tokens: rec, tokens (the fewest reported by the text's messages); texts without are judged by themselves. Empty and
    blank texts are not cut, unless their message reports tokens.
    """
    texts = df.where(F.col(text).isNotNull() & F.col(rec).isNotNull()).select(F.col(rec).alias("rec"), F.coalesce(F.col(page), F.lit(-1)).alias("page"), F.col(text).alias("text"))
    read = materialize(texts.mapInPandas(_read, READ), "read")
    ends = read.where("kind = 'end'").select("rec", "state", "word", "label", "last", *_TOKENS)
    vocabulary = materialize(read.where("kind != 'end'").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("stops").alias("stops")), "vocabulary")
    word = prefix_counts(vocabulary.where("kind = 'word'").select("key", "n"), ends.where("word != ''").select(F.col("word").alias("key")).distinct())
    label = prefix_counts(vocabulary.where("kind = 'para'").select("key", "n"), ends.where("label != ''").select(F.col("label").alias("key")).distinct())
    word = materialize(word.select(F.col("key").alias("word"), (F.col("ends") <= WORD_SHARE * F.col("goes_on")).alias("part"), (F.col("ends") > 0).alias("known")), "words")
    label = materialize(label.select(F.col("key").alias("label"), F.col("ends"), F.col("goes_on")), "labels")
    last = vocabulary.where("kind = 'last'").select(F.col("key").alias("last"), "n", "stops").join(_bounded(materialize(ends.where("last != ''").select("last").distinct(), "lasts")), "last", "left_semi")
    last = materialize(last.select("last", ((F.col("n") >= GOES_ON) & (F.col("stops") <= ENDS * (F.col("n") + F.col("stops")))).alias("carried")), "carried")
    both = ends.join(_bounded(word), "word", "left").join(_bounded(label), "label", "left").join(_bounded(last), "last", "left")
    # a label seen once tells nothing: it is one only if it is a single word that is known
    whole = F.expr(f"ends >= {LABEL_SHARE} * (ends + goes_on) and (ends + goes_on > 1 or (not label like '% %' and (coalesce(known, false) or word = '')))")
    unstopped = F.col("state").isin("sign", "open", "prose")
    evidence = (
        F.when((unstopped | (F.col("state") == "label")) & F.coalesce("part", F.lit(False)), "word")
        .when(unstopped & F.coalesce("carried", F.lit(False)), "tokens_go_on")
        .when((F.col("state") == "label") & ~F.coalesce(whole, F.lit(False)), "label")
        .when(unstopped, F.col("state"))
    )
    out = both.select("rec", "state", evidence.alias("evidence"), *_TOKENS)
    if tokens is not None:
        out = materialize(out.join(tokens.select(F.col(rec).alias("rec"), "tokens"), "rec", "left"), "tokens")
        rates = token_rates(out.where("tokens is not null and han + latin >= 100 and evidence is null"))
        expected = sum(F.col(c) * float(r) for c, r in zip(_TOKENS, rates))
        out = out.withColumn("evidence", F.coalesce("evidence", F.when(F.col("tokens") > expected * (1 + EXCESS) + 3, "token_count")))
    return out.select(F.col("rec").alias(rec), "state", F.col("evidence").isNotNull().alias("cut"), "evidence")


def page_tokens(pages: DataFrame, messages: DataFrame, rec: str) -> DataFrame:
    """(rec, tokens): the fewest completion tokens among the messages of the text's run and page.

    pages: rec, run_id, pno. messages: run_id, page, status, completion_tokens; only successes count.
    """
    good = messages.where("status = 'success' and completion_tokens is not null and page is not null").groupBy("run_id", F.col("page").alias("pno")).agg(F.min("completion_tokens").alias("tokens"))
    return pages.select(rec, "run_id", F.col("pno").cast("long").alias("pno")).join(good, ["run_id", "pno"]).select(rec, "tokens")


def cut_share(df: DataFrame, rec: str, source: str, cuts: DataFrame) -> DataFrame:
    """(source, texts, cut, share): how often each source truncates; a null source is one of its own."""
    both = df.select(rec, source).join(cuts.select(rec, "cut"), rec)
    return both.groupBy(source).agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"), (F.count_if("cut") / F.count("*")).alias("share"))
