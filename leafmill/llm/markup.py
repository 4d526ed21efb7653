"""Markup residue: which kinds a text holds, and its clean text without templates.

Every construct of a text is an *element* with its kind (html, markdown, wiki, latex) and its place (an HTML element from its
opening to its closing tag, a template, an environment, a heading, ...). Elements that lie in one another are a tree; each has
the hash of its subtree: its name, its words and its children's hashes in their order, without attributes and blanks. The hashes are counted per host over distinct pages in Spark: an element that recurs on many pages of its
host belongs to the site's template. Templates are cut first; what they and the rest consist of is told apart, and the
clean text is that of the rest. Headings, lists, tables, code and formulas stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.lookalike import visible
from leafmill.runtime import materialize

# fixed values: element names of HTML
_TAGS = (
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del details dfn div dl dt em embed "
    "fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav "
    "noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg "
    "table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
).split()
# fixed values: elements that never have content
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# fixed values: tables, code, formulas and marked words; they stay in the clean text however often they recur
_STAYS = "caption code col colgroup display emphasis fence inline pre quotes strike strong table tbody td tfoot th thead tr b em i s sub sup u".split()
_TAG = re.compile(rf"<(/?)({'|'.join(sorted(_TAGS, key=len, reverse=True))})((?:\s[^<>]*|/)?)>", re.I)
#: names that are also written for letters, in angle brackets: alone, without an end tag or attributes, they are no markup
_LETTERS = frozenset("a b i p q s u th dd dt tt rt rp li tr td em".split())
_IPA = re.compile(r"[ɐ-ʯʰ-˿̀-ͯᴀ-ᶿ²³¹⁰-⁹ãẽĩõũŋæøðβθχ]")

_FENCE = re.compile(r"(?m)^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S)
_SPAN = re.compile(r"(?<!`)(`+)(?!`)([^\n]+?)(?<!`)\1(?!`)")
_RAW = re.compile(r"<(pre|code|nowiki|syntaxhighlight|script|style)\b[^<>]*>((?:(?!<\1\b).)*?)</\1\s*>|\\begin\{(verbatim|lstlisting)\}((?:(?!\\begin\{\3\}).)*?)\\end\{\3\}", re.S | re.I)

# what each kind is made of; a pattern matches one construct
_CONSTRUCTS: list[tuple[str, str, re.Pattern]] = [
    ("html", "comment", re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>", re.S | re.I)),
    ("html", "entity", re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")),
    ("markdown", "image", re.compile(r"!\[[^\[\]\n]*\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)")),
    ("markdown", "link", re.compile(r"(?<!!)\[[^\[\]\n]+\]\((?=[^()\s]*[./#:])[^()\s]+(?:\s+\"[^\"\n]*\")?\)")),
    ("markdown", "footnote", re.compile(r"\[\^[^\[\]\s]+\]")),
    ("markdown", "heading", re.compile(r"(?m)^ {0,3}#{1,6}[ \t]+\S.*$")),
    ("markdown", "underlined", re.compile(r"(?m)^(?![ \t]*(?:[-=|+*>#]|$))[^\n]+\n {0,3}(?:={3,}|-{3,})[ \t]*$")),
    ("markdown", "rule", re.compile(r"(?m)^ {0,3}(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|-{3,})[ \t]*$")),
    ("markdown", "table", re.compile(r"(?m)^[ \t]*\|(?![-|}+])[^|\n]*\|(?!\|)[^\n]*\|[ \t]*$|^[ \t]*(?:\|[ \t]*)?:?-{3,}:?[ \t]*\|(?:[ \t]*:?-{3,}:?[ \t]*\|)*(?:[ \t]*:?-{3,}:?)?[ \t]*$")),
    ("markdown", "item", re.compile(r"(?m)^[ \t]*(?:[-+*][ \t]+(?![-+*\d\s]+[-–—·*]?[ \t]*$)\S|\d{1,3}[.)][ \t]+\S).*$")),
    ("markdown", "quote", re.compile(r"(?m)^ {0,3}>[ \t]?(?!\s*\d+\s*/)\S.*$")),
    ("markdown", "strong", re.compile(r"(?<![A-Za-z0-9*])\*\*(?=[^\s*])[^*\n]+?(?<=\S)\*\*(?!\*)|(?<![A-Za-z0-9_])__(?=[^\s_])[^_\n]+?(?<=\S)__(?![A-Za-z0-9_])")),
    ("markdown", "emphasis", re.compile(r"(?<![A-Za-z0-9*\\])\*[㐀-鿿]+\*(?![A-Za-z0-9*])|(?<![\w*\\])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?![\w_])")),
    ("markdown", "strike", re.compile(r"~~(?=\S)[^~\n]+?(?<=\S)~~")),
    ("wiki", "table", re.compile(r"(?m)^[ \t]*\{\|.*$|^[ \t]*\|-+[ \t]*$|^[ \t]*\|\}|^[ \t]*!(?!\[)[^\n]*!![^\n]*$|^[ \t]*\|[^|\n]+\|\|[^\n]*$")),
    ("wiki", "heading", re.compile(r"(?m)^[ \t]*(={1,6})(?!=)[^\n=]+\1[ \t]*$")),
    ("wiki", "template", re.compile(r"\{\{(?![{\s])(?:[^{}]|\{\{[^{}]*\}\})+\}\}")),
    ("wiki", "link", re.compile(r"\[\[(?:[^\[\]|\n]+\|[^\[\]\n]*|[A-Za-z]+:[^\[\]\n]+|[^\[\]\n]+)\]\]")),
    ("wiki", "quotes", re.compile(r"(?<!')'{2,3}(?=[^\s'])[^'\n]+?(?<=[^\s'])'{2,3}(?!')")),
    ("wiki", "external", re.compile(r"\[https?://[^\[\]\s]+[^\[\]\n]*\]")),
    ("latex", "display", re.compile(r"\$\$(?=[^$]*[\\^_={}A-Za-z])[^$]+\$\$|\\\[(?:(?!\\\[).)*?\\\]", re.S)),
    ("latex", "inline", re.compile(r"\\\((?:(?!\\\()[^\n])*?\\\)|(?<![\\$])\$(?=[^\s$])(?=[^$\n]*[\\^_{}])[^$\n]+?(?<=[^\s\\])\$(?![\d$])|(?<![\\$\w])\$[A-Za-z]\$(?![\d$])")),
    ("latex", "environment", re.compile(r"\\begin\{[a-zA-Z]+\*?\}|\\end\{[a-zA-Z]+\*?\}")),
    ("latex", "command", re.compile(r"\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?(?:\{(?:[^{}\n]|\{[^{}\n]*\})*\})*|\\[&%$#_{}](?!\w)|\\\\[ \t]*(?:\\hline)?[ \t]*$", re.M)),
]


# what a text must hold for a construct to be looked for; a construct that is not here is always looked for
_TRIGGERS = {
    ("markdown", "strong"): ("**", "__"), ("markdown", "emphasis"): ("*", "_"), ("markdown", "link"): ("](",), ("markdown", "heading"): ("#",), ("markdown", "underlined"): ("===", "---"), ("markdown", "rule"): ("*", "_", "---"),
    ("markdown", "table"): ("|",), ("markdown", "quote"): (">",), ("wiki", "table"): ("{|", "|-", "|}", "!!", "||"), ("wiki", "heading"): ("=",), ("wiki", "quotes"): ("''",), ("latex", "display"): ("$$", "\\["), ("latex", "inline"): ("$", "\\("),
}


def _may_hold(text: str, kind: str, name: str) -> bool:
    signs = _TRIGGERS.get((kind, name))
    return signs is None or any(x in text for x in signs)


def _masked(text: str) -> tuple[str, list[tuple[str, str, int, int]]]:
    """The text with what stands inside code replaced by \\0, and the code elements."""
    found = []

    def over(m: re.Match, a: int, b: int, kind: str, name: str) -> str:
        found.append((kind, name, m.start(), m.end()))
        s = m[0]
        return s[: a - m.start()] + re.sub(r"[^\n]", "\0", s[a - m.start() : b - m.start()]) + s[b - m.start() :]

    if "```" in text or "~~~" in text:
        text = _FENCE.sub(lambda m: over(m, m.start(), m.end(), "markdown", "fence"), text)
    if "`" in text:
        text = _SPAN.sub(lambda m: over(m, m.start(), m.end(), "markdown", "code"), text)
    for m in reversed(list(_RAW.finditer(text))) if "<" in text or "\\begin" in text else ():
        g = 2 if m[2] is not None else 4
        text = text[: m.start(g)] + re.sub(r"[^\n]", "\0", m[g]) + text[m.end(g) :]
    return text, found


def _html(text: str) -> list[tuple[str, str, int, int]]:
    tags = [(m[1] == "/", m[2].lower(), m[3].strip(), m.start(), m.end()) for m in _TAG.finditer(text)]
    ended = {n for end, n, *_ in tags if end}
    sure = {n for end, n, attrs, *_ in tags if end or attrs or n not in _LETTERS}
    tables = bool(sure & {"table", "tr", "td", "th", "tbody", "thead"})
    out, open_ = [], []
    for end, n, attrs, a, b in tags:
        if n in _LETTERS and not attrs and n not in ended and not (tables and n in ("td", "th", "tr")):
            continue
        if end:
            k = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == n), None)
            if k is None:
                out.append(("html", n, a, b))
            else:
                out.append(("html", n, open_[k][1], b))
                # what was left open inside is its tag alone
                out.extend(("html", x, s, z) for x, s, z in open_[k + 1 :])
                del open_[k:]
        elif n in _VOID or attrs.endswith("/"):
            out.append(("html", n, a, b))
        else:
            open_.append((n, a, b))
    return out + [("html", n, a, z) for n, a, z in open_]


def elements(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, start, end) of each construct. Empty for plain text; signs used as text are none."""
    masked, found = _masked(text)
    found += _html(masked)
    for kind, name, pattern in _CONSTRUCTS:
        for m in pattern.finditer(masked) if _may_hold(masked, kind, name) else ():
            if kind == "wiki" and name == "link" and "|" not in m[0] and ":" not in m[0] and _IPA.search(m[0]):
                continue  # a narrow transcription in double brackets
            if name in ("emphasis", "strong") and _IPA.search(m[0]) and m[0].startswith("*") and not m[0].startswith("**"):
                continue  # starred forms
            if name == "entity" and not m[0].startswith("&#") and html.unescape(m[0]) == m[0]:
                continue
            found.append((kind, name, m.start(), m.end()))
    return found


_ANY_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--|-->")


def subtree_hashes(text: str, found: list[tuple[str, str, int, int]]) -> list[int]:
    """The hash of each element's subtree, in the order of `found`; linear in the text and the elements.

    An element lies in the innermost one that holds it whole; those that overlap are neighbours.
    """
    out = [0] * len(found)
    order = sorted(range(len(found)), key=lambda i: (found[i][2], -found[i][3]))
    open_: list[list] = []  # [element, place so far, parts]

    def words(a: int, z: int) -> str:
        return " ".join(_ANY_TAG.sub(" ", text[a:z]).split())

    def close() -> None:
        i, at, parts = open_.pop()
        kind, name, a, z = found[i]
        h = xxhash.xxh64_intdigest("\0".join((kind, name, *parts, words(at, z))).encode("utf-8", "surrogatepass"))
        out[i] = h - (1 << 64) if h >> 63 else h
        if open_:
            up = open_[-1]
            if z <= found[up[0]][3]:
                up[2] += [words(up[1], a), str(h)]
                up[1] = max(up[1], z)

    for i in order:
        while open_ and found[open_[-1][0]][3] < found[i][3]:
            close()
        open_.append([i, found[i][2], []])
    while open_:
        close()
    return out


ELEMENT = "table_name string, rec_id long, host string, kind string, name string, start int, stop int, subtree long"


def _parse(table: str):
    names = [c.strip().split(" ")[0] for c in ELEMENT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rec, host, text in zip(b["rec_id"], b["host"], b["text"]):
                text = visible(text)
                found = elements(text)
                rows.extend((table, rec, host, *e, h) for e, h in zip(found, subtree_hashes(text, found)))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return run


def element_rows(df: DataFrame, rec: str, host: str, text: str, table: str = "") -> DataFrame:
    """The elements of every text that is not null and has an id; places are those in its `visible` form."""
    few = df.where(F.col(text).isNotNull() & F.col(rec).isNotNull()).select(F.col(rec).alias("rec_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    return few.mapInPandas(_parse(table), ELEMENT)


def template_subtrees(rows: DataFrame, pages: int = 5, share: float = 0.02) -> DataFrame:
    """(table_name, host, subtree, n_pages): element subtrees on at least `pages` pages and `share` of the marked-up pages of their host.

    Entities and bare line elements are never templates. Null hosts have none.
    """
    whole = rows.where("host is not null and not (name in ('entity', 'br', 'hr', 'rule', 'environment', 'command') or stop - start < 12)")
    n = whole.groupBy("table_name", "host", "subtree").agg(F.count_distinct("rec_id").alias("n_pages")).where(F.col("n_pages") >= pages)
    total = rows.where("host is not null").groupBy("table_name", "host").agg(F.count_distinct("rec_id").alias("of"))
    return n.join(total, ["table_name", "host"]).where(F.col("n_pages") >= F.col("of") * share).select("table_name", "host", "subtree", "n_pages")


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cut, rest) of materialised element rows: elements that are templates of their host, and all others."""
    key = ["table_name", "host", "subtree"]
    templates = materialize(template_subtrees(rows).select(*key), "templates")
    cut = rows.where(~F.col("name").isin(_STAYS)).join(templates, key, "left_semi")
    rest = rows.where(F.col("name").isin(_STAYS)).unionByName(rows.where(~F.col("name").isin(_STAYS)).join(templates, key, "left_anti"))
    return cut, rest


def kinds(rows: DataFrame) -> DataFrame:
    """(table_name, rec_id, kind, own): the kinds of markup of each text; own is false where only templates of its host bear it."""
    cut, rest = parted(rows)
    both = rest.select("table_name", "rec_id", "kind", F.lit(True).alias("own")).union(cut.select("table_name", "rec_id", "kind", F.lit(False)))
    return both.groupBy("table_name", "rec_id", "kind").agg(F.bool_or("own").alias("own"))


# ---- clean text


def _table_text(inner: str) -> str:
    rows = re.split(r"(?i)<tr\b[^>]*>", inner)
    out = []
    for r in rows:
        cells = re.split(r"(?i)<t[dh]\b[^>]*>", r)[1:]
        if cells:
            out.append(" | ".join(" ".join(re.sub(r"<[^>]*>", " ", c).split()) for c in cells))
    return "\n" + "\n".join(out) + "\n"


def clean_text(text: str, cut: list[tuple[int, int]] = ()) -> str:
    """Plain text: headings as `# title`, items as `- item`, table rows as `a | b`, code and formulas as they stand.

    cut: places (in the `visible` form) to leave out, templates of the site.
    """
    text = visible(text)
    for a, z in sorted(cut, reverse=True):
        text = text[:a] + re.sub(r"[^\n]", "", text[a:z]) + text[z:]
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x01{len(kept) - 1}\x02"

    text = _FENCE.sub(lambda m: keep(m[0]), text)
    text = _SPAN.sub(lambda m: keep(m[2]), text)
    text = re.sub(r"\$\$[^$]+\$\$|\\\[(?:(?!\\\[).)*?\\\]|\\\((?:(?!\\\()[^\n])*?\\\)", lambda m: keep(m[0]), text, flags=re.S)
    text = next(p for k, n, p in _CONSTRUCTS if n == "inline").sub(lambda m: keep(m[0]), text)
    # html
    text = re.sub(r"<!--.*?(?:-->|\Z)", "", text, flags=re.S)
    text = re.sub(r"(?is)<(script|style)\b(?:(?!<\1\b).)*?</\1\s*>", "", text)
    text = re.sub(r"(?is)<table\b[^>]*>(.*?)(?:</table\s*>|\Z)", lambda m: _table_text(m[1]), text)
    if re.search(r"(?i)<tr\b", text):
        text = re.sub(r"(?is)<tr\b.*</t[dhr]\s*>", lambda m: _table_text(m[0]), text)
    text = re.sub(r"(?is)<h([1-6])\b[^<>]*>((?:(?!<h[1-6]\b).)*?)</h[1-6]\s*>", lambda m: f"\n{'#' * int(m[1])} {m[2].strip()}\n", text)
    text = re.sub(r"(?i)<li\b[^>]*>", "\n- ", text)
    text = re.sub(r"(?i)<(br|hr|p|div|/p|/div|/ul|/ol|/tr)\b[^>]*>", "\n", text)
    real = {(a, z) for kind, name, a, z in _html(text) if kind == "html"}
    starts, ends = {a for a, _ in real}, {z for _, z in real}
    text = _TAG.sub(lambda m: "" if m.start() in starts or m.end() in ends else m[0], text)
    text = html.unescape(text).replace("\xa0", " ")
    # wiki
    for _ in range(3):
        text = re.sub(r"\{\{(?:[^{}|]*\|)*([^{}|]*)\}\}", lambda m: m[1].split("=", 1)[-1], text)
    text = re.sub(r"\[\[(?:File|Image|Category):[^\[\]]*?\|?([^\[\]|]*)\]\]", lambda m: m[1] if "." not in m[1] else "", text)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", lambda m: m[0] if _IPA.search(m[0]) and "|" not in m[0] else m[1], text)
    text = re.sub(r"(?m)^[ \t]*(={1,6})(?!=)([^\n=]+)\1[ \t]*$", lambda m: f"{'#' * len(m[1])} {m[2].strip()}", text)
    text = re.sub(r"(?m)^[ \t]*(?:\{\|.*|\|-+|\|\})[ \t]*$\n?", "", text)
    text = re.sub(r"(?m)^[ \t]*[!|]([^\n|!]+(?:\|\||!!)[^\n]*)$", lambda m: re.sub(r"\s*(\|\||!!)\s*", " | ", m[1].strip()), text)
    text = re.sub(r"(?<!')'{2,3}(?=[^\s'])([^'\n]+?)'{2,3}(?!')", r"\1", text)
    # latex
    text = re.sub(r"\\(?:chapter|section|(sub){1,2}section)\*?\{([^{}\n]*)\}", lambda m: f"# {m[2]}", text)
    text = re.sub(r"\\begin\{tabular\}\{[^}]*\}|\\(?:begin|end)\{[a-zA-Z]+\*?\}", "", text)
    text = re.sub(r"\\item\b[ \t]*", "- ", text)
    text = re.sub(r"(?m)[ \t]*\\\\[ \t]*(?:\\hline)?[ \t]*$", lambda m: "", text)
    text = re.sub(r"(?m)^(?=[^\n]* & )([^\n]*)$", lambda m: m[1] if re.search(r"\d & ", m[1]) and m[1].count(" & ") == 1 and "$" in m[1] else m[1].replace(" & ", " | "), text)
    for _ in range(3):
        text = re.sub(r"~?\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}", r"\1", text)
    text = re.sub(r"\\([&%$#_{}])", r"\1", text)
    text = re.sub(r"\\(?:hline|noindent|par|newline|centering)\b", "", text)
    # markdown
    text = re.sub(r"!?\[([^\[\]\n]+)\]\((?=[^()\s]*[./#:])[^()\s]+(?:\s+\"[^\"\n]*\")?\)", r"\1", text)
    text = re.sub(r"\[\^[^\[\]\s]+\]", "", text)
    text = re.sub(r"(?m)^(?![ \t]*(?:[-=|+*>#]|$))([^\n]+)\n {0,3}(={3,}|-{3,})[ \t]*$", lambda m: ("# " if m[2][0] == "=" else "## ") + m[1].strip(), text)
    text = re.sub(r"(?m)^[ \t]*(?:\|[ \t]*)?:?-{3,}:?[ \t]*\|[ \t:|-]*$\n?", "", text)
    text = re.sub(r"(?m)^[ \t]*\|(?!\|)(.*)\|[ \t]*$", lambda m: " | ".join(x.strip() for x in m[1].split("|")), text)
    text = re.sub(r"(?m)^[ \t]*[*+][ \t]+(?=\S)", "- ", text)
    text = re.sub(r"(?m)^ {0,3}>[ \t]?(?!\s*\d+\s*/)", "", text)
    for n in ("strong", "emphasis", "strike"):
        p = next(p for k, name, p in _CONSTRUCTS if name == n)
        text = p.sub(lambda m: m[0] if _IPA.search(m[0]) and m[0][0] == "*" and m[0][1] != "*" else m[0].strip("*_~"), text)
    text = re.sub("\x01(\\d+)\x02", lambda m: kept[int(m[1])], text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", text, flags=re.M)).strip()


def clean_texts(df: DataFrame, rec: str, host: str, text: str) -> DataFrame:
    """(rec, kinds, n_template, clean): clean text of each row, without the templates of its host.

    A recurring part of a table, code or formula is content and stays; only a template around it takes it along. kinds: sorted kinds of markup found. Null texts stay null with no kinds; empty ones stay empty.
    """
    rows = materialize(element_rows(df, rec, host, text), "elements")
    cut = parted(rows)[0].groupBy("rec_id").agg(F.collect_set(F.struct("start", "stop")).alias("cut"))
    found = rows.groupBy("rec_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds")).join(cut, "rec_id", "left")

    @F.pandas_udf("string")
    def clean(s: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for t, c in zip(s, places):
            spans = [] if c is None else sorted({(x["start"], x["stop"]) for x in c})
            outer = [x for x in spans if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in spans)]
            out.append(None if t is None else clean_text(t, outer))
        return pd.Series(out, dtype=object)

    both = df.select(F.col(rec).alias("rec_id"), F.col(text).alias("__text")).join(found, "rec_id", "left")
    return both.select(
        F.col("rec_id").alias(rec), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), F.coalesce(F.size("cut"), F.lit(0)).alias("n_template"), clean("__text", "cut").alias("clean")
    )
