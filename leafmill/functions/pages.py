"""Markdown pages: cleaning that leaves code and formulas alone, page blocks, and books made of pages."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: what is kept byte for byte (footers, code, formulas), in the order it is looked for
FOOTER = r"(?m)^[ \t]*[·.]\s*\d+\s*[·.][ \t]*$"
CODE = r"```[\s\S]*?```|`[^`\n]*`"
FORMULA = r"(?<!\\)(?:\\\[[^\]]*\\\]|\\\([^)]*\\\)|\$[^\$\n]*\$|\\(?:underset|overset|text|mathrm|mathbf|mathit|frac|sqrt)\s*(?:\{(?:[^{}]|\{[^{}]*\})*\}|[^\s]+)(?:\s*\{(?:[^{}]|\{[^{}]*\})*\})?|\^\{(?:[^{}]|\{[^{}]*\})*\}|_\{(?:[^{}]|\{[^{}]*\})*\})"
_KEPT = [re.compile(p) for p in (FOOTER, CODE, FORMULA)]
_LOCAL_IMAGE = re.compile(r"!\[[^\]]*\]\((?!https?://|data:)[^)]+\)", re.I)
_BARE_FOOTER = re.compile(r"[ \t]*[·.]\s*\d+\s*[·.][ \t]*")
_WIDE = dict(zip(",.;:()", "，。；：（）"))
_LABEL = re.compile(r"(?:(前言|目录|前置)\s+)?第\s*(\d+)\s*页|(?:page|p)\s*(\d+)|(封面|内封|扉页|扉頁|版权页|版權頁)", re.I)
_MODERN = {"扉頁": "扉页", "版權頁": "版权页"}
_MARKER = re.compile(r"<!--\s*PAGE\s+(\d+)\s*-->", re.I)
_INDEX_ITEM = re.compile(r"-\s*Page\s+\d+\s*:\s*PAGE\s+\d+\s*", re.I)
_NUMBER = re.compile(r"第\s*(\d+)\s*页")
_MARK = "\ue000%d\ue001"


def _outside_kept(text: str, change) -> str:
    """`change` applied to what is neither footer, code nor formula."""
    kept: list[str] = []

    def away(m: re.Match) -> str:
        kept.append(m[0])
        return _MARK % (len(kept) - 1)

    for p in _KEPT:
        text = p.sub(away, text)
    text = change(text)
    for i, s in enumerate(kept):
        text = text.replace(_MARK % i, s)
    return text


def _is_han(ch: str) -> bool:
    return "\u3400" <= ch <= "\u9fff"


def punctuate(text: str) -> str:
    """Full-width marks beside ideographs, paired quotes.

    One flag serves both kinds of quotes, and a closing single quote becomes a double one: kept as users know it.
    """
    padded = f" {text} "
    out, opens = [], True
    for before, ch, after in zip(padded, text, padded[2:]):
        if ch in _WIDE:
            ch = _WIDE[ch] if _is_han(before) or _is_han(after) else ch
        elif ch == "'" and before.isalnum() and after.isalnum():
            ch = "’"
        elif ch in "\"'":
            ch = ("“" if ch == '"' else "‘") if opens else "”"
            opens = not opens
        out.append(ch)
    return "".join(out)


def tidy_lines(text: str) -> str:
    lines = [x.rstrip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    lines = [x.strip() if _BARE_FOOTER.fullmatch(x) else x for x in lines]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def clean_markdown(text: str) -> str:
    return tidy_lines(_outside_kept(text, punctuate))


def clean_page(text: str) -> str:
    """Local images replaced by a note, then `clean_markdown`. Cleaning twice changes nothing more."""
    return clean_markdown(_outside_kept(text, lambda t: _LOCAL_IMAGE.sub("[图片]", t)))


def label_of(line: str) -> str | None:
    """A page's label in its standard form, or None."""
    m = _LABEL.fullmatch(line.strip())
    if not m:
        return None
    prefix, number, latin, cover = m.groups()
    if cover:
        return _MODERN.get(cover, cover)
    return f"{prefix + ' ' if prefix else ''}第 {int(number or latin)} 页"


def _rule(line: str) -> bool:
    return line.strip() == "---"


def _trim(lines: list[str]) -> list[str]:
    """Without blank lines and rules at both ends."""
    full = [i for i, x in enumerate(lines) if x.strip() and not _rule(x)]
    return lines[full[0] : full[-1] + 1] if full else []


@dataclass
class Block:
    label: str
    body: str


def page_blocks(text: str) -> tuple[list[str], list[Block]]:
    """(title lines, blocks) of a text with page labels or markers.

    A label counts at the very beginning or below a rule; elsewhere it is prose. A marker and a label that follows it with
    only blanks and rules between are one page. Old page indexes are dropped.
    """
    lines, index = [], False
    for x in clean_page(text).split("\n"):
        if x.strip().lower() == "## page index":
            index = True
        elif not (index and (not x.strip() or _INDEX_ITEM.fullmatch(x.strip()))):
            index = False
            lines.append(x)
    starts: list[tuple[int, int, str]] = []  # line of the label, first line of the body, label
    above, marker_open = None, False
    for i, x in enumerate(lines):
        if not x.strip():
            continue
        m = _MARKER.fullmatch(x.strip())
        label = label_of(x)
        if m:
            if not marker_open:
                starts.append((i, i + 1, f"第 {int(m[1])} 页"))
            marker_open = True
        elif label and marker_open:
            a, _, own = starts[-1]
            starts[-1] = (a, i + 1, own)
            marker_open = False
        elif label and (above is None or _rule(above)):
            starts.append((i, i + 1, label))
        elif not _rule(x):
            marker_open = False
        above = x
    if not starts:
        return lines, []
    ends = [a for a, _, _ in starts[1:]] + [len(lines)]
    return _trim(lines[: starts[0][0]]), [Block(label, "\n".join(_trim(lines[b:e]))) for (_, b, label), e in zip(starts, ends)]


def _page(label: str, body: str) -> str:
    return "\n\n".join(x for x in (f"---\n{label}", body, "---") if x)


def clean_book(text: str) -> str:
    """A book in standard page blocks; sorted if all labels have numbers; no page is made up."""
    title, blocks = page_blocks(text)
    if not blocks:
        return clean_page("\n".join(title))
    numbers = [_NUMBER.search(b.label) for b in blocks]
    if all(numbers):
        blocks = [b for _, _, b in sorted((int(m[1]), i, b) for i, (m, b) in enumerate(zip(numbers, blocks)))]
    head = "\n".join(_trim(title)).strip()
    return "\n\n".join([*([head] if head else []), *(_page(b.label, clean_page(b.body)) for b in blocks)]).rstrip() + "\n"


def page_document(text: str, label: str) -> tuple[str, str]:
    """(label, body) of one page's file; what stands above its marker is kept."""
    title, blocks = page_blocks(text)
    if not blocks:
        return label, clean_page(text)
    above = "\n".join(_trim(title)).strip()
    return blocks[0].label, clean_page("\n\n".join(x for x in (above, blocks[0].body) if x))


def merge_pages(pages: dict[int, str], title: str) -> str:
    """The book of some pages (numbered from 1), in order, without filling gaps."""
    head = clean_markdown(title).strip()
    parts = [f"# {head.lstrip('#').strip()}"] if head else []
    parts += [_page(*page_document(pages[n], f"第 {n} 页")) for n in sorted(pages)]
    return clean_book("\n\n".join(parts) + ("\n" if parts else ""))


# fixed values: the markup that alignment texts are stripped of, in order; a link's text is kept, an image's too
_STRIP = [
    (re.compile(r"(?m)^\s{0,3}#{1,6}\s+"), ""), (re.compile(r"(?m)^\s*[-*+]\s+"), ""), (re.compile(r"(\*\*|__)(.*?)\1"), r"\2"),
    (re.compile(r"(`+)(.*?)\1"), r"\2"), (re.compile(r"!?\[([^\]]*)\]\((?:[^()\[\]]*)\)"), r"\1"),
]


def _is_row(line: str) -> bool:
    return line[:1] == "|" and line[-1:] == "|" and line[:2] != "||" and line.count("|") >= 2


def plain_markdown(text: str) -> str:
    """Text to align by: no marks, table rows as their cells, no blank lines, composed form. Pipes of notation stay."""
    out = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        for p, to in _STRIP:
            line = p.sub(to, line)
        if _is_row(line.strip()):
            line = " ".join(c.strip() for c in line.strip().strip("|").split("|") if c.strip())
        if line.strip():
            out.append(line.rstrip())
    return unicodedata.normalize("NFC", "\n".join(out))


def headings(text: str) -> list[tuple[int, str]]:
    found = (re.match(r"(#{1,6})\s+(.+)$", x.strip()) for x in text.splitlines())
    return [(len(m[1]), m[2].strip()) for m in found if m and m[2].strip()]


_DECIMAL = re.compile(r"[·.\-—–\s]*(\d{1,4})[·.\-—–\s]*$|第\s*(\d{1,4})\s*页$")
_ROMAN = re.compile(r"[·.\-—–\s]*([ivx]{1,8})[·.\-—–\s]*$", re.I)
_ROMANS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}


def printed_number(text: str | None, footers: list[str]) -> tuple[str, int] | None:
    """(style, number) printed on a page: footers first, then the last three lines, then the first. Decimal before Roman."""
    lines = [x.strip() for x in (text or "").splitlines() if x.strip()]
    tries = [x.strip() for x in footers] + lines[-3:] + lines[:1]
    for t in tries:
        m = _DECIMAL.match(t)
        if m and 1 <= int(m[1] or m[2]) <= 3000:
            return "D", int(m[1] or m[2])
    for t in tries:
        m = _ROMAN.match(t)
        if m and m[1].lower() in _ROMANS:
            return "r", _ROMANS[m[1].lower()]
    return None


def _text_udf(f):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f(t))

    return run


clean_page_text = _text_udf(clean_page)
clean_book_text = _text_udf(clean_book)
plain_markdown_text = _text_udf(plain_markdown)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("title", T.StringType())])))
def heading_list(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [] if t is None else [{"level": n, "title": x} for n, x in headings(t)])


def printed_page_number(text, footers):
    """struct(style, number) of a page, null where none is printed, as `printed_number`, all by built-ins."""
    from leafmill.functions.text import BLANK, strip_blanks, unix_lines

    full = F.filter(F.transform(F.split(unix_lines(F.coalesce(text, F.lit(""))), "\n"), strip_blanks), lambda x: x != "")
    tries = F.concat(F.transform(footers, strip_blanks), F.slice(full, F.greatest(F.lit(1), F.size(full) - 2), F.lit(3)), F.slice(full, F.lit(1), F.lit(1)))
    edge = f"(?:[·.—–-]|{BLANK})*"
    digits = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, f"^{edge}([0-9]{{1,4}}){edge}$", 1), F.lit("")), F.nullif(F.regexp_extract(x, f"^第{BLANK}*([0-9]{{1,4}}){BLANK}*页$", 1), F.lit(""))).try_cast("int")
    names = F.array(*map(F.lit, _ROMANS))
    roman = lambda x: F.array_position(names, F.lower(F.regexp_extract(x, f"(?i)^{edge}([ivx]{{1,8}}){edge}$", 1))).cast("int")
    decimal = F.try_element_at(F.filter(F.transform(tries, digits), lambda n: n.between(1, 3000)), F.lit(1))
    other = F.try_element_at(F.filter(F.transform(tries, roman), lambda n: n > 0), F.lit(1))
    style = F.when(decimal.isNotNull(), "D").when(other.isNotNull(), "r")
    return F.struct(style.alias("style"), F.coalesce(decimal, other).alias("number"))
