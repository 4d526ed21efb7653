"""Rules of phonetic notation as text gates: counts by built-ins, issues with their places by an Arrow UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the notation rules, (code, pattern)
RULES = {
    "latex_residue": r"\\(?:underset|overset)\b|(?<!\\)\$|\\\[|\\\]",
    "banned_bracket_mark": r"\[[^\]\r\n]*[_^][^\]\r\n]*\]",
    "dropped_attached_mark": r"\[(?:tɕ'?|tc'?|[tkdp])[wW]\]",
    "ascii_modifier_letter": r"\[(?:[kpt][hH]|[ɕnl][jJ])\]",
    "split_combining_mark": r"[A-Za-zɕŋəɛɔɑβʔʂʐɖɳɭɰɣʃʒɹɿʅɦɥɤɲ'’]\s+[ʷʰʲː̃̚ˈˌ\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]",
    "stray_combining_mark": r"(?m)(?:^|[\s\u3000-\u303f\uff00-\uffef.,;:!?，。；：“”‘’（）|(){}\[\]])[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]",
    "ascii_position_operator": r"(?<!\\)[_^]",
}
_COMPILED = {k: re.compile(p) for k, p in RULES.items()}
_SPAN = re.compile(r"\[[^\[\]\r\n]*\]")
_CLOSES = {")": "(", "]": "[", "}": "{"}

ISSUE = T.ArrayType(
    T.StructType([T.StructField("code", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("line", T.IntegerType()), T.StructField("snippet", T.StringType())])
)


def unbalanced(text: str) -> list[int]:
    """Places of brackets without a partner. A backslash hides the next character; a closer that does not fit removes nothing."""
    waiting: list[int] = []
    alone: list[int] = []
    hidden = False
    for i, ch in enumerate(text):
        if hidden or ch == "\\":
            hidden = not hidden
        elif ch in "([{":
            waiting.append(i)
        elif ch in _CLOSES:
            if waiting and text[waiting[-1]] == _CLOSES[ch]:
                waiting.pop()
            else:
                alone.append(i)
    return alone + waiting


def find_issues(text: str | None) -> list[dict]:
    """All issues of a text by place, then code; null and empty texts have none."""
    if not text:
        return []
    inside: set[int] = set()
    for m in _SPAN.finditer(text):
        inside.update(range(m.start() + 1, m.end()))
    found = [(m.start(), code) for code, p in _COMPILED.items() for m in p.finditer(text) if code != "ascii_position_operator" or m.start() not in inside]
    found += [(i, "unbalanced_brackets") for i in unbalanced(text)]
    breaks = [i for i, ch in enumerate(text) if ch == "\n"]
    import bisect

    return [{"code": c, "position": i, "line": bisect.bisect_left(breaks, i) + 1, "snippet": text[max(0, i - 24) : i + 48].replace("\n", " ")} for i, c in sorted(found)]


@F.pandas_udf(ISSUE)
def issues(s: pd.Series) -> pd.Series:
    return s.map(find_issues)


def rule_counts(c: Column) -> dict[str, Column]:
    """How often the rules that need no place are broken, all inside the JVM.

    Unescaped signs are counted as all signs less the escaped ones; position operators after bracket spans are taken out.
    """
    n = lambda x, p: F.regexp_count(x, F.lit(p)).cast("long")
    outside = F.regexp_replace(c, r"\[[^\[\]\r\n]*\]", "")
    return {
        "latex_residue": n(c, r"\\(?:underset|overset)\b|\\\[|\\\]") + n(c, r"\$") - n(c, r"\\\$"),
        "banned_bracket_mark": n(c, RULES["banned_bracket_mark"]),
        "dropped_attached_mark": n(c, RULES["dropped_attached_mark"]),
        "ascii_modifier_letter": n(c, RULES["ascii_modifier_letter"]),
        "ascii_position_operator": n(outside, "[_^]") - n(outside, r"\\[_^]"),
    }


def mark_counts(c: Column) -> dict[str, Column]:
    """How often combining marks are split from their letter, or stand alone; blanks of every kind count."""
    return {k: F.regexp_count(c, F.lit("(?U)" + RULES[k])).cast("long") for k in ("split_combining_mark", "stray_combining_mark")}
