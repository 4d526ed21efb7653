"""Projections of stored requests and responses: texts, secrets, endpoints, error classes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: names and values that are credentials
SECRET_KEY = re.compile(r"api[_-]?key|apikey|secret|token|passwd|password|credential|authorization|bearer|cookie", re.I)
SECRET_VALUE = re.compile(r"sk-[A-Za-z0-9_\-]{8,}|ghp_[A-Za-z0-9]{8,}|xox[baprs]-[A-Za-z0-9\-]{8,}|AKIA[0-9A-Z]{12,}|Bearer\s+[A-Za-z0-9._\-]{8,}")
# fixed values: other names of the endpoints
ENDPOINTS = {"chat/completions": "chat", "/v1/chat/completions": "chat", "/v1/responses": "responses", "anthropic": "messages", "/v1/messages": "messages"}
# fixed values: keys under which a raw stream is stored
_RAW = ("_raw_stream", "raw_stream")


def stored_text(data) -> str:
    """The text of a stored page: the chat message, else `text`, else `content`, else all values named `text`, each once."""
    if isinstance(data, dict):
        try:
            message = data["transcript_response"]["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError):
            message = None
        for own in (message, data.get("text"), data.get("content")):
            if isinstance(own, str):
                return own
    found: dict[str, None] = {}
    todo = [("", data)]
    while todo:
        key, value = todo.pop()
        if key in _RAW:
            continue
        if key == "text" and isinstance(value, str):
            found[value] = None
        elif isinstance(value, dict):
            todo.extend((str(k), v) for k, v in reversed(value.items()))
        elif isinstance(value, list):
            todo.extend((key, v) for v in reversed(value))
    return "\n".join(found)


def _paths(data: dict, above: tuple[str, ...] = ()):
    """(path, value) of every member of nested objects, outer ones before their members; lists are values."""
    for key, value in data.items():
        path = (*above, str(key))
        yield path, value
        if isinstance(value, dict):
            yield from _paths(value, path)


def without_secrets(data: dict) -> tuple[dict, list[str]]:
    """(copy, dropped paths). A member goes, with all it holds, if its name is one of a credential, or its value is text that looks like one.

    What looks like a credential inside lists stays, as lists are not searched.
    """
    dropped: dict[tuple[str, ...], None] = {}
    kept: dict = {}
    for path, value in _paths(data):
        if any(path[:n] in dropped for n in range(1, len(path))):
            continue
        if SECRET_KEY.search(path[-1]) or (isinstance(value, str) and SECRET_VALUE.search(value)):
            dropped[path] = None
            continue
        at = kept
        for name in path[:-1]:
            at = at[name]
        at[path[-1]] = {} if isinstance(value, dict) else value
    return kept, [".".join(p) for p in dropped]


def _parts(value, kinds: tuple[str, ...]) -> list[str]:
    return [p["text"] for p in value if isinstance(p, dict) and p.get("type", "text") in kinds and isinstance(p.get("text"), str)] if isinstance(value, list) else []


def response_text(data) -> str:
    """The text of a model's response in any of the three shapes; '' where there is none."""
    if not isinstance(data, dict):
        return ""
    out = []
    for item in data.get("output") or []:
        if isinstance(item, dict):
            out += _parts(item.get("content"), ("output_text", "text")) + [t for t in [item.get("text")] if isinstance(t, str)]
    content = data.get("content")
    out = out or _parts(content, ("text",)) or [content] * isinstance(content, str)
    if out:
        return "\n".join(out).strip()
    choices = data.get("choices")
    if isinstance(choices, list) and choices and isinstance(choices[0], dict):
        content = (choices[0].get("message") or {}).get("content", "")
        return ("".join(_parts(content, ("text",))) if isinstance(content, list) else str(content or "")).strip()
    return data["output_text"].strip() if isinstance(data.get("output_text"), str) else ""


def _on_json(f, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else f(json.loads(t))
            except ValueError:
                return None

        return pd.Series([one(t) for t in s], dtype=object)

    return run


stored_text_of = _on_json(stored_text, T.StringType())
response_text_of = _on_json(response_text, T.StringType())
public_json = _on_json(lambda d: json.dumps(without_secrets(d)[0], ensure_ascii=False) if isinstance(d, dict) else None, T.StringType())
dropped_secrets = _on_json(lambda d: without_secrets(d)[1] if isinstance(d, dict) else [], T.ArrayType(T.StringType()))


def endpoint(c: Column) -> Column:
    """The plain name of an endpoint; null and empty mean `chat`."""
    e = F.lower(F.trim(F.coalesce(F.nullif(c, F.lit("")), F.lit("chat"))))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in ENDPOINTS.items() for x in kv))[e], e)


def resolution(c: Column) -> Column:
    """A whole number from 72 to 300, else null."""
    n = c.try_cast("int")
    return F.when(n.between(72, 300), n)


def error_class(status: Column, message: Column) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(status.isin(401, 403), "UNAUTHORIZED")
        .when((status == 400) & text.contains("model not found"), "MODEL_NOT_FOUND")
        .when(status == 429, "RATE_LIMITED")
        .when(status.between(500, 599), "GATEWAY_5XX")
        .when(status.isNull() & F.ltrim(text).startswith("<") & text.rlike("<html|<!doctype"), "BAD_GATEWAY_HTML")
        .when(status.isNull(), "TIMEOUT")
        .otherwise("UNKNOWN")
    )


def first_value(json_text: str, keys: list[str], default: str) -> Column:
    """The first value that is there under any of several spellings of a setting, else the default."""
    return F.coalesce(*(F.get_json_object(json_text, f"$.{k}") for k in keys), F.lit(default))
