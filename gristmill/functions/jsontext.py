"""JSON objects out of model replies. Balanced braces have no regular expression, hence an Arrow function."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORDS = {"None": "null", "True": "true", "False": "false"}
_QUOTED = re.compile(r'\\.|"|[{}]', re.S)


def balanced(text: str) -> str | None:
    """From the first brace to the one that closes it; braces in strings don't count."""
    start = text.find("{")
    depth, quoted = 0, False
    for found in _QUOTED.finditer(text, start) if start >= 0 else ():
        mark = found[0]
        if mark == '"':
            quoted = not quoted
        elif not quoted and mark[0] in "{}":
            depth += 1 if mark == "{" else -1
            if not depth:
                return text[start : found.end()]
    return None


def candidates(reply: str) -> Iterator[str]:
    """Parts of a reply that may be JSON, the likeliest first: all, fenced blocks, the first balanced object."""
    head, close, rest = reply.strip().rpartition("</think>")
    reply = rest.strip() if close and "<think>" in head else reply.strip()
    yield reply
    for fence in ("```json", "```"):
        _, opened, tail = reply.partition(fence)
        inner, closed, _ = tail.partition("```")
        if opened and closed:
            yield inner
    if (found := balanced(reply)) is not None:
        yield found


def _no_nulls(value):
    if isinstance(value, dict):
        return {k: _no_nulls(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_no_nulls(v) for v in value]
    return "" if value is None else value


def repaired(reply: str | None, fill: bool = False) -> str | None:
    """Compact JSON of the first candidate that parses, as it is or with Python's constants put right; else null."""
    for part in candidates(reply or ""):
        for text in (part.strip(), re.sub(r"\b(None|True|False)\b", lambda m: _WORDS[m[0]], part.strip())):
            try:
                value = json.loads(text)
            except (ValueError, RecursionError):
                continue
            return json.dumps(_no_nulls(value) if fill else value, ensure_ascii=False, separators=(",", ":"))
    return None


def json_of(reply: Column, fill: bool = False) -> Column:
    """Compact JSON from a reply, null where there is none; `fill` turns nulls into empty texts."""

    @F.pandas_udf("string")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda v: repaired(v, fill), na_action="ignore")

    return parse(reply)
