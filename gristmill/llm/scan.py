"""Base scanners of secrets and personal data on UTF-8 bytes, and spans in code points.

All patterns are ASCII, so bytes and characters match alike. The scanners look only
where a match can be: around a keyword, an at sign, or a run with digits.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa

from gristmill.llm.textkit import char_offsets, utf8_view

Span = tuple[str, int, int]

#: Fixed patterns.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
IP = re.compile(rb"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_HEXES = np.isin(np.arange(256), list(b"0123456789abcdef"))
_NUMERIC = np.isin(np.arange(256), list(b"0123456789 .()+-"))
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def secret_spans(raw: bytes) -> list[Span]:
    """assign, access and hex matches of one text, in bytes."""
    found: list[Span] = []
    low = raw.lower()
    if any(k in low for k in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in raw:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 18]
    starts, ends = runs(_HEXES[np.frombuffer(raw, np.uint8)])
    found += [("hex", int(s), int(e)) for s, e in zip(starts[ends - starts >= 16], ends[ends - starts >= 16], strict=True)]
    return found


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(raw: bytes) -> list[Span]:
    """Leftmost matches: the run of local characters before an at sign, not before the last match, and a domain after it."""
    found, past, at = [], 0, raw.find(b"@")
    while at >= 0:
        start = at
        while start > past and raw[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(raw, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            past = m.end()
        at = raw.find(b"@", max(at + 1, past))
    return found


def personal_spans(raw: bytes) -> list[Span]:
    """email, ip, card and phone matches of one text, in bytes."""
    found = _emails(raw) if b"@" in raw else []
    data = np.frombuffer(raw, np.uint8)
    digits = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
    if digits[-1] < 4:
        return found
    starts, ends = runs(_NUMERIC[data])
    some = digits[ends] - digits[starts] >= 4
    for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
        found += [("ip", m.start(), m.end()) for m in IP.finditer(raw, s, e) if all(int(p) <= 255 for p in m[0].split(b".") if len(p) < 10) and all(len(p.lstrip(b"0")) < 4 for p in m[0].split(b"."))]
        for m in CARD.finditer(raw, s, e):
            number = m[0].replace(b" ", b"").replace(b"-", b"")
            if 14 <= len(number) <= 19 and luhn(number):
                found.append(("card", m.start(), m.end()))
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(raw, s, e) if 10 <= sum(48 <= c <= 57 for c in m[0]) <= 15]
    return found


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2]))


def in_characters(raw: bytes, spans: list[Span]) -> list[Span]:
    if not spans or raw.isascii():
        return spans
    at = char_offsets(np.frombuffer(raw, np.uint8), [x for s in spans for x in s[1:]]).tolist()
    return [(k, at[2 * i], at[2 * i + 1]) for i, (k, _, _) in enumerate(spans)]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def texts_of(column: pa.Array) -> list[bytes]:
    data, offsets = utf8_view(column)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
