"""The search language: text to clauses. Runs on the driver and sees no rows.

A query is clauses separated by white space, all of which must hold. A clause is alternatives joined by
``|``; ``!`` before it negates it. An alternative is a term (plain, with wildcards, or a path), quoted or
not, or a filter such as ``ext:pdf``, ``size:>10mb``, ``dm:2026-05``. What can't be read is reported and left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from sedgeway.functions.names import CATEGORY_OF_ALIAS

MAX_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Term:
    text: str
    only: str | None = None  # "file" or "folder"

    @classmethod
    def of(cls, text: str, only: str | None = None) -> Term:
        return cls(text.lower(), only)

    @property
    def kind(self) -> str:
        if "*" in self.text or "?" in self.text:
            return "wildcard"
        return "path" if "\\" in self.text else "plain"

    @property
    def allows_typos(self) -> bool:
        return self.kind == "plain" and 4 <= len(self.text) <= 64

    @property
    def max_typos(self) -> int:
        return 0 if not self.allows_typos else 1 if len(self.text) <= 6 else 2


@dataclass(frozen=True)
class Filter:
    """``kind`` names the test; ``value`` is what it needs."""

    kind: str
    value: object


Alternative = Term | Filter


@dataclass(frozen=True)
class Clause:
    alternatives: tuple[Alternative, ...]
    negated: bool = False

    @property
    def rank(self) -> int:
        """Cheap clauses first: filters, then names, then paths."""
        if all(isinstance(a, Filter) and a.kind != "path" for a in self.alternatives):
            return 0
        return 2 if any((isinstance(a, Filter) and a.kind == "path") or (isinstance(a, Term) and a.kind == "path") for a in self.alternatives) else 1


@dataclass(frozen=True)
class Query:
    clauses: tuple[Clause, ...] = ()
    errors: tuple[str, ...] = ()
    #: Terms on names in clauses that aren't negated, in the order of the text.
    name_terms: tuple[Term, ...] = ()


# --- sizes and dates

_UNIT = {"": 1, "b": 1} | {u + b: 1024**i for i, u in enumerate("kmgt", 1) for b in ("", "b")}
_KB, _MB = 1024, 1024**2
#: Named sizes, inclusive. Fixed values.
SIZE_NAMES = {
    "empty": (0, 0), "tiny": (0, 10 * _KB - 1), "small": (10 * _KB, 100 * _KB - 1), "medium": (100 * _KB, _MB - 1),
    "large": (_MB, 16 * _MB - 1), "huge": (16 * _MB, 128 * _MB - 1), "gigantic": (128 * _MB, MAX_LONG),
}


def _amount(s: str) -> int | None:
    m = re.fullmatch(r"\s*([0-9.]+)\s*([a-z]*)\s*", s)
    if not m or m[2] not in _UNIT:
        return None
    try:
        v = float(m[1]) * _UNIT[m[2]]
    except ValueError:
        return None
    return round(v) if 0 <= v <= MAX_LONG else None


def parse_size(text: str) -> tuple[int, int] | None:
    """Inclusive bounds, or None."""
    s = text.strip().lower()
    if s in SIZE_NAMES:
        return SIZE_NAMES[s]
    if ".." in s:
        low, high = (_amount(p) for p in s.split("..", 1))
        return (low, high) if low is not None and high is not None and low <= high else None
    op = next((o for o in (">=", "<=", ">", "<", "=") if s.startswith(o)), "")
    v = _amount(s[len(op) :])
    if v is None or (op == "<" and v == 0):
        return None
    return {">": (min(v + 1, MAX_LONG), MAX_LONG), ">=": (v, MAX_LONG), "<": (0, v - 1), "<=": (0, v)}.get(op, (v, v))


_FAR = datetime.max


def _period(s: str) -> tuple[datetime, datetime] | None:
    """Start and end of a day, month or year; the end of the last ones is the end of time."""
    m = re.fullmatch(r"(\d{4})(?:-(\d\d)(?:-(\d\d))?)?", s)
    if not m:
        return None
    y, mo, d = int(m[1]), int(m[2] or 1), int(m[3] or 1)
    try:
        start = datetime(y, mo, d)
    except ValueError:
        return None
    try:
        if m[3]:
            return start, start + timedelta(days=1)
        return start, datetime(y + (mo == 12), mo % 12 + 1, 1) if m[2] else datetime(y + 1, 1, 1)
    except (ValueError, OverflowError):
        return start, _FAR


def parse_dates(text: str, now: datetime, zone: str = "UTC") -> tuple[datetime | None, datetime | None] | None:
    """Half-open bounds in UTC without a zone (None: open), or None if unreadable. Days are those of ``zone``."""
    s = text.strip().lower()
    tz = ZoneInfo(zone)

    def utc(local: datetime) -> datetime | None:
        return None if local == _FAR else local.replace(tzinfo=tz).astimezone(timezone.utc).replace(tzinfo=None)

    now_utc = now.astimezone(timezone.utc).replace(tzinfo=None)
    today = datetime.combine(now.astimezone(tz).date(), datetime.min.time())
    if s in ("today", "yesterday"):
        day = today - timedelta(days=s == "yesterday")
        return utc(day), utc(day + timedelta(days=1))
    for name, days in (("week", 7), ("month", 30), ("year", 365)):
        if s in (name, f"this{name}", f"last{name}"):
            return now_utc - timedelta(days=days), None
    if ".." in s:
        a, b = (_period(p) for p in s.split("..", 1))
        if not a or not b:
            return None
        low, high = utc(a[0]), utc(b[1])
        return (low, high) if high is None or high > low else None
    op = next((o for o in (">=", "<=", ">", "<") if s.startswith(o)), "")
    p = _period(s[len(op) :])
    if not p:
        return None
    start, end = p
    never = datetime.max  # later than the end of time: nothing passes
    return {
        ">": (utc(end) if end != _FAR else never, None), ">=": (utc(start), None), "<": (None, utc(start)), "<=": (None, utc(end)),
    }.get(op, (utc(start), utc(end)))


# --- text to clauses


@dataclass
class _Token:
    parts: list[tuple[str, bool]] = field(default_factory=list)
    negated: bool = False
    leads: bool = False  # begins with a pipe
    trails: bool = False  # ends with one


def _tokens(text: str) -> list[_Token]:
    out: list[_Token] = []
    token, word, quoted, begun, inside = _Token(), "", False, False, False

    def end_part() -> None:
        nonlocal word, quoted
        if word:
            token.parts.append((word, quoted))
        word, quoted = "", False

    def end_token() -> None:
        nonlocal token, begun
        end_part()
        if token.parts or token.leads or token.trails:
            out.append(token)
        token, begun = _Token(), False

    for c in text:
        if c == '"':
            quoted = quoted or not word
            inside, begun, token.trails = not inside, True, False
        elif inside:
            word += c
            begun, token.trails = True, False
        elif c.isspace():
            end_token()
        elif c == "|":
            token.leads = token.leads or not begun
            end_part()
            token.trails = begun = True
        elif c == "!" and not begun:
            token.negated = begun = True
        else:
            word += c
            begun, token.trails = True, False
    end_token()
    merged: list[_Token] = []
    for t in out:
        if merged and (t.leads or merged[-1].trails):
            merged[-1].parts += t.parts
            merged[-1].trails = t.trails
        else:
            merged.append(t)
    return [t for t in merged if t.parts]


def _list(value: str) -> list[str]:
    return [x for x in (p.strip() for p in re.split("[;,]", value)) if x]


def parse(text: str | None, now: datetime | None = None, zone: str = "UTC") -> Query:
    now = now or datetime.now(timezone.utc)
    errors: list[str] = []

    def ext(_: str, value: str) -> Alternative | None:
        found = [e for e in (x.lstrip(".").lower() for x in _list(value)) if e]
        if not found:
            errors.append("ext: needs an extension, such as ext:pdf")
            return None
        return Filter("ext", tuple(dict.fromkeys(found)))

    def kind(_: str, value: str) -> Alternative | None:
        cats, files = [], False
        for part in _list(value):
            low = part.lower()
            if low in ("file", "files"):
                files = True
            elif low in CATEGORY_OF_ALIAS:
                cats.append(CATEGORY_OF_ALIAS[low])
            else:
                errors.append(f"unknown type {part!r}")
        if cats:
            return Filter("category", tuple(dict.fromkeys(cats)))
        if files:
            return Filter("folders", False)
        if not value:
            errors.append("type: needs a value, such as type:image")
        return None

    def only(name: str, value: str) -> Alternative | None:
        return Term.of(value, name) if value else Filter("folders", name == "folder")

    def size(_: str, value: str) -> Alternative | None:
        if (bounds := parse_size(value)) is None:
            errors.append(f"size {value!r} can't be read; try size:>10mb")
            return None
        return Filter("size", bounds)

    def dates(_: str, value: str) -> Alternative | None:
        if (bounds := parse_dates(value, now, zone)) is None:
            errors.append(f"date {value!r} can't be read; try dm:today or dm:2026-05")
            return None
        return Filter("date", bounds)

    def path(_: str, value: str) -> Alternative | None:
        if not value:
            errors.append("path: needs a value")
            return None
        return Filter("path", value.lower())

    def drive(_: str, value: str) -> Alternative | None:
        letter = value.rstrip(":\\")
        if not re.fullmatch("[A-Za-z]", letter):
            errors.append("drive: needs a letter, such as drive:E")
            return None
        return Filter("drive", letter.upper())

    readers: dict[str, Callable[[str, str], Alternative | None]] = {
        "ext": ext, "type": kind, "kind": kind, "file": only, "folder": only, "size": size, "dm": dates, "datemodified": dates,
        "modified": dates, "path": path, "parent": path, "infolder": path, "drive": drive,
    }

    def alternative(part: str, quoted: bool) -> Alternative | None:
        head, colon, value = part.partition(":")
        if colon and head and not quoted and head.lower() in readers:
            return readers[head.lower()](head.lower(), value)
        return Term.of(part)

    clauses = []
    for t in _tokens(text or ""):
        found = [a for a in (alternative(*p) for p in t.parts) if a is not None]
        if found:
            clauses.append(Clause(tuple(found), t.negated))
    terms = tuple(a for c in clauses if not c.negated for a in c.alternatives if isinstance(a, Term) and a.kind != "path")
    return Query(tuple(sorted(clauses, key=lambda c: c.rank)), tuple(errors), terms)


__all__ = ["Clause", "Filter", "Query", "Term", "parse", "parse_dates", "parse_size"]
