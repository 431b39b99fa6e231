from datetime import datetime, timezone

import pytest

from sedgeway.plans.query import MAX_LONG, Filter, Term, parse, parse_dates, parse_size

NOW = datetime(2026, 10, 7, 15, tzinfo=timezone.utc)
MB = 1024**2


@pytest.mark.parametrize(
    "text,bounds",
    [
        ("empty", (0, 0)), ("tiny", (0, 10239)), ("small", (10240, 102399)), ("medium", (102400, MB - 1)), ("large", (MB, 16 * MB - 1)), ("gigantic", (128 * MB, MAX_LONG)),
        (">1mb", (MB + 1, MAX_LONG)), (">=1.5k", (1536, MAX_LONG)), ("<10", (0, 9)), ("<=2g", (0, 2 * 1024 * MB)), ("=5", (5, 5)), ("7 b", (7, 7)), ("1mb..2mb", (MB, 2 * MB)),
        ("<0", None), ("2..1", None), ("zzz", None), ("", None), ("5x", None), ("1..", None),
    ],
)
def test_sizes(text, bounds):
    assert parse_size(text) == bounds


@pytest.mark.parametrize(
    "text,bounds",
    [
        ("today", (datetime(2026, 10, 7), datetime(2026, 10, 8))), ("yesterday", (datetime(2026, 10, 6), datetime(2026, 10, 7))), ("lastweek", (datetime(2026, 9, 30, 15), None)),
        ("2026-05", (datetime(2026, 5, 1), datetime(2026, 6, 1))), ("2025", (datetime(2025, 1, 1), datetime(2026, 1, 1))), (">2025", (datetime(2026, 1, 1), None)),
        (">=2025", (datetime(2025, 1, 1), None)), ("<2025-03-04", (None, datetime(2025, 3, 4))), ("<=2025-03-04", (None, datetime(2025, 3, 5))),
        ("2024..2025", (datetime(2024, 1, 1), datetime(2026, 1, 1))), ("2025..2024", None), ("9999", (datetime(9999, 1, 1), None)), ("2026-13", None), ("soon", None),
    ],
)
def test_dates(text, bounds):
    assert parse_dates(text, NOW) == bounds


def test_days_are_those_of_the_zone():
    assert parse_dates("today", NOW, "Asia/Tokyo") == (datetime(2026, 10, 7, 15), datetime(2026, 10, 8, 15))


def shape(text):
    return [("!" if c.negated else "") + "|".join(f"{a.kind}={a.value}" if isinstance(a, Filter) else a.text for a in c.alternatives) for c in parse(text, NOW).clauses]


@pytest.mark.parametrize(
    "text,clauses",
    [
        ("a b", ["a", "b"]), ("a | b c", ["a|b", "c"]), ("a| b", ["a|b"]), ("a |b", ["a|b"]), ("!a|b", ["!a|b"]), ('"a b" c', ["a b", "c"]), ('"ext:pdf"', ["ext:pdf"]),
        ("ext:.PDF;docx", ["ext=('pdf', 'docx')"]), ("foo:bar", ["foo:bar"]), (":x", [":x"]), ("type:pics,video", ["category=('Image', 'Video')"]), ("type:file", ["folders=False"]),
        ("folder:", ["folders=True"]), ("drive:e:\\", ["drive=E"]), ("path:A\\b", ["path=a\\b"]), ("x ext:pdf", ["ext=('pdf',)", "x"]), ("a\\b x", ["x", "a\\b"]), ("|", []), ("", []), ("!", []),
    ],
)
def test_clauses(text, clauses):
    assert shape(text) == clauses


def test_errors_drop_their_alternative_only():
    q = parse("ext: size:zzz drive:xy dm:soon path: type:blah report", NOW)
    assert len(q.errors) == 6 and [c.alternatives for c in q.clauses] == [(Term("report"),)]


def test_terms():
    assert parse("folder:abc").clauses[0].alternatives[0] == Term("abc", "folder")
    assert [Term.of(t).max_typos for t in ("abc", "abcd", "abcdef", "abcdefg", "a*cd", "x" * 65)] == [0, 1, 1, 2, 0, 0]
    assert [t.text for t in parse("a !b c\\d *.e").name_terms] == ["a", "*.e"]
