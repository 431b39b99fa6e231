import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sedgeway.functions import match as M
from sedgeway.operators import stats
from sedgeway.operators.search import recent_searches, search
from sedgeway.plans.query import Term
from sedgeway.sources.entries import derive

NOW = datetime(2026, 10, 7, 15, tzinfo=timezone.utc)
ROWS = [
    (1, 0, "Documents", True, False, 0, "2026-01-01"), (2, 0, "Projects", True, False, 0, "2026-01-01"), (3, 1, "report.pdf", False, False, 5_000, "2026-10-06"),
    (4, 1, "final_report.docx", False, False, 50_000, "2025-01-01"), (5, 1, "myreport.txt", False, False, 10, "2024-01-01"), (6, 2, "src", True, False, 0, None),
    (7, 6, "quarterly_report_final.xlsx", False, False, 2_000_000_000, "2026-09-01"), (8, 2, "node_modules", True, False, 0, None), (9, 1, "secret.txt", False, True, 1, None),
]


@pytest.fixture(scope="module")
def entries(spark):
    paths, out = {0: "C:"}, []
    for i, p, n, d, h, s, m in ROWS:
        paths[i] = f"{paths[p]}\\{n}"
        out.append(("C", "C", i, p, n, d, h, False, False, False, True, s, m and datetime.fromisoformat(f"{m}T12:00:00"), i, paths[i].count("\\"), paths[i]))
    schema = "volume_id string, drive_letter string, entry_id long, parent_id long, name string, is_dir boolean, hidden boolean, system boolean, reparse boolean, deleted boolean, metadata_known boolean, size long, modified timestamp_ntz, record_no long, depth int, full_path string"
    return derive(spark.createDataFrame(out, schema)).cache()


@pytest.mark.parametrize(
    "text,names",
    [
        ("report", ["report.pdf", "final_report.docx", "quarterly_report_final.xlsx", "myreport.txt"]), ("projects\\sr", ["src", "quarterly_report_final.xlsx"]), ("ext:pdf;docx", ["report.pdf", "final_report.docx"]),
        ("folder:", ["src", "Projects", "Documents", "node_modules"]), ("nmod", ["node_modules"]), ("!report ext:txt", []), ("dm:2026-10", ["report.pdf"]), ("size:>1gb", ["quarterly_report_final.xlsx"]),
        ("*.pdf", ["report.pdf"]), ("drive:d report", []), ("", []), ("size:zzz report", ["report.pdf", "final_report.docx", "quarterly_report_final.xlsx", "myreport.txt"]),
    ],
)
def test_search(entries, text, names):
    r = search(entries, text, now=NOW)
    assert [h.name for h in r.hits.collect()] == names and r.total == len(names) and bool(r.errors) == ("zzz" in text)


def test_typing_errors_are_a_second_pass(entries):
    r = search(entries, "quartelry")
    assert r.used_typos and [(h.name, h.tier, h.score) for h in r.hits.collect()] == [("quarterly_report_final.xlsx", 5, 40)]
    assert search(entries, "quartelry", fuzzy=False).total == 0


def test_options(entries):
    assert search(entries, "secret").total == 0 and search(entries, "secret", include_hidden=True).total == 1
    assert [h.name for h in search(entries, "report", sort="size", max_results=2).hits.collect()] == ["quarterly_report_final.xlsx", "final_report.docx"]
    assert [h.name for h in search(entries, "report", sort="name").hits.collect()][0] == "final_report.docx"
    assert search(entries, "", category="Folder").total == 4
    h = search(entries, "report", highlight=True).hits.filter("entry_id = 4").first().highlights
    assert [(x.start, x.length) for x in h] == [(6, 6)]


def test_highlights():
    assert M.highlight_ranges("abcxyzdef", ["abc", "def"]) == [(0, 3), (6, 3)]
    assert M.highlight_ranges("FinalReport", ["report"]) == [(5, 6)] and M.highlight_ranges("node_modules", ["nmod"]) == [(0, 1), (5, 3)]
    assert M.highlight_ranges("abc", ["zzz"]) == []


CLASSES = {c: i for i, cs in enumerate([" \t", "", "\\/,:;|_-."]) for c in cs}


def slow_class(c):
    if c in CLASSES:
        return CLASSES[c]
    return 3 if c.islower() else 4 if c.isupper() else 5 if c.isalpha() else 6 if c.isdecimal() else 1


def slow_bonus(prev, cls):
    if cls > 1 and prev <= 2:
        return (10, 8, 9)[prev]
    if (prev, cls) == (3, 4) or (prev != 6 and cls == 6):
        return 7
    return {1: 8, 2: 8, 0: 10}.get(cls, 0)


def slow_score(name, low, text, start, end):
    p = score = run = first = 0
    gap, prev = False, slow_class(name[start - 1]) if start else 0
    for i in range(start, end):
        if p == len(text):
            break
        cls = slow_class(name[i])
        if low[i] == text[p]:
            b = slow_bonus(prev, cls)
            if run == 0 or (b >= 8 and b > first):
                first = b
            worth = b if run == 0 else max(b, first, 4)
            score += 16 + worth * (2 if p == 0 else 1)
            gap, run, p = False, run + 1, p + 1
        else:
            score, gap, run, first = score + (-1 if gap else -3), True, 0, 0
        prev = cls
    return score


def slow_match(name, t, typos):
    low, m = name.lower(), len(t)
    places = [i for i in range(len(low)) if low.startswith(t, i)]
    if places and places[0] == 0:
        return (0 if m == len(low) or low.rfind(".") == m else 1), slow_score(name, low, t, 0, m)
    if places:
        edge = next((p for p in places if M.is_word_start(name, p)), None)
        p = places[0] if edge is None else edge
        return (3 if edge is None else 2), slow_score(name, low, t, p, p + m)
    span = M.subsequence_span(low, t)
    if m >= 2 and span and span[1] - span[0] <= 2 * m + 3:
        return 4, slow_score(name, low, t, *span)
    term = Term.of(t)
    if typos and term.allows_typos:
        row = list(range(m + 1))
        best = row[m]
        for c in low:
            new = [0]
            for j in range(1, m + 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (t[j - 1] != c)))
            row, best = new, min(best, new[m])
        if best <= term.max_typos:
            return 5, 100 - 30 * best
    return 255, 0


@pytest.mark.parametrize("text", ["ab", "abca", "cadbab", "bacdabcd", "a", "b.a"])
def test_matching_equals_a_plain_twin(spark, text):
    rng = random.Random(text)
    names = ["".join(rng.choices("abcdABCD1 _-.é(", k=rng.randint(1, 24))) for _ in range(250)]
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("fold", F.lower("name"))
    hit, tier, score = M.match(F.col("name"), F.col("fold"), Term.of(text), True, True)
    for r in df.select("name", hit.alias("hit"), tier.alias("tier"), score.alias("score")).collect():
        assert r.hit == (r.tier != M.NO_MATCH)
        assert (r.tier, r.score) == slow_match(r.name, text, True), (r.name, text)


def test_statistics(spark, entries):
    assert stats.summary(entries).first()[:3] == (5, 4, 2_000_055_011)
    assert [r.name for r in stats.largest(entries, 2).collect()] == ["quarterly_report_final.xlsx", "final_report.docx"]
    assert {r.category: r.files for r in stats.categories(entries).collect()} == {"Document": 5}
    assert stats.folder_size(entries, "C:\\Documents").first().files == 4
    assert stats.scan_agreement(entries, entries.filter("entry_id > 2")).first()[:2] == (7, 1.0)
    searches = spark.createDataFrame([("Foo", 1), ("foo ", 2), ("x", 3), ("bar", 4)], "query string, at long")
    assert [(r["query"], r["at"]) for r in recent_searches(searches).collect()] == [("bar", 4), ("foo", 2)]
