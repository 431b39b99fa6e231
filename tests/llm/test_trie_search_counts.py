"""The prefix trie, ranked search and token counts against brute force and the library."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedgeway.llm import lexical, prefix_trie, token_counts
from sedgeway.llm.common import tokenizer_path

# --- the trie


def brute_trie(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((str(len((role or "").encode())) + ":" + (role or "") + (text or "")).encode()).digest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in by.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, schema="conv_id long, turn long, role string, text string, node string, key string, depth string, length string"):
    df = spark.createDataFrame([(*r, "own", "own", "own", "own") for r in rows], schema)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turns_of(df))).collect()), key=str)


def test_trie_equals_brute_force(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"turn {t} of {c // 7 if t > 2 else 0}") for c in range(-6, 40) for t in range(1 + c % 6)]
    rows += [(100, None, None, None), (100, None, "a", "x"), (100, 3, "a", "ü" * 5000), (100, 3, "a", "b"), (100, 3, "a", "b"), (None, 1, "user", "nobody's"), (103, 1, "user", "")]
    rows += [(200 + i, t, "user", "the same") for i in range(60) for t in range(3)]  # copies
    rows += [(300 + i, 1, "ab", "c") for i in range(4)] + [(310, 1, "a", "bc")]  # role and text apart
    rows += [(400, 5000 * t, "user", f"far {t}") for t in range(12)]
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_of_no_rows_and_of_one(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "a", "b")]) == []
    assert trie(spark, [(5, 1, "a", "b")]) == brute_trie([(5, 1, "a", "b")])


def test_ids_of_a_node_are_hashed_in_order_over_blocks(spark):
    ended = spark.range(5000).select(F.lit(1).cast("long").alias("depth"), F.lit(0).cast("long").alias("node"), F.col("id").alias("conv"))
    nodes = spark.createDataFrame([(0, 1, None, 5000, 0, 1, 0, None)], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, _end string")
    assert prefix_trie._with_ends(nodes, ended).first()["ends_sha256"] == hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()


# --- search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, top=10):
    def terms(text):
        return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    held = [(d, Counter(terms(t))) for d, t in docs]
    total = sum(sum(c.values()) for _, c in held)
    n_docs = sum(1 for _, c in held if c)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for doc, c in held:
            score = 0
            for t, q in asked.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 25 + 75 * sum(c.values()) * n_docs // total
                    score += q * w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def searched(spark, docs, items):
    index = lexical.postings(spark.createDataFrame([(*d, "own", "own") for d in docs], "doc_id long, text string, bucket string, first string"))
    index = lexical.store(index, partition_by=("bucket",))
    out = lexical.ranked(index, spark.createDataFrame([(*i, "own") for i in items], "item_id long, text string, term string"))
    return sorted((tuple(r) for r in out.collect()), key=str)


DOCS = [(i, " ".join(f"w{(i * 7 + k * k) % 23}" for k in range(i % 17))) for i in range(60)] + [
    (60, None), (61, ""), (62, " \t!?"), (None, "w1 w2 w3"), (63, "W1,w2;W3 " * 4000), (64, "Über ÜBER naïve 漢字-漢字 x1y"), (64, "Über ÜBER naïve 漢字-漢字 x1y"), (5, "w1 w1"), (65, "w1 w2"), (66, "w2 w1"),
]
ITEMS = [(1, "w1 w2 w2 w9"), (2, "Über über 漢字"), (3, None), (4, "nothing of this"), (5, "W3 w3 W22 x1Y"), (None, "w5"), (1, "w7")]


def test_search_equals_brute_force(spark, monkeypatch):
    expected = brute_search(DOCS, ITEMS)
    assert searched(spark, DOCS, ITEMS) == expected
    monkeypatch.setattr(lexical, "MAX_BROADCAST", 3)  # joined by a shuffle
    assert searched(spark, DOCS, ITEMS) == expected


def test_search_over_empty_tables(spark):
    assert searched(spark, [], ITEMS) == [] and searched(spark, DOCS, []) == [] and searched(spark, [(1, None), (2, "")], ITEMS) == []


@given(st.text())
def test_terms_follow_the_pattern(text):
    assert [t.decode() for t in lexical.terms_of(text.encode("utf-8", "ignore"))] == TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text.encode("utf-8", "ignore").decode()))


# --- token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(token_counts.NAME))


@pytest.fixture(scope="module")
def counts():
    with open(tokenizer_path(token_counts.NAME), encoding="utf-8") as f:
        return token_counts.prepare(f.read())


def test_counts_equal_the_library(spark, odd_docs, no_docs, library):
    loaded = token_counts.load(spark)
    got = token_counts.with_counts(odd_docs, loaded, max_tokens=10).collect()
    assert len(got) == 10 and all(r["mine"] == "keep" for r in got)
    for r in got:
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 10)
    assert token_counts.with_counts(no_docs, loaded).count() == 0


def test_every_plain_character_is_split_as_the_library_does(library, counts):
    c = token_counts.Counter(counts)
    plain = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and c.plain(chr(i))]
    assert len(plain) > 30_000
    for k in range(0, len(plain), 500):
        for form in ("{0}", "a{0}b", "1{0}'{0}", "e{0} "):
            text = " ".join(form.format(x) for x in plain[k : k + 500])
            assert c.count(text) == len(library.encode(text, add_special_tokens=False).ids)


PARTS = [*"aBz19'_- \n\t\x1c\x85\xadé́ΣςİſÅ漢각😀‍﻿½Ⅳǅﬁ<|>", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "thing"]


@pytest.fixture(scope="module")
def small_memo(counts):
    return token_counts.Counter(counts, memo=2)


@settings(max_examples=400)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=20))
def test_counts_of_any_text_equal_the_library(library, small_memo, text):
    text = text.encode("utf-8", "ignore").decode()
    assert small_memo.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_a_full_memo_changes_nothing_and_keeps_the_frequent(counts):
    c = token_counts.Counter(counts, memo=5)
    frequent = len(c.lengths)
    words = [f"qz{i}x" for i in range(40)]
    assert c.count(" ".join(words)) == sum(map(token_counts.Counter(counts).count, words))
    assert frequent < len(c.lengths) <= frequent + 5


def test_other_tokenizer_files_are_refused():
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        token_counts.prepare(f.read())
