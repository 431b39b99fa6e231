import random
import re

import numpy as np
import xxhash

from sedgeway.llm import simhash as S
from sedgeway.llm.components import connected_components


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(fps, limit=3):
    """Least index that each fingerprint reaches."""
    group = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= limit:
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return group


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_follow_the_definition():
    for text in ["", " \n", "a", "A b", "one two three", "Ünï Two ÉCOLE x y z", "word " * 500, "a\x0bb\x0cc\rd"]:
        assert S.fingerprint(text.encode()) == slow_fingerprint(text)


def test_groups_equal_brute_force_over_odd_rows(spark, odd_docs):
    got = {(r.doc_id, r.fp): r.component_id for r in S.near_groups(odd_docs).collect()}
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in odd_docs.select("doc_id", "text").collect()]
    group = slow_groups([f for _, f in rows])
    for (d, f), g in zip(rows, group):
        ids = [x for (x, _), k in zip(rows, group) if k == g and x is not None]
        assert got[d, signed(f)] == (min(ids) if ids else None)


def test_search_equals_brute_force_on_clustered_fingerprints(spark, monkeypatch):
    rng = random.Random(4)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 5, 60, 300])):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    monkeypatch.setattr(S, "BLOCK", 64)  # so that buckets are split
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(4)
    n, counts = S.bit_counts(df)
    assert n == len(fps) and counts[3, 7] == sum(f >> 3 & f >> 7 & 1 for f in fps)
    want = slow_groups(fps)
    plans = [S.plan_parts(n, counts), [S.Part(tuple(range(32)), 1), S.Part(tuple(range(32, 64)), 1)], [S.Part(tuple(range(i, 64, 4)), 0) for i in range(4)]]
    for parts in plans:
        assert sum(p.threshold for p in parts) == 3 - len(parts) + 1
        found = {r.node: r.root for r in connected_components(S.links(S.bucket_rows(df, parts))).collect()}
        roots = [found.get(signed(f), signed(f)) for f in fps]
        assert len(set(zip(roots, want))) == len(set(roots)) == len(set(want))


def test_links_of_a_bucket_are_a_forest(spark):
    own = np.array([signed(1 << i) for i in range(40)], dtype=np.int64)  # all within two bits of each other
    df = spark.createDataFrame([(int(x),) for x in own], "fp long").coalesce(1)
    assert S.links(S.bucket_rows(df, [S.Part(tuple(range(48, 64)), 0)])).distinct().count() == 39


def test_one_document_of_each_group_stays(spark, odd_docs, no_docs):
    kept = [r.doc_id for r in S.keep_one(odd_docs).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 5, 7, 8, None], key=str)
    assert S.keep_one(odd_docs).columns == odd_docs.columns
    assert S.near_groups(no_docs).count() == 0


def test_one_row_of_each_group_stays_with_null_and_repeated_doc_ids(spark):
    a, b, c, d, e = ("alpha beta gamma delta", "one two three four", "red green blue grey", "north south east west", "spring summer autumn winter")
    rows = [(5, a), (5, b), (6, b), (2, a), (None, a), (None, c), (None, c), (None, c.upper()), (None, d), (7, d), (4, e), (4, "x y z"), (4, "x y z")]
    kept = sorted(((r.doc_id, r.text.lower()) for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()), key=str)
    assert kept == sorted([(2, a), (5, b), (None, c), (7, d), (4, e), (4, "x y z")], key=str)


def test_long_chains_and_hubs_become_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, i) for i in range(1000, 1100)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame([*chain, *hub, (3, 3)], "a long, b long")).collect()}
    assert all(found[i] == 100 for i in range(100, 161)) and all(found[i] == 7 for i in range(1000, 1100)) and 3 not in found


def test_thresholds_of_two_find_all_within_eleven_bits(spark):
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for x in list(fps):
        for _ in range(6):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 14)):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3)
    n, counts = S.bit_counts(df)
    four = [S.Part(tuple(range(i, 64, 4)), 2) for i in range(4)]
    for parts in (four, S.plan_parts(n, counts, 11), S.plan_parts(10**8, counts * (10**8 / n), 11)):
        assert sum(p.threshold for p in parts) == 11 - len(parts) + 1
        found = {r.node: r.root for r in connected_components(S.links(S.bucket_rows(df, parts), 11)).collect()}
        roots = [found.get(signed(f), signed(f)) for f in fps]
        want = slow_groups(fps, 11)
        assert len(set(zip(roots, want))) == len(set(roots)) == len(set(want))


def five(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def slow_similar(sets, comp):
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if comp[i] == comp[j] and 10 * len(a & sets[j]) >= 8 * len(a | sets[j]) > 0:
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return group


def copies(rng, n_bases, n_copies, words, edits):
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    out = []
    for _ in range(n_bases):
        base = rng.choices(vocabulary, k=words)
        for _ in range(n_copies):
            w = list(base)
            for _ in range(rng.randint(*edits)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w[: len(w) - rng.choice([0, 0, 0, words // 12])]))
    return out


def test_texts_are_not_sent_back(spark, odd_docs):
    docs = odd_docs.selectExpr("text", "'x' as node", "1L as comp", "1 as n")
    for df in (S._marks(docs, "text", 5), S._sets(docs, "text", 5)):
        plan = df._jdf.queryExecution().analyzed().toString()
        assert "text#" not in plan[plan.index("MapInArrow") :].split("\n")[0].rpartition(", [")[2]


def test_similar_groups_equal_brute_force(spark):
    rng = random.Random(8)
    texts = list(dict.fromkeys(copies(rng, 4, 60, 120, (0, 5)) + copies(rng, 3, 40, 60, (1, 3)) + ["a b", "a b c d e f", "a b c d e g"]))
    sets, comp = [five(t) for t in texts], [i % 2 if i < 30 else 7 for i in range(len(texts))]
    rows = [(f"{i:04}", c, len(s), [xxhash.xxh64_intdigest(x) - (1 << 63) for x in s]) for i, (s, c) in enumerate(zip(sets, comp))]
    want = slow_similar(sets, comp)
    for small in (64, 0, 10**6):  # some comps in one task, none, all
        found = {r.node: r.label for r in S.similar_groups(spark.createDataFrame(rows, "node string, comp long, n int, s array<long>").repartition(3), small=small).collect()}
        got = [found[f"{i:04}"] for i in range(len(texts))]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))
    assert 10 < len(set(want)) < len(texts) - 50


def test_pairs_of_a_shingle_are_written_only_if_they_may_be_similar(spark):
    rng = random.Random(11)
    pool = [rng.getrandbits(64) - (1 << 63) for _ in range(240)]
    sets = [set(rng.sample(pool, rng.randint(70, 90))) for _ in range(40)]  # of any two, a fifth or so is shared
    sets += [set(rng.sample(sorted(s), len(s) - 5)) | set(rng.sample(range(1 << 60), k % 4)) for k, s in enumerate(sets)]
    rows = [(f"{i:03}", 1, len(s), sorted(s)) for i, s in enumerate(sets)]
    at = S._prefixes(spark.createDataFrame(rows, "node string, comp long, n int, s array<long>"), 0.5).cache()
    other = at.select("s", *[S.F.col(c).alias(f"l_{c}") for c in ("node", "n", "alone", "rest", *S._PARITY)])
    meet = at.join(other, "s").filter("node < l_node")
    got = {(r.node, r.l_node) for r in meet.filter(S._may_be_similar(0.5)).select("node", "l_node").collect()}
    want = {(f"{i:03}", f"{j:03}") for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 2 * len(a & b) >= len(a | b)}
    assert want <= got and len(want) >= 40
    assert 2 * len(got) < meet.select("node", "l_node").distinct().count()
    at.unpersist()


def test_one_of_each_five_word_group_stays(spark):
    rng = random.Random(9)
    texts = copies(rng, 40, 4, 150, (0, 4)) + copies(rng, 6, 10, 80, (3, 12)) + ["x y", "X y", "", None, " "]
    rows = [(i * 7 % 997, t) for i, t in enumerate(texts)]
    fps, sets = [slow_fingerprint(t) for _, t in rows], [five(t) for _, t in rows]
    comp = slow_groups(fps, S.SEARCH_DISTANCE)
    group = slow_similar(sets, comp)
    same = {}
    for i, s in enumerate(sets):
        group[i] = group[same.setdefault(s, i)]  # texts without words, too
    want = sorted(min(d for (d, _), g in zip(rows, group) if g == k) for k in set(group))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in S.keep_one(df).collect()) == want
    near = [(a, b) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 10 * len(a & b) >= 8 * len(a | b) > 0 and a != b]
    linked = sum(comp[i] == comp[j] for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 10 * len(a & b) >= 8 * len(a | b) > 0 and a != b)
    assert linked >= 0.9 * len(near) > 20  # what the search itself misses


def test_similar_sets_meet_in_their_prefixes():
    rng = random.Random(12)
    pool = np.array(sorted(rng.getrandbits(64) - (1 << 63) for _ in range(400)), dtype=np.int64)
    known = np.sort(rng.sample(pool.tolist(), 150))
    for frequent in ((known[:0], known[:0]), (known, np.array(rng.sample(range(150), 150)))):
        for n in [0, 1, 2, 3, 4, 5, 9, 10, *(rng.randint(6, 200) for _ in range(300))]:
            a = set(rng.sample(pool.tolist(), n))
            b = set(rng.sample(sorted(a), n - rng.randint(0, n // 9))) | set(rng.sample(pool.tolist(), rng.randint(0, n // 9)))
            x, y = (S._prefix(np.array(sorted(s), dtype=np.int64), 0.8, frequent) for s in (a, b))
            assert 10 * len(a & b) < 8 * len(a | b) or not a or set(x.tolist()) & set(y.tolist())
            assert len(x) == min(len(a), len(a) - -(-8 * len(a) // 10) + 1)
            rare = set(a) - set(frequent[0].tolist())
            assert len(rare & set(x.tolist())) == min(len(rare), len(x))


def test_texts_meet_by_shingles_that_they_share(spark, monkeypatch):
    rng = random.Random(13)
    line = " ".join(f"notice{i}" for i in range(10))
    alone = [f"{line} {i} {t}" for i, t in enumerate(copies(rng, 60, 1, 90, (0, 0)))]
    met, links = [], S.links
    monkeypatch.setattr(S, "links", lambda rows, *more: met.append(rows.count()) or links(rows, *more))
    assert S.keep_one(spark.createDataFrame(list(enumerate(alone)), "doc_id long, text string")).count() == 60
    assert met == [0]  # neither by numbers alone, however many texts, nor by a line that all hold


def test_similar_texts_of_distant_fingerprints_are_found(spark):
    rng, pairs = random.Random(14), []
    while len(pairs) < 8:
        base, other = copies(rng, 1, 2, 60, (0, 1))
        a, b = five(base), five(other)
        if 10 * len(a & b) >= 8 * len(a | b) and bin(slow_fingerprint(base) ^ slow_fingerprint(other)).count("1") > 11:
            pairs.append((base, other))
    rows = list(enumerate(t for p in pairs for t in p))
    assert sorted(r.doc_id for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()) == [2 * i for i in range(8)]


def test_long_chains_settle_and_estimates_stay_small(spark):
    from pyspark.sql import functions as F

    from sedgeway.llm.components import connected_components

    n = 6000
    edges = spark.range(1, n).select((F.col("id") * 4099 % n).alias("a"), ((F.col("id") - 1) * 4099 % n).alias("b"))
    found = connected_components(edges)
    assert found.count() == n and found.filter("root != 0").count() == 0
    size = int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size.bit_length() < 40
