"""Mixing sources to target weights by minimum-cost flow over membership patterns.

Documents are summed by the set of sources they belong to (their pattern). Sources get target token
counts from their weights, water-filled so that none is above ``max_repeats`` times what it holds. A
minimum-cost flow sends each pattern's capacity to the quotas of its sources; the r-th use of the same
tokens costs r - 1, so nothing is repeated while unused tokens remain. Each pattern then uses all its
documents some whole number of times and a seeded selection of them once more.

The selection orders documents by a seeded hash and takes those below a cut, which is found by two
rounds of 4096 sums each; no source's documents ever meet in one task. The cut falls on a cell of
1 / 2^24 of a pattern's hash range, so a pattern misses its quota by about one document.

Defined cases: a null text has size 0; documents of size 0 are never taken; a null source is a source of
its own, last in order; rows that share a doc_id, or have none, are told apart by ``tie`` (in op5 the hash of
the text); rows alike in both are separate documents that are taken alike; an empty table gives no rows; extra
columns pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedgeway.llm.common import WORD
from sedgeway.runtime import cut, table

#: Patterns whose sums come to the driver at most; more is refused.
MAX_PATTERNS = 100_000
#: Sources' weights in order of their names, repeating; share of all tokens that the mix takes; uses of a document at most.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEATS = 2
SEED = 17
_CELLS = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> dict[str | None, float]:
    """Target of each source: by weight, none above ``max_repeats`` times its size, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, free = share * sum(sizes.values()), list(order)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > max_repeats * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = float(max_repeats * sizes[s])
        left = max(0.0, left - sum(out[s] for s in over))
        free = [s for s in free if s not in out]
    return {s: out[s] for s in order}


def flow(capacity: dict[tuple, int], quota: dict, max_repeats: int = MAX_REPEATS) -> dict[tuple, int]:
    """Tokens that each pattern sends to its sources' quotas at least cost.

    Successive shortest augmenting paths. The arcs from the start to a pattern are its ``max_repeats``
    uses, of cost 0, 1, ...; a path's cost is that of its first arc less that of the use it gives back.
    """
    used = defaultdict(int)
    sent: dict[tuple, dict] = {p: defaultdict(int) for p in capacity}
    need = {s: round(q) for s, q in quota.items()}
    members = defaultdict(list)
    for p in capacity:
        for s in p:
            members[s].append(p)
    for level in range(max_repeats):
        # Within a level all arcs cost the same: plain augmentation by breadth-first search.
        limit = {p: (level + 1) * c for p, c in capacity.items()}
        for p in capacity:  # direct arcs first
            for s in p:
                x = min(limit[p] - used[p], need.get(s, 0))
                if x > 0:
                    used[p] += x
                    sent[p][s] += x
                    need[s] -= x
        while True:
            start = [p for p in capacity if used[p] < limit[p]]
            back: dict = {("p", p): None for p in start}
            queue, goal = [("p", p) for p in start], None
            for node in queue:
                kind, key = node
                if kind == "p":
                    step = [("s", s) for s in key]
                else:
                    if need.get(key, 0) > 0:
                        goal = node
                        break
                    step = [("p", p) for p in members[key] if sent[p][key] > 0]
                for nxt in step:
                    if nxt not in back:
                        back[nxt] = node
                        queue.append(nxt)
            if goal is None:
                break
            path = [goal]
            while back[path[-1]] is not None:
                path.append(back[path[-1]])
            path.reverse()
            x = min(limit[path[0][1]] - used[path[0][1]], need[goal[1]])
            for a, b in zip(path, path[1:]):
                if a[0] == "s":
                    x = min(x, sent[b[1]][a[1]])
            used[path[0][1]] += x
            need[goal[1]] -= x
            for a, b in zip(path, path[1:]):
                if a[0] == "p":
                    sent[a[1]][b[1]] += x
                else:
                    sent[b[1]][a[1]] -= x
    return {p: used[p] for p in capacity}


def _cut_cells(cells: DataFrame, cell: str) -> DataFrame:
    """For each pattern the cell in which the running sum of sizes passes ``quota``, and what is left of the quota before it."""
    w = Window.partitionBy("_pattern").orderBy(cell)
    run = cells.withColumn("upto", F.sum("held").over(w))
    return run.filter((F.col("upto") - F.col("held") <= F.col("quota")) & (F.col("upto") > F.col("quota"))).select(
        "_pattern", F.col(cell).alias(f"{cell}_cut"), (F.col("quota") - F.col("upto") + F.col("held")).alias(f"{cell}_left")
    )


def _keyed(docs: DataFrame, sources: str, doc_id: str, tie: str | None, seed: int) -> DataFrame:
    """``docs`` with its pattern and the two cells of its hash."""
    members = F.coalesce(F.col(sources), F.array(F.lit(None).cast("string")))
    h = F.xxhash64(F.col(doc_id), *([F.col(tie)] if tie else []), F.lit(seed))
    return docs.withColumns({"_members": members, "_pattern": F.to_json(F.array_sort(F.array_distinct(members))), "_c1": F.shiftrightunsigned(h, 52).cast("int"), "_c2": (F.shiftrightunsigned(h, 40) % _CELLS).cast("int")})


def mix(
    docs: DataFrame, sources: str = "sources", size: str = "size", doc_id: str = "doc_id", narrow: DataFrame | None = None,
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, seed: int = SEED, tie: str | None = None,
) -> tuple[DataFrame, dict, dict]:
    """``docs`` with ``times``, the uses of each document, and the sizes and targets of the sources.

    ``sources`` is an array column: a document may belong to several sources, and counts for each.
    ``narrow`` may give the same rows without their texts, for the sums. ``tie`` names a column that tells apart
    rows of one doc_id, or of none.
    """
    spark = docs.sparkSession
    keyed = _keyed(narrow if narrow is not None else docs, sources, doc_id, tie, seed)
    sums = keyed.groupBy("_pattern").agg(F.first("_members").alias("_members"), F.sum(size).alias("held")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    by_pattern = {r["_pattern"]: (tuple(dict.fromkeys(r["_members"])), int(r["held"] or 0)) for r in sums}
    sizes: dict = defaultdict(int)
    for members, held in by_pattern.values():
        for s in members:
            sizes[s] += held
    goal = targets(dict(sizes), weights, share, max_repeats)
    used = flow({(*m, ("_pattern", p)): n for p, (m, n) in by_pattern.items()}, goal, max_repeats) if by_pattern else {}
    plan = []
    for key, tokens in used.items():
        p = key[-1][1]
        held = by_pattern[p][1]
        whole = min(max_repeats, tokens // held) if held else 0
        plan.append((p, int(whole), int(tokens - whole * held)))
    cuts = spark.createDataFrame(plan, "_pattern string, _whole int, quota long")
    level1 = keyed.groupBy("_pattern", "_c1").agg(F.sum(size).alias("held")).join(F.broadcast(cuts), "_pattern")
    cut1 = _cut_cells(level1, "_c1")
    # Broadcast: these frames have a row for each pattern, so MAX_PATTERNS at most.
    inside = keyed.join(F.broadcast(cut1), "_pattern").filter("_c1 = _c1_cut").select("_pattern", "_c2", F.col(size).alias("held_size"), F.col("_c1_left").alias("quota"))
    cut2 = _cut_cells(inside.groupBy("_pattern", "_c2", "quota").agg(F.sum("held_size").alias("held")), "_c2")
    rows = cuts.join(cut1, "_pattern", "left").join(cut2, "_pattern", "left").select("_pattern", "_whole", "_c1_cut", "_c2_cut").collect()  # a row for each pattern
    chosen = spark.createDataFrame([tuple(r) for r in rows], "_pattern string, _whole int, _c1_cut int, _c2_cut int")
    extra = (F.col("_c1") < F.coalesce("_c1_cut", F.lit(-1))) | ((F.col("_c1") == F.col("_c1_cut")) & (F.col("_c2") < F.coalesce("_c2_cut", F.lit(-1))))
    times = F.when(F.col(size) > 0, F.col("_whole") + F.coalesce(extra, F.lit(False)).cast("int")).otherwise(0)
    return _keyed(docs, sources, doc_id, tie, seed).join(F.broadcast(chosen), "_pattern", "left").withColumn("times", times).drop("_members", "_pattern", "_c1", "_c2", "_whole", "_c1_cut", "_c2_cut"), dict(sizes), goal


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", F.array("source").alias("sources"), size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")))
    mixed, sizes, goal = mix(sized, tie="tie")
    known = spark.createDataFrame([(s, int(sizes[s]), float(goal[s])) for s in goal], "src string, source_size long, target double")
    out = mixed.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("src")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"))
