"""A trie of conversations by their turns: what they share from the start, level by level.

Construction goes down the levels together. At depth d the live conversations, those that still share their node
with another, meet their d-th turn; grouping by (parent node, turn) gives the nodes of the depth, each named by its
least member, and a join takes the names back to the members. A conversation that is alone in its node leaves the
levels: the rest of it is a chain, written out without reading its turns. So there are as many levels as the longest
start that two conversations share, plus one.

The roll-up goes back: level by level the children of each node are summed and joined to it (children, leaves,
savings). A turn is known by the SHA-256 of its role and text.

Where groups are large: a group is aggregated before it is sent; the join back is one that Spark splits; ids of the
conversations that end in a node are put together in blocks of ``BLOCK`` ids and hashed as they pass in order.

Defined cases: rows without a conv_id belong to no conversation and are left out; a null role or text is empty;
turns are ordered by turn, null first, and those of one turn number by role and text; repeated rows are turns like any other;
an empty table has no nodes, not even a root; other columns are ignored. Ids are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedgeway.functions.fold import running_sha256
from sedgeway.runtime import cut, discard, store, table

#: Values of conv_id, and of turn, that one group may span.
BLOCK = 1024
#: Conversations that take their start from one, and by how many turns at most.
FAMILY, MOST = 5, 9


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, key, n_bytes): the turns of every conversation, numbered from 1.

    Numbers are given within blocks of ``BLOCK`` turn numbers, to which the rows of the blocks before are added, so a
    conversation of very many turns is spread over tasks.
    """
    said, as_text = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.floor(F.col(turn) / BLOCK), F.lit(-(1 << 62))).cast("long").alias("block"),
        F.unhex(F.sha2(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, as_text), 256)).alias("key"), F.octet_length(as_text).cast("long").alias("n_bytes"), said.alias("role"), F.xxhash64(as_text).alias("h"),
    )
    rows = store(rows)
    blocks = rows.groupBy("conv", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("skip > 0").select("conv", "block", "skip")
    inside = Window.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), "role", "key")
    numbered = rows.withColumn("_k", F.row_number().over(inside)).join(first, ["conv", "block"], "left")
    return numbered.select("conv", (F.col("_k") + F.coalesce("skip", F.lit(0))).alias("pos"), "key", "n_bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, key, n_bytes) and (conv, length) of the rebuilt conversations.

    Conversation c takes the first h turns of c - c % 5, h being the CRC-32 of its decimal number modulo 9, then its
    own after its first h. Nothing is paired within a family beyond its first turns: at most 5 times 8 of them.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % MOST
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", h)
    own = turns.withColumn("h", h).filter("pos > h")
    starts = turns.filter(F.col("pos") < MOST).select(F.col("conv").alias("base"), "pos", "key", "n_bytes")
    given = convs.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).join(starts, "base").filter("pos <= h")
    given = store(given.select("conv", "pos", "key", "n_bytes"))
    taken = given.groupBy("conv").agg(F.count("*").alias("taken"))
    convs = store(convs.join(taken, "conv", "left").select("conv", "h", F.coalesce("taken", F.lit(0)).alias("taken"), (F.coalesce("taken", F.lit(0)) + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")))
    # Where the start has fewer turns than h, the own turns close up.
    short = convs.filter("taken < h").select("conv", (F.col("h") - F.col("taken")).alias("less"))
    moved = own.join(short, "conv", "left").select("conv", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "key", "n_bytes")
    return given.unionByName(moved), convs.select("conv", "length")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv, length) with ``turns`` (conv, pos, key, n_bytes), a row for each.

    Columns: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    turns = store(turns.repartitionByRange("pos", "conv"))  # a level reads the files that hold its turns
    convs = store(convs)
    top = convs.agg(F.min("conv").alias("node"), F.count("*").alias("n_convs")).first()  # one row
    live = convs.select("conv", F.lit(top["node"]).cast("long").alias("node"), "length")
    levels: list[DataFrame] = []
    ended = [live.filter("length = 0").select(F.lit(0).cast("long").alias("depth"), "node", "conv")]
    chains: list[DataFrame] = []
    depth = 0
    while True:
        depth += 1
        at = cut(live.filter(F.col("length") >= depth).join(turns.filter(F.col("pos") == depth).select("conv", "key", "n_bytes"), "conv").select("conv", F.col("node").alias("parent"), "length", "key", "n_bytes"))
        groups = at.groupBy("parent", "key").agg(F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("length").alias("longest"))
        groups = cut(groups)
        found = groups.agg(F.count("*").alias("nodes"), F.count_if(F.col("n_convs") > 1).alias("shared")).first()
        if found["nodes"]:
            levels.append(groups)
            chains.append(groups.filter((F.col("n_convs") == 1) & (F.col("longest") > depth)).select("node", F.lit(depth).cast("long").alias("from"), "longest"))
            ended.append(groups.filter((F.col("n_convs") == 1) & (F.col("longest") == depth)).select(F.lit(depth).cast("long").alias("depth"), "node", F.col("node").alias("conv")))
        if not found["shared"]:
            discard(at)
            break
        live = cut(at.join(groups.filter("n_convs > 1").select("parent", "key", "node"), ["parent", "key"]).select("conv", "node", "length"))
        discard(at)
        ended.append(live.filter(F.col("length") == depth).select(F.lit(depth).cast("long").alias("depth"), "node", "conv"))
    return _with_ends(_rolled_up(levels, chains, top["node"], top["n_convs"], convs), _union(ended))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _rolled_up(levels: list[DataFrame], chains: list[DataFrame], root: int | None, n_convs: int, convs: DataFrame) -> DataFrame:
    """All nodes but for ``ends_sha256``: the levels from the last to the first, each joined to the sums of the one below."""
    done: list[DataFrame] = []
    below: DataFrame | None = None

    def sums(level: DataFrame) -> DataFrame:
        return level.groupBy(F.col("parent_conv_id").alias("up")).agg(F.count("*").alias("c_children"), F.sum("n_leaves").alias("c_leaves"), F.sum("saved_tokens").alias("c_saved"))

    def joined(level: DataFrame, alone: Column) -> DataFrame:
        if below is None:
            level = level.withColumns({c: F.lit(None).cast("long") for c in ("c_children", "c_leaves", "c_saved")})
        else:
            level = level.join(sums(below), F.col("node") == F.col("up"), "left")
        return level.select(
            F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("c_children", alone.cast("long")).alias("n_children"), F.coalesce("c_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("n_bytes") + F.coalesce("c_saved", F.lit(0))).alias("saved_tokens"),
        )

    for k in range(len(levels) - 1, -1, -1):
        alone = F.when((F.col("n_convs") == 1) & (F.col("longest") > k + 1), 1).otherwise(0)
        below = cut(joined(levels[k].withColumn("depth", F.lit(k + 1).cast("long")), alone))
        done.append(below)
    one = convs.sparkSession.createDataFrame([(root, 0, None, n_convs, 0)], "node long, depth long, parent long, n_convs long, n_bytes long").filter("n_convs > 0")
    done.append(joined(one, F.lit(0)))
    for chain in chains:
        row = chain.select("node", "longest", F.explode(F.sequence(F.col("from") + 1, F.col("longest"))).alias("depth"))
        zero = F.lit(0).cast("long")
        done.append(row.select(F.col("node").alias("conv_id"), "depth", F.col("node").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(F.col("depth") < F.col("longest"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens")))
        done[-1] = done[-1].withColumn("_end", F.when(F.col("n_children") == 0, F.sha2(F.col("conv_id").cast("string"), 256)))
    return _union([df if "_end" in df.columns else df.withColumn("_end", F.lit(None).cast("string")) for df in done])


def _with_ends(nodes: DataFrame, ended: DataFrame) -> DataFrame:
    """``nodes`` with the digest of the ids of the conversations that end in each, ascending."""
    blocks = ended.groupBy("depth", "node", F.floor(F.col("conv") / BLOCK).alias("block")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))).alias("ids"))
    ends = running_sha256(blocks, ["depth", "node"], "block", "ids", b",").select("depth", F.col("node").alias("conv_id"), "sha256")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(ends, ["depth", "conv_id"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", "_end", none).alias("ends_sha256")
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns = store(turns_of(table(spark, sf_dir, "conversations")))
    return prefix_trie(*rebuilt(turns))


#: The same in DuckDB: prefixes as lists, CRC-32 bit by bit.
OP11_SQL = """
WITH own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
), crc AS (
  SELECT c, l, c - c % 5 AS b,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda a, x: list_reduce(list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT) % 9 AS h
  FROM own
), built AS (
  SELECT x.c, CASE WHEN p.l IS NULL THEN x.l[x.h + 1:] ELSE list_concat(p.l[1:x.h], x.l[x.h + 1:]) END AS l FROM crc x LEFT JOIN own p ON p.c = x.b
), node AS (
  SELECT d, l[1:d] AS p, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE any_value(strlen(l[d].t)) END AS bytes,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(l) = d), '')) AS ends_sha256
  FROM built, LATERAL (SELECT unnest(range(0, len(l) + 1)) AS d) GROUP BY 1, 2
), child AS (
  SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2
), leafy AS (
  SELECT m.*, coalesce(k.n, 0) AS n_children FROM node m LEFT JOIN child k ON k.d = m.d AND k.p = m.p
), total AS (
  SELECT a AS d, p[1:a] AS p, count_if(n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
  FROM leafy, LATERAL (SELECT unnest(range(0, d + 1)) AS a) GROUP BY 1, 2
)
SELECT m.conv_id, m.d::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, t.n_leaves, t.saved_tokens, m.ends_sha256
FROM leafy m JOIN total t ON t.d = m.d AND t.p = m.p LEFT JOIN node up ON up.d = m.d - 1 AND up.p = m.p[1:m.d - 1]
"""
