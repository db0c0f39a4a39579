"""Prefix trie of conversations, by digests of fixed-length blocks of turns.

Every turn has two 64-bit hashes of its content and place; the digest of a prefix is the
exclusive or of its turns' hashes, so prefixes grow and shrink by one operation and are
the same exactly when their turns are (but for a chance of 2^-128 a pair). Conversations are
grouped by block first: running digests after each block of ``BLOCK`` turns make block
nodes, each with its members' number and its smallest member, who alone stands for all from
there on. Where all who go on from a block's start go on with the same block, that member's turns are
nodes as they are. Only where siblings diverge are digests worked out turn by turn inside the block, one row a
sibling and turn, and grouped again.

Sums over subtrees need no walk over the trie. The smallest member of a prefix is that of all longer ones it
has, so a conversation owns its path from some depth on, and what its subtree holds is a
sum over members: of their turns' bytes before that depth (``shared``), and of one for each
owner of a leaf. A second pass over the block nodes makes these sums.

Nothing is gathered for one conversation: places come from one sort and the rows that each of its
partitions holds, running digests from chunks of ``CHUNK`` blocks and one row a chunk, and joins on
a long conversation or a common prefix may be split. The ids that end at a node are hashed in their order
as they stream by, packed to strings by the tasks of a sort.

Defined results: null role or text counts as empty; turns are ordered by turn, null
first, then role, then the hash of role and text, and repeated rows are turns each; rows without a conversation id take no
part; a conversation without turns is a member of the root; an empty table gives no
node; other columns are not read. Texts of any length are read once, as hash and byte length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm.durable import written

BLOCK = 4  # turns of a block
CHUNK = 1024  # blocks of a chunk of running digests
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, turn_hash, bytes, n): each turn with its place from 0 and the number of turns of its conversation."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    turn_hash = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), turn_hash.alias("turn_hash"), F.octet_length(text).cast("long").alias("bytes"))
    id_ = F.monotonically_increasing_id()
    rows = rows.filter("conv IS NOT NULL").orderBy("conv", F.col("turn").asc_nulls_first(), "role", "turn_hash")
    rows = written(rows.select("conv", "turn_hash", "bytes", F.shiftright(id_, 33).alias("part"), id_.bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "turns")
    parts = rows.groupBy("conv", "part").agg(F.min("i").alias("low"), F.count("*").alias("held"))
    own = Window.partitionBy("conv")  # one row a partition of the sort
    parts = parts.select("conv", "part", (F.coalesce(F.sum("held").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("low")).alias("shift"), F.sum("held").over(own).alias("n"))
    return rows.join(parts, ["conv", "part"]).select("conv", (F.col("i") + F.col("shift")).alias("pos"), "turn_hash", "bytes", "n")


def grafted(turns: DataFrame, every: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Numbered turns and ids of conversations that each begin with the first turns of another one.

    Conversation c takes its first h = crc32(c) % (most + 1) turns from conversation c - c % every.
    """
    n = turns.groupBy("conv").agg(F.first("n").alias("n"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).alias("h")
    plan = n.select("conv", (F.col("conv") - F.col("conv") % every).alias("base"), h).join(n.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    plan = written(plan.select("conv", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("m")), "grafts")
    own = turns.join(plan.select("conv", "h", "m"), "conv").filter("pos >= h").select("conv", (F.col("pos") + F.col("m") - F.col("h")).alias("pos"), "turn_hash", "bytes")
    base = turns.filter(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "turn_hash", "bytes")
    head = base.join(plan.select("conv", "base", "m"), "base").filter("pos < m").select("conv", "pos", "turn_hash", "bytes")
    return own.union(head), plan.select("conv")


def _running(rows: DataFrame) -> DataFrame:
    """Blocks (conv, b, bx, by, bytes) with digests (ex, ey) and bytes (total) up to their end; no window holds more than a chunk of a conversation."""
    rows = rows.withColumn("chunk", F.expr(f"b DIV {CHUNK}"))
    inside = Window.partitionBy("conv", "chunk").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"ex": F.bit_xor("bx").over(inside), "ey": F.bit_xor("by").over(inside), "total": F.sum("bytes").over(inside)})
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("conv", "chunk").agg(F.bit_xor("bx").alias("bx"), F.bit_xor("by").alias("by"), F.sum("bytes").alias("bytes"))
    chunks = chunks.select("conv", "chunk", *[F.coalesce(f.over(before), F.lit(0)).alias(a) for f, a in ((F.bit_xor("bx"), "hx"), (F.bit_xor("by"), "hy"), (F.sum("bytes"), "h"))])
    joined = rows.join(chunks, ["conv", "chunk"])
    return joined.select("conv", "b", "bx", "by", "bytes", F.col("ex").bitwiseXOR(F.col("hx")).alias("ex"), F.col("ey").bitwiseXOR(F.col("hy")).alias("ey"), (F.col("total") + F.col("h")).alias("total"))


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (depth, px, py, conv) rows as one row for each run of a key in a batch, its ids joined."""
    for x in batches:
        key = x[["depth", "px", "py"]]
        run = (key != key.shift()).any(axis=1).cumsum()
        yield x.assign(ids=x["conv"].astype(str)).groupby(run, sort=False).agg(depth=("depth", "first"), px=("px", "first"), py=("py", "first"), low=("conv", "first"), ids=("ids", ",".join))


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hash of each key's joined ids, which come sorted by (key, low)."""
    key, sha = None, None
    for x in batches:
        out = []
        for depth, px, py, ids in zip(x["depth"], x["px"], x["py"], x["ids"], strict=True):
            if (depth, px, py) == key:
                sha.update(b",")
            else:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (depth, px, py), hashlib.sha256()
            sha.update(ids.encode())
        yield pd.DataFrame(out, columns=["depth", "px", "py", "sha"])
    if key is not None:
        yield pd.DataFrame([(*key, sha.hexdigest())], columns=["depth", "px", "py", "sha"])


def _ends(members: DataFrame) -> DataFrame:
    """(depth, px, py, sha): the hash of the ids that end at each prefix, in numerical order."""
    key = ["depth", "px", "py"]
    packed = members.select(*key, "conv").orderBy(*key, "conv").mapInPandas(_pack, "depth long, px long, py long, low long, ids string")
    return packed.repartition(*key).sortWithinPartitions(*key, "low").mapInPandas(_stream, "depth long, px long, py long, sha string")


def _xor(a: str, b: str) -> Column:
    return F.col(a).bitwiseXOR(F.col(b))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node of the trie of ``turns`` (conv, pos, turn_hash, bytes) of the conversations ``convs`` (conv), which may have none.

    conv_id (the smallest member), depth, parent_conv_id, n_convs (members), n_children,
    n_leaves, saved_tokens (over the subtree, each node's members but one times its last
    turn's bytes), ends_sha256 (of the joined ids that end there).
    """
    rows = turns.select("conv", "pos", F.expr(f"pos DIV {BLOCK}").alias("b"), F.xxhash64("turn_hash", "pos").alias("x"), F.xxhash64("pos", F.lit("second"), "turn_hash").alias("y"), "bytes")
    rows = written(rows, "hashed-turns")
    whole = rows.groupBy("conv").agg(F.count("*").alias("depth"), F.bit_xor("x").alias("px"), F.bit_xor("y").alias("py"), F.sum("bytes").alias("total"))
    members = written(convs.join(whole, "conv", "left").na.fill(0, ["depth", "px", "py", "total"]), "members")

    # block nodes: members by running digests, and how many go on differently from the same start
    blocks = _running(rows.groupBy("conv", "b").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"), F.sum("bytes").alias("bytes")))
    blocks = written(blocks.select("conv", "b", "ex", "ey", _xor("ex", "bx").alias("sx"), _xor("ey", "by").alias("sy"), (F.col("total") - F.col("bytes")).alias("before")), "blocks")
    nodes = written(blocks.groupBy("b", "ex", "ey", "sx", "sy", "before").agg(F.min("conv").alias("conv"), F.count("*").alias("n")), "block-nodes")
    siblings = written(nodes.groupBy("b", "sx", "sy").agg(F.count("*").alias("siblings")), "siblings")
    nodes = nodes.join(siblings, ["b", "sx", "sy"]).select("conv", "b", "sx", "sy", "before", "n", "siblings")

    # the turns of those who stand for a block node, and where siblings diverge one node for equal prefixes
    inside = Window.partitionBy("conv", "b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    steps = rows.join(nodes, ["conv", "b"])
    steps = steps.withColumns({"px": F.bit_xor("x").over(inside).bitwiseXOR(F.col("sx")), "py": F.bit_xor("y").over(inside).bitwiseXOR(F.col("sy")), "shared": F.col("before") + F.sum("bytes").over(inside) - F.col("bytes")})
    steps = written(steps.select("conv", "b", (F.col("pos") + 1).alias("depth"), "px", "py", _xor("px", "x").alias("qx"), _xor("py", "y").alias("qy"), "shared", "n", "siblings"), "steps")
    what = ["depth", "px", "py", "qx", "qy", "shared"]
    alone = steps.filter("siblings = 1").select("conv", *what, "n")
    merged = steps.filter("siblings > 1").groupBy(*what).agg(F.min("conv").alias("conv"), F.sum("n").alias("n"))
    root = members.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).filter("n > 0").select("conv", *[F.lit(0).cast("long").alias(c) for c in what], "n")
    nodes = written(alone.unionByName(merged).unionByName(root), "nodes")

    # a conversation's first own node hangs on another's: that is its parent, and one of that one's children
    first = nodes.filter("depth > 0").groupBy("conv").agg(F.min(F.struct("depth", "qx", "qy", "shared")).alias("f")).select("conv", "f.*")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("conv").alias("parent"))
    first = written(first.join(parents, ["depth", "qx", "qy"]).select("conv", "depth", "parent", "shared"), "first-nodes")
    hung = first.groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("hung"))
    owners = members.select("conv", F.col("depth").alias("length"), "total").join(first.select("conv", F.col("shared").alias("before")), "conv", "left")
    owners = written(owners.select("conv", "length", F.coalesce("before", "total").alias("not_own")), "owners")  # tables on both sides: a long conversation's join can be split
    nodes = nodes.join(owners.select("conv", "length", "not_own"), "conv").join(hung, ["conv", "depth"], "left")
    children = F.coalesce("hung", F.lit(0)) + ((F.col("depth") > 0) & (F.col("length") > F.col("depth"))).cast("long")
    nodes = written(nodes.select("conv", "depth", "px", "py", "shared", "n", "not_own", children.alias("children")), "nodes-with-children")

    # what members add to the sums of all subtrees that they are in
    leaves = nodes.filter("children = 0 AND depth > 0").select("conv", F.lit(1).cast("long").alias("leaf"))
    adds = written(owners.join(leaves, "conv", "left").select("conv", "not_own", F.coalesce("leaf", F.lit(0)).alias("leaf")), "member-sums")
    sums = [F.sum("not_own").alias("not_own_sum"), F.sum("leaf").alias("leaves")]
    by_block = blocks.select("conv", "b", "ex", "ey").join(adds, "conv").groupBy("b", "ex", "ey").agg(F.min("conv").alias("conv"), *sums).drop("ex", "ey")
    by_step = steps.select("conv", "b", "depth", "px", "py", "siblings").join(by_block, ["conv", "b"])
    alone = by_step.filter("siblings = 1").select("conv", "depth", "not_own_sum", "leaves")
    merged = by_step.filter("siblings > 1").groupBy("depth", "px", "py").agg(F.min("conv").alias("conv"), F.sum("not_own_sum").alias("not_own_sum"), F.sum("leaves").alias("leaves")).drop("px", "py")
    root = adds.agg(F.min("conv").alias("conv"), *sums).select("conv", F.lit(0).cast("long").alias("depth"), "not_own_sum", "leaves")
    added = alone.unionByName(merged).unionByName(root)

    out = nodes.join(added, ["conv", "depth"]).join(first.select("conv", "depth", "parent"), ["conv", "depth"], "left").join(_ends(members), ["depth", "px", "py"], "left")
    saved = F.col("not_own_sum") - (F.col("n") - 1) * F.col("shared") - F.col("not_own")
    return out.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.when(F.col("children") == 0, F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        saved.alias("saved_tokens"),
        F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The trie of conversations as they are; ``columns`` as for ``numbered``."""
    turns = written(numbered(conversations, **columns), "numbered")
    return trie(turns, turns.select("conv").distinct())


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    turns = written(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "numbered")
    return trie(*grafted(turns))


OP13_SQL = """
WITH t AS (
  SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS th, strlen(coalesce(text, '')) AS bytes, turn, coalesce(role, '') AS role
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, th, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, th) - 1 AS pos FROM t
), n AS (
  SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id
), h AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, n,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda a, byte: list_reduce(list_prepend(xor(a, byte), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 9 AS h
  FROM n
), p AS (
  SELECT h.conv_id, h.base, h.h, least(h.h, coalesce(b.n, 0)) AS m FROM h LEFT JOIN n b ON b.conv_id = h.base
), r AS (
  SELECT o.conv_id, m + pos - h AS pos, th, bytes FROM o JOIN p USING (conv_id) WHERE pos >= h
  UNION ALL SELECT p.conv_id, pos, th, bytes FROM p JOIN o ON o.conv_id = p.base AND pos < m
), m AS (
  SELECT conv_id, pos + 1 AS depth, md5(string_agg(th, ',') OVER (PARTITION BY conv_id ORDER BY pos)) AS k, bytes FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM p
), d AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes FROM m GROUP BY depth, k
), l AS (
  SELECT d.depth, d.k, u.conv_id AS parent FROM d JOIN m ON m.conv_id = d.conv_id AND m.depth = d.depth - 1 JOIN d u ON u.depth = m.depth AND u.k = m.k
), c AS (
  SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n FROM l GROUP BY ALL
), y AS (
  SELECT d.*, coalesce(c.n, 0) AS kids FROM d LEFT JOIN c USING (conv_id, depth)
), s AS (
  SELECT m.depth, m.k, sum((kids = 0)::BIGINT)::BIGINT AS leaves, sum((y.n - 1) * y.bytes)::BIGINT AS saved FROM y JOIN m ON m.conv_id = y.conv_id AND m.depth <= y.depth GROUP BY m.depth, m.k
), e AS (
  SELECT depth, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM (SELECT conv_id, depth, k FROM m QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY depth, k
)
SELECT y.conv_id, y.depth, l.parent AS parent_conv_id, y.n AS n_convs, y.kids AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM y JOIN s USING (depth, k) LEFT JOIN l USING (depth, k) LEFT JOIN e USING (depth, k)
"""
