"""Prefix trie of conversations by digests of blocks of turns (operator 13).

A conversation's turns are cut into blocks of a fixed number. Conversations are grouped by
the digests of successive blocks first: a block's group is told by its number and by what
all blocks up to it hold. Turn boundaries are refined only in blocks where siblings diverge,
that is where one group goes on with several different blocks; and there one row stands for
all equal blocks. A block that all members of its group share gives its turns' nodes at once.

Sums over subtrees need no walk: each node belongs to its smallest member, so the nodes of a
subtree are what its members own below it, and a node's sums are sums over its members of
numbers that each conversation has once: bytes in all, bytes owned, and whether it ends in a leaf.

Positions and prefixes are running sums inside a key, which are dealt by range so that one
conversation may hold any share of the rows. Ids of conversations that end at a node are
hashed as a sorted stream, a chunk at a time.

Defined cases: null roles and texts are empty; turns go by turn (null first), ties by role
and then text; repeated rows are turns of their own; rows without a conv_id belong to no
conversation and are left out; an empty table gives no rows; other columns are ignored.
Nodes are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import written

BLOCK = 8  # turns
CHUNK = 1 << 15  # ids hashed at a time
NONE = hashlib.sha256(b"").hexdigest()
SHARED = 5  # the query: conversations of one base
HEADS = 9


def running(df: DataFrame, key: str, deal: list, order: list, folds: dict[str, tuple]) -> DataFrame:
    """Adds running folds inside a key: name -> (aggregate, column, how two folds make one).

    Rows are dealt by range of key and `deal` (which order begins with) and written with
    their part's number; inside a part a window folds, and each part is given what the
    key's parts before it hold. So one key may be spread over any number of tasks.
    """
    dealt = written(df.repartitionByRange(key, *deal).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(key, "_part").agg(*[f(c).alias(f"_{k}") for k, (f, c, _) in folds.items()])
    carry = parts.select(key, "_part", *[F.coalesce(f(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k, (f, _, _) in folds.items()])
    local = dealt.withColumns({k: f(c).over(inside) for k, (f, c, _) in folds.items()})
    return local.join(carry, [key, "_part"]).withColumns({k: both(F.col(k), F.col(f"_{k}")) for k, (_, _, both) in folds.items()}).drop("_part", *[f"_{k}" for k in folds])


def _add(a: Column, b: Column) -> Column:
    return a + b


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def numbered(rows: DataFrame) -> DataFrame:
    """(conv, d, mark, bytes): each conversation's turns from 1, with a digest of role and text and the text's UTF-8 bytes."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).filter("conv is not null")
    mark = F.substr(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), F.lit(1), F.lit(32))
    turn = F.col("turn").asc_nulls_first()
    begin = F.substr("text", F.lit(1), F.lit(64))  # ranges are made of samples, which should be short
    told = running(given, "conv", [turn, F.col("role"), begin], [turn, "role", "text"], {"d": (F.sum, F.lit(1).cast("long"), _add)})
    return told.select("conv", "d", mark.alias("mark"), F.octet_length("text").cast("long").alias("bytes"))


def blocks(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per conversation and block: (conv, b, turns, before_1, before_2, upto_1, upto_2, bytes_before, bytes_upto); prefixes are told by two words each."""
    item = F.struct("d", "mark", "bytes")
    cut = turns.groupBy("conv", F.floor((F.col("d") - 1) / size).alias("b")).agg(F.sort_array(F.collect_list(item)).alias("turns"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: t["mark"]), ""), 256)
    cut = cut.withColumn("digest", digest).withColumns({f"own_{k}": F.xxhash64(F.lit(k), "b", "digest") for k in (1, 2)}).drop("digest")
    cut = cut.withColumn("own_bytes", F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["bytes"]))
    folds = {"upto_1": (F.bit_xor, F.col("own_1"), _xor), "upto_2": (F.bit_xor, F.col("own_2"), _xor), "bytes_upto": (F.sum, F.col("own_bytes"), _add)}
    folds = {k: ((lambda c, f=f: f(c)), c, both) for k, (f, c, both) in folds.items()}
    told = running(cut, "conv", [F.col("b")], ["b"], folds)
    before = {f"before_{k}": F.col(f"upto_{k}").bitwiseXOR(F.col(f"own_{k}")) for k in (1, 2)} | {"bytes_before": F.col("bytes_upto") - F.col("own_bytes")}
    return told.withColumns(before).drop("own_1", "own_2", "own_bytes")


SUMS = ("all_bytes", "all_owned", "all_leaves")


def refined(groups: DataFrame, size: int = BLOCK) -> DataFrame:
    """Nodes of the blocks' groups: (depth, k1, k2: the node; p1, p2: its parent; conv, n_convs, bytes, prefix, e1, e2: the group whose turns end here, and sums).

    A group without siblings gives a node for each turn; where siblings diverge, their
    turns' prefixes are compared.
    """
    siblings = groups.groupBy("b", "before_1", "before_2").agg(F.count("*").alias("siblings"))
    told = groups.join(siblings, ["b", "before_1", "before_2"])
    before = lambda j: F.slice("turns", 1, j)
    inner = F.transform(F.sequence(F.lit(1), F.size("turns")), lambda j: F.struct(
        j.alias("j"), F.when(F.col("siblings") > 1, F.array_join(F.transform(before(j), lambda t: t["mark"]), "")).alias("inner"),
        F.aggregate(before(j - 1), F.col("bytes_before"), lambda s, t: s + t["bytes"]).alias("prefix"), F.element_at("turns", j)["bytes"].alias("bytes")))
    each = told.withColumn("x", F.explode(inner)).select("*", "x.*").drop("x")

    def key(k: int, j: Column, inner: Column) -> Column:
        shared = F.when(F.col("siblings") > 1, F.xxhash64(F.lit(k), F.lit("inside"), f"before_{k}", j, inner)).otherwise(F.xxhash64(F.lit(k), F.lit("alone"), f"upto_{k}", j))
        return F.when(j == 0, F.col(f"before_{k}")).when(j == size, F.col(f"upto_{k}")).otherwise(shared)

    above = F.substr("inner", F.lit(1), F.length("inner") - 32)  # without the last mark
    j, last = F.col("j"), F.col("j") == F.size("turns")
    made = each.select(
        "siblings", (F.col("b") * size + j).alias("depth"), *[key(k, j, F.col("inner")).alias(f"k{k}") for k in (1, 2)], *[key(k, j - 1, above).alias(f"p{k}") for k in (1, 2)],
        "conv", "n_convs", "bytes", "prefix", *[F.when(last, F.col(f"upto_{k}")).alias(f"e{k}") for k in (1, 2)], *SUMS)
    one = [f.alias(n) for n, f in ({n: F.first(n) for n in ("p1", "p2", "bytes", "prefix")} | {"conv": F.min("conv"), "n_convs": F.sum("n_convs"), "e1": F.max("e1"), "e2": F.max("e2")} | {n: F.sum(n) for n in SUMS}).items()]
    met = made.filter("siblings > 1").groupBy("depth", "k1", "k2").agg(*one)
    return made.filter("siblings = 1").drop("siblings").unionByName(met)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (e1, e2, conv) as texts of ids, CHUNK at most each."""
    group, ids = None, []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"e1": group[0], "e2": group[1], "first": ids[0], "ids": ",".join(map(str, ids))}], schema=pa.schema([("e1", pa.int64()), ("e2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

    for batch in batches:
        for a, b, conv in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if ids and (group != (a, b) or len(ids) == CHUNK):
                yield told()
                ids = []
            group = (a, b)
            ids.append(conv)
    if ids:
        yield told()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's texts, comma-joined, as they come."""
    group, sha, done = None, None, []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"e1": g[0], "e2": g[1], "ends_sha256": h} for g, h in done], schema=pa.schema([("e1", pa.int64()), ("e2", pa.int64()), ("ends_sha256", pa.string())]))

    for batch in batches:
        for a, b, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if group != (a, b):
                if group:
                    done.append((group, sha.hexdigest()))
                group, sha = (a, b), hashlib.sha256()
                sha.update(ids.encode())
            else:
                sha.update(f",{ids}".encode())
        yield told()
        done = []
    if group:
        done.append((group, sha.hexdigest()))
    yield told()


def ends_digests(ends: DataFrame) -> DataFrame:
    """(e1, e2, conv) -> (e1, e2, ends_sha256), ids in rising order; memory is that of a chunk, whatever ends at one node."""
    parts = ends.repartitionByRange("e1", "e2", "conv").sortWithinPartitions("e1", "e2", "conv").mapInArrow(_chunks, "e1 long, e2 long, first long, ids string")
    return parts.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "first").select("e1", "e2", "ids").mapInArrow(_hashed, "e1 long, e2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Nodes of the trie of turns (conv, d from 1, mark, bytes) of conversations convs (conv), turnless ones too. Columns as of conversation_trie."""
    cut = written(blocks(turns, size))
    group = ["b", "before_1", "before_2", "upto_1", "upto_2"]
    zero = [F.lit(0).cast("long").alias(c) for c in SUMS]
    groups = written(cut.groupBy(*group).agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.first("turns").alias("turns"), F.first("bytes_before").alias("bytes_before")))
    first = written(refined(groups.select("*", *zero), size).drop(*SUMS))
    children = first.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    childed = written(first.join(children, ["depth", "k1", "k2"], "left").select("depth", "k1", "k2", "conv", "bytes", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")))
    owned = childed.groupBy("conv").agg(F.sum("bytes").alias("owned"), F.count_if(F.col("n_children") == 0).alias("leaf"))
    last = F.max(F.struct("b", F.col("upto_1").alias("e1"), F.col("upto_2").alias("e2"), F.col("bytes_upto").alias("bytes"))).alias("last")
    of = written(cut.groupBy("conv").agg(last).join(owned, "conv", "left").select("conv", "last.*", F.coalesce("owned", F.lit(0)).alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf")))
    each = cut.join(of.select("conv", F.col("bytes").alias("all_bytes"), F.col("owned").alias("all_owned"), F.col("leaf").alias("all_leaves")), "conv")
    sums = each.groupBy("b", "upto_1", "upto_2").agg(*[F.sum(c).alias(c) for c in SUMS])
    nodes = refined(groups.join(sums, ["b", "upto_1", "upto_2"]), size)
    nodes = nodes.join(childed.select("depth", "k1", "k2", "n_children"), ["depth", "k1", "k2"])
    nodes = nodes.join(of.select("conv", "bytes", "owned").withColumnsRenamed({"bytes": "least_bytes", "owned": "least_owned"}), "conv")
    # bytes of all members from here on, less each node's bytes once; what the smallest member owns above this node is not below it
    suffix = F.col("all_bytes") - F.col("n_convs") * F.col("prefix")
    once = F.col("all_owned") - F.col("least_owned") + F.col("least_bytes") - F.col("prefix")
    nodes = written(nodes.select("depth", "p1", "p2", "e1", "e2", "conv", "n_convs", "n_children", "all_leaves", (suffix - once).alias("saved_tokens")))
    digests = written(ends_digests(of.select("e1", "e2", "conv")))
    nodes = nodes.join(digests, ["e1", "e2"], "left")
    parents = first.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    least = convs.agg(F.min("conv").alias("least"))  # one row, as root and tops below
    nodes = nodes.join(parents, ["depth", "p1", "p2"], "left").join(F.broadcast(least)).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("least")).otherwise(F.col("parent_conv_id")))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = nodes.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("all_leaves").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))
    tops = of.agg(F.sum("bytes").alias("all_bytes"), F.sum("owned").alias("all_owned"), F.sum("leaf").alias("leaves"))
    below = first.filter("depth = 1").agg(F.count("*").alias("n_children"))
    rooted = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    turnless = ends_digests(convs.join(of, "conv", "left_anti").select(F.lit(0).cast("long").alias("e1"), F.lit(0).cast("long").alias("e2"), "conv")).select("ends_sha256")
    turnless = turnless.agg(F.coalesce(F.max("ends_sha256"), F.lit(NONE)).alias("ends_sha256"))
    root = written(rooted.join(F.broadcast(tops)).join(F.broadcast(below)).join(F.broadcast(turnless))).select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce(F.col("all_bytes") - F.col("all_owned"), F.lit(0)).alias("saved_tokens"), "ends_sha256")
    return nodes.select(*out).unionByName(root)


def conversation_trie(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per node of the trie of conversations (conv_id, turn, role, text): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = written(numbered(rows))
    return trie(turns, turns.select("conv").distinct(), size)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's conversations: the first h turns of the base, then the own ones after the first h; and all ids."""
    sizes = written(turns.groupBy("conv").agg(F.max("d").alias("n")))
    base, h = F.col("conv") - F.col("conv") % SHARED, F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    heads = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    told = sizes.select("conv", base.alias("base"), h.alias("h")).join(heads, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("lead"))
    told = written(told)
    begin = turns.filter(F.col("d") < HEADS).withColumnRenamed("conv", "base").join(told.select("base", "conv", "lead"), "base").filter("d <= lead").select("conv", "d", "mark", "bytes")
    rest = turns.join(told.select("conv", "h", "lead"), "conv").filter("d > h").select("conv", (F.col("d") - F.col("h") + F.col("lead")).alias("d"), "mark", "bytes")
    return written(begin.unionByName(rest)), sizes.select("conv")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(written(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")))))


QUERIES = {"op13_conversation_trie": op13_conversation_trie}
SQL = {
    "op13_conversation_trie": r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM t),
crc(c, s, k, v) AS (
  SELECT c, CAST(c AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL
  SELECT c, s, k + 1, CASE WHEN w % 2 = 1 THEN xor(w >> 1, CAST(3988292384 AS BIGINT)) ELSE w >> 1 END
  FROM (SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(v, CAST(ascii(s[k // 8 + 1]) AS BIGINT)) ELSE v END AS w FROM crc WHERE k < 8 * length(s))),
heads AS (SELECT c, c - c % 5 AS base, xor(v, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE k = 8 * length(s)),
made AS (
  SELECT heads.c, 0 AS part, d, x FROM heads JOIN t ON t.c = base AND d <= h
  UNION ALL SELECT heads.c, 1, d, x FROM heads JOIN t ON t.c = heads.c AND d > h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, d) AS d, x FROM made),
lists AS (SELECT ids.c, coalesce(list(x ORDER BY d) FILTER (x IS NOT NULL), []) AS xs FROM ids LEFT JOIN r ON r.c = ids.c GROUP BY ids.c),
members AS (SELECT c, unnest(range(0, len(xs) + 1)) AS depth, xs FROM lists),
nodes AS (
  SELECT depth, xs[1:depth] AS path, min(c) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN strlen(xs[depth].t) ELSE 0 END) AS bytes,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(xs) = depth), '')) AS ends_sha256
  FROM members GROUP BY depth, xs[1:depth]),
kids AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
told AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, path)),
up AS (SELECT depth AS from_depth, unnest(range(0, depth + 1)) AS depth, path AS whole, n_children, n_convs, bytes FROM told),
sums AS (SELECT depth, whole[1:depth] AS path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens FROM up GROUP BY ALL)
SELECT told.conv_id, CAST(told.depth AS BIGINT) AS depth, above.conv_id AS parent_conv_id, told.n_convs, told.n_children, n_leaves, saved_tokens, told.ends_sha256
FROM told JOIN sums ON sums.depth = told.depth AND sums.path = told.path LEFT JOIN told above ON above.depth = told.depth - 1 AND above.path = told.path[1:told.depth - 1]""",
}
