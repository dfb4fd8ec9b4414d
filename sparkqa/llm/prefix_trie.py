"""Trie of the common beginnings of conversations, by truncation peeling.

A conversation is a sequence of turns; its prefix of d turns is known by a 128-bit digest that chains the digests of its
turns, so texts travel once, as digests. A state is a node that all of its deeper part has been told of: its path of
digests, its smallest member, and what its subtree sums up to. Peeling goes from the greatest depth up:

1. States of a depth are what conversations newly end there and what survives from below; equal paths merge into one node,
   by minima and sums that are combined before the shuffle, and the node is told.
2. The last turn is stripped, and what is left meets the states of the depth above.

One pass both finds the nodes and sums them up. Many turns are stripped at once where nothing can merge on the way: among
the states below depth d, one whose prefix of d turns no other has keeps to itself down to there, and its whole chain of
nodes is told at once. Only the others are halved by depth, deeper half first. So the number of steps goes with the
depths at which something merges, and a long conversation costs no step a turn.

Equal conversations merge where they end, before anything else, so a conversation that a third of all rows repeat is one
state. The ids that end at a node may be as many; they are sorted over ranges and hashed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkqa.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Characters of a piece of a node's id list.
PIECE_CHARS = 1 << 20
ROOT = b""


def turn_sequences(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns, an array of (turn, digest of role and text, words in the text), one row per conversation.

    Turns go by ``turn`` (nulls first), equal ones by their digest, a repeated row being a repeated turn. Null roles and texts
    are empty; rows with a null conversation id are one conversation; texts are taken whole; other columns are left out."""
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    by = F.coalesce(F.col(role).cast("string"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256), 1, 32))
    rows = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), digest.alias("digest"), F.regexp_count(said, F.lit(WORD)).alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digests of all prefixes, and the words up to each."""
    for batch in batches:
        paths, sums = [], []
        for digests, words in zip(batch["digests"], batch["words"], strict=True):
            path, upto, known, so_far = [], [], ROOT, 0
            for digest, n in zip(digests, words, strict=True):
                known, so_far = hashlib.blake2b(known + digest, digest_size=16).digest(), so_far + int(n)
                path.append(known)
                upto.append(so_far)
            paths.append(path)
            sums.append(upto)
        yield pd.DataFrame({"conv": batch["conv_id"], "path": paths, "upto": sums}).astype({"conv": "Int64"})


def _depth() -> Column:
    return F.size("path")


def _key(depth: Column | int) -> Column:
    """The digest of the prefix of so many turns, the root's if none."""
    return F.coalesce(F.get("path", F.lit(depth) - 1 if isinstance(depth, int) else depth - 1), F.lit(ROOT))


def _upto(depth: Column | int) -> Column:
    return F.coalesce(F.get("upto", F.lit(depth) - 1 if isinstance(depth, int) else depth - 1), F.lit(0).cast("long"))


STATE = ["path", "upto", "conv", "n", "kids", "leaves", "saved"]
NODE = ["key", "parent", "depth", "conv", "n", "kids", "leaves", "saved"]


def _chain(rows: DataFrame, low: int) -> tuple[DataFrame, DataFrame]:
    """Of states alone down to depth ``low``: their nodes above it, and what survives at it."""
    rows = rows.withColumn("leaves", F.greatest("leaves", F.lit(1).cast("long"))).withColumn("k", _depth())
    each = rows.withColumn("depth", F.explode(F.sequence(F.lit(low + 1), "k")))
    saved = lambda over: F.col("saved") + (F.col("n") - 1) * (_upto(F.col("k")) - over)
    nodes = each.select(
        _key(F.col("depth")).alias("key"), _key(F.col("depth") - 1).alias("parent"), "depth", "conv", "n",
        F.when(F.col("depth") == F.col("k"), F.col("kids")).otherwise(1).alias("kids"), "leaves", saved(_upto(F.col("depth") - 1)).alias("saved"),
    )
    left = rows.select(F.slice("path", 1, low).alias("path") if low else F.array().cast("array<binary>").alias("path"), F.slice("upto", 1, low).alias("upto") if low else F.array().cast("array<bigint>").alias("upto"), "conv", "n", F.lit(1).cast("long").alias("kids"), "leaves", saved(_upto(low)).alias("saved"))
    return nodes, left


def _merged(rows: DataFrame, depth: int) -> DataFrame:
    """One state per path of ``depth`` turns."""
    sums = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")]
    return rows.groupBy(_key(depth).alias("key")).agg(F.any_value("path").alias("path"), F.any_value("upto").alias("upto"), F.min("conv").alias("conv"), *sums).drop("key")


def _peel(rows: DataFrame, low: int, told: list[DataFrame]) -> DataFrame | None:
    """Of stored states deeper than ``low``: what survives at it; adds nodes to ``told``. None if there are no states."""
    high = rows.agg(F.max(_depth())).first()[0]
    if high is None:
        return None
    if high == low + 1:
        nodes, left = _chain(stored(_merged(rows, high), "states"), low)
        told.append(nodes)
        return left
    key = _key(low + 1)
    shared = stored(rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    if shared.isEmpty():
        nodes, left = _chain(rows, low)
        told.append(nodes)
        return left
    tagged = stored(rows.withColumn("key", key).join(shared.withColumn("shared", F.lit(True)), "key", "left").drop("key"), "tagged")
    nodes, left = _chain(tagged.where("shared is null").drop("shared"), low)
    told.append(nodes)
    tagged, middle = tagged.where("shared").drop("shared"), (low + high) // 2
    up = _peel(tagged.where(_depth() > middle), middle, told)
    rest = tagged.where(_depth() <= middle)
    down = _peel(stored(rest if up is None else rest.unionByName(up), "states"), low, told) if middle > low else up
    return left if down is None else left.unionByName(down)


def _pieces(batches: Iterator[pd.DataFrame], chars: int) -> Iterator[pd.DataFrame]:
    """Lists of ids in a row with equal keys, in pieces. In: key, conv, in order."""
    key, first, ids, size = None, None, [], 0
    for batch in batches:
        out = []
        for k, conv in zip(batch["key"], batch["conv"].astype("Int64"), strict=True):
            if ids and (k != key or size > chars):
                out.append((key, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                key, first = k, conv
            ids.append("null" if conv is pd.NA else str(conv))
            size += len(ids[-1]) + 1
        yield pd.DataFrame(out, columns=["key", "first", "ids"]).astype({"first": "Int64"})
    if ids:
        yield pd.DataFrame([(key, first, ",".join(ids))], columns=["key", "first", "ids"]).astype({"first": "Int64"})


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each key's pieces joined by commas. In: key, ids, in order."""
    key, digest = None, None
    for batch in batches:
        out = []
        for k, ids in zip(batch["key"], batch["ids"], strict=True):
            if digest is not None and k == key:
                digest.update(b"," + ids.encode())
                continue
            if digest is not None:
                out.append((key, digest.hexdigest()))
            key, digest = k, hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["key", "ends_sha256"])
    if digest is not None:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "ends_sha256"])


def ends(rows: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Per key: the SHA-256 of its ids in order, joined by commas. rows: key, conv. No list is ever held whole: it goes in
    pieces of ``piece_chars``, in order through one digest."""
    ranged = rows.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    pieces = ranged.mapInPandas(lambda b: _pieces(b, piece_chars), "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInPandas(_hashed, "key binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id (the parent's; null for the root), n_convs,
    n_children, n_leaves (childless nodes of its subtree), saved_tokens (over its subtree, members but one times words of
    the last turn), ends_sha256 (of the ids of the conversations that end there, in order, joined by commas).

    sequences: as ``turn_sequences`` gives them. A sequence without turns belongs to the root alone. A null id is a member
    like others, never the smallest one beside others, and reads ``null``, first, in the list of ids. No sequences, no nodes."""
    paths = sequences.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words")).mapInPandas(_paths, "conv long, path array<binary>, upto array<bigint>")
    paths = stored(paths, "paths")
    ended = paths.groupBy(_key(_depth()).alias("key"), _depth().alias("d")).agg(F.any_value("path").alias("path"), F.any_value("upto").alias("upto"), F.min("conv").alias("conv"), F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    states = stored(ended.select("path", "upto", "conv", "n", zero.alias("kids"), zero.alias("leaves"), zero.alias("saved")), "states")
    told: list[DataFrame] = []
    left, turnless = _peel(states.where(_depth() > 0), 0, told), states.where(_depth() == 0)
    left = turnless if left is None else left.unionByName(turnless)
    root = left.agg(F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")]).where("n > 0")
    root = stored(root.select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("depth"), "conv", "n", "kids", F.greatest("leaves", F.lit(1).cast("long")).alias("leaves"), "saved"), "root")
    top = root.first()
    nodes = root
    for part in told:
        nodes = nodes.unionByName(part)
    nodes = stored(nodes, "nodes")
    ending = ends(paths.select(_key(_depth()).alias("key"), "conv"), piece_chars)
    parents = nodes.where("kids > 0 and depth > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"))
    above = F.when(F.col("depth") == 1, F.lit(top.conv if top else None)).when(F.col("depth") > 1, F.col("parent_conv"))
    # nodes of depth 1, which may be most, have the root above them and do not look for it: their own key spreads them out
    out = nodes.withColumn("parent", F.when(F.col("depth") > 1, F.col("parent")).otherwise(F.col("key"))).join(parents, "parent", "left").join(ending, "key", "left")
    return out.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), above.cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


#: Conversations of a family, and one more than the turns that a member may take from its first.
FAMILY, HEADS = 20, 4


def with_shared_heads(sequences: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % 20 in place of its own, h = crc32(c) % 4."""
    heads = sequences.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = F.coalesce(F.crc32(F.col("conv_id").cast("string")) % HEADS, F.lit(0)).cast("int")
    joined = sequences.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", h).join(heads, "base", "left")
    own = F.filter("turns", lambda t, i: i >= F.col("h"))
    return joined.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), own)).alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_heads(turn_sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


SQL = r"""
WITH given AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS sha, turn
  FROM conversations
), own AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) AS i FROM given
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT)] || list_transform(range(8), lambda b: CAST(-1 AS BIGINT)))),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations)
), rebuilt AS (
  SELECT c.conv_id, o.i, o.sha, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.i <= c.h
  UNION ALL
  SELECT c.conv_id, o.i, o.sha, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.i > c.h
), turns AS (
  SELECT conv_id, text, row_number() OVER w AS depth, string_agg(sha, '') OVER w AS path FROM rebuilt
  WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)
), member AS (
  SELECT conv_id, depth, path, text FROM turns UNION ALL SELECT conv_id, 0, '', '' FROM convs
), last AS (
  SELECT conv_id, max(depth) AS depth, max_by(path, depth) AS path FROM member GROUP BY conv_id
), ended AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM last GROUP BY path
), node AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS saved
  FROM member GROUP BY path, depth
), kids AS (
  SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT left(n.path, 64 * d) AS path, sum(n.saved) AS saved, count(*) FILTER (k.path IS NULL) AS leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM node) n LEFT JOIN kids k ON k.path = n.path GROUP BY 1
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
       CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM node n JOIN below b USING (path) LEFT JOIN kids k ON k.path = n.path LEFT JOIN ended e ON e.path = n.path
LEFT JOIN node p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = left(n.path, 64 * (n.depth - 1))
"""
