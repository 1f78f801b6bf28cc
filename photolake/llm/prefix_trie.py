"""A trie of conversations, built as ternary search trees in range shards.

Turns are dictionary-encoded, conversations become sequences of turn ids, and equal sequences are collapsed first, so that a conversation
repeated a million times is one row. Sorted sequences are dealt to shards by range; a shard inserts its sequences median first into
a ternary search tree (so each level's search tree is balanced) and an iterative traversal sums members, leaves and savings
upwards. Only nodes on the path of a shard's first or last sequence can go on in another shard; these boundary nodes are merged afterwards,
each adding what its shards hold below it. Sequences of more than ``SEGMENT`` turns are cut: the tree of a later segment hangs below
the node at which the segment before it ends, and deeper levels are done first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from photolake.llm.base import bounded, written
from photolake.operators.ranking import ranked

#: Turns of a conversation in one row.
SEGMENT = 1024
#: Turns of distinct sequences in one shard.
SHARD_TURNS = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()


def encoded(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, pos (1, 2, ...), key (SHA-256 of role and text), words (of the text).

    Rows go by turn, null first, ties by key; a null role or text is empty; repeated rows stay repeated turns. Rows without
    conv_id belong to no conversation. Only the digest of a text moves; a conversation of any length is ranked in many tasks.
    """
    rows = conversations.where("conv_id IS NOT NULL").selectExpr(
        "CAST(conv_id AS BIGINT) AS conv_id", "turn", "coalesce(CAST(role AS STRING), '') AS role",
        "coalesce(CAST(text AS STRING), '') AS text")
    return ranked(rows.select("conv_id", "turn", F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("key"),
                              F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")),
                  ["conv_id"], [F.col("turn"), F.col("key")], "pos").select("conv_id", "pos", "key", "words")


def _segments(turns: DataFrame, convs: DataFrame, segment: int) -> DataFrame:
    """conv_id, level, r0, r1 (hash of all earlier segments), ids, words, x0, x1 (that hash with this segment), goes_on, seq."""
    terms = written(turns.groupBy("key").agg(F.max("words").alias("words")).withColumn("id", F.monotonically_increasing_id()))
    coded = turns.select("conv_id", "pos", "key").join(terms, "key")
    rows = (coded.groupBy("conv_id", F.floor((F.col("pos") - 1) / segment).cast("long").alias("level"))
            .agg(F.sort_array(F.collect_list(F.struct("pos", "id", "words"))).alias("t"))
            .selectExpr("conv_id", "level", "t.id AS ids", "t.words AS words"))
    empty = convs.join(rows.select("conv_id").distinct(), "conv_id", "left_anti").selectExpr(
        "conv_id", "0L AS level", "CAST(array() AS ARRAY<BIGINT>) AS ids", "CAST(array() AS ARRAY<BIGINT>) AS words")
    own = "sha2(concat_ws(',', CAST(level AS STRING), CAST(ids AS ARRAY<STRING>)), 256)"
    order = W.partitionBy("conv_id").orderBy("level")
    rows = rows.unionByName(empty).withColumn("own", F.expr(own))
    for k, at in (("0", 1), ("1", 16)):
        rows = (rows.withColumn(f"h{k}", F.expr(f"CAST(conv(substr(own, {at}, 15), 16, 10) AS BIGINT)"))
                .withColumn(f"x{k}", F.bit_xor(f"h{k}").over(order.rowsBetween(W.unboundedPreceding, 0)))
                .withColumn(f"r{k}", F.expr(f"x{k} ^ h{k}")))
    return (rows.withColumn("goes_on", F.lead("level").over(order).isNotNull())
            .withColumn("seq", F.unhex(F.sha2(F.concat_ws(",", F.col("r0").cast("string"), F.col("r1").cast("string"), "own"), 256)))
            .select("conv_id", "level", "r0", "r1", "ids", "words", "x0", "x1", "goes_on", "seq"))


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, conv_id), sorted -> seq, SHA-256 of its conv_ids, comma-joined. A list is hashed as it streams by."""
    seq, digest = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for own, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if own == seq:
                digest.update(b",%d" % conv_id)
                continue
            if seq is not None:
                done.append((seq, digest.hexdigest()))
            seq, digest = own, hashlib.sha256(b"%d" % conv_id)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())],
                                         names=["seq", "ends"])
    if seq is not None:
        yield pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["seq", "ends"])


_OUT = pa.schema([("r0", pa.int64()), ("r1", pa.int64()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
                  ("n_convs", pa.int64()), ("words", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                  ("saved", pa.int64()), ("ends", pa.string()), ("node", pa.binary()), ("above", pa.list_(pa.binary())),
                  ("parent", pa.binary())])
_OUT_SQL = ("r0 long, r1 long, depth long, conv_id long, parent_conv_id long, n_convs long, words long, n_children long, n_leaves long, "
            "saved long, ends string, node binary, above array<binary>, parent binary")


class TernaryTree:
    """Sequences of ids with a weight and a least member, in a ternary search tree.

    Node 0 stands for the empty sequence. ``low`` and ``high`` lead to siblings with smaller and greater ids, ``down`` to the children.
    """

    def __init__(self) -> None:
        self.turn, self.words, self.parent, self.depth = [-1], [0], [-1], [0]
        self.low, self.high, self.down = [-1], [-1], [-1]
        self.members, self.least = [0], [None]
        self.ends: dict[int, str] = {}
        self.below: dict[int, tuple[int, int, int]] = {}

    def _node(self, turn: int, words: int, parent: int) -> int:
        for values, value in ((self.turn, turn), (self.words, words), (self.parent, parent), (self.depth, self.depth[parent] + 1),
                              (self.low, -1), (self.high, -1), (self.down, -1), (self.members, 0), (self.least, None)):
            values.append(value)
        return len(self.turn) - 1

    def insert(self, ids: list[int], words: list[int], members: int, least: int) -> int:
        """The node at which the sequence ends."""
        at = 0
        for turn, n_words in zip(ids, words):
            links, place = self.down, at
            while (here := links[place]) >= 0 and self.turn[here] != turn:
                links, place = (self.low if turn < self.turn[here] else self.high), here
            if here < 0:
                here = links[place] = self._node(turn, n_words, at)
            at = here
        self.members[at] += members
        self.least[at] = least if self.least[at] is None else min(least, self.least[at])
        return at

    def order(self) -> list[int]:
        """All nodes, parents first."""
        out, stack = [0], [self.down[0]]
        while stack:
            at = stack.pop()
            if at >= 0:
                out.append(at)
                stack += (self.low[at], self.high[at], self.down[at])
        return out

    def path(self, at: int) -> list[int]:
        out = [at]
        while out[-1]:
            out.append(self.parent[out[-1]])
        return out[::-1]


def _grow(rows: list[dict]) -> tuple[TernaryTree, list[int]]:
    """Sorted sequences of one root, inserted median first, and the node of each."""
    tree, nodes, stack = TernaryTree(), [0] * len(rows), [(0, len(rows))]
    while stack:
        a, b = stack.pop()
        if a < b:
            mid = (a + b) // 2
            row = rows[mid]
            nodes[mid] = at = tree.insert(row["ids"], row["words"], row["n"], row["least"])
            if row["ends"] is not None:
                tree.ends[at] = row["ends"]
            if row["below_children"]:
                tree.below[at] = (row["below_children"], row["below_leaves"], row["below_saved"])
            stack += ((a, mid), (mid + 1, b))
    return tree, nodes


def _summed(rows: list[dict], is_first: bool, is_last: bool) -> pa.RecordBatch:
    """One root's sequences of a shard -> its nodes. A node that may go on in another shard (the path of the shard's first or
    last sequence) has ``node`` set, and counts children, leaves and savings without those of such nodes below it."""
    tree, nodes = _grow(rows)
    own = rows[0]
    open_nodes: dict[int, bytes] = {}
    for at in [nodes[0]] * is_first + [nodes[-1]] * is_last:
        digest = hashlib.sha256(b"%d,%d" % (own["r0"], own["r1"]))
        for x in tree.path(at):
            digest.update(b",%d" % tree.turn[x])
            open_nodes[x] = digest.digest()
    size = len(tree.turn)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for at, (n_children, n_leaves, n_saved) in tree.below.items():
        children[at], leaves[at], saved[at] = n_children, n_leaves, n_saved
    order = tree.order()
    for at in reversed(order):
        up = tree.parent[at]
        if at not in open_nodes:
            leaves[at] += not children[at]
            if at:
                saved[at] += (tree.members[at] - 1) * tree.words[at]
        if up >= 0:
            tree.members[up] += tree.members[at]
            if tree.least[up] is None or tree.least[at] < tree.least[up]:
                tree.least[up] = tree.least[at]
            if at not in open_nodes:
                children[up] += 1
                leaves[up] += leaves[at]
                saved[up] += saved[at]
    if own["root_least"] is not None:
        tree.least[0] = own["root_least"]
    columns: list[list] = [[] for _ in _OUT]
    for at in order:
        up = tree.parent[at]
        node = open_nodes.get(at)
        above = [open_nodes[x] for x in tree.path(at)[:-1]] if node is not None else None
        values = (own["r0"], own["r1"], tree.depth[at], tree.least[at], tree.least[up] if up >= 0 else None, tree.members[at], tree.words[at],
                  children[at], leaves[at], saved[at], tree.ends.get(at), node, above, open_nodes.get(up))
        for column, value in zip(columns, values):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted sequences of a shard, one root after the other."""
    rows: list[dict] = []
    first = True
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["r0"], row["r1"]) != (rows[0]["r0"], rows[0]["r1"]):
                yield _summed(rows, first, False)
                rows, first = [], False
            rows.append(row)
    if rows:
        yield _summed(rows, first, True)


def _merged(parts: DataFrame) -> DataFrame:
    """Boundary nodes of all shards -> whole nodes with ``node`` and ``parent``."""
    nodes = written(parts.where("node IS NOT NULL").groupBy("node", "parent", "above", "r0", "r1", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("words").alias("words"),
        F.sum("n_children").alias("inner_children"), F.sum("n_leaves").alias("inner_leaves"), F.sum("saved").alias("inner_saved"),
        F.max("ends").alias("ends")))
    known = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    nodes = nodes.join(known, "node", "left").withColumn("n_children", F.expr("inner_children + coalesce(more, 0L)"))
    sums = (nodes.selectExpr("inner_leaves + CASE WHEN n_children = 0 THEN 1L ELSE 0L END AS leaves",
                             "inner_saved + CASE WHEN depth > 0 THEN (n_convs - 1) * words ELSE 0L END AS saved",
                             "explode(concat(above, array(node))) AS node")
            .groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved")))
    return nodes.join(sums, "node").select("node", "parent", "r0", "r1", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends")


def prefix_trie(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``turns`` as from ``encoded`` and ``convs`` (conv_id, distinct, all conversations) -> one row per node.

    Columns: conv_id (least member), depth, parent_conv_id (the parent's conv_id; null at the root), n_convs (members), n_children, n_leaves
    (childless nodes in the subtree), saved_tokens (over the subtree, (n_convs - 1) * words of the node's last turn), ends_sha256 (of the
    comma-joined conv_ids, ascending, of members that end here; of the empty string if none does).

    A conversation without turns ends at the root. Ties, nulls and repeated rows are settled in ``encoded``. Other columns are ignored; without
    conversations there is no node. Members that end at one node are hashed in one stream (SHA-256 of a list cannot be split), in constant memory.
    """
    segments = written(_segments(turns, convs.select("conv_id"), segment))
    levels = segments.agg(F.max("level")).first()[0]
    if levels is None:
        return segments.selectExpr("conv_id", "level AS depth", "conv_id AS parent_conv_id", "level AS n_convs", "level AS n_children",
                                   "level AS n_leaves", "level AS saved_tokens", "CAST(seq AS STRING) AS ends_sha256")
    ends = segments.where("NOT goes_on").select("seq", "conv_id").repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(
        _list_digests, "seq binary, ends string")
    keys = ["seq", "level", "r0", "r1", "x0", "x1", "ids", "words"]
    distinct = segments.groupBy(*keys).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.bool_or("goes_on").alias("goes_on"))
    sequences = written(distinct.join(ends, "seq", "left"))
    sizes = {r["level"]: r["turns"] for r in sequences.groupBy("level").agg(F.sum(F.size("ids") + 1).alias("turns")).collect()}  # a row per level
    below, out = None, []
    for level in range(levels, -1, -1):
        rows = sequences.where(F.col("level") == level)
        if below is None:
            rows = rows.selectExpr("*", "0L AS below_children", "0L AS below_leaves", "0L AS below_saved")
        else:
            rows = rows.join(below, (F.col("x0") == F.col("b0")) & (F.col("x1") == F.col("b1")) & F.col("goes_on"), "left").drop("b0", "b1")
        if level == 0:
            rows = rows.withColumn("root_least", F.lit(None).cast("long"))
        else:
            roots = sequences.where((F.col("level") == level - 1) & F.col("goes_on")).selectExpr("x0 AS r0", "x1 AS r1", "least AS root_least")
            rows = rows.join(roots, ["r0", "r1"])
        shards = max(1, -(-int(sizes[level]) // shard_turns))
        placed = rows.repartitionByRange(shards, "r0", "r1", "ids").sortWithinPartitions("r0", "r1", "ids")
        parts = written(placed.select("r0", "r1", "root_least", "ids", "words", "n", "least", "ends", "below_children", "below_leaves",
                                      "below_saved").mapInArrow(_shard, _OUT_SQL))
        merged = written(_merged(parts))
        own = parts.where("node IS NULL")
        up = bounded(merged.selectExpr("node AS up", "conv_id AS up_conv_id"))
        columns = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
        inner = own.join(up, F.col("parent") == F.col("up"), "left").withColumn(
            "parent_conv_id", F.coalesce("up_conv_id", "parent_conv_id"))
        edge = merged.join(up, F.col("parent") == F.col("up"), "left").withColumnRenamed("up_conv_id", "parent_conv_id")
        nodes = inner.select(*columns).unionByName(edge.select(*columns))
        if level:
            nodes = nodes.where("depth > 0")
            roots = own.where("depth = 0").select("r0", "r1", "n_children", "n_leaves", "saved").unionByName(
                merged.where("depth = 0").select("r0", "r1", "n_children", "n_leaves", "saved"))
            below = written(roots.selectExpr("r0 AS b0", "r1 AS b1", "n_children AS below_children", "n_leaves AS below_leaves", "saved AS below_saved"))
        out.append(nodes.withColumn("depth", F.col("depth") + level * segment))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
                        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, **params) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text); see ``encoded`` and ``prefix_trie``."""
    return prefix_trie(encoded(conversations), conversations.selectExpr("CAST(conv_id AS BIGINT) AS conv_id").where(
        "conv_id IS NOT NULL").distinct(), **params)
