"""Prefix tries of conversations in adaptive radix trees.

A turn's id is 16 bytes of the SHA-256 of its role and text, a conversation's key the ids of its turns
one after the other. Sorted keys are dealt to tasks in ranges; a task puts each chunk of them into an
adaptive radix tree, whose nodes hold 4, 16, 48 or 256 children and compress paths. Only byte depths
that are a whole number of turns are nodes of the result.

A chunk's nodes that are prefixes of its first or last key may have members in other chunks too:
these are open, the others closed. Closed nodes are complete. Open ones, two paths a chunk, are summed
by node; the sums below them come from each chunk's closed part and from the open nodes that
each chunk owns, which are those no earlier chunk has.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinograph.session import with_small

from . import rows

#: Bytes of a turn's id.
WIDTH = 16
#: Turns of a chunk; its last conversation is whole.
CHUNK_TURNS = 100_000
_NONE = hashlib.sha256(b"").hexdigest()


class Sorted:
    """Up to 16 children: their bytes in order, and the children beside them."""

    __slots__ = ("bytes", "nodes", "room")

    def __init__(self, room: int = 4):
        self.bytes, self.nodes, self.room = bytearray(), [], room

    def get(self, byte: int):
        k = self.bytes.find(byte)
        return None if k < 0 else self.nodes[k]

    def put(self, byte: int, node):
        k = bisect_left(self.bytes, byte)
        if k < len(self.bytes) and self.bytes[k] == byte:
            self.nodes[k] = node
            return self
        if len(self.bytes) == self.room:
            if self.room == 4:
                self.room = 16
            else:
                return Indexed(self.items()).put(byte, node)
        self.bytes.insert(k, byte)
        self.nodes.insert(k, node)
        return self

    def items(self):
        return zip(self.bytes, self.nodes)


class Indexed:
    """Up to 48 children, found through a table of 256 places."""

    __slots__ = ("place", "nodes")

    def __init__(self, items):
        self.place, self.nodes = bytearray(256), []
        for byte, node in items:
            self.put(byte, node)

    def get(self, byte: int):
        k = self.place[byte]
        return self.nodes[k - 1] if k else None

    def put(self, byte: int, node):
        k = self.place[byte]
        if k:
            self.nodes[k - 1] = node
            return self
        if len(self.nodes) == 48:
            return Full(self.items()).put(byte, node)
        self.nodes.append(node)
        self.place[byte] = len(self.nodes)
        return self

    def items(self):
        return ((byte, self.nodes[k - 1]) for byte, k in enumerate(self.place) if k)


class Full:
    """A child for each byte."""

    __slots__ = ("nodes",)

    def __init__(self, items):
        self.nodes = [None] * 256
        for byte, node in items:
            self.nodes[byte] = node

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node):
        self.nodes[byte] = node
        return self

    def items(self):
        return ((byte, node) for byte, node in enumerate(self.nodes) if node is not None)


class Node:
    __slots__ = ("path", "children", "ends")

    def __init__(self, path: bytes):
        self.path, self.children, self.ends = path, None, []

    def put(self, byte: int, node: Node) -> None:
        self.children = (self.children or Sorted()).put(byte, node)


class RadixTree:
    """Keys may repeat and may be prefixes of each other; a node lists the items that end there."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, item) -> None:
        node, above, edge, at = self.root, None, 0, 0
        while True:
            path = node.path
            if not key.startswith(path, at):
                same = len(commonprefix([path, key[at:at + len(path)]]))
                top = Node(path[:same])
                top.put(path[same], node)
                node.path = path[same + 1:]
                above.put(edge, top)
                node = top
            at += len(node.path)
            if at == len(key):
                node.ends.append(item)
                return
            edge, above = key[at], node
            node = above.children.get(edge) if above.children else None
            at += 1
            if node is None:
                leaf = Node(key[at:])
                leaf.ends.append(item)
                above.put(edge, leaf)
                return


def _chain(key: bytes) -> list[bytes]:
    """The name of each whole-turn prefix: a running digest, so that long keys stay linear."""
    names = [b"\0" * 16]
    for k in range(0, len(key), WIDTH):
        names.append(hashlib.blake2b(names[-1] + key[k:k + WIDTH], digest_size=16).digest())
    return names


def _joined(ids) -> str:
    return ",".join("" if i is None else str(i) for i in ids)


class _Sums:
    """What is known of the subtree at a place on the way up."""

    __slots__ = ("n", "least", "kids", "leaves", "saved", "item", "rows")

    def __init__(self):
        self.n, self.least, self.kids, self.leaves, self.saved, self.item, self.rows = 0, None, 0, 0, 0, None, []

    def add(self, other: _Sums) -> None:
        self.n += other.n
        if self.least is None or other.least is not None and other.least < self.least:
            self.least = other.least
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        if self.item is None:
            self.item = other.item
        if len(other.rows) > len(self.rows):
            self.rows, other.rows = other.rows, self.rows
        self.rows += other.rows


def chunk_nodes(keys: list, ids: list, words: list) -> tuple[list, list]:
    """Closed and open nodes of sorted keys, from the leaves up."""
    tree = RadixTree()
    for item, key in enumerate(keys):
        tree.insert(key, item)
    ends = (keys[0], keys[-1])
    names = [_chain(k) for k in ends]
    closed, open_ = [], []

    def emit(at: int, same: list, here: list, sums: _Sums) -> None:
        depth = at // WIDTH
        count = words[sums.item][depth - 1] if depth else 0
        own = (sums.n - 1) * count
        on = [at <= s for s in same]
        if any(on):
            path = names[0] if on[0] else names[1]
            for row in sums.rows:
                row["parent"] = path[depth]
            open_.append({"name": path[depth], "parent": path[depth - 1] if depth else None, "conv_id": sums.least, "depth": depth,
                          "n_convs": sums.n, "n_children": sums.kids, "n_leaves": sums.leaves, "saved_tokens": sums.saved, "words": count,
                          "side": 0 if on[0] else 1, "shared": all(on), "ends": _joined(ids[k] for k in here) if here else None})
            sums.kids, sums.rows = 0, []
            return
        if not sums.kids:
            sums.leaves = 1
        sums.saved += own
        for row in sums.rows:
            row["parent_conv_id"] = sums.least
        closed.append({"conv_id": sums.least, "depth": depth, "n_convs": sums.n, "n_children": sums.kids, "n_leaves": sums.leaves,
                       "saved_tokens": sums.saved, "ends_sha256": hashlib.sha256(_joined(ids[k] for k in here).encode()).hexdigest() if here else _NONE})
        sums.kids, sums.rows = 1, [closed[-1]]

    def visit(node: Node, above: int, edge: bytes, limits: list):
        """A node on the way: where it starts and ends, and how far it agrees with either end."""
        part = edge + node.path
        same = [above + len(commonprefix([part, e[above:above + len(part)]])) if s == above else s for s, e in zip(limits, ends)]
        return node, above, above + len(part), same, iter(node.children.items() if node.children else ()), _Sums()

    todo = [visit(tree.root, 0, b"", [0, 0])]
    while todo:
        node, above, end, same, children, sums = todo[-1]
        if child := next(children, None):
            todo.append(visit(child[1], end, bytes([child[0]]), same))
            continue
        todo.pop()
        if node.ends:
            first = _Sums()
            first.n, first.item = len(node.ends), node.ends[0]
            first.least = min((ids[k] for k in node.ends if ids[k] is not None), default=None)
            sums.add(first)
        at = end - end % WIDTH
        while at > above or at == 0 and node is tree.root:
            emit(at, same, node.ends if at == end else [], sums)
            at -= WIDTH
        if todo:
            todo[-1][5].add(sums)
    return closed, open_


_PARTS = ("chunk long, open boolean, name binary, parent binary, conv_id {id}, depth long, parent_conv_id {id}, n_convs long, n_children long, "
          "n_leaves long, saved_tokens long, words long, side int, shared boolean, ends string, ends_sha256 string")


def _trees(turns: int):
    names = [c.split(" ")[0] for c in _PARTS.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        chunk, held, size, kind = TaskContext.get().partitionId() << 33, [], 0, None

        def flush():
            closed, open_ = chunk_nodes(*map(list, zip(*held)))
            for row in closed:
                row["open"] = False
            for row in open_:
                row["open"] = True
            both = open_ + closed
            types = {"chunk": pa.int64(), "open": pa.bool_(), "name": pa.binary(), "parent": pa.binary(), "conv_id": kind, "parent_conv_id": kind,
                     "side": pa.int32(), "shared": pa.bool_(), "ends": pa.string(), "ends_sha256": pa.string()}
            for k in range(0, len(both), 50_000):
                part = both[k:k + 50_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk] * len(part) if c == "chunk" else [row.get(c) for row in part], types.get(c, pa.int64())) for c in names], names=names)

        for batch in batches:
            kind = batch.column("conv_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "words"))):
                held.append(row)
                size += len(row[2]) + 1
                if size >= turns:
                    yield from flush()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield from flush()
    return run


def _streamed(batches):
    """Pieces come sorted by node and chunk; a node's digest is fed piece by piece."""
    name, state = None, None
    for batch in batches:
        out = []
        for node, piece in zip(batch.column("name").to_pylist(), batch.column("ends").to_pylist()):
            if node != name:
                if state:
                    out.append((name, state.hexdigest()))
                name, state = node, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=["name", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["name", "ends_sha256"])


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, key (its turns' ids in order), words (white-space separated
    words of each turn's text).

    Turns are ordered by turn (null first), ties by role and then by the turn's id; null roles and texts
    are empty, null conversation ids are one conversation, repeated rows are turns of their own. Only
    ids and counts are grouped, never texts; a conversation's ids must fit into one row. An empty table
    gives no rows; other columns are not read.
    """
    given = conversations.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    turns = given.select("conv_id", F.struct("turn", "role", F.substring(digest, 1, 2 * WIDTH).alias("id"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).alias("t"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select(
        "conv_id", F.unhex(F.array_join("t.id", "")).alias("key"), F.col("t.words").alias("words"))


def prefix_trie(sequences: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """One row per distinct prefix (in whole turns) of the rows (conv_id, key, words) of ``sequences``,
    the empty one included: conv_id (the smallest that starts with it), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (over the subtree, each node's words times its conversations but
    one), ends_sha256 (of the ids of conversations that are the prefix, ascending and comma-joined).

    Null ids come last, are named only where no other is, and are empty text in the digest. Equal
    keys are members of one node each; an empty table gives no rows. A task holds the tree of
    ``chunk_turns`` turns and one conversation. The digest of a node's members is one stream by
    nature: one task reads them in order, holding a piece at a time.
    """
    given = rows.land(sequences.select("conv_id", "key", "words"), "sequences")
    order = [F.col("key"), F.col("conv_id").asc_nulls_last()]
    schema = _PARTS.format(id=dict(given.dtypes)["conv_id"])
    parts = rows.land(given.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_trees(chunk_turns), schema), "trees")
    paths = parts.filter("open")
    nodes = paths.groupBy("name").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("kids"), F.max("words").alias("words"), F.min("chunk").alias("owner"))
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("open_kids"))
    nodes = rows.land(nodes.join(kids, "name", "left").withColumn("n_children", F.col("kids") + F.coalesce("open_kids", F.lit(0))).select(
        "name", "parent", "depth", "conv_id", "n_convs", "n_children", "owner", ((F.col("n_convs") - 1) * F.col("words")).alias("own")), "open")
    # What lies below a node: a chunk's closed part, and the open nodes that the chunk owns on its paths.
    owned = F.col("chunk") == F.col("owner")
    below = paths.select("name", "chunk", "side", "shared", "depth", "n_leaves", "saved_tokens").join(
        with_small(nodes.select("name", "owner", "own", "n_children"), rows.SMALL), "name").withColumns({
            "own": F.when(owned, F.col("own")).otherwise(0), "leaf": F.when(owned & (F.col("n_children") == 0), 1).otherwise(0)})
    up = Window.partitionBy("chunk", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    chunk = Window.partitionBy("chunk")

    def under(c: str):
        other = F.sum(F.when(F.col("side") == 1, F.col(c)).otherwise(0)).over(chunk)
        return F.sum(c).over(up) + F.when(F.col("shared"), other).otherwise(0)

    sums = below.withColumns({"s": under("own"), "l": under("leaf")}).groupBy("name").agg(
        F.sum(F.col("n_leaves") + F.col("l")).alias("n_leaves"), F.sum(F.col("saved_tokens") + F.col("s")).alias("saved_tokens"))
    ends = paths.filter("ends is not null").select("name", "chunk", "ends").repartition("name").sortWithinPartitions("name", "chunk").select(
        "name", "ends").mapInArrow(_streamed, "name binary, ends_sha256 string")
    whole = nodes.join(sums, "name").join(ends, "name", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE)))
    cols = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    heads = with_small(nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("head")), rows.SMALL)
    whole = whole.withColumn("parent_conv_id", F.lit(None).cast(dict(nodes.dtypes)["conv_id"]))
    done = parts.filter("not open").select("parent", "parent_conv_id", *cols).unionByName(whole.select("parent", "parent_conv_id", *cols))
    return done.join(heads, "parent", "left").select("conv_id", "depth", F.coalesce("head", "parent_conv_id").alias("parent_conv_id"), *cols[2:])


def shared_starts(sequences: DataFrame, share: int = 20, most: int = 3) -> DataFrame:
    """Sequences whose first turns are those of the conversation with the next lower id divisible by
    ``share``: as many as the checksum of the id says, up to ``most``; fewer or none where that one
    is shorter or absent. A null id keeps its turns."""
    h = f"cast(coalesce(crc32(cast(conv_id as string)) % {most + 1}, 0) as int)"
    heads = sequences.filter(f"conv_id % {share} = 0").select(
        F.col("conv_id").alias("base"), F.expr(f"substring(key, 1, {most * WIDTH})").alias("head"), F.slice("words", 1, most).alias("head_words"))
    given = sequences.withColumn("base", F.expr(f"conv_id - conv_id % {share}")).withColumn("h", F.expr(h)).join(heads, "base", "left")
    return given.select(
        "conv_id", F.expr(f"concat(substring(coalesce(head, X''), 1, {WIDTH} * h), substring(key, {WIDTH} * h + 1))").alias("key"),
        F.expr("concat(slice(coalesce(head_words, cast(array() as array<bigint>)), 1, h), slice(words, h + 1, greatest(size(words) - h, 0)))").alias("words"))


def op11_radix_tree(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that neighbours share their first turns."""
    sequences = rows.land(turn_sequences(rows.table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(shared_starts(sequences))


#: Integers that may be null are doubles here, as Spark hands them to a data frame.
OP11_SQL = r"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)),
convs AS (SELECT conv_id AS c, conv_id - conv_id % 20 AS base, xor(list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations)),
mixed AS (SELECT c, 0 AS part, k, role, text FROM convs JOIN turns ON conv_id = base AND k <= h UNION ALL SELECT c, 1, k, role, text FROM convs JOIN turns ON conv_id = c AND k > h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, k) AS d, len(regexp_extract_all(text, '[^ 	-
]+')) AS words,
  sha256(length(role) || ':' || role || text) AS id FROM mixed),
steps AS (SELECT c, d, words, sha256(string_agg(id, '') OVER (PARTITION BY c ORDER BY d)) AS p FROM placed),
paths AS (SELECT c, d, words, p, coalesce(lag(p) OVER (PARTITION BY c ORDER BY d), '') AS above FROM steps UNION ALL SELECT c, 0, 0, '', NULL FROM convs),
ending AS (SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, p, d, max(d) OVER (PARTITION BY c) AS last FROM paths) WHERE d = last GROUP BY p),
nodes AS (SELECT p, d, min(above) AS above, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * max(words) AS own FROM paths GROUP BY p, d),
kids AS (SELECT above, count(*) AS n_children FROM nodes GROUP BY above),
whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.above = nodes.p),
sums AS (SELECT paths.p, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM whole JOIN paths ON paths.c = whole.conv_id AND paths.d <= whole.d GROUP BY paths.p)
SELECT w.conv_id, w.d AS depth, CAST(u.conv_id AS DOUBLE) AS parent_conv_id, w.n AS n_convs, CAST(w.n_children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM whole w JOIN sums USING (p) LEFT JOIN ending USING (p) LEFT JOIN whole u ON u.p = w.above
"""
