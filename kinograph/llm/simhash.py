"""Near-duplicates by SimHash fingerprints and a self-join of their binary tries.

Fingerprints that differ in at most ``errors`` of 64 bits are linked. The 64 bits are a ring of
``errors + 1`` blocks. For any such pair some block of the ring can lead so that the first i blocks
from there hold at most i - 1 errors, for every i (the errors sum to less than one a block, so by the
cycle lemma some start keeps every partial sum below its count of blocks). So there is a binary trie for each
leading block, and its error budget grows with depth: none in the leading block, then one more a block.

A trie is sorted fingerprints; a node is a range of them that shares its first bits. Pairs of nodes of
one depth are traversed together: their children meet, unequal bits add an error, and a pair over the
budget of its depth is pruned with all below it. A leading block without errors splits a trie into
subtrees that never meet, which is how tasks share the work; a subtree that is too large is dealt
to its second block's nodes, which meet at most one bit apart.

Joined fingerprints are labelled as they are found, and a pair of nodes whose fingerprints all have
one label is pruned too. The budget is raised in rounds, so that a dense group, whose members are few
bits apart, is one label before its many wider pairs are reached.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.session import with_small

from . import graph, rows

BITS, SEED = 64, 42
#: Fingerprints under one leading block up to which they are one subtree.
HEAVY = 32_768
#: Fingerprints a task joins at a time, at least one whole subtree; node pairs it holds at a time.
CHUNK, PAIRS = 1 << 18, 1 << 18
#: Node pairs of so few fingerprint pairs are compared without going down.
LEAVES = 16
_WINDOW = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _windows(data: bytes):
    """Lists of words of a text, a megabyte at a time."""
    at = 0
    while at < len(data):
        end = at + _WINDOW
        cut = _SPACE.search(data, end) if end < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end].lower().split()
        at = end


def _ones(text: bytes, starts: list, ends: list) -> np.ndarray:
    """Of the shingles at these places, how many hashes have each bit."""
    total = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), 8192):
        found = np.array([digest(text[a:b], SEED) for a, b in zip(starts[k:k + 8192], ends[k:k + 8192])], "<u8")
        total += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(data: bytes | None, width: int = 4) -> int:
    """Unsigned: a bit is set if more than half of the runs of ``width`` words, repeats included, have
    it in their XXH64. Fewer words are one run; no words give zero."""
    ones, n, carry = np.zeros(BITS, np.int64), 0, []
    for found in _windows(data or b""):
        words = carry + found
        if len(words) >= width:
            size = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(size + 1) - 1
            starts = (end - size)[:len(words) - width + 1].tolist()
            ones += _ones(b" ".join(words), starts, end[width - 1:].tolist())
            n += len(starts)
        carry = words[max(0, len(words) - width + 1):] if width > 1 else []
    if not n and carry:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED)
    return int(((2 * ones > n).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))


def _printed(width: int):
    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), width) for x in batch.column("text").cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))],
                                             names=["doc_id", "text_hash", "print"])
    return run


def blocks(errors: int) -> list[int]:
    """Where each block of the ring ends: ``errors + 1`` blocks of nearly equal size."""
    return [BITS * (k + 1) // (errors + 1) for k in range(errors + 1)]


def budgets(errors: int, first: int, most: int) -> np.ndarray:
    """Errors allowed after each depth of the trie that block ``first`` leads, ``most`` in all."""
    ends = [0, *blocks(errors)]
    sizes = np.diff(ends)
    ring = np.roll(sizes, -first)
    return np.concatenate([[0], np.minimum(np.repeat(np.arange(errors + 1), ring), most)])


def turned(prints: np.ndarray, errors: int, first: int) -> np.ndarray:
    """The bits from block ``first`` on, then those before it."""
    by = np.uint64(([0, *blocks(errors)])[first])
    return prints if not by else (prints << by) | (prints >> (np.uint64(BITS) - by))


def _shift(depth) -> np.uint64:
    return np.uint64(BITS) - np.uint64(depth)


class Joined:
    """Labels of fingerprints: those found linked share their smallest place."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.label = prints, np.arange(len(prints))
        self._count()

    def _count(self) -> None:
        self.changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])

    def whole(self, low, high):
        """Ranges whose fingerprints all have one label."""
        return self.changes[low] == self.changes[high - 1]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        changed = False
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                break
            changed = True
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(above := self.label[self.label], self.label):
                self.label = above
        if changed:
            self._count()


def traverse(joined: Joined, pairs: tuple, depth: int, budget: np.ndarray, most: int) -> None:
    """From node pairs (low, high, low, high, errors) of one depth down to linked fingerprints."""
    prints, todo = joined.prints, [(depth, pairs)]
    while todo:
        depth, (l1, h1, l2, h2, err) = todo.pop()
        ok = (h1 > l1) & (h2 > l2) & (err <= budget[depth]) & ((l1 != l2) | (h1 - l1 > 1))
        ok[ok] = ~(joined.whole(l1[ok], h1[ok]) & joined.whole(l2[ok], h2[ok]) & (joined.label[l1[ok]] == joined.label[l2[ok]]))
        l1, h1, l2, h2, err = (x[ok] for x in (l1, h1, l2, h2, err))
        if len(l1) > PAIRS:
            half = len(l1) // 2
            todo += [(depth, tuple(x[half:] for x in (l1, h1, l2, h2, err))), (depth, tuple(x[:half] for x in (l1, h1, l2, h2, err)))]
            continue
        size = (h1 - l1) * (h2 - l2)
        few = (size <= LEAVES) | (depth == BITS)
        if few.any():
            n = size[few]
            own = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            wide = (h2 - l2)[few][own]
            a, b = l1[few][own] + place // wide, l2[few][own] + place % wide
            near = (a != b) & (np.bitwise_count(prints[a] ^ prints[b]) <= most)
            joined.link(a[near], b[near])
        l1, h1, l2, h2, err = (x[~few] for x in (l1, h1, l2, h2, err))
        if not len(l1):
            continue
        # The first places of ones below each node: ranges are sorted, so zeros stand before them.
        ones = np.concatenate([[0], np.cumsum((prints >> _shift(depth + 1)) & np.uint64(1))]).astype(np.int64)
        m1, m2 = h1 - (ones[h1] - ones[l1]), h2 - (ones[h2] - ones[l2])
        other = l1 != l2
        todo.append((depth + 1, tuple(np.concatenate(x) for x in (
            (l1, m1, l1, m1[other]), (m1, h1, m1, h1[other]), (l2, m2, m2, l2[other]), (m2, h2, h2, m2[other]), (err, err, err + 1, err[other] + 1)))))


def join_subtrees(first: int, depth: int, left: np.ndarray, right: np.ndarray, prints: np.ndarray, errors: int) -> np.ndarray:
    """Labels of ``prints`` (turned, sorted by their subtree pair). ``left`` and ``right`` name each
    row's pair of nodes of this depth: one node with itself, or two that differ in one bit."""
    edge = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    stop = np.append(edge[1:], len(prints))
    same = left[edge] == right[edge]
    second = np.concatenate([[0], np.cumsum((prints >> _shift(depth)).astype(np.int64) == right)])
    middle = np.where(same, edge, stop - (second[stop] - second[edge]))
    pairs = (edge, np.where(same, stop, middle), middle, stop, np.where(same, 0, 1))
    joined = Joined(prints)
    for most in sorted({min(errors, k) for k in (1, 2, errors)}):
        traverse(joined, pairs, depth, budgets(errors, first, most), most)
    return joined.label


def _linked(errors: int):
    def run(batches):
        held, size = [], 0

        def flush(parts):
            cols = [np.concatenate(x) for x in zip(*parts)]
            first, depth, left, right, value = cols
            out_a, out_b = [], []
            # Rows come sorted by leading block and depth.
            edge = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (depth[1:] != depth[:-1])]))
            for a, b in zip(edge, np.append(edge[1:], len(first))):
                prints = value[a:b]
                label = join_subtrees(int(first[a]), int(depth[a]), left[a:b], right[a:b], prints, errors)
                moved = np.flatnonzero(label != np.arange(b - a))
                by = np.uint64(([0, *blocks(errors)])[int(first[a])])
                back = prints if not by else (prints >> by) | (prints << (np.uint64(BITS) - by))
                out_a.append(back[moved])
                out_b.append(back[label[moved]])
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("first", "depth", "left", "right")]
            cols.append((batch.column("sorted").to_numpy() ^ np.iinfo(np.int64).min).view(np.uint64))
            while len(cols[0]):
                if size < CHUNK:
                    cut = min(len(cols[0]), CHUNK - size)
                else:  # to the end of the subtree pair at hand
                    key = [held[-1][k][-1] for k in range(4)]
                    apart = np.logical_or.reduce([cols[k] != key[k] for k in range(4)])
                    cut = int(np.argmax(apart)) if apart.any() else len(apart)
                    if not cut:
                        yield flush(held)
                        held, size = [], 0
                        continue
                held.append([c[:cut] for c in cols])
                size += cut
                cols = [c[cut:] for c in cols]
        if held:
            yield flush(held)
    return run


def _rotations(errors: int):
    """Every fingerprint in each of its tries, under the node that its leading block names."""
    ends = [0, *blocks(errors)]

    def run(batches):
        for batch in batches:
            prints = batch.column("print").to_numpy().view(np.uint64)
            for k in range(errors + 1):
                value = turned(prints, errors, k)
                lead = ends[k + 1] - ends[k]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(value), k, np.int64)), pa.array(np.full(len(value), lead, np.int64)),
                    pa.array((value >> _shift(lead)).astype(np.int64)), pa.array(value.view(np.int64) ^ np.iinfo(np.int64).min)],
                    names=["first", "depth", "left", "sorted"])
    return run


def _dealt(errors: int):
    """A heavy subtree's fingerprints under their node at the second block's end, alone and with each
    node one bit away."""
    ends = [0, *blocks(errors)]
    sizes = np.diff(ends)

    def run(batches):
        for batch in batches:
            first = batch.column("first").to_numpy()
            for k in np.unique(first):
                value = batch.column("sorted").to_numpy()[first == k]
                lead, more = int(sizes[k]), int(sizes[(k + 1) % (errors + 1)])
                node = ((value ^ np.iinfo(np.int64).min).view(np.uint64) >> _shift(lead + more)).astype(np.int64)
                for other in (node, *(node ^ (1 << bit) for bit in range(more))):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(value), k, np.int64)), pa.array(np.full(len(value), lead + more, np.int64)),
                        pa.array(np.minimum(node, other)), pa.array(np.maximum(node, other)), pa.array(value)],
                        names=["first", "depth", "left", "right", "sorted"])
    return run


def links(prints: DataFrame, errors: int = 4, heavy: int = HEAVY) -> DataFrame:
    """(a, b): links that join all of the distinct long column ``print`` which are reachable over
    links of at most ``errors`` bits. At most one row per fingerprint and trie leaves a task."""
    tries = rows.land(prints.mapInArrow(_rotations(errors), "first long, depth long, left long, sorted long"), "tries")
    large = tries.groupBy("first", "left").count().filter(F.col("count") > heavy).select("first", "left")
    names = ["first", "depth", "left", "right", "sorted"]
    if errors == 0 or large.isEmpty():
        given = tries.withColumn("right", F.col("left")).select(names)
    else:
        # Fewer than rows / heavy nodes; broadcast where that is small.
        large = with_small(rows.land(large, "large"), rows.SMALL)
        given = tries.join(large, ["first", "left"], "left_anti").withColumn("right", F.col("left")).select(names).unionAll(
            tries.join(large, ["first", "left"], "left_semi").select("first", "sorted").mapInArrow(
                _dealt(errors), "first long, depth long, left long, right long, sorted long"))
    return given.repartition("first", "left", "right").sortWithinPartitions(*names).mapInArrow(_linked(errors), "a long, b long")


def near_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4, errors: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, fingerprint (16 hex digits), component_id (the
    smallest id reachable over links of at most ``errors`` bits, its own included).

    Null and empty texts have fingerprint zero, linked like any other. Rows with one fingerprint are
    one node of the trie, so copies are never paired. Null ids count as larger than all others: a
    component of such rows alone has no id. Repeated rows are rows of their own. Other columns are not
    read; an empty table gives no rows. No link is missed. ``errors`` is at most 15.
    """
    base = rows.keyed(docs, id, text)
    base = rows.land(base.mapInArrow(_printed(width), f"doc_id {dict(base.dtypes)['doc_id']}, text_hash long, print long"), "prints")
    nodes = rows.land(base.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    root = rows.land(graph.components(links(nodes.select("print"), errors), "a", "b"), "roots")
    nodes = nodes.join(root, nodes["print"] == root["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rows.land(nodes.join(ids, "root").select("print", "component_id"), "named")
    return base.join(with_small(named, rows.SMALL), "print").select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op12_trie_join(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint of 4-word runs and its component at 4 bits."""
    return near_fingerprints(rows.table(spark, sf_dir, "documents")).drop("text_hash")
