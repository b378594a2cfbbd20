"""Near-duplicates by a multi-index Hamming join of b-bit minhash signatures.

A signature has 112 places of 16 bits, split into 14 chunks of 8. Texts whose signatures differ in at
most 27 places must, by pigeonhole, have a chunk with at most one difference; so each chunk is
indexed under its eight variants with one place left open, and such texts meet under one key. Texts
at the link similarity that differ in more places still meet, as it takes one good chunk of 14: all
fail with probability 3e-7 at a similarity of 0.85, 6e-5 at 0.8.

Texts that meet form families. Inside a family pairs are ruled out by signature distance and size,
and confirmed on full shingle sets, in blocks; only a spanning set of links leaves a task. Blocks are
compared with each other only for members that are not yet in their family's largest component. Texts
with equal shingle sets are one node throughout, so exact copies are never paired.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.session import with_small

from . import graph, rows

CHUNKS, PLACES = 14, 8
SIZE = CHUNKS * PLACES
#: Members of a block of a family, and bytes of their sets.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Bytes of sets after which a batch is handed on.
_BATCH = 4 << 20
#: Words whose hashes a worker remembers.
_KNOWN = 100_000
_RNG = np.random.default_rng(20_240_501)
_MUL = _RNG.integers(0, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, SIZE, dtype=np.uint64)
_PLACE = _RNG.integers(0, 1 << 63, SIZE, dtype=np.uint64)
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BASE = "rid long, doc_id {id}, text_hash long, n long, set_key binary, sig binary"


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(data: bytes | None, width: int = 3) -> np.ndarray:
    """Sorted 64-bit numbers of the distinct runs of ``width`` words of a whole text; fewer words
    are one run; no words, no runs."""
    w = data.lower().split() if data else []
    if not w:
        return np.empty(0, np.uint64)
    known = rows.worker_cache("near", _Words)
    if len(known) > _KNOWN:
        known.clear()
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    if len(w) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    total = np.zeros(len(w) - width + 1, np.uint64)
    for k in range(width):
        total = _mix(total + h[k:len(w) - width + 1 + k] * _P[k % 3])
    return np.unique(total)


def signature(found: np.ndarray) -> np.ndarray:
    low = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 256):
        np.minimum(low, (found[k:k + 256, None] * _MUL + _ADD).min(axis=0), out=low)
    return (_mix(low) & np.uint64(0xFFFF)).astype("<u2")


def _sign(width: int):
    def run(batches):
        for batch in batches:
            n, keys, sigs = [], [], []
            for data in rows.utf8(batch.column("text")):
                found = shingles(data, width)
                n.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sigs.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                names=["rid", "doc_id", "text_hash", "n", "set_key", "sig"])
    return run


def _keys(batches):
    """Every chunk of every signature with each one place left open."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, SIZE).astype(np.uint64)
        nodes = batch.column("node").to_numpy()
        for k in range(0, len(sig), 2000):
            part = _mix(sig[k:k + 2000] * _P[0] + _PLACE)
            total = part.reshape(-1, CHUNKS, PLACES).sum(axis=2, dtype=np.uint64)
            keys = _mix(np.repeat(total, PLACES, axis=1) - part + _ADD)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(nodes[k:k + 2000], SIZE))], names=["key", "node"])


def _sets(width: int):
    """Full sets of the members, handed on every few megabytes."""
    names = ["node", "sig", "found"]

    def run(batches):
        for batch in batches:
            texts, nodes, first, held, size = batch.column("text").cast(pa.binary()), batch.column("node"), 0, [], 0
            for k in range(batch.num_rows):
                found = shingles(texts[k].as_py(), width)
                held.append((signature(found).tobytes(), found.tobytes()))
                size += found.nbytes
                if size >= _BATCH or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([nodes.slice(first, len(held)), *(pa.array(c, pa.binary()) for c in zip(*held))], names=names)
                    first, held, size = k + 1, [], 0
    return run


def least_agreement(share: float) -> int:
    """Places in which signatures of sets with this similarity agree, less 5.5 standard deviations:
    fewer happen with a probability of 2e-8."""
    return int(SIZE * share - 5.5 * (SIZE * share * (1 - share)) ** 0.5)


def _spanning(members: list, num: int, den: int, least: int) -> list:
    """Members (node, side, label, sig, set) joined by their labels as far as full sets allow: (label, the
    least label joined with it). All pairs are compared if all sides are 0, else those of a side 1 and a
    side 0. Pairs of one label are never compared, and a link makes two labels one."""
    side, (label, names) = np.array([m[1] for m in members]), _numbered([m[2] for m in members])
    sigs = np.frombuffer(b"".join(m[3] for m in members), "<u2").reshape(-1, SIZE)
    sets = [np.frombuffer(m[4], np.uint64) for m in members]
    size = np.array([len(s) for s in sets])
    parent = list(range(len(names)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    near = []
    for a in np.flatnonzero(side == side.max()).tolist():
        b = np.arange(a + 1, len(members)) if not side.any() else np.flatnonzero(side == 0)
        b = b[(np.minimum(size[a], size[b]) * den >= np.maximum(size[a], size[b]) * num) & (label[b] != label[a])]
        agree = (sigs[b] == sigs[a]).sum(axis=1)
        b, agree = b[agree >= least], agree[agree >= least]
        near.append(np.stack([-agree, np.full(len(b), a), b], 1))
    near = np.concatenate(near)
    for _, a, b in near[np.argsort(near[:, 0], kind="stable")].tolist():  # the likeliest first
        x, y = root(label[a]), root(label[b])
        if x == y:
            continue
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if both * den >= (size[a] + size[b] - both) * num:
            # Stars, not chains, so that components need few rounds.
            parent[x if names[x] > names[y] else y] = y if names[x] > names[y] else x
    return [(names[k], names[root(k)]) for k in range(len(names)) if root(k) != k]


def _numbered(values: list) -> tuple[np.ndarray, list]:
    names = {}
    return np.array([names.setdefault(v, len(names)) for v in values]), list(names)


def _confirm(similarity: tuple[int, int]):
    """Groups (family, i, j) come sorted by node and side; a node that comes again is read once."""
    num, den = similarity
    least = least_agreement(num / den)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        key, held = None, []
        for batch in batches:
            out = []
            sigs, sets = batch.column("sig"), batch.column("found")
            for k, (family, i, j, node, side, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j", "node", "side", "label")))):
                if (family, i, j) != key:
                    if len(held) > 1:
                        out += _spanning(held, num, den, least)
                    key, held = (family, i, j), []
                if not held or held[-1][:2] != (node, side):
                    held.append((node, side, label, sigs[k].as_py(), sets[k].as_py()))
            yield batch_of(out)
        if len(held) > 1:
            yield batch_of(_spanning(held, num, den, least))
    return run


def _compared(docs: DataFrame, places: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """Links found in the groups that ``places`` (family, i, j, node, side, label, _id, _hash) names.
    Each text's set is made once and copied to its node's groups."""
    places = rows.land(places, "places")
    nodes = places.groupBy("node").agg(F.first("_id").alias("_id"), F.first("_hash").alias("_hash"))
    found = docs.join(with_small(nodes, rows.SMALL), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    sets = found.select("node", "text").mapInArrow(_sets(width), "node long, sig binary, found binary")
    order = ["family", "i", "j", "node", "side"]
    given = sets.join(with_small(places.drop("_id", "_hash"), rows.SMALL), "node").select(*order, "label", "sig", "found")
    return given.repartition("family", "i", "j").sortWithinPartitions(*order).mapInArrow(_confirm(similarity), "a long, b long")


def _roots(docs: DataFrame, members: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """(node, root) of the linked members of families, which are (family, hub, blocks, node, n, _id, _hash).

    A family's members are dealt to blocks; each block is compared within itself and with the family's
    hub, the member that most others met. That joins most of a large group of near copies. Then, in
    families with several blocks, only members outside the largest component so far are compared with
    those of other components, so that a group which has become one is not compared again.
    """
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")
    members = rows.land(members.select("*", own), "members")
    block = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    first = _compared(docs, members.select(
        "family", F.explode(block).alias("i"), F.lit(0).alias("j"), "node", F.lit(0).alias("side"), F.col("node").alias("label"), "_id", "_hash"),
        width, similarity)
    root = rows.land(graph.components(first, "a", "b"), "joined")
    large = members.filter("blocks > 1")
    if large.isEmpty():
        return root
    named = rows.land(large.join(root, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"), "named")
    parts = named.groupBy("family", "label").agg(F.count(F.lit(1)).alias("size"))
    main = parts.groupBy("family").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    main = rows.land(main.select("family", "main"), "main")
    if main.isEmpty():
        return root
    named = named.join(with_small(main, rows.SMALL), "family")
    groups = named.filter("label != main").groupBy("family").agg(_blocks_for("n").alias("groups"))
    named = rows.land(named.join(with_small(rows.land(groups, "groups"), rows.SMALL), "family"), "open")
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("groups")).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cols = ["family", "i", "j", "node", "side", "label", "_id", "_hash"]
    outer = named.filter("label != main").withColumns({"i": part, "side": F.lit(1)}).withColumn("j", every("blocks"))
    inner = named.withColumns({"j": F.col("own"), "side": F.lit(0)}).withColumn("i", every("groups"))
    # Labels joined with labels; a member without links so far is its own label.
    top = rows.land(graph.components(_compared(docs, outer.select(cols).unionAll(inner.select(cols)), width, similarity), "a", "b"), "tops")
    above = top.select(F.col("node").alias("_label"), F.col("root").alias("_top"))
    moved = root.join(above, root["root"] == F.col("_label"), "left").select("node", F.coalesce("_top", "root").alias("root"))
    return moved.unionAll(top.join(root.select("node"), "node", "left_anti").select("node", "root"))


def _blocks_for(n: str):
    """Blocks of at most ``BLOCK`` members and ``BLOCK_BYTES`` of sets, in the mean."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.col(n) * 8) / BLOCK_BYTES)).cast("int")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, component_id, kept.

    Texts link when ``similarity`` (a fraction, at least 4/5) of the union of their word runs is
    shared. ``component_id`` is the smallest id reachable over links; the row of that id is kept, and
    where rows share it, the first. Null and empty texts have no runs and link with nothing, not even
    with each other. Null ids count as larger than all others; a component of such rows alone has no
    id and keeps one row. Other columns are not read; an empty table gives no rows.
    """
    base = rows.keyed(docs, id, text).withColumn("rid", F.monotonically_increasing_id())
    schema = _BASE.format(id=dict(base.dtypes)["doc_id"])
    base = rows.land(base.mapInArrow(_sign(width), schema), "signatures")
    classes = rows.land(base.filter("n > 0").groupBy("set_key").agg(F.min(F.struct("rid", "doc_id", "text_hash", "n", "sig")).alias("r")).select(
        "set_key", F.col("r.rid").alias("node"), "r.doc_id", "r.text_hash", "r.n", "r.sig"), "classes")
    keys = classes.select("node", "sig").mapInArrow(_keys, "key long, node long")
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first != last")
    met = rows.land(keys.join(shared.select("key", "first"), "key").filter("node != first").select("node", "first").distinct(), "met")
    family = rows.land(graph.components(met, "node", "first"), "families")
    hubs = met.groupBy(F.col("first").alias("node")).agg(F.count(F.lit(1)).alias("meets")).join(family, "node").groupBy("root").agg(
        F.max_by("node", F.struct("meets", "node")).alias("hub"))
    placed = rows.land(classes.select("node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n").join(family, "node"), "placed")
    blocks = rows.land(placed.groupBy("root").agg(_blocks_for("n").alias("blocks")).join(hubs, "root"), "blocks")
    members = placed.join(with_small(blocks, rows.SMALL), "root").withColumnRenamed("root", "family")
    root = rows.land(_roots(rows.keyed(docs, id, text), members, width, similarity), "roots")
    labelled = rows.land(base.join(classes.select("set_key", "node"), "set_key", "left").join(root, "node", "left").withColumn(
        "component", F.coalesce("root", "node", "rid")).select("rid", "doc_id", "text_hash", "n", "component"), "labelled")
    # Landed, so that the join below reads two shuffles and a large component's rows can be split.
    first = rows.land(labelled.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")), "first")
    return labelled.join(first, "component").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), (F.col("rid") == F.col("first.rid")).alias("kept"))


def op5_multi_index_hamming(spark, sf_dir: str) -> DataFrame:
    """Every document's class of texts that share 85 % of their 3-word runs."""
    found = near_duplicates(rows.table(spark, sf_dir, "documents"), width=3, similarity=(17, 20))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP5_SQL = r"""
WITH RECURSIVE listed AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s, len(w) < 3 AS few FROM listed),
runs AS (SELECT doc_id, few, unnest(s) AS run FROM sets),
numbered AS (SELECT doc_id, dense_rank() OVER (ORDER BY few, run) AS r FROM runs),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS meet FROM numbered a JOIN numbered b ON a.r = b.r AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * meet >= 85 * (len(a.s) + len(b.s) - meet)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS z FROM sets UNION SELECT r.x, y FROM reach r JOIN ways w ON w.x = r.z),
least AS (SELECT x, min(z) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON x = doc_id
"""
