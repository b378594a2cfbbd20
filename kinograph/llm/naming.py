"""Exact de-duplication by deterministic block naming.

A text is cut into blocks of fixed size. Blocks are sorted and each distinct block gets an integer
name; then adjacent names are paired, distinct pairs are sorted and named, and so on until one name
stands for the whole text. Names are equal only when what they name is equal, byte by byte: no hash
decides. Hashes only deal blocks to sort buckets.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rows

BUCKETS = 1 << 20
_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_SCHEMA = ("rid long, pos int, n int, doc_id {id}, text_hash long, sha string, bucket int, block binary, "
           "ref_rid long, ref_pos int")


def normalised(data: bytes) -> bytes:
    """Each run of ASCII white space becomes one space."""
    data = data.translate(_SPACES)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data


def _blocks(size: int, window: int):
    """Rows of blocks. A block met before in the same task is sent as a reference to its first
    place, so copies of one text reach a sort bucket once per task; ``window`` bounds the bytes
    remembered (a forgotten block is merely sent again)."""
    def run(batches):
        seen, held = {}, 0
        for batch in batches:
            out = [[] for _ in range(9)]
            ids = []
            texts = rows.utf8(batch.column("text"))
            for i, (rid, th, data) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("text_hash").to_pylist(), texts)):
                data = normalised(data or b"")
                sha, n = hashlib.sha256(data).hexdigest(), max(1, -(-len(data) // size))
                for pos in range(n):
                    block = data[pos * size:(pos + 1) * size]
                    first = seen.get(block)
                    if first is None:
                        if held > window:
                            seen, held = {}, 0
                        seen[block], held = (rid, pos), held + len(block) + 100
                        row = (rid, pos, n, th, sha if pos == 0 else None, zlib.crc32(block) % BUCKETS, block, None, None)
                    else:
                        row = (rid, pos, n, th, sha if pos == 0 else None, (rid * 31 + pos) % BUCKETS, None, *first)
                    for column, value in zip(out, row):
                        column.append(value)
                    ids.append(i)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int32())
            cols = [pa.array(c, k) for c, k in zip(out, kinds)]
            cols.insert(3, batch.column("doc_id").take(pa.array(ids, pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "pos", "n", "doc_id", "text_hash", "sha", "bucket", "block", "ref_rid", "ref_pos"])
    return run


def _named(df: DataFrame, *by: str) -> DataFrame:
    """``name``: the place in its sort bucket, with the bucket's number above it."""
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*by))
    return df.withColumn("name", F.shiftleft(F.col("bucket").cast("long"), 32) + rank)


def identities(docs: DataFrame, id: str = "doc_id", text: str = "text", block_bytes: int = 4096, window_bytes: int = 64 << 20) -> DataFrame:
    """(rid, doc_id, text_hash, sha, n, name): texts are equal exactly where (n, name) are.

    Null texts count as empty; an empty text is one empty block. A text of any length takes
    log2(length / block_bytes) rounds; all but the first move integers only.
    """
    base = rows.keyed(docs, id, text).withColumn("rid", F.monotonically_increasing_id())
    schema = _SCHEMA.format(id=dict(base.dtypes)["doc_id"])
    blocks = rows.land(_named(base.mapInArrow(_blocks(block_bytes, window_bytes), schema), "block").withColumn(
        "name", F.expr("if(ref_rid is null, name, null)")).drop("block", "bucket"), "blocks")
    own = blocks.filter("ref_rid is null").select(F.col("rid").alias("ref_rid"), F.col("pos").alias("ref_pos"), "name")
    refs = blocks.filter("ref_rid is not null").drop("name").join(own, ["ref_rid", "ref_pos"])
    cols = ["rid", "pos", "n", "name"]
    now = blocks.filter("ref_rid is null").select(cols).union(refs.select(cols))
    heads = blocks.filter("pos = 0").select("rid", "doc_id", "text_hash", "sha", "n")
    most = blocks.agg(F.max("n")).first()[0] or 1
    done, width = [now.filter("n = 1").select("rid", "name")], 1
    while width < most:
        # Names of a level stand for ``width`` blocks; a text is done when one name covers it.
        pairs = rows.land(now.filter(F.col("n") > width).groupBy("rid", "n", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"),
            F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("b")), "pairs")
        width *= 2
        names = _named(pairs.select("a", "b").distinct().withColumn(
            "bucket", F.pmod(F.xxhash64("a", "b"), F.lit(BUCKETS)).cast("int")), "a", "b")
        now = rows.land(pairs.join(names.drop("bucket"), ["a", "b"]).select(cols), "names")
        done.append(now.filter(F.col("n") <= width).select("rid", "name"))
    whole = done[0]
    for d in done[1:]:
        whole = whole.union(d)
    return heads.join(whole, "rid")


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", block_bytes: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays; null ids come last; of rows that also share
    the id, one stays (keep_id then says the id, ``kept`` the row). An empty table gives no rows.
    Other columns of ``docs`` are not read.
    """
    found = rows.land(identities(docs, id, text, block_bytes), "identities")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    # Landed, so that the join below reads two shuffles and a large group's rows can be split.
    groups = rows.land(found.groupBy("n", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    return found.join(groups, ["n", "name"]).select(
        "doc_id", "text_hash", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def op10_block_naming(spark, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    out = exact_duplicates(rows.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
