"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by document: each row is a shard with the places of every indexed term among the
words of some documents. A search walks each shard by itself, from the rarest terms of each phrase,
intersecting lists shifted by the terms' offsets, so no list of one term ever meets in one task.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rows

#: Word bytes are a-z, 0-9 and all above ASCII; A-Z are lowered, all else parts words.
_WORDS = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
INDEX = "shard long, docs array<struct<doc_id: {id}, text_hash: long, start: long, n_words: long>>, terms array<binary>, ends array<long>, places binary"
HITS = "doc_id {id}, text_hash long, n_words long, n_hit long, items array<string>, spans array<struct<item: string, phrase: int, start: long, length: int>>"


def words(data: bytes | None) -> list[bytes]:
    return data.translate(_WORDS).split() if data else []


def _index(vocabulary, shard_words: int, with_shard: bool = True):
    """A shard closes at ``shard_words`` words or the batch's end; a longer text is one shard."""
    def run(batches):
        known = {t: i for i, t in enumerate(vocabulary.value)} if vocabulary is not None else None
        shard = None
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("text_hash").to_pylist()
            first = batch.column("rid").to_pylist()
            texts = rows.utf8(batch.column("text"))
            held, at, place = [], [], 0
            for i, data in enumerate(texts):
                found = words(data)
                if known is None:
                    codes = found
                else:
                    codes = np.fromiter((known.get(w, -1) for w in found), np.int32, len(found))
                held.append((i, place, len(found), codes))
                place += len(found) + 1  # a gap, so that no phrase runs into the next text
                if place >= shard_words:
                    yield _shard(held, ids, hashes, first, vocabulary.value if known is not None else None)
                    held, place = [], 0
            if held:
                yield _shard(held, ids, hashes, first, vocabulary.value if known is not None else None)
    return run


def _shard(held, ids, hashes, rids, terms):
    if terms is None:
        local: dict = {}
        held = [(i, p, n, np.fromiter((local.setdefault(w, len(local)) for w in c), np.int32, n)) for i, p, n, c in held]
        terms = list(local)
    code = np.concatenate([c for *_, c in held]) if held else np.empty(0, np.int32)
    place = np.concatenate([np.arange(p, p + n, dtype=np.int32) for _, p, n, _ in held])
    keep = np.flatnonzero(code >= 0)
    code, place = code[keep], place[keep]
    order = np.argsort(code, kind="stable")
    code, place = code[order], place[order]
    used, starts = np.unique(code, return_index=True)
    ends = np.append(starts[1:], len(code)).astype(np.int64)
    index = pa.array([i for i, *_ in held], pa.int64())
    docs = pa.StructArray.from_arrays(
        [ids.take(index), pa.array([hashes[i] for i, *_ in held], pa.int64()), pa.array([p for _, p, *_ in held], pa.int64()),
         pa.array([n for _, _, n, _ in held], pa.int64())], names=["doc_id", "text_hash", "start", "n_words"])
    return pa.RecordBatch.from_arrays([
        pa.array([rids[held[0][0]]], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
        pa.array([[terms[k] for k in used]], pa.list_(pa.binary())), pa.array([ends.tolist()], pa.list_(pa.int64())),
        pa.array([place.astype("<i4").tobytes()], pa.binary())], names=["shard", "docs", "terms", "ends", "places"])


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text", terms: list[bytes] | None = None,
                shard_words: int = 1 << 20) -> DataFrame:
    """Postings of every word, or of ``terms`` only (others cannot be part of a match), as a stored
    table. Null and empty texts are in it with no words, so every row, repeats included, is found again; an
    empty table has no shards. Other columns are not read."""
    spark = docs.sparkSession
    base = rows.keyed(docs, id, text).withColumn("rid", F.monotonically_increasing_id())
    kind = dict(base.dtypes)["doc_id"]
    vocabulary = spark.sparkContext.broadcast(terms) if terms is not None else None
    return rows.land(base.mapInArrow(_index(vocabulary, shard_words), INDEX.format(id=kind)), "index")


def phrases_of(items: list[tuple[str, bytes | None]], width: int) -> list[tuple[str, tuple[bytes, ...]]]:
    """Every run of ``width`` words of each item; a shorter item is one phrase; none has none."""
    out = []
    for item, data in items:
        w = words(data)
        out += [(item, tuple(w[k:k + width])) for k in range(max(1, len(w) - width + 1))] if w else []
    return out


def _places(phrase, lists, slack: int):
    """Starts and lengths of the phrase; the rarest terms are intersected first. With ``slack`` all
    starts from which its words follow in order with at most so many others between neighbours, each
    with its longest match, inside of which all its others lie."""
    got = []
    for offset, term in enumerate(phrase):
        post = lists.get(term)
        if post is None:
            return None, None
        got.append((len(post), offset, post))
    if not slack:
        got.sort(key=lambda x: x[0])
        _, offset, starts = got[0]
        starts = starts - offset
        for _, offset, post in got[1:]:
            if not len(starts):
                break
            want = starts + offset
            k = np.searchsorted(post, want)
            k[k == len(post)] = 0
            starts = starts[post[k] == want]
        return starts, np.full(len(starts), len(phrase), np.int64)
    # Proximity, from the last term back: the places from which the rest follows, and the furthest end
    # from each. Ends grow with places, so the furthest place in reach of the next term leads to it.
    reach = end = got[-1][2]
    for _, _, post in got[-2::-1]:
        if not len(reach):
            break
        j = np.searchsorted(reach, post + slack + 1, "right") - 1
        ok = (j >= 0) & (reach[j] > post)
        reach, end = post[ok], end[j[ok]]
    return reach, end - reach + 1


def _search(phrases, slack: int, kind: pa.DataType, spans: bool):
    def run(batches):
        wanted: dict = {}
        for number, (item, phrase) in enumerate(phrases.value):
            wanted.setdefault(phrase, []).append((number, item))
        # A phrase is looked for where the term that fewest phrases share is present.
        shared = Counter(t for phrase in wanted for t in set(phrase))
        by_term: dict = {}
        for phrase, owners in wanted.items():
            by_term.setdefault(min(phrase, key=lambda t: (shared[t], t)), []).append((phrase, owners))
        for batch in batches:
            for row in range(batch.num_rows):
                docs = batch.column("docs")[row].values
                terms = batch.column("terms")[row].as_py()
                ends = batch.column("ends")[row].as_py()
                places = np.frombuffer(batch.column("places")[row].as_buffer(), "<i4").astype(np.int64) if terms else np.empty(0, np.int64)
                start = docs.field("start").to_numpy()
                if slack:  # texts move apart, so that no match runs into the next one
                    places = places + slack * (np.searchsorted(start, places, "right") - 1)
                    start = start + slack * np.arange(len(start))
                lists = {t: places[a:b] for t, a, b in zip(terms, [0, *ends], ends)}
                count = docs.field("n_words").to_numpy()
                hit = np.zeros(int(start[-1] + count[-1]) + 2, np.int32)
                found: dict[int, set] = {}
                where: dict[int, list] = {}
                for phrase, owners in (x for t in terms for x in by_term.get(t, ())):
                    at, length = _places(phrase, lists, slack)
                    if at is None or not len(at):
                        continue
                    owner = np.searchsorted(start, at, "right") - 1
                    inside = at + length <= start[owner] + count[owner]
                    at, length, owner = at[inside], length[inside], owner[inside]
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + length, -1)
                    for doc in np.unique(owner):
                        found.setdefault(int(doc), set()).update(i for _, i in owners if i is not None)
                    if spans:
                        for a, n, doc in zip(at.tolist(), length.tolist(), owner.tolist()):
                            where.setdefault(doc, []).extend({"item": i, "phrase": p, "start": a - int(start[doc]), "length": n} for p, i in owners)
                covered = np.append(0, np.cumsum(np.cumsum(hit)[:-1] > 0))
                n_hit = covered[start + count] - covered[start]
                yield pa.RecordBatch.from_arrays([
                    docs.field("doc_id"), docs.field("text_hash"), docs.field("n_words"), pa.array(n_hit.astype(np.int64)),
                    pa.array([sorted(found.get(k, ())) for k in range(len(docs))], pa.list_(pa.string())),
                    pa.array([where.get(k, []) for k in range(len(docs))], pa.list_(pa.struct([("item", pa.string()), ("phrase", pa.int32()), ("start", pa.int64()), ("length", pa.int32())])))],
                    names=["doc_id", "text_hash", "n_words", "n_hit", "items", "spans"])
    return run


def search(index: DataFrame, phrases: list[tuple[str, tuple[bytes, ...]]], slack: int = 0, spans: bool = True) -> DataFrame:
    """Per indexed row: doc_id, text_hash, n_words, n_hit (words inside any match), items (sorted
    names of the phrases' owners) and, on wish, the exact spans. ``slack`` allows so many other words
    between neighbouring words of a phrase: proximity instead of exact matches. Repeated rows are found
    each; equal phrases of several owners hit once and name all of them, owners without a name none; no
    phrases hit nothing; an empty index gives no rows."""
    kind = next(f.dataType for f in index.schema["docs"].dataType.elementType.fields if f.name == "doc_id").simpleString()
    given = index.sparkSession.sparkContext.broadcast(phrases)
    return index.select("docs", "terms", "ends", "places").mapInArrow(_search(given, slack, kind, spans), HITS.format(id=kind))


def _item_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """The test set, streamed in blocks of bounded size (one item may exceed it)."""
    block, size = [], 0
    for name, data in benchmark.select(F.col(item).cast("string"), F.col(text).cast("binary")).toLocalIterator():
        block.append((name, bytes(data) if data is not None else None))
        size += len(data or b"")
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20, slack: int = 0,
                  spans: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_words, n_hit, items.

    The test set is the stated query set: it streams through the driver in blocks of ``block_bytes``,
    of which two are held at most; every block is searched in all documents. One block indexes its own
    terms only; for more, one index of all words serves every block, and what each block hits is
    landed and merged by its spans. Null texts have no words; null item ids own nothing but their words
    count as hit; repeated rows are rows; an empty table gives no rows, an empty test set no hits. Extra
    columns are not read.
    """
    blocks = _item_blocks(benchmark, item, item_text, block_bytes)
    first = phrases_of(next(blocks), width)
    more = next(blocks, None)
    if more is None:
        return search(build_index(docs, id, text, sorted({w for _, p in first for w in p})), first, slack, spans)
    index = build_index(docs, id, text)
    found = [rows.land(search(index, phrases, slack).filter("n_hit > 0"), "hits")
             for phrases in chain([first], (phrases_of(block, width) for block in chain([more], blocks)))]
    return _merged(search(index, [], spans=False), found)


def _merged(plain: DataFrame, found: list[DataFrame]) -> DataFrame:
    """One row per document from what several searches hit. Rows equal in id and text have equal results."""
    every = plain.withColumn("_own", F.lit(1))
    for hits in found:
        every = every.unionByName(hits.withColumn("_own", F.lit(0)))
    kind = dict(every.dtypes)["doc_id"]

    def covered(spans):
        out = []
        for row in spans.to_pylist():
            total, end = 0, -1
            for a, b in sorted({(s["start"], s["start"] + s["length"]) for s in row}):
                total += max(0, b - max(a, end))
                end = max(end, b)
            out.append(total)
        return pa.array(out, pa.int64())

    covered.__annotations__ = {"spans": pa.Array, "return": pa.Array}
    merged = every.groupBy("doc_id", "text_hash", "n_words").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.sum("_own").cast("int").alias("_times"))
    out = merged.withColumn("n_hit", F.arrow_udf(covered, "long")("spans")).withColumn("_t", F.explode(F.sequence(F.lit(1), "_times")))
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "text_hash", "n_words", "n_hit", "items", "spans")


def op7_positional_index(spark, sf_dir: str) -> DataFrame:
    """Every document against every 10-word window of the benchmark."""
    found = contamination(rows.table(spark, sf_dir, "documents"), rows.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP7_SQL = r"""
WITH lowered AS (SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
listed AS (SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
placed AS (SELECT kind, id, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS p FROM listed WHERE len(w) > 0),
wanted AS (SELECT DISTINCT id AS item, array_to_string(w[p:p + least(n, 10) - 1], ' ') AS phrase, least(n, 10) AS size
  FROM placed WHERE kind = 'b' AND p + least(n, 10) - 1 <= n),
sizes AS (SELECT DISTINCT size FROM wanted),
grams AS (SELECT id, p, size, array_to_string(w[p:p + size - 1], ' ') AS phrase FROM placed, sizes
  WHERE kind = 'd' AND p + size - 1 <= n),
matches AS (SELECT g.id, g.p, g.size, item FROM grams g JOIN wanted USING (phrase, size)),
hits AS (SELECT id, count(DISTINCT place) AS n_hit FROM (SELECT id, unnest(range(p, p + size)) AS place FROM matches) GROUP BY id),
items AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS named
  FROM (SELECT DISTINCT id, item FROM matches) GROUP BY id)
SELECT CAST(l.id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM listed l LEFT JOIN hits USING (id) LEFT JOIN items USING (id) WHERE kind = 'd'
"""
