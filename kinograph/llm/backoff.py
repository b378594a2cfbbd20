"""Stupid-backoff language-model scores from n-gram counts of the whole corpus.

Documents are gathered in slabs. Each slab explodes its n-grams, adds equal ones up and sends them to
hash partitions; there the slabs' runs are merged into the partition's count table, and every run is
joined to it, so each n-gram gets its count in the corpus. The counts return to the slab, whose words
are scored and summed per document.

A run is a sorted array of 64-bit n-gram numbers with its counts, not a row per n-gram: only the
gaps between numbers travel, byte by byte and compressed, which halves what is shuffled. An n-gram enters a
partition at most once per slab, so no word, however common, weighs on one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rows

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_SLAB = "slab long, doc_ids array<{id}>, hashes array<long>, lengths array<long>, vocabulary binary, codes binary"
_RUN = "slab long, part int, n int, size long, grams binary, counts binary"
_OUT = "doc_id {id}, text_hash long, n_words long, log_score double"


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_CODEC = "zstd"
_AT_ONCE = 1 << 17


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, each plane compressed by itself, as the random low bytes of gaps would spoil
    the code of their high ones; length first. An empty plane has size 0, one that does not compress is kept as it is."""
    codec, out = pa.Codec(_CODEC, compression_level=1), [len(x).to_bytes(8, "little")]
    for plane in np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T):
        data = b""
        if plane.any():
            data = codec.compress(plane, asbytes=True)
            data = data if len(data) < len(plane) else plane.tobytes()
        out += [len(data).to_bytes(4, "little"), data]
    return b"".join(out)


def _whole(data: bytes, kind) -> np.ndarray:
    n, at = int.from_bytes(data[:8], "little"), 8
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    for place in range(out.shape[1]):
        size, at = int.from_bytes(data[at:at + 4], "little"), at + 4
        if size:
            plane = data[at:at + size]
            out[:, place] = np.frombuffer(plane if size == n else pa.decompress(plane, n, codec=_CODEC), np.uint8)
        at += size
    return out.reshape(-1).view(kind)


def _mix(x: np.ndarray) -> np.ndarray:
    """In place: a slab's numbers are its task's largest arrays."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    return x


def grams(words: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """The number of the n-gram that ends at each word; 0 where the document has fewer words before it."""
    total = words.copy()
    for back in range(1, n):
        before = words[:-back] * _P[back]
        before += total[back:]
        total[back:] = _mix(before)
    total += np.uint64(int(_P[0]) * n % (1 << 64))
    _mix(total)
    total[total == 0] = 1
    starts = np.cumsum(lengths) - lengths
    for place in range(n - 1):
        total[starts[lengths > place] + place] = 0
    return total


def _slabs(size: int):
    """One row per slab: whole documents of about ``size`` words; a longer one is a slab by itself."""
    def run(batches):
        held, total = [], 0
        kind = None

        def flush():
            words = np.concatenate([h[3] for h in held])
            vocabulary, often = np.unique(words, return_counts=True)
            codes = np.searchsorted(vocabulary, words)
            common = np.argsort(-often, kind="stable")  # small codes for common words; equally common ones by number, so in small gaps
            rank = np.empty(len(common), "<u4")
            rank[common] = np.arange(len(common), dtype="<u4")
            lengths = [len(h[3]) for h in held]
            return pa.RecordBatch.from_arrays([
                pa.array([held[0][0]], pa.int64()), pa.array([[h[1] for h in held]], pa.list_(kind)),
                pa.array([[h[2] for h in held]], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([_planes(np.diff(vocabulary[common], prepend=np.uint64(0)))], pa.binary()),
                pa.array([_planes(rank[codes])], pa.binary())],
                names=["slab", "doc_ids", "hashes", "lengths", "vocabulary", "codes"])

        for batch in batches:
            kind = batch.column("doc_id").type
            for rid, doc, th, data in zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(),
                                          batch.column("text_hash").to_pylist(), rows.utf8(batch.column("text"))):
                w = data.lower().split() if data else []
                known = rows.worker_cache("backoff", _Words)
                if len(known) > 300_000:
                    known.clear()
                held.append((rid, doc, th, np.fromiter(map(known.__getitem__, w), np.uint64, len(w))))
                total += len(w)
                if total >= size:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()
    return run


def _words_of(vocabulary: bytes, codes: bytes) -> np.ndarray:
    return np.cumsum(_whole(vocabulary, "<u8"), dtype=np.uint64)[_whole(codes, "<u4")]


def _explode(order: int, parts: int):
    """A slab's distinct n-grams as one sorted run per order and hash partition."""
    width = np.uint64(-(-(1 << 64) // parts))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                slab, lengths = batch.column("slab")[row].as_py(), np.array(batch.column("lengths")[row].as_py(), np.int64)
                words = _words_of(batch.column("vocabulary")[row].as_py(), batch.column("codes")[row].as_py())
                for n in range(1, order + 1):
                    found, counts = np.unique(grams(words, lengths, n), return_counts=True)
                    skip = int(len(found) > 0 and found[0] == 0)
                    found, counts = found[skip:], counts[skip:]
                    ends = np.append(0, np.searchsorted(found // width, np.arange(1, parts + 1, dtype=np.uint64)))
                    out = []
                    for part in range(parts):
                        a, b = ends[part], ends[part + 1]
                        out.append((slab, part, n, b - a, _planes(np.diff(found[a:b], prepend=np.uint64(0))), _planes(counts[a:b].astype("<u4"))))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                        pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["slab", "part", "n", "size", "grams", "counts"])
    return run


def _count(batches):
    """Rows come sorted by (part, n): the runs of one table are merged and joined to it."""
    key, held = None, []

    def flush():
        runs = [np.cumsum(_whole(h[2], "<u8"), dtype=np.uint64) for h in held]
        table, place = np.unique(np.concatenate(runs), return_inverse=True)
        sent = [_whole(h[3], "<u4") for h in held]
        counts = np.bincount(place, np.concatenate(sent), len(table)).astype("<u8")[place]
        ends = np.cumsum([len(r) for r in runs])
        return pa.RecordBatch.from_arrays([
            pa.array([h[0] for h in held], pa.int64()), pa.array([key[0]] * len(held), pa.int32()), pa.array([key[1]] * len(held), pa.int32()),
            pa.array([_planes(counts[b - len(r):b]) for r, b in zip(runs, ends)], pa.binary()),
            pa.array([int(c.sum()) for c in sent], pa.int64())], names=["slab", "part", "n", "counts", "occurrences"])

    for batch in batches:
        for slab, part, n, grams_, counts in zip(*(batch.column(c).to_pylist() for c in ("slab", "part", "n", "grams", "counts"))):
            if (part, n) != key:
                if held:
                    yield flush()
                key, held = (part, n), []
            held.append((slab, part, grams_, counts))
    if held:
        yield flush()


def _score(order: int, alpha: float, least: int, total: int, names):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lengths = np.array(left.column("lengths")[0].as_py(), np.int64)
        words = _words_of(left.column("vocabulary")[0].as_py(), left.column("codes")[0].as_py())
        got: dict = {}
        for part, n, counts in sorted(zip(*(right.column(c).to_pylist() for c in ("part", "n", "counts"))), key=lambda r: r[:2]):
            got.setdefault(n, []).append(_whole(counts, "<u8"))
        count = []
        for n in range(1, order + 1):
            each = grams(words, lengths, n)
            found = np.unique(each)
            known = np.concatenate([np.zeros(int(len(found) > 0 and found[0] == 0), "<u8"), *got.pop(n, [])])
            if len(known) != len(found):
                raise RuntimeError("the documents changed between two reads: land them first")
            mine, known = np.empty(len(each)), known.astype(float)
            for a in range(0, len(each), _AT_ONCE):
                part = each[a:a + _AT_ONCE]
                by_number = np.argsort(part)  # sorted keys are found without a cache miss each
                mine[a + by_number] = known[np.searchsorted(found, part[by_number])]
            count.append(mine)
            del each, found, known
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.log(count[0] / total)
            for n in range(2, order + 1):
                place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                before = np.append(0.0, count[n - 2][:-1])
                hit = count[n - 1] >= least
                score = np.where(place < n - 1, score, np.where(hit, np.log(count[n - 1] / before), np.log(alpha) + score))
        sums = np.zeros(len(lengths))
        np.add.at(sums, np.repeat(np.arange(len(lengths)), lengths), score)
        return pa.Table.from_arrays([left.column("doc_ids")[0].values, left.column("hashes")[0].values, pa.array(lengths), pa.array(sums)], names=names)
    return run


def backoff_scores(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT,
                   slab_words: int = 1 << 21, parts: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, log_score.

    ``log_score`` sums, over the words of the whole text (ASCII-lower-cased, cut at white space), the
    natural logarithm of count(n-gram) / count(its context) for the longest n-gram that the corpus has
    at least ``min_count`` times, times ``alpha`` for each shorter step; single words count from one, over
    all words. The first words of a text have shorter n-grams only. Null and empty texts have no words
    and score 0. Repeated rows and null ids are rows like others; other columns are not read; an empty
    table gives no rows. ``parts`` count tables (default: three times the session's shuffle partitions)
    bound a task's memory. ``docs`` is read twice and must read the same, as a stored table does; where numbers of
    n-grams differ it stops.
    """
    spark = docs.sparkSession
    parts = parts or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = rows.keyed(docs, id, text).withColumn("rid", F.monotonically_increasing_id())
    kind = dict(base.dtypes)["doc_id"]
    slabs = base.mapInArrow(_slabs(slab_words), _SLAB.format(id=kind))
    runs = slabs.select("slab", "lengths", "vocabulary", "codes").mapInArrow(_explode(order, parts), _RUN)
    counts = rows.land(runs.repartition(parts, "part").sortWithinPartitions("part", "n", "slab").mapInArrow(
        _count, "slab long, part int, n int, counts binary, occurrences long"), "counts")
    total = counts.filter("n = 1").agg(F.sum("occurrences")).first()[0] or 0
    out = _OUT.format(id=kind)
    return slabs.groupBy("slab").cogroup(counts.drop("occurrences").groupBy("slab")).applyInArrow(
        _score(order, alpha, min_count, total, [c.split()[0] for c in out.split(", ")]), out)


def op3_stupid_backoff(spark, sf_dir: str) -> DataFrame:
    """Every document's trigram stupid-backoff score under the counts of all documents."""
    found = backoff_scores(rows.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"),
                        F.round(F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")), 4).alias("log_per_word"))


OP3_SQL = r"""
WITH listed AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
placed AS (SELECT doc_id, i, w[i] AS c, w[i - 1] AS b, w[i - 2] AS a FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM listed)),
one AS (SELECT c, count(*) AS n FROM placed GROUP BY c),
two AS (SELECT b, c, count(*) AS n FROM placed WHERE i >= 2 GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS n FROM placed WHERE i >= 3 GROUP BY a, b, c),
looked AS (SELECT p.doc_id, p.i, one.n AS c1, two.n AS c2, three.n AS c3, ctx1.n AS x1, ctx2.n AS x2, (SELECT count(*) FROM placed) AS total
  FROM placed p JOIN one ON one.c = p.c LEFT JOIN two ON p.i >= 2 AND two.b = p.b AND two.c = p.c LEFT JOIN three ON p.i >= 3 AND three.a = p.a AND three.b = p.b AND three.c = p.c
  LEFT JOIN one ctx1 ON ctx1.c = p.b LEFT JOIN two ctx2 ON ctx2.b = p.a AND ctx2.c = p.b),
scored AS (SELECT doc_id, CASE WHEN i = 1 THEN ln(c1 / total)
  WHEN c3 >= 2 THEN ln(c3 / x2) WHEN c2 >= 2 THEN ln(c2 / x1) + CASE WHEN i >= 3 THEN ln(0.4) ELSE 0 END
  ELSE ln(c1 / total) + ln(0.4) * CASE WHEN i >= 3 THEN 2 ELSE 1 END END AS s FROM looked),
sums AS (SELECT doc_id, sum(s) AS s FROM scored GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0.0), 4) AS log_score,
       CASE WHEN len(w) > 0 THEN round(s / len(w), 4) END AS log_per_word
FROM listed LEFT JOIN sums USING (doc_id)
"""
