"""Distributed building blocks for vectors: moments per key, and best items per query.

Both split the work over blocks of bounded size. Nothing pairs rows in the JVM and no
block depends on how many rows one key or item has.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as N
from ..session import BATCH_BYTES, bounded_batches, cut, top_per_key

#: Queries that are one vector each: items are read once for so many. Rows that carry a matrix come in smaller blocks.
BLOCK_QUERIES, MODEL_QUERIES = 16_384, 4096
#: Items that one task may hold whole, and those of a sheet, which is what a task holds of them otherwise.
BLOCK_ITEMS, SHARD_ITEMS = 262_144, 32_768
#: Queries below which a block is not split for the sake of idle cores.
LEAST_QUERIES = 128
#: Scores that stand in one matrix.
SCORES_AT_ONCE = 4_000_000
#: Shuffle partitions above which the moments of few keys are summed in two steps.
TREE_FROM = 64


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column]) if len(column) else np.zeros((0, 0))


def in_batches(rows: Iterable[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows with vectors as frames of bounded bytes: one matrix a row would fill a worker otherwise."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(v.nbytes for v in row if isinstance(v, np.ndarray))
        if size >= BATCH_BYTES:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions by ``keys`` in a fixed number. Python work is heavy per byte, so it must
    not be merged into few tasks for having little data; grouping reuses this partitioning."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """As ``spread``, for a map that reads a key's rows as one run. Spark drops a repartition whose input is dealt
    alike, and may later read that input in other pieces, as a map asks for no order of its own: one more expression keeps it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys, F.lit(0))


def moments(rows: DataFrame, keys: list[str], few: bool = False) -> DataFrame:
    """Weighted moments of [1, vec, y] per key: ``packed`` upper triangle and ``n``.

    ``rows`` has the keys, ``w``, ``y``, ``cnt`` (what a row adds to ``n``; negative weights
    take rows back out) and ``vec``. First each partition is sorted locally and a key's run
    of rows is folded into its moments as soon as that is the smaller form, so a dominant
    key leaves the map side as a few matrices. After the shuffle a task adds up one key at
    a time, holding one matrix. A key has at most a matrix a partition; only where ``few`` keys
    gather all rows do these meet in groups first, as elsewhere the rows on their way are smaller than
    the matrices such groups would make of them.
    """
    key_fields = [rows.schema[k] for k in keys]
    mid = T.StructType([*key_fields, T.StructField("folded", T.BooleanType()), T.StructField("cnt", T.DoubleType()),
                        T.StructField("payload", T.ArrayType(T.DoubleType()))])
    out = T.StructType([*key_fields, T.StructField("n", T.DoubleType()), T.StructField("packed", T.ArrayType(T.DoubleType()))])

    bounded_batches(rows.sparkSession)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A key's run goes on over batches: its rows wait until their matrix is the smaller form.
        current, total, n, wait = None, None, 0.0, []

        def folded(rows):
            m = np.vstack(rows)
            return N.pack((m[:, :-1] * m[:, -1:]).T @ m[:, :-1])

        def flush():
            if total is not None:
                return [(*current, True, n, total + folded([x for x, _ in wait]) if wait else total)]
            return [(*current, False, float(c), row) for x, cnt in wait for row, c in zip(x, cnt)]

        for pdf in batches:
            found = []
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                if key != current:
                    if current is not None:
                        found += flush()
                    current, total, n, wait = key, None, 0.0, []
                cnt = part["cnt"].to_numpy(float)
                wait.append((np.column_stack([N.augmented(_stack(part["vec"]), part["y"].to_numpy(float)), part["w"].to_numpy(float)]), cnt))
                n += float(cnt.sum())
                if sum(len(c) for _, c in wait) > wait[0][0].shape[1] // 2:
                    more = folded([x for x, _ in wait])
                    total, wait = more if total is None else total + more, []
            yield from in_batches(found, mid.names)
        if current is not None:
            yield from in_batches(flush(), mid.names)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        current, total, n = None, None, 0.0
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                if key != current:
                    if current is not None:
                        yield (*current, n, total)
                    current, total, n = key, 0.0, 0.0
                n += float(part["cnt"].sum())
                for payload in part.loc[part["folded"], "payload"]:
                    total = total + np.asarray(payload)
                loose = part.loc[~part["folded"], "payload"]
                if len(loose):
                    a = _stack(loose)
                    total = total + N.pack((a[:, :-1] * a[:, -1:]).T @ a[:, :-1])
        if current is not None:
            yield (*current, n, total)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_batches(sums(batches), out.names)

    slim = rows.select(*keys, F.col("w").cast("double"), F.col("y").cast("double"), F.col("cnt").cast("double"), "vec")
    parts = slim.sortWithinPartitions(*keys).mapInPandas(fold, mid)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if few and tasks > TREE_FROM:
        # Partial sums first: a key's matrices, one a partition, meet in groups before they meet in one task.
        salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(int(tasks**0.5))))
        again = spread(salted, *keys, "_salt").sortWithinPartitions(*keys, "_salt").drop("_salt").mapInPandas(merge, out)
        parts = again.select(*keys, F.lit(True).alias("folded"), F.col("n").alias("cnt"), F.col("packed").alias("payload"))
    return spread(parts, *keys).sortWithinPartitions(*keys).mapInPandas(merge, out)


def one_moment(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Moments of a whole frame, model-sized, on the driver."""
    row = moments(rows.withColumn("_all", F.lit(0)), ["_all"], few=True).head()
    if row is None:
        return np.zeros((0, 0)), 0.0
    width = int((np.sqrt(8 * len(row["packed"]) + 1) - 1) / 2)
    return N.unpack(row["packed"], width), row["n"]


def block_plan(spark, n_queries: int, n_items: int, block: int | None = None, whole: bool = False) -> tuple[int, int]:
    """(query blocks, parts of the items): bounded blocks, and no fewer tasks than cores if the data allow.

    A task reads all items, sheet by sheet; they are dealt to several only where blocks are fewer than cores.
    """
    blocks, parts = max(-(-n_queries // (block or BLOCK_QUERIES)), 1), 1
    cores = spark.sparkContext.defaultParallelism
    if n_queries * n_items > 2_000_000:
        blocks = max(blocks, min(4 * cores, -(-n_queries // LEAST_QUERIES)))
        if blocks < cores and not whole:
            parts = min(-(-cores // blocks), max(n_items // 1000, 1))
    return blocks, parts


def sheets(rows: DataFrame, name: str, most: int) -> DataFrame:
    """The rows of each partition, so many or so many bytes together as one value."""

    def run(batches):
        held, n, size = [], 0, 0

        def sheet():
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held[0].schema) as stream:
                for part in held:
                    stream.write_batch(part)
            return pa.RecordBatch.from_pydict({name: pa.array([out.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n, size = n + part.num_rows, size + part.nbytes
                if n >= most or size >= BATCH_BYTES:
                    yield sheet()
                    held, n, size = [], 0, 0
        if held:
            yield sheet()

    return rows.mapInArrow(run, f"{name} binary")


def _of_sheet(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(value).read_pandas()


def per_block(queries: DataFrame, items: DataFrame, skip: DataFrame | None, fn, schema, sizes: tuple[int, int] | None = None,
              whole: bool = False, block: int | None = None, streamed: bool = False) -> DataFrame:
    """``fn(queries, items, skip)`` on every block of queries and sheet of items, or with ``whole`` on all items at
    once. With ``streamed`` it gets an iterator of the sheets and returns one of results.

    Both sides are shuffled once, however many blocks there are: sheets of items are stored and read by every
    block. ``skip`` pairs (qid, item_id) travel with their query. Both sides must be cheap to count.
    """
    spark = queries.sparkSession
    bounded_batches(spark)
    n_q, n_i = sizes or (queries.count(), items.count())
    blocks, parts = block_plan(spark, n_q, n_i, block, whole)
    left = queries.toDF(*queries.columns).repartition(blocks, "qid")
    if skip is not None:
        gone = skip.toDF(*skip.columns).repartition(blocks, "qid").groupBy("qid").agg(F.collect_set("item_id").alias("_gone"))
        left = left.join(gone.hint("merge"), "qid", "left")
    left = sheets(left, "_asked", block or BLOCK_QUERIES).withColumn("_block", F.monotonically_increasing_id())
    dealt = items.repartition(max(parts, -(-n_i // SHARD_ITEMS), 1))
    right = cut(sheets(dealt, "_items", min(BLOCK_ITEMS, SHARD_ITEMS))).coalesce(parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for pdf in batches for row in zip(pdf["_block"], pdf["_asked"], pdf["_items"]))
        for _, met in groupby(rows, key=lambda row: row[0]):
            first = next(met)
            asked, drop = _of_sheet(first[1]), {}
            if "_gone" in asked:
                some = asked["_gone"].notna()
                drop = dict(zip(asked.loc[some, "qid"], asked.loc[some, "_gone"]))
                asked = asked.drop(columns="_gone")
            found = (_of_sheet(value).sort_values("item_id", ignore_index=True) for _, _, value in chain([first], met))
            if streamed:
                yield from fn(asked, found, drop)
            elif whole:
                yield fn(asked, pd.concat(found, ignore_index=True).sort_values("item_id", ignore_index=True), drop)
            else:
                yield from (fn(asked, rp, drop) for rp in found)

    return left.crossJoin(right.hint("shuffle_replicate_nl")).mapInPandas(lambda batches: (out for out in run(batches) if len(out)), schema)


def one_vector(items: DataFrame, *more: str) -> DataFrame:
    """Items with vec and the length of latent; latent itself only where vec does not begin with it."""
    leads = F.slice("vec", 1, F.size("latent")) == F.col("latent").cast("array<double>")
    return items.select("item_id", "vec", *more, F.size("latent").alias("_d"), F.when(~leads, F.col("latent").cast("array<double>")).alias("_latent"))


def latent_of(rp: pd.DataFrame, x: np.ndarray) -> np.ndarray:
    d, own = int(rp["_d"].iloc[0]), rp["_latent"].notna().to_numpy()
    if not own.any():
        return x[:, :d]
    return _stack([v if mine else row[:d] for v, mine, row in zip(rp["_latent"], own, x)])


def best_per_query(hits: DataFrame, k: int, score: str = "score") -> DataFrame:
    return top_per_key(hits, ["qid"], [F.desc(score), F.asc("item_id")], k)


def gone_at(item_ids: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Places of ``gone`` among items in order of their ids."""
    if item_ids.dtype.kind != "i":
        return np.flatnonzero(np.isin(item_ids, gone))
    first, last = np.searchsorted(item_ids, gone), np.searchsorted(item_ids, gone, "right")
    return np.concatenate([first[last > first], *[np.arange(a, b) for a, b in zip(first[last > first + 1], last[last > first + 1])]])


def keep_mask(item_ids: np.ndarray, gone: np.ndarray | None) -> np.ndarray:
    """Items, in order of their ids, that are not ``gone``."""
    keep = np.ones(len(item_ids), dtype=bool)
    if gone is not None and len(gone):
        keep[gone_at(item_ids, gone)] = False
    return keep


def in_slices(n: int, items: int):
    """Slices of queries whose scores against so many items stand in one matrix."""
    step = max(SCORES_AT_ONCE // max(items, 1), 1)
    return (slice(k, k + step) for k in range(0, n, step))


class BestRows:
    """Each query's k best items so far, by score and then by id, while sheets of items pass."""

    #: Items whose k-th best bounds that of a sheet from below.
    HEAD = 4096

    def __init__(self, qids: np.ndarray, k: int, drop: dict):
        self.qids, self.k, self.drop = qids, k, drop
        self.score, self.ids = np.full((len(qids), k), -np.inf), None

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries ``at`` for a sheet's items, in order of their ids; overwrites ``scores``."""
        for row, q in zip(scores, self.qids[at]):
            if (gone := self.drop.get(q)) is not None:
                row[gone_at(ids, gone)] = -np.inf
        least = self.score[at, -1]
        head = scores[:, :max(self.HEAD, 4 * self.k)]
        if head.shape[1] >= self.k and not np.isfinite(least).all():
            head = np.where(np.isfinite(head), head, -np.inf)
            least = np.maximum(least, np.partition(head, head.shape[1] - self.k, axis=1)[:, head.shape[1] - self.k])
        row, column = np.nonzero(scores >= least[:, None])
        new = scores[row, column]
        if self.ids is None:
            self.ids = np.zeros(self.score.shape, ids.dtype)
        held = np.arange(len(at)).repeat(self.k)
        row, score = np.r_[row, held], np.r_[new, self.score[at].ravel()]
        item = np.concatenate([ids[column], self.ids[at].ravel()])
        some = np.isfinite(score)
        row, score, item = row[some], score[some], item[some]
        by_id = np.argsort(item, kind="stable")
        order = by_id[np.lexsort((-score[by_id], row[by_id]))]
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        row, place, order = row[best], place[best], order[best]
        self.score[at] = -np.inf
        self.ids = self.ids.astype(np.result_type(self.ids.dtype, item.dtype), copy=False)
        self.score[at[row], place], self.ids[at[row], place] = score[order], item[order]

    def frame(self, names: list[str]) -> pd.DataFrame:
        row, place = np.nonzero(np.isfinite(self.score))
        if not len(row):
            return pd.DataFrame([], columns=names)
        return pd.DataFrame(dict(zip(names, (self.qids[row], self.ids[row, place], self.score[row, place]))))


def as_frame(held: list, names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({name: np.concatenate(c) for name, c in zip(names, zip(*held))}) if held else pd.DataFrame([], columns=names)


def top_items(queries: DataFrame, items: DataFrame, k: int, skip: DataFrame | None = None, bias: bool = False,
              sizes: tuple[int, int] | None = None) -> DataFrame:
    """The k items with the largest dot product per query(qid, w[, b]), exact.

    A block keeps its k best while the items pass; one window ranks them.
    """
    schema = T.StructType([queries.schema["qid"], items.schema["item_id"], T.StructField("score", T.DoubleType())])

    def run(asked, found, drop):
        w, best = _stack(asked["w"]), BestRows(asked["qid"].to_numpy(), k, drop)
        places = np.arange(len(w))
        for rp in found:
            ids, x = rp["item_id"].to_numpy(), _stack(rp["vec"]).T
            for part in in_slices(len(w), len(ids)):
                scores = w[part] @ x
                if bias:
                    scores += asked["b"].to_numpy(float)[part, None]
                best.add(places[part], scores, ids)
        yield best.frame(schema.names)

    return best_per_query(per_block(queries, items.select("item_id", "vec"), skip, run, schema, sizes, streamed=True), k)
