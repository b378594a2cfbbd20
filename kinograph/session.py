"""Session settings, shared scratch space, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def get_session(app: str = "kinograph", cpus: int | str | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the one it gives."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEM", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which timers and several state columns need;
    the session's own provider is back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


#: Bytes of a batch between the JVM and a Python worker.
BATCH_BYTES = 8 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes a batch, so that a worker's memory does not grow with the
    width of rows; a lower limit of the session's own stays."""
    if int(spark.conf.get(_ARROW_BYTES).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(_ARROW_BYTES, str(BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    root = tempfile.mkdtemp(prefix="kinograph-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise with a reliable checkpoint, so lost executors never repeat the past."""
    spark = df.sparkSession
    root = scratch_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the scratch folder and read back; keeps column pruning."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast ``df`` only once a bounded count proves it small; otherwise leave
    the join to Spark, which shuffles both sides."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def global_index(df: DataFrame, order: list, name: str = "position", start: int = 0) -> DataFrame:
    """Number rows by a total order without a single-task window.

    Range partitioning sorts in parallel; a row's number is its place inside its
    partition plus the sizes of the partitions before it. ``order`` must end in a
    unique column. The checkpoint pins the partitioning both reads depend on.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
    )
    part = F.shiftright("_m", 33)
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    # One row per partition of the job, so both the window and the broadcast are bounded.
    before = sizes.select(
        "_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_off")
    )
    return (
        ranged.withColumn("_p", part)
        .join(F.broadcast(before), "_p")
        .withColumn(name, F.col("_off") + F.col("_m").bitwiseAND((1 << 33) - 1) + start)
        .drop("_m", "_p", "_off")
    )


def one_row(df: DataFrame):
    """A one-row frame as a scalar subquery: a struct column to pick fields from."""
    return df.select(F.struct(*[F.col(c) for c in df.columns])).scalar()


def running_totals(df: DataFrame, group: list[str], order: list, sums: dict) -> DataFrame:
    """Per group, in order: ``before`` = rows before this one, and each sum over them.

    A range sort splits even one dominant group over all partitions. Windows run per
    (group, partition) slice; earlier slices enter through their totals, which number
    at most groups + partitions.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group]
    ranged = cut(df.repartitionByRange(n, *keys, *order).withColumn("_p", F.spark_partition_id()))
    local = Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumns({
        "_c": F.coalesce(F.count(F.lit(1)).over(local), F.lit(0)),
        **{f"_s_{k}": F.coalesce(F.sum(v).over(local), F.lit(0.0)) for k, v in sums.items()},
    })
    slices = ranged.groupBy("_p", *group).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    earlier = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        "_p", *group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_on"),
        *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0.0)).alias(f"_o_{k}") for k in sums])
    return rows.join(offsets, ["_p", *group]).withColumns({
        "before": F.col("_c") + F.col("_on"),
        **{k: F.col(f"_s_{k}") + F.col(f"_o_{k}") for k in sums},
    }).drop("_p", "_c", "_on", *[f"_s_{k}" for k in sums], *[f"_o_{k}" for k in sums])


def top_per_key(df: DataFrame, keys: list[str], order: list, n: int, name: str = "rank", salt_on: str = "item_id") -> DataFrame:
    """First ``n`` rows per key. Spark limits each group before the shuffle only up to a
    thousand rows; beyond that the groups are first cut in salted slices, so no task sees
    more than slices × n rows of one key."""
    if n > 1000:
        inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(64))).withColumn("_n", F.row_number().over(inner)).filter(
            F.col("_n") <= n).drop("_n", "_salt")
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
