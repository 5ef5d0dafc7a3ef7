"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on: UTC for all timestamp logic, AQE for runtime
# re-planning (partition coalescing and skew-join splitting), Arrow for the
# few pandas batches.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # State of streams on disk: it may outgrow an executor's memory.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "triagekit", extra: dict | None = None,
                inputs: list[str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's required settings.

    ``inputs`` are the paths the job reads: scan splits, shuffle partitions and skew
    thresholds then follow their size and the cluster's cores (:func:`scale_conf`).
    Without them, and without ``shuffle_partitions``, Spark's own default stays.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    if inputs:
        for k, v in scale_conf(stored_bytes(spark, inputs), spark.sparkContext.defaultParallelism).items():
            spark.conf.set(k, v)
    return spark


def stored_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Bytes stored under the paths, by the file system's own summary."""
    jvm, total = spark.sparkContext._jvm, 0
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p):
            total += fs.getContentSummary(p).getLength()
    return total


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``triagekit`` importable in every Python worker (local or cluster).

    Operator functions run in Arrow-batched Python workers that import them by
    module name; the package is zipped once per application and registered
    with ``addPyFile``, which Spark distributes to the executors.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="triagekit-pyfiles-"), "triagekit.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def apply_conf(spark: SparkSession) -> None:
    """Apply runtime-settable options to an existing session (e.g. the driver's)."""
    ship_package(spark)
    for k, v in BASE_CONF.items():
        if k.startswith("spark.ui"):
            continue
        if spark.conf.isModifiable(k):  # static settings of a foreign session stay
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    On a cluster the setting must be present and point at shared storage.
    Only when it is unset (local runs, tests) do we create one of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        # Local runs and tests only: a private folder on this machine.
        configured = tempfile.mkdtemp(prefix="triagekit-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read back: cuts the
    lineage in compressed columns, and a lost executor loses nothing of it."""
    path = f"{checkpoint_dir(df.sparkSession)}/triagekit-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's default scan split.
SCAN_SPLIT = 128 << 20


def input_bytes(df: DataFrame) -> int:
    """Size of ``df`` by the optimizer's statistics (file sizes, scaled by the columns
    read); runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin spread a narrow input before CPU-heavy row work.

    Only a plain scan whose size makes under half as many scan tasks as the cluster's
    default parallelism (a single large file or row group) is spread: inputs that are
    already wide are left alone, so at scale this adds no shuffle.  Decided from the
    plan's statistics alone; frames that already shuffle are left to adaptive execution.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(x in plan for x in ("Join", "Aggregate", "Repartition", "Sort", "Window")):
        return df
    if input_bytes(df) // SCAN_SPLIT * 2 > target:
        return df
    return df.repartition(target)


def scale_conf(input_bytes: int, cores: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle/scan sizing for a job reading ``input_bytes`` on ``cores`` cores.

    Targets ~``partition_bytes`` per task so partitions fit executor memory
    without spilling, and at least three waves of tasks for load balance;
    AQE then coalesces small partitions and splits skewed ones.
    """
    parts = max(cores * 3, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 64 << 20


def _row_bytes(kind) -> int:
    """Bytes of a value of a fixed-width type; 0 where the width depends on the data."""
    from pyspark.sql import types as T
    if isinstance(kind, T.StructType):
        widths = [_row_bytes(f.dataType) for f in kind.fields]
        return sum(widths) + 8 if all(widths) else 0
    if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)):
        return 0
    return 16 if isinstance(kind, T.DecimalType) else 8


def measured_bytes(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of ``df`` from one aggregate: partial counts per task, one row each.

    Fixed-width columns count by type, others by the length of their text form.
    """
    wide = [f.name for f in df.schema.fields if not _row_bytes(f.dataType)]
    fixed = sum(_row_bytes(f.dataType) for f in df.schema.fields) + 16
    width = F.lit(fixed)
    for c in wide:
        width = width + F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("b")).first()
    return r.n, r.b or 0


def maybe_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                    materialize: bool = False, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast-hint ``df`` if it is measured to be within ``max_bytes`` and ``max_rows``.

    ``materialize`` checkpoints ``df`` first, for frames that are expensive to
    derive (an aggregate over a big table): the measurement and the join then
    read the checkpoint instead of recomputing it.

    A static hint is what keeps the *large* side of a join from being
    shuffled: AQE can switch to a broadcast join only after both sides'
    shuffle stages have run.  Beyond the bound the frame is returned as is
    and the join shuffles (AQE still splits skewed partitions).
    """
    if materialize:
        df = cut_lineage(df)
    rows, size = measured_bytes(df)
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df
