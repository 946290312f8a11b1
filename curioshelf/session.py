"""Session settings and places to write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Tables grow, the number of partitions that a session is given does not.  Up to 200 a shuffle writes
# straight to its files, without a buffer that could overflow; small ones are put together again.
PARTITIONS = 200
PARTITION_SIZE = "32m"
# The driver builds what is broadcast: it holds some times the bytes measured, and several tables at once.
BROADCAST_MOST, BROADCAST_SHARE = 128 << 20, 32
_local: dict[str, str] = {}
_made: list[str] = []  # scratch folders of this driver


def broadcast_size(heap: int) -> int:
    """Bytes up to which a driver with such a heap broadcasts a table."""
    return min(BROADCAST_MOST, heap // BROADCAST_SHARE)


def tune(spark: SparkSession) -> SparkSession:
    """Settings the operators are written for: adaptive plans, splitting of skewed look-up joins
    even where that costs a later aggregation one more exchange, and broadcasting a look-up side
    whose size, once it has been measured at run time, is small next to the driver.  A shuffle starts
    with many partitions, so that a task sorts little and need not spill.  The state of streams is
    kept on disk, not in the memory of executors."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    heap = spark._jvm.java.lang.Runtime.getRuntime().maxMemory()
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(broadcast_size(heap)))
    given = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(given, PARTITIONS)))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PARTITION_SIZE)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder.  Only a session on one machine may go without: it gets a local
    folder, the same one throughout.  On a cluster a missing setting is an error."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder is None:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        if "folder" not in _local:
            _local["folder"] = tempfile.mkdtemp(prefix="spark-")
        folder = _local["folder"]
    return folder


def scratch(spark: SparkSession) -> str:
    """Path of a fresh folder in the shared folder."""
    _made.append(f"{shared_folder(spark)}/curioshelf-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> int:
    """Deletes the scratch folders that this driver has made, and returns their number.  Results that
    read them can no longer be computed, so this comes after the last of them has been written."""
    done = len(_made)
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared folder, for a result that a plan
    reads several times.  It survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and written as a table in the shared folder."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
