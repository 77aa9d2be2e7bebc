"""Session settings and lineage cutting shared by all iterative plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Tables above SHARE_ROWS are shuffled in shares, one after the other, so the disk holds the shuffles of one share.
SHARES, SHARE_ROWS = 4, 4_000_000
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "loomcycle", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the engine expects; clusters bring their own."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.limit.initialNumPartitions", "64")  # small partitions: one job says whether any has a row
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no stack walk for each expression
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names its shared folder in spark.checkpoint.dir; a temporary one is made only in local mode."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loomcycle-checkpoint-"))


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: survives lost executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Shuffle files and checkpoints of plans that nothing refers to leave the disk now, not when the driver's memory is full."""
    spark._jvm.System.gc()


class Stage:
    """A relation that is written again and again, as Parquet with zstd: only what was written last stays on disk.

    What is read from it must be written elsewhere before the next put or drop.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, None

    def put(self, df: DataFrame) -> DataFrame:
        folder = fresh_folder(self.spark, "stage")
        df.write.parquet(folder, compression="zstd")
        return self._turn_to(folder, df)

    def put_shares(self, shares: Iterable[DataFrame]) -> DataFrame:
        """The union of plans of one schema, written one after the other; a plan's shuffles leave the disk with its end."""
        folder, before = fresh_folder(self.spark, "stage"), self.spark.conf.get(_CLEAN_UP, None)
        for df in shares:
            self.spark.conf.set(_CLEAN_UP, "true")
            try:
                df.write.mode("append").parquet(folder, compression="zstd")
            finally:
                self.spark.conf.unset(_CLEAN_UP) if before is None else self.spark.conf.set(_CLEAN_UP, before)
        return self._turn_to(folder, df)

    def _turn_to(self, folder: str, df: DataFrame) -> DataFrame:
        self.drop()
        self.folder = folder
        return self.spark.read.schema(df.schema).parquet(folder)

    def drop(self) -> None:
        if self.folder:
            remove(self.spark, self.folder)
            self.folder = None
        release(self.spark)


@contextmanager
def written(spark: SparkSession, shares: Iterable[DataFrame]) -> Iterator[DataFrame]:
    """The union of the plans as one written relation, which leaves the disk at the end of the block."""
    stage = Stage(spark)
    try:
        yield stage.put_shares(shares)
    finally:
        stage.drop()


def shares_of(rows: int) -> int:
    return max(1, min(SHARES, -(-rows // SHARE_ROWS)))


def share(column: str, k: int, n: int) -> Column:
    """Share k of n of the column's values; a value lies wholly in one."""
    return F.pmod(F.xxhash64(column), F.lit(n)) == k
