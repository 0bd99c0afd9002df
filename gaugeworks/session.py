"""Session helpers: tables written to the shared folder of the cluster."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_PARTITIONS = 20_000
_INPUT_MB: dict[str, int] = {}  # MB of files per input folder
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tuned(spark: SparkSession) -> None:
    """Adaptive execution as the operators expect it.

    Small sides are broadcast at their measured size.  Plain joins with a hot key
    are split also where that costs another shuffle later.  Sizes of files and of
    shuffles are those of compressed data: a table of a few MB can be hundreds of MB
    of rows in the driver, so both count tenfold before anything is broadcast.  For
    the same reason a task takes 16 MB of a shuffle, not 64, and 32 MB of a file, not
    128.  Python gets its rows in batches of 8 MB, or of one row.  A session that asks for
    less keeps it.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "10")
    _at_most(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", 16)
    _at_most(spark, "spark.sql.files.maxPartitionBytes", 32)
    _at_most(spark, "spark.sql.execution.arrow.maxBytesPerBatch", 8)
    if not spark.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-"):
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "1m")


def _at_most(spark: SparkSession, name: str, mb: int) -> None:
    """Lower a size setting to so many MB; a smaller one stays."""
    size = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(name).lower())
    factor = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    if size is None or int(size[1]) * factor[size[2]] > mb << 20:
        spark.conf.set(name, f"{mb}m")


def dealt_by_size(spark: SparkSession, folder: str) -> None:
    """As many partitions of a shuffle as the input has MB, at least those the session asks for.

    Adaptive execution only merges partitions.  With a fixed number of them a task's sort
    would grow with the tables.
    """
    if folder not in _INPUT_MB:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        _INPUT_MB[folder] = (files.agg(F.sum("length")).first()[0] or 0) // 1_000_000
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(least, min(_INPUT_MB[folder], MOST_PARTITIONS)))
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables.

    The cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local
    session without one gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="gaugeworks-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialised(df: DataFrame, *, free: bool = False) -> DataFrame:
    """Write a table to the checkpoint folder and read it back.

    Cuts the lineage and fixes the rows, so that a lost executor never makes a
    later step see other values.  A written table is computed once, where
    ``checkpoint()`` would compute the last stage twice, and its size is known to
    the planner.  With ``free`` the shuffles behind it leave the disk as soon as it
    is written, not when the driver next collects its garbage, and its files are zstd.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with freed(df.sparkSession, free):
        (df.write.option("compression", "zstd") if free else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int, kinds: tuple[str, ...] = ()) -> DataFrame | list[DataFrame]:
    """Like ``materialised`` with ``free``, dealt by a column.

    Tables of as many buckets are joined on it where they lie: none of them is shuffled.
    With ``kinds`` a table for each value of the column ``kind``, which can be discarded by itself.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"

    def named():
        return f"table_{uuid.uuid4().hex}"

    def unnamed(name):
        out = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # the name only, its files stay
        return out

    name = named()
    with freed(spark):
        writer = df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column)
        (writer.partitionBy("kind") if kinds else writer).saveAsTable(name)
    whole = unnamed(name)
    if not kinds:
        return whole
    out = []
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop("kind").schema)
    for kind in kinds:
        name = named()
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({column}) INTO {buckets} BUCKETS LOCATION '{path}/kind={kind}'")
        out.append(unnamed(name))
    return out


@contextmanager
def freed(spark: SparkSession, on: bool = True):
    """Shuffles of what is written inside are removed at its end."""
    before = spark.conf.get(_FREE, None)
    if on:
        spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if on:
            spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialised`` has written and that no later step reads."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        for folder in {os.path.dirname(f) for f in table.inputFiles()}:
            if "/table-" in folder:
                path = sc._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
