"""Session helpers: table access and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> None:
    """Session settings that results depend on.

    Spark 4.1 may take a union for partitioned by a key because its inputs are, and leave out the
    shuffle before an aggregation; when the inputs' partitions are then coalesced differently at run
    time, groups come out twice. That inference is switched off."""
    try:
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    except Exception:  # noqa: BLE001 - a version without the setting does not need it
        pass
    _ship(spark)


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application, wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="paperloom-")  # read by the driver only, which serves the file
    try:
        sc.addPyFile(shutil.make_archive(f"{folder}/paperloom_package", "zip", package.parent, package.name))
    except Exception:  # noqa: BLE001 - then the executors must have it on their path
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; without one only a local session gets a folder of its own (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"paperloom-checkpoint-{os.getuid()}"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage and drop its lineage."""
    prepare(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """``cut``, and the shuffle files that led to it are deleted at once, not when the driver happens to
    collect its garbage; a Spark without that setting keeps them until then."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return cut(df.select("*"))  # a plan of its own: only its shuffles go
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def dropped(*cuts: DataFrame) -> None:
    """Delete the files of tables made by ``cut`` that nothing reads any more."""
    for df in cuts:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores, dealt out evenly for work in Python.

    Only for direct scans (the number of splits of a shuffled plan is known at run time only); large
    tables have more splits than cores and stay as they are."""
    prepare(scan.sparkSession)
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(2 * cores) if scan.rdd.getNumPartitions() < cores else scan


def shuffle_width(spark: SparkSession) -> int:
    prepare(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
