"""Session helpers: the shared folder, and tables by name."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, a laptop) a local folder is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        path = tempfile.mkdtemp(prefix="lexweave-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder. ``release`` removes it;
    at the latest that happens when the program ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lexweave-{spark.sparkContext.applicationId}"
    if path not in _scratch:
        _scratch[path] = spark
        if len(_scratch) == 1:
            atexit.register(_release_all)
    return path


_scratch: dict[str, SparkSession] = {}


def release(spark: SparkSession) -> None:
    """Remove the tables that this application wrote into the shared folder.

    To be called when the results are written: queries read these tables until then.
    """
    _remove(scratch_dir(spark))


def _remove(path: str) -> None:
    sc = _scratch.pop(path).sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def _release_all() -> None:
    for path in list(_scratch):
        try:
            _remove(path)
        except Exception:  # noqa: BLE001 - the session is gone, its folder stays for the cluster to clean
            pass


def shared_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table written into the shared folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as parquet into the shared folder, in folders by the column ``by``
    if given, and read it back.

    Cuts the lineage in a way that survives the loss of any executor.
    """
    path = shared_table_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(scan: DataFrame) -> DataFrame:
    """A scan with at least as many partitions as there are cores.

    Small files come as one or two tasks, too few for work that is heavy per
    row. Only then rows are dealt out anew; a scan of many partitions is left
    alone, so nothing large is ever shuffled for it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
