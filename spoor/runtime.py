"""Session helpers: the shared folder, written intermediate tables, table loading."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import zipfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Where tests keep their intermediate tables; a cluster names its own shared folder.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs on one machine (tests) a
    temporary folder of this machine is used; on a cluster its absence is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="spoor-")
        atexit.register(shutil.rmtree, _LOCAL[key], ignore_errors=True)
    return _LOCAL[key]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether the shuffle files of a query are deleted as soon as it has ended.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def swept(spark: SparkSession):
    """Actions within it leave no shuffle files; else these stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_SWEEP, "false")
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SWEEP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, and is
    columnar and compressed, unlike an RDD checkpoint. What was shuffled for it is deleted once it is written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with swept(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores before costly expressions, where it has fewer partitions than those; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once a session.

    The archive is made on the driver and served by Spark's own file server,
    so that no executor needs the repository on its path.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spoor-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as held:
        for path in sorted(root.rglob("*.py")):
            held.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
