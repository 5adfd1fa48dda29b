"""Session defaults and durable intermediate results.

``durable`` cuts lineage by writing a Parquet table into the folder that the cluster
shares (``spark.checkpoint.dir``), so a lost executor never takes an intermediate with it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (local runs and tests).
LOCAL_SHARED_DIR = "/tmp/checkpoints"
_SHIPPED: set[str] = set()
#: Rows that a task groups, sorts or joins at once where their number is known.
ROWS_IN_TASK = 1 << 19


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomgraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def shared_root(spark: SparkSession) -> str:
    """This application's part of the shared folder; only a local session may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_SHARED_DIR
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """As many tasks as keep each at about ROWS_IN_TASK of the rows, whatever their number."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_IN_TASK))


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that its functions unpickle there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="loomgraph-"), "loomgraph.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("loomgraph", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def release(spark: SparkSession) -> None:
    """Delete everything this application has written with ``durable``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
