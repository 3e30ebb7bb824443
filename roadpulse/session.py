"""Session settings and the shared folder for checkpoints and written results."""

import shutil
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHIPPED = "spark.roadpulse.shipped"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(master=None, app_name="roadpulse", **conf):
    """A session with the settings the operators are planned for."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # A hot VIN or fleet is split even when the join's partitioning would be reused later.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


@lru_cache(maxsize=1)
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="roadpulse-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own: on a cluster a
    machine-local path would be lost with the machine.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
        base = _local_base()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Gives the Python workers of every executor this package, once per session.

    The archive is made on the driver; Spark copies it to the executors.
    """
    if spark.conf.get(SHIPPED, None):
        return
    source = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="roadpulse-")) / source.name
    archive = shutil.make_archive(str(target), "zip", source.parent, source.name)
    spark.sparkContext.addPyFile(archive)
    spark.conf.set(SHIPPED, "true")
