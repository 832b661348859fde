"""Session helpers: local sessions for tests and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

#: Temporary folders of local applications that name no shared one, by application.
LOCAL_ROOTS: dict[str, str] = {}


def build_session(app: str = "sourceloom", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the session is given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written tables and stream state.

    It lies under the folder the cluster names in ``spark.checkpoint.dir``. Only a
    local session without that setting falls back to a temporary folder.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        if context.applicationId not in LOCAL_ROOTS:
            LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="sourceloom-")
        root = LOCAL_ROOTS[context.applicationId]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(rows: DataFrame, purpose: str) -> DataFrame:
    """``rows`` from a new table in the shared folder, so that what made them runs once however often they are read."""
    table = shared_dir(rows.sparkSession, purpose)
    rows.write.parquet(table)
    return rows.sparkSession.read.schema(rows.schema).parquet(table)
