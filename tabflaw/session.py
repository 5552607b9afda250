"""Spark session settings and the shared checkpoint folder.

On a cluster the session is created by the platform; ``configure`` only
sets what is unset.  ``checkpoint_dir`` reads ``spark.checkpoint.dir``
from the session and falls back to a scratch folder only when it is
unset (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale: adaptive execution re-plans joins and
# coalesces shuffle partitions at runtime, and splits skewed join
# partitions (a single hot key may hold a third of all rows).
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tabflaw") -> SparkSession:
    master = master or os.environ.get("SPARK_MASTER", "local[8]")
    cores = master[len("local["):-1] if master.startswith("local[") else "8"
    parts = shuffle_partitions or (8 if cores == "*" else max(int(cores), 1))
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               # local runs keep catalog tables out of the working directory
               .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "tabflaw-warehouse"))
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
               .config("spark.driver.memory", "16g")
               .config("spark.sql.shuffle.partitions", str(parts)))
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply SCALE_CONF keys that the session does not set yet."""
    for k, v in SCALE_CONF.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared lineage-cut folder.

    ``spark.checkpoint.dir`` of the session if it is set, else the folder that
    the context already has.  Only a local session may do without: it gets a
    fresh scratch folder.  On a cluster a machine-local folder would lose data,
    so the setting is required there.
    """
    global _LOCAL_DIR
    sc = spark.sparkContext
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _LOCAL_DIR is None:
            _LOCAL_DIR = tempfile.mkdtemp(prefix="tabflaw-ckpt-")
        conf_dir = _LOCAL_DIR
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for a written table."""
    import uuid
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (never ``localCheckpoint``).

    Spark removes the files when the frame is garbage-collected if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set (local sessions
    of this module set it; it cannot be changed on a running cluster session).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
