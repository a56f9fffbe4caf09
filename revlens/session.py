"""Session construction and cluster-safe settings.

Only tests, ``bench.py`` and ``__spark_entry__`` build a session; library code
receives one. Settings chosen for scale:

* AQE on, with partition coalescing and skew-join splitting, so a hot key
  (one Lead_ID holding a third of the deals) is split at runtime instead of
  landing in one task.
* ANSI mode stays on (Spark 4 default); arithmetic that may divide by zero
  uses ``try_divide``.
* Session time zone UTC, so month truncation is stable across executors.
* The checkpoint directory is read from the session. It is only set when the
  cluster did not name one (local tests), never to a machine-local folder
  on a cluster.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "revlens", extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session with the settings above.

    ``master`` is only used for local runs; on a cluster the launcher sets it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_SCALE_CONF)
    conf.update({
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("REVLENS_DRIVER_MEMORY", "8g"),
    })
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for key, value in _SCALE_CONF.items():
        spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, naming a scratch one only for a local master.

    On a cluster ``spark.checkpoint.dir`` must name a folder that the driver and
    all executors share; without one this raises, since a folder of one machine
    would lose data. Local runs get a fresh ``/tmp`` folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="revlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current
