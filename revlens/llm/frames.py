"""Frame helpers shared by the corpus operators.

* ``texts`` - the two columns an operator reads, under private names, so that
  extra columns of any name never clash; a null text is empty.
* ``stored`` - cuts lineage with a reliable checkpoint in the folder that
  ``spark.checkpoint.dir`` names (shared by all executors); a local session
  without one gets a scratch folder, any other master raises.
* ``tidy`` - trims a Python worker when its task ends.
* ``resident`` - the one vocabulary or automaton that a Python worker keeps
  between tasks.
* ``slices`` - number of hash slices so that one holds about ``target`` bytes.
"""

from __future__ import annotations

import ctypes
import gc
import math
import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_shipped: set[str] = set()
_resident: dict = {}


def trim() -> None:
    """Give a worker's freed memory back to the system: idle workers stay and count against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def tidy(run):
    """A function over Arrow batches that trims its worker when its task ends."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()
    return wrapped


def resident(name: str, data: bytes, make):
    """What a worker keeps between tasks: one thing, ``make(data)``, of the operator that it served last.

    Workers are reused by whatever operator comes next; the tables and caches
    of the one before are let go first, and their memory is given back.
    """
    key = (name, data)
    if key not in _resident:
        if _resident:
            _resident.clear()
            trim()
        _resident[key] = make(data)
    return _resident[key]


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers unless they find it by themselves (path or working folder)."""
    sc = spark.sparkContext
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    if sc.applicationId in _shipped or root == os.getcwd() or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(sc.applicationId)
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)  # Spark copies it to every executor


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of at most ``rows`` rows, so long texts stay within a worker's memory; workers find this package."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a null text as the empty string."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", named)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there.

    Shuffle files of what led to it are no longer needed; a collection of
    unused objects lets Spark's cleaner drop those of earlier steps.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    gc.collect()
    spark._jvm.System.gc()
    return out


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """Total UTF-8 bytes of a text column (one aggregate, one number)."""
    return int(df.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0)


def slices(total_bytes: int, target: int) -> int:
    return max(1, math.ceil(total_bytes / target))


def crc_rest(col: str, mod: int):
    """crc32 of the id's decimal text, mod ``mod`` (a null id: 0)."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod), F.lit(0))
