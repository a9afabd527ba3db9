"""Intermediate tables that survive the loss of an executor.

A stage that is read more than once is written to the folder that all executors share, the one named in
``spark.checkpoint.dir``. Only where that setting is absent and the master is local (tests, one machine) a folder of
this machine is made; on a cluster its absence is an error, as each executor would write to a disk of its own.

What a process has written here is deleted when it ends, or by :func:`clean`.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of this machine only if the session names none and runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jvm_dir.get() if jvm_dir.isDefined() else None
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="searchloom-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return _own["dir"]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_root(spark)}/searchloom/{label}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clean_at_exit)
    _made.add(path)
    return path


def clean(spark: SparkSession) -> int:
    """Delete all tables that this process has written here; no result that still reads one may be in use. Returns their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for path in sorted(_made):
        p = jvm.org.apache.hadoop.fs.Path(path)
        n += bool(p.getFileSystem(conf).delete(p, True))
    _made.clear()
    return n


def _clean_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            clean(spark)
    except Exception:  # noqa: BLE001  the session has ended before
        pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a fresh table: lineage is cut, retries read the files."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
