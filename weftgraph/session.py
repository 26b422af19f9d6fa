"""Session helpers: building a session, the shared folder, and cutting lineage through written tables.

Executors can be lost at any time, so intermediate results that are read more than once are written to the
folder named by ``spark.checkpoint.dir`` (shared by all executors) and read back; nothing relies on cached
blocks or on ``localCheckpoint``.
"""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "weftgraph", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the plans are written for (AQE with skew joins, UTC, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediate tables.

    Taken from ``spark.checkpoint.dir`` or an already set checkpoint directory. Only a local session (one
    machine, as in tests) may fall back to a temporary folder; on a cluster the setting is required.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not there and jsc.getCheckpointDir().isDefined():
        there = jsc.getCheckpointDir().get()
    if not there:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may already be gone
        pass


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run: once per context, through the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_weftgraph_shipped", False):
        return
    root, box = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(f"{root.name}/{p.relative_to(root)}", p.read_bytes())
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/weftgraph-{uuid.uuid4().hex}/weftgraph.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(box.getvalue()))
    finally:
        out.close()
    sc.addPyFile(path.toString())
    sc._weftgraph_shipped = True


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftgraph-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._weftgraph_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`written` once nothing reads it any more."""
    path = getattr(df, "_weftgraph_path", None)
    if path:
        _remove(df.sparkSession, path)
