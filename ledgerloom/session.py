"""Session helpers: table access and lineage cuts in the shared folder."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, from ``spark.checkpoint.dir``.

    A temporary folder is made only where the setting is empty and all executors run
    on this machine; on a cluster a folder of its own on each machine would lose
    rows, so the setting is required there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        d = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in the shared folder at once: under another name first, then renamed over the old one."""
    sc = spark.sparkContext
    fs_path = sc._jvm.org.apache.hadoop.fs.Path
    new, old = fs_path(f"{path}.{uuid.uuid4().hex[:8]}"), fs_path(path)
    fs = old.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(new, old):  # file systems that do not rename over a file
        fs.delete(old, False)
        fs.rename(new, old)


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small file in the shared folder; None if there is none."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    text = bytes(stream.readAllBytes()).decode()
    stream.close()
    return text


_FOLDERS: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder; it is deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    path = _FOLDERS.get(app)
    if path is None or not path.startswith(shared_dir(spark)):
        path = _FOLDERS[app] = f"{shared_dir(spark)}/ledgerloom-{app}-{uuid.uuid4().hex[:8]}"
        jvm = spark.sparkContext._jvm

        def clean() -> None:
            try:  # the session may be stopped by now, its JVM is not
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
            except Exception:  # noqa: BLE001
                pass

        atexit.register(clean)
    return path


def cut(df: DataFrame, partition_by: list[str] | None = None, count: Column | str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends there, so a lost executor costs no recomputation of earlier
    rounds, the plan is computed once, and the reader knows the table's true size.
    With ``count``, rows that meet the condition are counted as they are written and
    ``counted`` of the result is above 0 if there is one; it is exact unless a task
    was repeated.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/cut-{uuid.uuid4().hex}"
    schema, seen = df.schema, None
    if count is not None:
        seen = Observation()
        df = df.observe(seen, F.count_if(F.expr(count) if isinstance(count, str) else count).alias("n"))
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._cut_path = path
    out.counted = seen.get.get("n", 0) if seen else None
    return out


def drop_cut(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`cut` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps deleted, which else waits for the driver to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a table's size; exact for a freshly written cut."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
