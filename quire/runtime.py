"""Session helpers shared by every operator: table reading and lineage cutting."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only on a single machine that leaves it unset, as in tests, a temporary folder is set; a cluster must name one,
    because no executor could read what another wrote to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, partitions: int | None = None, free: bool = True) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back; with ``free`` the driver then looks for
    shuffle files that nothing needs any more.

    This cuts the lineage like a reliable checkpoint, but in a compact columnar form that later
    scans can prune. A lost executor costs nothing: the files are on shared storage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quire/{uuid.uuid4().hex}"
    out = df if partitions is None else df.coalesce(partitions)
    out.write.option("compression", "zstd").parquet(path)
    # the shuffle files behind the table go once the driver's collector finds them unused; left to itself it may
    # not look for a long time, and the disks hold every step's files
    if free:
        release(spark)
    made = spark.read.schema(df.schema).parquet(path)
    made._quire_path = path
    return made


def release(spark: SparkSession) -> None:
    """Let the driver's collector look for broadcasts, plans, compiled code and shuffle files that nothing needs any more."""
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more: all that was made of them has been written itself."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_quire_path", None)
        if path:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Changes with the files under a path: their names, sizes and times."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    seen = hashlib.sha256()
    while files.hasNext():
        x = files.next()
        seen.update(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}\n".encode())
    return seen.hexdigest()[:32]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table of the data folder; ``root`` may be a local path or any URI."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
