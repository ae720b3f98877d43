"""Tables written and appended to: snapshots, logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """A table under its version number; readers take the greatest complete one."""
    path = f"{root}/v={version:09d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest version that was written to its end."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    if not fs.exists(base):
        return None
    done = [p for s in fs.listStatus(base) if fs.exists(jvm.org.apache.hadoop.fs.Path((p := s.getPath().toString()) + "/_SUCCESS"))]
    return spark.read.parquet(max(done)) if done else None


def commit_work(tables: dict[str, DataFrame], root: str, version: int) -> None:
    """Several tables (works, their files and their blocks) under one version: readers see all of it or nothing, as
    the version's mark is written after the last table. Doing it again overwrites what a stopped run left."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/v={version:09d}")
    spark = df.sparkSession
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_done/{version:09d}")
    mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(mark, True).close()


def read_work(spark: SparkSession, root: str, name: str, key: str | None = None) -> DataFrame | None:
    """A table of all versions with a mark; with a key, of each key the rows of its newest version only."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(f"{root}/_done")
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = sorted(s.getPath().getName() for s in fs.listStatus(base)) if fs.exists(base) else []
    if not done:
        return None
    df = spark.read.option("basePath", f"{root}/{name}").parquet(*[f"{root}/{name}/v={v}" for v in done])
    if key is not None:
        newest = df.groupBy(key).agg(F.max("v").alias("v"))
        df = df.join(newest, [key, "v"], "left_semi")
    return df.drop("v")


def start_run(spark: SparkSession, path: str, run_id: int, root: str, sampled: bool, probe_version: int) -> None:
    """Note that a survey has begun. Notes are only ever appended; ``runs`` folds them to one row a run."""
    row = spark.createDataFrame([(run_id, root, sampled, probe_version)], "id long, root string, sampled boolean, probe_version int")
    row.withColumn("started_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/started")


def finish_run(spark: SparkSession, path: str, run_id: int, seen: int, probed: int, skipped: int, errors: int) -> None:
    """Note that a survey has ended, with its counts."""
    row = spark.createDataFrame([(run_id, seen, probed, skipped, errors)], "id long, files_seen long, files_probed long, files_skipped long, errors long")
    row.withColumn("finished_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/finished")


def runs(started: DataFrame, finished: DataFrame) -> DataFrame:
    """One row a run; of several notes on one end the last counts, and a run that wasn't finished has no end."""
    last = finished.groupBy("id").agg(F.max_by(F.struct(*[c for c in finished.columns if c != "id"]), "finished_at").alias("x")).select("id", "x.*")
    return started.join(last, "id", "left")


def append_errors(errors: DataFrame, path: str) -> None:
    """Failures appended as they come; retries are rows of their own."""
    errors.select("path", "sha256", "stage", "error", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def append_vectors(vectors: DataFrame, path: str, key: str = "chunk_id") -> None:
    """Vectors whose key isn't stored yet; doing it twice stores them once."""
    spark = vectors.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        vectors = vectors.join(spark.read.parquet(path).select(key), key, "left_anti")
    vectors.dropDuplicates([key]).write.mode("append").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row JSON report, indented, letters kept as they are."""
    import json

    row = report.first()
    with open(path, "w", encoding="utf-8") as f:
        json.dump(json.loads(row[0]), f, indent=2, ensure_ascii=False)
