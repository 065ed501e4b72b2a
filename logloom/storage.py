"""Tables written part-way through a job, so that a lost executor never costs more than one stage; and folders
whose content is published version by version.

Everything goes below ``spark.checkpoint.dir``, the folder that all executors share. A cluster session without
that setting is refused; in local mode (tests, a notebook on one machine) a temporary folder of this machine serves.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``; a temporary one in local mode, an error on a cluster, if it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
        folder = getattr(shared_folder, "_local", None) or "file://" + tempfile.mkdtemp(prefix="logloom-")
        shared_folder._local = folder
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; removed by :func:`clean`, or when the session's process ends."""
    path = f"{shared_folder(spark)}/logloom/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns it read back (a cut lineage that outlives executors)."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's FileSystem and Path for ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as executors that know nothing of the session's default file system need it."""
    fs, p = filesystem(spark, path)
    return fs.makeQualified(p).toString()


def arrow_filesystem(uri: str):
    """(Arrow's file system, the path in it) for a qualified path; for use in tasks."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def clean() -> None:
    """Removes every intermediate table made so far; results that still read them must have been written."""
    while _made:
        spark, path = _made.pop()
        try:
            remove(spark, path)
        except Exception:  # the session is gone; its folder is the cluster's to clean
            pass


atexit.register(clean)


# ------------------------------------------------------------------------------------ published versions


def latest_version(spark: SparkSession, folder: str) -> dict | None:
    """What was published last in ``folder``, or None."""
    fs, p = filesystem(spark, f"{folder}/versions")
    if not fs.exists(p):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    names = [n for n in names if n.endswith(".json") and not n.startswith(".")]
    if not names:
        return None
    stream = fs.open(filesystem(spark, f"{folder}/versions/{names[-1]}")[1])
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish_version(spark: SparkSession, folder: str, content: dict) -> None:
    """Publishes ``content`` under its ``version``, whole or not at all. A version that another writer took meanwhile is an error.

    The text is written aside and renamed to a name that must not exist yet, so there is nothing to overwrite,
    and of two writers one fails.
    """
    name = f"{content['version']:010d}.json"
    fs, temporary = filesystem(spark, f"{folder}/versions/.{name}-{uuid.uuid4().hex[:8]}")
    stream = fs.create(temporary, True)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(temporary), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{folder}/versions/{name}")), options)


def forget_versions(spark: SparkSession, folder: str, before: int) -> None:
    """Removes the published texts older than version ``before``; what they name is the caller's to remove."""
    fs, p = filesystem(spark, f"{folder}/versions")
    for s in fs.listStatus(p):
        digits = s.getPath().getName().split(".json")[0]
        if digits.isdigit() and int(digits) < before:
            fs.delete(s.getPath(), False)
