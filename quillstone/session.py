"""Session helpers: building a session, and tables written to the folder all executors share."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "quillstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, Arrow); any conf can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k: str(v) for k, v in conf.items()}
    spark = builder.config(map=settings).getOrCreate()
    if not is_local(spark):
        ship_package(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether all executors are threads of this machine's one JVM."""
    return spark.sparkContext.master.split("[")[0] == "local"


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, whose Python needs it, where it isn't installed on them."""
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="quillstone-package-"), "quillstone.zip")
    with open(path, "wb") as f:  # read by this driver only, which serves it to the executors
        f.write(packed.getvalue())
    spark.sparkContext.addPyFile(path)


def arrow_filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path for a URI of the shared folder, or for a path of this machine. Hadoop's name for
    object stores that Arrow calls ``s3`` is ``s3a``."""
    if uri.startswith("file:/"):
        uri = "file:///" + uri[5:].lstrip("/")
    elif "://" not in uri:
        uri = "file://" + os.path.abspath(uri)
    return pafs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a://") else uri)


@contextmanager
def text_output(path: str) -> Iterator[Callable[[str], object]]:
    """Writes one text file, UTF-8, at a path of the driver's machine or a URI: yields what takes the next piece."""
    if "://" in path or path.startswith("file:"):
        fs, at = arrow_filesystem(path)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(at) as out:
            yield lambda piece: out.write(piece.encode())
    else:
        with open(path, "w", encoding="utf-8", newline="") as f:
            yield f.write


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read.

    It is what ``spark.checkpoint.dir`` names. Where that is unset, a session on one machine gets a temporary folder,
    kept for the session; on a cluster there would be no folder that all executors see, so a RuntimeError is raised.
    """
    named = spark.sparkContext.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        if not is_local(spark):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set(CHECKPOINT_CONF, named)
    if ":/" not in named:  # a path of the default file system: Arrow has to know which one that is
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
        named = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if named.startswith("file:/"):
        named = "file:///" + named[5:].lstrip("/")
    return named.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quillstone/{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        if path.startswith("file://") and not os.path.exists(path[7:]):
            return
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended already
        pass


def release(spark: SparkSession, df_path: str) -> None:
    """Deletes a table that ``materialize`` wrote, once nothing reads it any more."""
    _delete(spark, df_path)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    This cuts the lineage in a way that outlives a lost executor, unlike a local checkpoint, and keeps
    loops' plans short.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillstone_path = path
    return out
