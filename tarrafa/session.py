"""Session helpers: table reading, shared checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest measured size, in bytes, of a table that may be broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one Parquet table of ``sf_dir``, pruned to ``columns`` when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share for checkpoints.

    The session's ``spark.checkpoint.dir`` is used when set; a temporary local folder is made only
    where it is unset and driver and executors are one process, as in tests. A cluster without it is an error:
    executors have no local folder in common.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    sc.setCheckpointDir(checkpoint_path(spark.conf.get("spark.checkpoint.dir", None), sc.master))
    return sc.getCheckpointDir()


def checkpoint_path(configured: str | None, master: str) -> str:
    if configured:
        return configured
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tarrafa-ckpt-")


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` behind a checkpoint, with a broadcast hint if what was written is no larger than ``limit``.

    A checkpoint keeps the estimate of the plan it came from, so its rows are counted and measured instead.
    """
    kept = checkpointed(df)
    return F.broadcast(kept) if measured_bytes(kept) <= limit else kept


def measured_bytes(df: DataFrame) -> int:
    """Size of a written table by its rows: fixed widths, and the lengths of its values as JSON where widths vary."""
    wide = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))]
    fixed = 16 + 8 * (len(df.columns) - len(wide))
    varying = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(wide)])))) if wide else F.lit(0)
    n, bytes_ = df.agg(F.count("*"), varying).first()
    return n * fixed + (bytes_ or 0)


def _at(spark: SparkSession, path: str):
    """The file system of a path, whatever its scheme, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no such folder."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def folder_bytes(spark: SparkSession, path: str) -> int:
    fs, at = _at(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all; an error where it exists already."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    fs, at = _at(spark, part)
    out = fs.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()
    target = _at(spark, path)[1]
    if fs.exists(target) or not fs.rename(at, target):
        fs.delete(at, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: its source goes along with the application, once.

    The archive is served by the driver; executors need no folder in common for it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tarrafa-src-"), "tarrafa.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.join("tarrafa", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
