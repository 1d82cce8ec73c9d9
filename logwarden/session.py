"""Session settings and the shared work folder."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the expressions here profit from.

    The rule CASEs are long. Fused into one generated method they pass the
    JVM's 8000-byte limit for compiling a method and would run interpreted; the
    limit below makes Spark fall back to its split projections for such stages
    (measured: about twice the lines per second).
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables and stream checkpoints.

    Lies in the folder that ``spark.checkpoint.dir`` names, which every executor
    can reach. Without that setting only a local session gets a temporary one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.mkdtemp(prefix='run-', dir='/tmp')}/{name}"


#: Lists of written paths that are being gathered, innermost last; each thread or task has its own.
_GATHERING: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("gathering", default=())


@contextlib.contextmanager
def gathered() -> Iterator[list[str]]:
    """The paths of all tables that are stored inside the block, for ``release``."""
    paths: list[str] = []
    token = _GATHERING.set((*_GATHERING.get(), paths))
    try:
        yield paths
    finally:
        _GATHERING.reset(token)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the work folder and read it back: a cut in the lineage that survives lost executors.

    The table stays until ``release`` removes it or the folder is cleaned.
    """
    path = work_folder(df.sparkSession, name)
    for paths in _GATHERING.get():
        paths.append(path)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Removes the tables at ``paths``; no result may still read them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = hadoop.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)
