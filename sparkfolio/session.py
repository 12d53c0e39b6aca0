"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "sparkfolio", **conf: str) -> SparkSession:
    """A session with UTC dates, ANSI arithmetic and adaptive execution.

    ``master`` is only for local use; on a cluster the launcher decides it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per application to the shared folder and read from there.

    Tables that many operators share are computed once, later filters and column choices reach the
    Parquet scan, and a lost executor costs only a re-read.
    """
    key = (spark.sparkContext.applicationId, source, name)
    if key in _STORED:
        try:
            return spark.read.parquet(_STORED[key])
        except AnalysisException:  # the folder was cleared in between
            pass
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    build().write.parquet(path)
    _STORED[key] = path
    return spark.read.parquet(path)


_WRITTEN: dict[str, list[str]] = {}


def record_written(spark: SparkSession, path: str) -> str:
    """Remember an intermediate table, so that ``clear_written`` can delete it."""
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a new folder beneath the shared folder, and read from there.

    What follows reads columns of a table instead of computing ``df`` again, also after a lost executor.
    """
    spark = df.sparkSession
    path = record_written(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_so_far(spark: SparkSession) -> int:
    """A mark for ``clear_written``: tables recorded up to here stay."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, ()))


def clear_written(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> int:
    """Delete the intermediate tables recorded after the mark ``since``, but for those in ``keep``; returns how many.

    To be called when results that read them have been collected or written.  Tables of ``stored`` stay.
    """
    held = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    fresh, held[since:] = held[since:], [name for name in held[since:] if name in keep]
    for name in fresh:
        if name not in keep:
            path = jvm.org.apache.hadoop.fs.Path(name)
            gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def shared_folder(spark: SparkSession) -> str:
    """Checkpoint folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master, where all
    tasks share one disk, may fall back to a fresh temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()
