"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

_LOCAL_WORK: list[str] = []


def build_session(app: str = "tallyweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; `conf` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Time buckets and instants are defined in UTC, whatever zone the session started with."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared folder (`spark.checkpoint.dir`).

    Only a local session without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        if not _LOCAL_WORK:
            _LOCAL_WORK.append(tempfile.mkdtemp(prefix="tallyweave-"))
        base = _LOCAL_WORK[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def mounted(spark: SparkSession, path: str) -> str | None:
    """The local name of a path in a shared folder that is mounted; of one in a store: none."""
    if not urlsplit(path).scheme:
        path = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/") + path
    return unquote(urlsplit(path).path) if path.startswith("file:") else None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a lost executor does not replay the whole plan."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_path(df.sparkSession, "cut"))
    return df.checkpoint()
