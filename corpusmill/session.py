"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

WORK_DIR_SETTING = "spark.checkpoint.dir"

_local_work_dirs: dict[str, str] = {}


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusmill")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder, because executors elsewhere could not see it.
    """
    configured = spark.conf.get(WORK_DIR_SETTING, "")
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError(f"set {WORK_DIR_SETTING} to a folder every executor can reach")
    app = spark.conf.get("spark.app.id")
    if app not in _local_work_dirs:
        _local_work_dirs[app] = folder = tempfile.mkdtemp(prefix="corpusmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _local_work_dirs[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the work folder that no other call gets."""
    return f"{work_dir(spark)}/corpusmill-{uuid.uuid4().hex}/{label}"


def materialize(df: DataFrame, label: str, **options: object) -> DataFrame:
    """Write ``df`` once, with the Parquet options given, and read it back: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
