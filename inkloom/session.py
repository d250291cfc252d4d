"""Session building and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# Plan-wide settings a standalone run wants.  On a cluster the submitter's own settings stand.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the engine's defaults."""
    builder = SparkSession.builder.master(master).appName("inkloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package known to the Python workers, wherever they run; once a session."""
    context = spark.sparkContext
    if getattr(context, "_inkloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="inkloom-code-")) / "inkloom.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._inkloom_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; a local session without that setting gets one of its own.

    On a cluster a folder of one machine would hold only what its own executors wrote, so the setting is needed there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="inkloom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and go on from there.

    The copy survives the loss of any executor, which a locally kept one does not.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write a frame as a compressed table in the shared checkpoint folder and read it back; smaller than ``cut``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    context = spark.sparkContext
    context._inkloom_tables = [*getattr(context, "_inkloom_tables", []), path]
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables that ``store`` wrote in this session, once no frame that reads them is needed; their number."""
    context = spark.sparkContext
    paths, context._inkloom_tables = getattr(context, "_inkloom_tables", []), []
    for path in paths:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None if nothing was written there yet; a table that can't be read is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the driver tables: ``<folder>/<name>.parquet``, a file or a folder of parts."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
