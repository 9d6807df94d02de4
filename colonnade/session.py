"""What a Spark session needs before the engine's Python functions run on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to all executors, once for each Spark application.

    Executors fetch it from the driver, so neither a shared folder nor an
    installed copy is needed; a copy on their own path takes precedence.
    """
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:  # the default: too many whole texts
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if getattr(sc, "_colonnade_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="colonnade-")) / "colonnade.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("colonnade") / p.relative_to(root))
    sc.addPyFile(str(at))
    sc._colonnade_shipped = True


def materialized(df: DataFrame) -> DataFrame:
    """df, computed once and written to the folder in spark.checkpoint.dir, so that every later read sees the same rows.

    The folder is shared by all machines; a temporary one is set only where none is.
    """
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="colonnade-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or a temporary one where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at:
        return at
    if not known.isDefined():
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="colonnade-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get()
