"""The session: a local one for tests and benchmarks, and this package on the executors of any."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, name: str = "stripweave") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {"spark.sql.shuffle.partitions": partitions, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives this package to the session's Python workers, once; the context's own file server hands it out."""
    context = spark.sparkContext
    if getattr(context, "_stripweave_shipped", False):
        return
    home = Path(__file__).resolve().parent
    path = f"{tempfile.mkdtemp(prefix='spark-')}/stripweave.zip"  # stays as long as the context may hand it out
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(home.rglob("*.py")):
            out.write(p, f"stripweave/{p.relative_to(home)}")
    context.addPyFile(path)
    context._stripweave_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """This session's own folder in the one that all executors share: that of spark.checkpoint.dir. Where it is unset, a local session gets one of its own; on a cluster that is an error,
    as a machine's own folder is none that the others see."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = context.getCheckpointDir()
    context._stripweave_run = getattr(context, "_stripweave_run", None) or f"stripweave-{uuid.uuid4().hex}"
    return f"{found.rstrip('/')}/{context._stripweave_run}"


def clear_work(spark: SparkSession) -> None:
    """Removes all work tables that this session has written, and no others. Results that queries have returned are read from them, so
    they must have been written or collected before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def work_dir(spark: SparkSession) -> str:
    """A new name in the folder that all executors share."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` as a Parquet table in the shared folder: what is read more than once is computed once, and a lost executor costs no recomputation.

    Joins with it are sort-merge joins: its files tell nothing of how large its rows are in memory (blank rows take a hundredth there), and would have it broadcast."""
    path = work_dir(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).hint("merge")
