"""Session defaults shared by the library, the tests and the benchmark."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks. A cluster brings its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("crawlspan")
    merged = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory} | conf
    for key, value in merged.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once in each session, wherever it was imported from.

    Unless the session says otherwise, it also lowers the size of Arrow batches:
    the operators work through a batch in slices, so larger ones only cost
    memory, twice for each core.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, None) in (None, "67108864b"):
        spark.conf.set(_BATCH, str(8 << 20))
    if getattr(sc, "_crawlspan_shipped", False):
        return spark
    home = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as build:
        shutil.copytree(home, Path(build, home.name), ignore=shutil.ignore_patterns("__pycache__"))
        place = tempfile.mkdtemp(prefix="crawlspan-code-")  # the driver serves it from here
        sc.addPyFile(shutil.make_archive(f"{place}/{home.name}", "zip", build, home.name))
    sc._crawlspan_shipped = True
    return spark


def ship_active() -> None:
    """`ship` for the session that is active here, if any: what makes functions that run on executors calls it."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where a session names none (local runs, tests) a temporary folder is
    made and set as the checkpoint folder; on a cluster that would be an error
    of configuration, so it is refused.
    """
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="crawlspan-", dir=os.environ.get("TMPDIR"))
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def cut_lineage(df):
    """`df` written to the shared folder: later work rereads it and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_to_columns(df):
    """As `cut_lineage`, in compressed columns: for tables of many rows, of which later work reads some columns or rows."""
    at = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
