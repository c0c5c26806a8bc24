"""Session defaults and the one way lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for local runs and tests; a cluster brings its own.
LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session; scripts and tests use it, library code takes the session it is given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessella")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    for key, value in LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session that
    names none gets one of its own, since there every task sees the same disk.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), f"tessella-checkpoints-{os.getpid()}")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for tables that pass between stages; every executor sees it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessella-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut_lineage``, as a compressed table of columns: for wide stages that are read several times, a few columns each time."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that outweighs moving the rows.

    A table of one small file is one task otherwise. Tables in many files or splits are left where they are.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= wanted else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of every executor, once per context.

    Workers import functions by name, and an executor needn't have the package installed. The archive lies beside the
    checkpoints where that folder is a path that this machine sees; executors get it from the driver in any case.
    """
    context = spark.sparkContext
    if getattr(context, "_tessella_shipped", False):
        return
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    folder = Path(shared) if shared.startswith("/") and "://" not in shared else Path(tempfile.mkdtemp(prefix="tessella-"))
    folder.mkdir(parents=True, exist_ok=True)
    archive = folder / f"tessella-{context.applicationId}.zip"
    package = Path(__file__).resolve().parent
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as made:
        for source in sorted(package.rglob("*.py")):
            made.write(source, Path(package.name) / source.relative_to(package))
    context.addPyFile(str(archive))
    context._tessella_shipped = True
