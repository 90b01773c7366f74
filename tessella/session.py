"""Sessions, table loading and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(cpus: int = 8, partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, use the one at hand."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessella")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TESSELLA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Removes a query's shuffle files as soon as it ends, instead of when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Every executor and the driver must see that folder. Only where the setting is missing and all runs on this
    machine, as in a bare test session, a folder of it stands in; on a cluster that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tessella-shared"
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}" if base.startswith("/") and _is_local(spark) else base
    return f"{base.rstrip('/')}/tessella-{uuid.uuid4().hex}"


def _is_local(spark: SparkSession) -> bool:
    fs = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return fs.startswith("file:")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that clash with none of ``df``, in any case of letters."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    Cuts lineage like ``checkpoint()``, but columnar and compressed; it outlives lost executors. The
    shuffles that led to the table are not needed any more and go at once.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # a plan takes the setting of the moment it is made
        writer = df.select("*").write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` returned; nothing may read them afterwards."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for file in table.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("tessella-"):
                folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
