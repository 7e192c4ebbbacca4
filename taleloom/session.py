"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application (as `--py-files` would)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="taleloom-")) / "taleloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def get_session(master: str | None = None, **settings: object) -> SparkSession:
    """A session with the settings that results depend on; sizes are left to the cluster unless they are given as keywords, with two underscores for a dot."""
    builder = SparkSession.builder if master is None else SparkSession.builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), str(value))
    return (
        builder.appName("taleloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def _folder_for(master: str, named: str | None, warehouse: str) -> str:
    if named:
        return named
    if master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return warehouse.rstrip("/") + "/_checkpoints"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; if it is unset, as in tests on a local master, one beside the tables of the warehouse.

    A cluster that names none is an error, as the warehouse may be a folder of one machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_folder_for(sc.master, spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir")))
    return sc.getCheckpointDir()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when each of them ends, not when the driver happens to collect its garbage."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the cluster's shared folder, so a lost executor never forces a replay of the whole job."""
    checkpoint_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a query takes the setting from when it is first named


def stored(df: DataFrame) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: a large part of the bytes of a checkpoint, read column by column, and of a known size."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/tables/{uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)
