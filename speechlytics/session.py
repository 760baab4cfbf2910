"""Session factory and the few session-level helpers that every operator shares."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "speechlytics", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the library expects of any session.

    On a cluster, pass your own session to the operators instead: they only rely on UTC and AQE, and read
    the shared folder from ``spark.checkpoint.dir``.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPEECHLYTICS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent and the master is local (tests, a laptop) a temporary folder is made and set;
    elsewhere executors and driver would write to different disks, so it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="speechlytics-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_open_scopes: list[list[Written]] = []


@contextmanager
def written_scope() -> Iterator[None]:
    """Drops, at its end, what was written to the shared folder within it. For callers who have stored or collected their
    results by then; results read lazily afterwards would find nothing."""
    mine: list[Written] = []
    _open_scopes.append(mine)
    try:
        yield
    finally:
        _open_scopes.remove(mine)
        for w in mine:
            w.drop()


class Written:
    """A table written to the shared folder: cuts the lineage and survives the loss of executors."""

    def __init__(self, df: DataFrame, name: str, partition_by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/speechlytics/{name}-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path)
        self.schema = df.schema
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if _open_scopes:
            _open_scopes[-1].append(self)
        # Results are read lazily, so what is not dropped before goes with its scope, or when the driver ends.
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(target)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a Spark context, by way of the shared folder."""
    context = spark.sparkContext
    if getattr(context, "_speechlytics_shipped", False):
        return
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(str(p.relative_to(root.parent)), p.read_text())
    path = f"{shared_dir(spark)}/speechlytics/code-{uuid.uuid4().hex}/speechlytics.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(data.getvalue()))
    stream.close()
    context.addPyFile(path)
    context._speechlytics_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df`` (compared as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = f"__{name}"
        while candidate.lower() in taken:
            candidate = "_" + candidate
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def clean_key(column: Column | str) -> Column:
    """The key rule: letter case and outer blanks and tabs carry no meaning. NULL stays NULL."""
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(F.btrim(column, F.lit(" \t")))


def clean_key_or(column: Column | str, default: str) -> Column:
    """The key rule, with NULL and empty read as ``default``."""
    cleaned = clean_key(column)
    return F.when(cleaned.isNull() | (cleaned == ""), F.lit(default)).otherwise(cleaned)
