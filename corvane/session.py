"""Session settings and shared storage for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_FOLDERS: dict[str, str] = {}


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "corvane", checkpoint_dir: str | None = None) -> SparkSession:
    """A local session with adaptive execution, used by tests and the benchmark.

    Intermediate tables go below ``checkpoint_dir`` if it is given, else below what the installation sets as
    ``spark.checkpoint.dir``; see :func:`shared_dir` for where neither is.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoint_dir is not None:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application for intermediate tables, below ``spark.checkpoint.dir``; it goes when the application ends.

    Where the setting is absent, a local session uses a temporary folder and any other the warehouse, which its executors share.
    """
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            local = context.master.startswith("local[") or context.master == "local"
            named = f"file://{tempfile.gettempdir()}/corvane-shared" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_corvane"
        folder = f"{named.rstrip('/')}/{context.applicationId}-{uuid.uuid4().hex[:8]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[context.applicationId] = folder
    return _FOLDERS[context.applicationId]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The table survives the loss of any executor. Nothing is kept in memory; the table goes with its application, or by :func:`drop`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[out] = path
    return out


_TABLES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def drop(df: DataFrame) -> None:
    """Remove a table of :func:`materialize` that no later step reads."""
    path = _TABLES.pop(df, None)
    if path is not None:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def together(*steps: Callable[[], object]) -> list:
    """The results of steps that do not need each other; their jobs run side by side and fill the cores that each leaves idle."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [x.result() for x in [pool.submit(step) for step in steps]]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="corvane-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / f"corvane-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Repartition a scan of few splits so that every core gets work; larger scans stay as they are.

    The number of splits is a property of the plan, so no job runs here.
    """
    want = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
