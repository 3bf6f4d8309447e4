"""Sessions, and the package on the executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: The folder of each application's saved tables.
_FOLDERS: dict[str, str] = {}


def session(name: str = "loamspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; a local one unless a master is given or set."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.master(master or os.environ.get("SPARK_MASTER", "local[*]"))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once in an application; Python functions in plans import it there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="loamspark-")
    atexit.register(shutil.rmtree, folder, True)
    target = f"{folder}/{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)


def table_folder(spark: SparkSession) -> str:
    """A folder of the application's own for tables that its queries save, below the shared one of ``spark.checkpoint.dir``, removed when the driver ends.

    Where none is set, one process (tests) may use a temporary folder; a cluster is refused.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        shared = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
        if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set, and executors share no other folder")
        _FOLDERS[app] = f"{shared.rstrip('/')}/loamspark-tables-{app}" if shared else f"file://{tempfile.mkdtemp(prefix='loamspark-')}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def saved(rows: DataFrame, name: str = "rows") -> DataFrame:
    """Rows as a table below ``table_folder``: later plans read them instead of making them anew, whose doubles could differ in the last place."""
    path = f"{table_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if the session still lives or the folder is local."""
    if path.startswith("file://"):
        shutil.rmtree(path.removeprefix("file://"), True)
    elif not spark._jsc.sc().isStopped():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(at, True)
