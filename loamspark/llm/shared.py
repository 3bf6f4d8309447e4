"""Tables in the shared folder, and connected components over tables of links.

Executors can be lost at any time and share no local folder, so every cut of the lineage here is
a Parquet table below the folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of each application's tables.
_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder below the cluster's shared one, removed when the driver's interpreter ends.

    Where no shared folder is set and Spark runs in one process (tests), a temporary one serves; on a cluster that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
        if found:
            _FOLDERS[app] = f"{found.rstrip('/')}/loamspark-{app}"
            atexit.register(_remove, spark, _FOLDERS[app])
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            local = tempfile.mkdtemp(prefix="loamspark-")
            atexit.register(shutil.rmtree, local, True)
            _FOLDERS[app] = f"file://{local}"
        else:
            raise ValueError("spark.checkpoint.dir is not set, and executors share no other folder")
    return _FOLDERS[app]


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if the session still lives."""
    jsc = spark._jsc.sc()
    if not jsc.isStopped():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: later stages start from its files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loam_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files behind ``written()`` when nothing reads them any more."""
    _remove(df.sparkSession, df._loam_path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; a component is named by its smallest node.

    Each round maps every node to the smallest of itself and its neighbours, doubles that pointer
    until it ends at a root, and contracts the edges by it, so half the nodes at least go; the rows are aggregated before each shuffle, so a hub with
    very many neighbours costs no more than its rows. Loops and null ends are ignored. Rounds and
    jumps grow with the logarithm of a component's size. Nothing but row counts reaches the driver.
    """
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    e = written(e, "edges")
    rounds = []
    while not e.isEmpty():
        ends = e.select(F.col("lo").alias("node"), F.col("hi").alias("near")).unionAll(e.select(F.col("hi").alias("node"), F.col("lo").alias("near")))
        p = ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("parent"))
        p = written(p, "parents")
        while True:
            up = p.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped = written(p.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "parents")
            discard(p)
            p = jumped
            if p.where("moved").isEmpty():
                break
        lo = jumped.select(F.col("node").alias("lo"), F.col("parent").alias("x"))
        hi = jumped.select(F.col("node").alias("hi"), F.col("parent").alias("y"))
        nxt = e.join(lo, "lo").join(hi, "hi").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).where("lo < hi").distinct()
        nxt = written(nxt, "edges")
        discard(e)
        e = nxt
        rounds.append(jumped)
    if not rounds:
        return e.select(F.col("lo").alias("node"), F.col("hi").alias("component"))
    out = rounds[0].select("node", F.col("parent").alias("component"))
    for p in rounds[1:]:
        up = p.select(F.col("node").alias("component"), F.col("parent").alias("above"))
        out = out.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
    return out
