"""Tables in the shared folder: cuts in a plan that survive lost executors."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.  A folder of our own is made only where the
    setting is absent and the master is local, as in tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="folioforge-")
    return _local_dirs[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folioforge/{name}-{uuid.uuid4().hex}"


def parts_of(df: DataFrame, size: int = 4 << 20) -> int:
    """So many parts that one doesn't grow with ``df``: one for ``size`` bytes of the tables that it reads, as far as Spark
    knows them, and the session's number at least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    parts = sum(x for x in found if x < 1 << 50) // size + 1  # an unknown size is the largest number
    return max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables made by :func:`save` that no later step reads."""
    for df in frames:
        path = getattr(df, "_folio_path", None)
        if path:
            jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def forget_older(spark: SparkSession, days: float) -> list[str]:
    """Delete tables of earlier sessions in the shared folder, last written ``days`` ago or more; their names.

    Results read some tables lazily: ``days`` has to exceed the longest run."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/folioforge")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    old = [s.getPath() for s in fs.listStatus(root) if s.getModificationTime() <= (time.time() - days * 86400) * 1000]
    for p in old:
        fs.delete(p, True)
    return sorted(p.getName() for p in old)
