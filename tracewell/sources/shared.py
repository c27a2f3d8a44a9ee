"""Places for tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a local master without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "local" not in _own:
        _own["local"] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _own["local"], ignore_errors=True)
    return "file://" + _own["local"]


def new_path(spark: SparkSession, name: str) -> str:
    """A place that nothing is at; ``release`` removes what has been written there."""
    _made.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession, keep: int = 0) -> int:
    """Removes what this process has written to the shared folder, but for the last ``keep`` places; returns how many went.

    To be called between jobs whose results have been stored: a DataFrame that still reads such a place can't be computed
    any more.  Works on any store that Spark can write to.
    """
    gone = _made[: len(_made) - keep]
    del _made[: len(gone)]
    for place in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of ``df`` with a table in the shared folder, which outlives executors and takes none of their memory."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
