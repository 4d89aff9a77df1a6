"""Where intermediate tables live.

Everything that has to outlive a stage goes below the folder the session names in
``spark.checkpoint.dir``, which every executor of a cluster can reach. Only when
that setting is absent (tests, notebooks) is a local folder chosen.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, set up as its checkpoint folder if none is."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="gridloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}"


#: Rows of a partition of a table whose size is known beforehand, about; the least partitions of one.
PART_ROWS, LEAST_PARTS = 50_000, 8


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    The result has no lineage but its files, so it is read again, not computed again,
    after an executor is lost. ``discard`` removes it. ``rows``, about, merges what would be many
    small partitions and files; large tables keep theirs.
    """
    if rows is not None:
        df = df.coalesce(max(LEAST_PARTS, rows // PART_ROWS))
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing will read again; other frames are left alone."""
    for table in tables:
        if path := table.__dict__.pop("_scratch_path", None):
            where = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where it lies, besides what they find themselves.

    Enough on one machine; on a cluster the package is installed or sent with --py-files.
    """
    here = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, here])
    return spark
