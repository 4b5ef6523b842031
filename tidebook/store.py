"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
#: Settings of the Parquet writer for rows of very many bytes.
WIDE_ROWS = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, a temporary one on a local master
    (tests); on a cluster that is an error, as its machines share no temporary folder."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="spark-tidebook-", dir="/tmp")
    return _local_dir


def few_files(df: DataFrame) -> DataFrame:
    """df in partitions of about spark.sql.adaptive.advisoryPartitionSizeInBytes: for narrow results of many
    tasks, which would be written as thousands of crumbs. Their number follows from the size of the data."""
    return df.hint("rebalance")


def is_scan(df: DataFrame) -> bool:
    """Whether df is no more than columns, filters and exploded columns of a table read from files."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter", "Generate"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def once(df: DataFrame, name: str) -> DataFrame:
    """df for plans that read it several times: itself if it is a scan, else stored."""
    return df if is_scan(df) else stored(df, name, narrow=False)


def stored(df: DataFrame, name: str, narrow: bool = True, wide_rows: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, and later plans
    start from a plain scan whose size the optimizer knows. The tables stay there until whoever runs the
    job clears the folder, as with checkpoints.

    Narrow tables are written in few_files; work over whole texts keeps a task per input split: False.
    wide_rows is for rows of very many bytes, whose size the writer would look at only after a hundred: it looks
    after each, and row groups are small, so that neither writers nor readers hold many rows at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df = few_files(df) if narrow else df
    df.write.options(compression="zstd", **(WIDE_ROWS if wide_rows else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
