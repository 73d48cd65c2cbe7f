"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows without a doc_id sort after all others.
NO_ID = 9223372036854775807
NODE_IDS = 1 << 62
#: Tables of a few numbers a row are broadcast up to this many rows; beyond it they are joined.
BROADCAST_ROWS = 1_000_000

_own: dict[str, str] = {}

def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if all runs in one process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-quire-")
    return _own[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; this cuts its lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(rows: DataFrame) -> DataFrame:
    """``rows`` (of a few numbers each), marked for broadcast only if they are few: they are counted."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def row_id(name: str = "doc_id") -> Column:
    """The id as a sort key that is never null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def node_id(name: str = "doc_id", text: str = "text") -> Column:
    """The id, or for rows without one a number above ``NODE_IDS`` made from the text."""
    made = F.lit(NODE_IDS) + F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit(NODE_IDS - 1))
    return F.coalesce(F.col(name).cast("long"), made)


def public_id(name: str) -> Column:
    """The doc_id of a node, null where it had none."""
    return F.when(F.col(name) < NODE_IDS, F.col(name))


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no frame has such a column in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
