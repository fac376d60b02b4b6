"""Helpers shared by the operators: tables, checkpoints, null-safe keys."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, with columns pruned by whatever is built on it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    A session on one machine that names none (as in tests) gets a local one; on a cluster that is an error, as a
    folder of one machine would be lost with it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "termloom-checkpoints")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place of this session for files in the shared folder; no two calls share one."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, its lineage cut."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """A scan on as many tasks as shuffles have, where it gives fewer, as of a few small files.

    A large scan has tasks enough and is left as it is, so nothing is shuffled at scale.
    """
    tasks = parallelism(df.sparkSession)
    return df.repartition(tasks) if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= tasks else df


def parallelism(spark: SparkSession) -> int:
    """Number of tasks that the shuffles of this session are set up for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores before it until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def text_or(column: str, default: str = "") -> F.Column:
    """The column with nulls as ``default``."""
    return F.coalesce(F.col(column), F.lit(default))


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors of the session, once per session.

    The package goes out as one archive, named by its contents, so that executors of a cluster need
    no copy of the repository.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for folder, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    entry = zipfile.ZipInfo(os.path.relpath(path, os.path.dirname(root)))
                    with open(path, "rb") as source:
                        archive.writestr(entry, source.read())
    name = f"termloom-{hashlib.sha256(buffer.getvalue()).hexdigest()[:12]}.zip"
    place = os.path.join(tempfile.mkdtemp(prefix="termloom-"), name)
    with open(place, "wb") as out:
        out.write(buffer.getvalue())
    context.addPyFile(place)
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()
